"""The evidence-graph schema read from the star-schema tables.

Entities are nations of customers, families are regions, annotations are parts that came back in large quantities,
genes are suppliers, pathways are brand and type of a part, and the ontology is part → brand, type → ALL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import table

CROSS = "cross"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines of large quantity with nation and part; filters reach the scan."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("entity"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return li.join(orders, "l_orderkey").join(customer, "o_custkey").join(part, "l_partkey")


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("entity"), F.col("n_regionkey").cast("string").alias("scope"))


def annotations(li: DataFrame) -> DataFrame:
    return li.select("entity", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("term")).distinct()


def _gene_lines(li: DataFrame) -> DataFrame:
    return li.where("l_quantity >= 50 and l_discount >= 0.09")


def genes(li: DataFrame) -> DataFrame:
    return _gene_lines(li).select("entity", F.col("l_suppkey").alias("gene")).distinct()


def pathways(li: DataFrame) -> DataFrame:
    return _gene_lines(li).select(F.col("l_suppkey").alias("gene"), F.concat_ws("|", "p_brand", "p_type").alias("pathway")).distinct()


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    p, b, t = F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.concat(F.lit("B:"), F.col("p_brand")), F.concat(F.lit("T:"), F.col("p_type"))
    up = part.select(p.alias("child"), F.explode(F.array(b, t)).alias("parent"))
    return up.unionAll(part.select(F.explode(F.array(b, t)).alias("child")).distinct().select("child", F.lit("ALL").alias("parent")))


SQL = """
li AS (SELECT l_partkey, l_suppkey, l_quantity, l_discount, CAST(c_nationkey AS BIGINT) AS entity, p_brand, p_type FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity >= 49),
scopes AS (SELECT CAST(n_nationkey AS BIGINT) AS entity, CAST(n_regionkey AS VARCHAR) AS scope FROM nation),
ann AS (SELECT DISTINCT entity, 'P' || l_partkey AS term FROM li),
genes AS (SELECT DISTINCT entity, l_suppkey AS gene FROM li WHERE l_quantity >= 50 AND l_discount >= 0.09),
pw AS (SELECT DISTINCT l_suppkey AS gene, p_brand || '|' || p_type AS pathway FROM li WHERE l_quantity >= 50 AND l_discount >= 0.09),
ont AS (SELECT 'P' || p_partkey AS child, 'B:' || p_brand AS parent FROM part UNION SELECT 'P' || p_partkey, 'T:' || p_type FROM part
  UNION SELECT 'B:' || p_brand, 'ALL' FROM part UNION SELECT 'T:' || p_type, 'ALL' FROM part),
nodes0 AS (SELECT child AS n FROM ont UNION SELECT parent FROM ont),
clo AS (WITH RECURSIVE c(node, ancestor) AS (SELECT n, n FROM nodes0 UNION SELECT c.node, ont.parent FROM c JOIN ont ON c.ancestor = ont.child) SELECT node, ancestor FROM c),
prop AS (SELECT DISTINCT entity, ancestor AS term FROM ann JOIN clo ON node = term),
ic AS (SELECT term, count(*) AS n, -ln(count(*) / (SELECT count(DISTINCT entity) FROM prop)) AS ic FROM prop GROUP BY 1),
gs AS (SELECT DISTINCT gene, scope FROM genes JOIN scopes USING (entity) UNION SELECT DISTINCT gene, 'cross' FROM genes),
gpw AS (SELECT DISTINCT gs.scope, gs.gene, pathway FROM gs JOIN pw USING (gene)),
tot AS (SELECT scope, count(DISTINCT gene) AS total FROM gpw GROUP BY 1),
rar AS (SELECT scope, pathway AS feature, count(*) AS n, any_value(total) AS total, ln(any_value(total) / count(*)) AS weight, count(*) <= greatest(2.0, any_value(total) / 2) AS specific FROM gpw JOIN tot USING (scope) GROUP BY 1, 2),
ep AS (SELECT DISTINCT entity, pathway AS feature FROM genes JOIN pw USING (gene)),
pairs AS (SELECT a.entity AS a, b.entity AS b, CASE WHEN a.scope = b.scope THEN a.scope ELSE 'cross' END AS scope FROM scopes a JOIN scopes b ON a.entity < b.entity),
sums AS (SELECT entity, sum(coalesce(ic, 0)) AS s FROM prop JOIN ic USING (term) GROUP BY 1),
inter AS (SELECT x.entity AS a, y.entity AS b, sum(ic) AS i FROM prop x JOIN prop y ON x.term = y.term AND x.entity < y.entity JOIN ic ON ic.term = x.term GROUP BY 1, 2),
gic AS (SELECT a, b, scope, coalesce(CASE WHEN sa.s + sb.s - i > 0 THEN i / (sa.s + sb.s - i) END, 0) AS phen FROM pairs LEFT JOIN inter USING (a, b) LEFT JOIN sums sa ON sa.entity = a LEFT JOIN sums sb ON sb.entity = b),
psum AS (SELECT entity, scope, sum(weight) AS s FROM ep JOIN rar USING (feature) GROUP BY 1, 2),
pint AS (SELECT a, b, p.scope, sum(weight) AS i, bool_or(specific) AS spec FROM pairs p JOIN ep x ON x.entity = a JOIN ep y ON y.entity = b AND y.feature = x.feature JOIN rar ON rar.scope = p.scope AND rar.feature = x.feature GROUP BY 1, 2, 3),
wj AS (SELECT a, b, scope, CASE WHEN spec THEN raw ELSE least(raw, 0.05) END AS overlap FROM (SELECT p.*, CASE WHEN x.s + y.s - i > 0 THEN i / (x.s + y.s - i) ELSE 0 END AS raw FROM pint p JOIN psum x ON x.entity = a AND x.scope = p.scope JOIN psum y ON y.entity = b AND y.scope = p.scope)),
shg AS (SELECT DISTINCT x.entity AS a, y.entity AS b FROM genes x JOIN genes y ON x.gene = y.gene AND x.entity < y.entity),
raw AS (SELECT a, b, g.scope, round(phen, 12) AS phen, coalesce(overlap, 0) AS overlap, shg.a IS NOT NULL AS gene, a % 7 = b % 7 AS series, a % 3 = b % 3 AS cls FROM gic g LEFT JOIN wj USING (a, b) LEFT JOIN shg USING (a, b)),
ref AS (SELECT phen FROM raw WHERE scope <> 'cross'),
pct AS (SELECT r.*, CASE WHEN phen <= 0 THEN 0 WHEN scope <> 'cross' THEN (SELECT (count_if(o.phen < r.phen) + 0.5 * count_if(o.phen = r.phen)) / count(*) FROM raw o WHERE o.scope = r.scope)
  ELSE (SELECT (count_if(o.phen < r.phen) + 0.5 * count_if(o.phen = r.phen)) / count(*) FROM ref o) END AS pct FROM raw r),
mech AS (SELECT *, greatest(overlap, CASE WHEN series THEN 0.6 ELSE 0 END, CASE WHEN cls THEN 0.15 ELSE 0 END) AS mechanism, pct >= 0.75 AND phen > 0 AS high FROM pct),
rel AS (SELECT *, CASE WHEN gene AND high THEN 'same_gene_similar_presentation' WHEN gene THEN 'same_gene_different_presentation' WHEN mechanism >= 0.25 AND high THEN 'mechanism_and_phenotype_neighbor'
  WHEN mechanism >= 0.25 THEN 'mechanism_neighbor_different_presentation' WHEN mechanism < 0.1 AND high THEN 'phenotype_lookalike_different_mechanism' WHEN high THEN 'phenotype_neighbor_weak_mechanism' ELSE 'not_linked' END AS relation,
  greatest(mechanism, CASE WHEN gene THEN 1 ELSE 0 END) AS mech_w FROM mech),
full_rel AS (SELECT *, 0.5 * mech_w + 0.5 * pct AS combined, NOT gene AND NOT series AND overlap < 0.1 AS class_only FROM rel)"""
