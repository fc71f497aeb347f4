"""Ontology and pair-similarity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import community, ontology, ranking, similarity
from weftgraph.plans import analogue
from weftgraph.plans.analogue import CROSS
from weftgraph.session import cut, table

R = 6


def _r(c: str, out: str | None = None):
    return F.round(F.col(c), R).alias(out or c)


def ontology_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.closure(analogue.ontology(spark, sf_dir))


def proper_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = ontology.closure(analogue.ontology(spark, sf_dir), reflexive=False)
    return closed.groupBy("node").agg(F.count("*").alias("ancestors"))


def _annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = cut(analogue.lines(spark, sf_dir))
    closed = ontology.closure(analogue.ontology(spark, sf_dir))
    return li, closed, cut(ontology.propagate(analogue.annotations(li), closed))


def information_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = ontology.information_content(_annotated(spark, sf_dir)[2])
    return ic.select("term", "n", _r("ic"))


def branch_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left and dropped per nation when the parts of one brand are excluded."""
    li = analogue.lines(spark, sf_dir).select("entity", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("term"))
    closed = ontology.closure(analogue.ontology(spark, sf_dir))
    li = cut(li)
    kept = ontology.exclude_branch(li, closed, ["B:Brand#13"]).groupBy("entity").agg(F.count("*").alias("kept"))
    return li.groupBy("entity").agg(F.count("*").alias("rows")).join(kept, "entity", "left").select("entity", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("rows") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def most_specific_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most specific common terms of each pair of nations, as text."""
    _, closed, prop = _annotated(spark, sf_dir)
    # a term that every entity has tells nothing: it would form all pairs
    ic = ontology.information_content(prop).where("ic > 0").select("term")
    shared = similarity.common_features(prop.join(ic, "term", "left_semi").select("entity", F.col("term").alias("feature"))).withColumnRenamed("feature", "term")
    leaves = ontology.most_specific(cut(shared), closed, ["a", "b"])
    return leaves.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("term")), ";").alias("terms"))


def first_leaves(spark: SparkSession, sf_dir: str, least: float = 2.0, most: int = 6) -> DataFrame:
    """``a, b, terms``: the first most specific common terms by information content, then name."""
    _, closed, prop = _annotated(spark, sf_dir)
    ic = cut(ontology.information_content(prop))
    shared = similarity.common_features(prop.join(ic.where("ic > 0").select("term"), "term", "left_semi").select("entity", F.col("term").alias("feature"))).withColumnRenamed("feature", "term")
    leaves = ontology.most_specific(cut(shared), closed, ["a", "b"]).join(ic.select("term", "ic"), "term").where(F.col("ic") >= least)
    return similarity.shared_lists(leaves, "term", "ic", most).withColumnRenamed("list", "terms")


def shared_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``a, b, pathways``: common pathways by their weight in the pair's scope, then name."""
    li, scopes = cut(analogue.lines(spark, sf_dir)), analogue.scopes(spark, sf_dir)
    features = analogue.genes(li).join(analogue.pathways(li), "gene").select("entity", F.col("pathway").alias("feature")).distinct()
    rows = similarity.in_scope(similarity.common_features(features), scopes, CROSS).join(_weights(li, scopes).select("scope", "feature", "weight"), ["scope", "feature"])
    return similarity.shared_lists(rows, "feature", "weight").withColumnRenamed("list", "pathways")


def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation's key replaced where an alias table says so."""
    aliases = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("bigint").alias("alias"), (F.col("n_nationkey") + 1).cast("bigint").alias("current"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"))
    return ontology.resolve_aliases(rows, "nation", aliases).select("c_custkey", "nation")


def _weights(li: DataFrame, scopes: DataFrame) -> DataFrame:
    genes = analogue.genes(li)
    gene_scope = genes.join(scopes, "entity").select(F.col("gene").alias("item"), "scope").unionByName(genes.select(F.col("gene").alias("item"), F.lit(CROSS).alias("scope")))
    return similarity.rarity(analogue.pathways(li).select(F.col("gene").alias("item"), F.col("pathway").alias("feature")), gene_scope)


def pathway_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = cut(analogue.lines(spark, sf_dir))
    return _weights(li, analogue.scopes(spark, sf_dir)).select("scope", "feature", "n", "total", _r("weight"), "specific")


def simgic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, prop = _annotated(spark, sf_dir)
    return similarity.simgic(prop, ontology.information_content(prop)).where("score > 0").select("a", "b", _r("score"))


def _overlap(li: DataFrame, scopes: DataFrame) -> DataFrame:
    features = analogue.genes(li).join(analogue.pathways(li), "gene").select("entity", F.col("pathway").alias("feature")).distinct()
    return similarity.weighted_jaccard(cut(features), scopes, cut(_weights(li, scopes)), CROSS)


def weighted_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = cut(analogue.lines(spark, sf_dir))
    return _overlap(li, analogue.scopes(spark, sf_dir)).select("a", "b", "scope", _r("overlap"))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, _, prop = _annotated(spark, sf_dir)
    scopes = cut(analogue.scopes(spark, sf_dir))
    genes = analogue.genes(li)
    shared = similarity.common_features(genes.select("entity", F.col("gene").alias("feature"))).select("a", "b").distinct()
    # a stands for any parent that groups entities: seven series and three broad classes
    series, classes = (scopes.select("entity", (F.col("entity") % n).alias("feature")) for n in (7, 3))
    phenotype = cut(similarity.simgic(prop, cut(ontology.information_content(prop))))
    return cut(similarity.relate(scopes, phenotype, cut(_overlap(li, scopes)), cut(shared), series, classes, CROSS))


def relation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every pair that shares anything, with its scores, class and edge weights."""
    out = _relations(spark, sf_dir)
    return out.select("a", "b", "scope", _r("phen"), _r("overlap"), "shares_gene", _r("mechanism"), _r("pct"), "relation", _r("combined"), _r("edge_mechanism"), _r("edge_phenotype"), _r("edge_combined"))


def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each class, those that share nothing counted by arithmetic, empty classes kept."""
    pairs = _relations(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(c,) for c in similarity.CLASSES], "relation string")
    whole = similarity.scope_sizes(analogue.scopes(spark, sf_dir), CROSS).agg(F.sum("pairs").alias("whole"))
    listed = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("listed"))
    out = names.join(pairs, "relation", "left").join(F.broadcast(whole.join(listed)))
    rest = F.when(F.col("relation") == "not_linked", F.col("whole") - F.col("listed")).otherwise(0)
    return out.select("relation", (F.coalesce("n", F.lit(0)) + rest).cast("bigint").alias("pairs"))


def pair_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations of one region by an equi-join, looked up whichever way round they are named."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name", F.col("n_regionkey").cast("bigint").alias("scope"))
    a, b = n.toDF("a", "name_a", "scope"), n.toDF("b", "name_b", "scope")
    pairs = a.join(b, "scope").where("a < b")
    asked = n.select((F.col("k") + 5).alias("x"), F.col("k").alias("y"))
    return pairs.join(asked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(True).alias("asked")), ["a", "b"], "left").select("a", "b", "scope", "name_a", "name_b", F.coalesce("asked", F.lit(False)).alias("asked"))


def midrank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 0).alias("balance"))
    return ranking.midrank(c, "balance", ["c_mktsegment"]).select("c_custkey", "c_mktsegment", _r("pct"))


def midrank_vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers ranked among customers of their nation by balance."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("nation"), F.round("s_acctbal", 0).alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("nation"), F.round("c_acctbal", 0).alias("balance"))
    return ranking.midrank_against(s, c, "balance", ["nation"]).select("s_suppkey", "nation", _r("pct"))


def nearest_rank_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    return ranking.nearest_rank(c, "c_acctbal", ["c_mktsegment"]).select("c_mktsegment", _r("cutoff"), "n")


def top_terms_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight terms of most information of each nation."""
    _, _, prop = _annotated(spark, sf_dir)
    ic = ontology.information_content(prop).withColumn("ic", F.round("ic", R))
    return ranking.top_per(prop.join(ic, "term"), ["entity"], [F.desc("ic"), F.asc("term")], 8).select("entity", "term", "ic", "rank")


def global_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty most informative terms that two or more nations have."""
    _, _, prop = _annotated(spark, sf_dir)
    ic = ontology.information_content(prop).where("n >= 2").withColumn("ic", F.round("ic", R))
    return ic.orderBy(F.desc("ic"), "term").limit(40).select("term", "n", "ic")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).select("a", "b", F.col("edge_combined").alias("weight")).where("weight > 0")


def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.louvain(analogue.scopes(spark, sf_dir).select("entity"), _edges(spark, sf_dir))


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of the combined graph with regions as communities."""
    return community.modularity(_edges(spark, sf_dir), analogue.scopes(spark, sf_dir)).select(_r("q"))


def cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers grouped by nation and market segment, by how many priorities their orders have."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("o_orderkey").alias("node"), F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("community"), "o_orderpriority")
    return community.mixed_communities(rows.select("node", "community").distinct(), rows.select("node", F.col("o_orderpriority").alias("family")).distinct())


QUERIES = {
    f.__name__: f
    for f in (
        relation_classes, relation_counts, ontology_closure, proper_ancestors, information_content, branch_exclusion, most_specific_shared, alias_resolution, pathway_rarity, simgic_pairs,
        weighted_jaccard_pairs, pair_self_join, midrank_percentile, midrank_vs_reference, nearest_rank_cutoff, top_terms_per_entity, global_bridges, louvain_communities, modularity, cluster_purity,
    )
}
_S = "WITH " + analogue.SQL
_SHARES = "(phen > 0 OR overlap > 0 OR gene OR series)"
ORACLE = {
    "relation_classes": f"""{_S} SELECT a, b, scope, round(phen, 6) AS phen, round(overlap, 6) AS overlap, gene AS shares_gene, round(CAST(mechanism AS DOUBLE), 6) AS mechanism, round(pct, 6) AS pct, relation, round(combined, 6) AS combined,
      round(CAST(CASE WHEN mech_w >= 0.25 THEN mech_w END AS DOUBLE), 6) AS edge_mechanism, round(CASE WHEN high THEN phen END, 6) AS edge_phenotype,
      round(CASE WHEN relation NOT IN ('not_linked', 'phenotype_lookalike_different_mechanism') AND NOT class_only THEN combined END, 6) AS edge_combined FROM full_rel WHERE {_SHARES}""",
    "relation_counts": f"""{_S} SELECT c.relation, count(r.a) AS pairs FROM (VALUES {", ".join(f"('{c}')" for c in similarity.CLASSES)}) c(relation) LEFT JOIN full_rel r ON r.relation = c.relation GROUP BY 1""",
    "ontology_closure": f"{_S} SELECT node, ancestor FROM clo",
    "proper_ancestors": f"{_S} SELECT node, count(*) AS ancestors FROM clo WHERE node <> ancestor GROUP BY 1",
    "information_content": f"{_S} SELECT term, n, round(ic, 6) AS ic FROM ic",
    "branch_exclusion": f"{_S} SELECT entity, count_if(x.node IS NULL) AS kept, count_if(x.node IS NOT NULL) AS dropped FROM li LEFT JOIN (SELECT node FROM clo WHERE ancestor = 'B:Brand#13') x ON x.node = 'P' || l_partkey GROUP BY 1",
    "most_specific_shared": f"""{_S}, sh AS (SELECT x.entity AS a, y.entity AS b, x.term FROM prop x JOIN prop y ON x.term = y.term AND x.entity < y.entity WHERE x.term IN (SELECT term FROM ic WHERE ic > 0)),
      cov AS (SELECT DISTINCT a, b, ancestor AS term FROM sh JOIN clo ON node = term WHERE node <> ancestor)
      SELECT a, b, string_agg(term, ';' ORDER BY term) AS terms FROM sh ANTI JOIN cov USING (a, b, term) GROUP BY 1, 2""",
    "alias_resolution": "SELECT c_custkey, CAST(CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0) THEN c_nationkey + 1 ELSE c_nationkey END AS BIGINT) AS nation FROM customer",
    "pathway_rarity": f"{_S} SELECT scope, feature, n, total, round(weight, 6) AS weight, specific FROM rar",
    "simgic_pairs": f"{_S} SELECT a, b, round(phen, 6) AS score FROM gic WHERE phen > 0",
    "weighted_jaccard_pairs": f"{_S} SELECT a, b, scope, round(CAST(overlap AS DOUBLE), 6) AS overlap FROM wj",
    "pair_self_join": """SELECT CAST(x.n_nationkey AS BIGINT) AS a, CAST(y.n_nationkey AS BIGINT) AS b, CAST(x.n_regionkey AS BIGINT) AS scope, x.n_name AS name_a, y.n_name AS name_b, y.n_nationkey - x.n_nationkey = 5 AS asked
      FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey""",
    "midrank_percentile": """WITH c AS (SELECT c_custkey, c_mktsegment, round(c_acctbal, 0) AS v FROM customer)
      SELECT c_custkey, c_mktsegment, round((rank() OVER (PARTITION BY c_mktsegment ORDER BY v) - 1 + 0.5 * count(*) OVER (PARTITION BY c_mktsegment, v)) / count(*) OVER (PARTITION BY c_mktsegment), 6) AS pct FROM c""",
    "midrank_vs_reference": """WITH c AS (SELECT c_nationkey AS nation, round(c_acctbal, 0) AS v FROM customer), s AS (SELECT s_suppkey, s_nationkey AS nation, round(s_acctbal, 0) AS v FROM supplier)
      SELECT s_suppkey, CAST(s.nation AS BIGINT) AS nation, round((count_if(c.v < s.v) + 0.5 * count_if(c.v = s.v)) / nullif(count(c.v), 0), 6) AS pct FROM s LEFT JOIN c ON c.nation = s.nation GROUP BY s_suppkey, s.nation, s.v""",
    "nearest_rank_cutoff": """WITH c AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
      SELECT c_mktsegment, round(c_acctbal, 6) AS cutoff, n FROM c WHERE i = least(n - 1, CAST(floor(0.75 * n) AS BIGINT))""",
    "top_terms_per_entity": f"{_S} SELECT * FROM (SELECT entity, term, round(ic, 6) AS ic, row_number() OVER (PARTITION BY entity ORDER BY round(ic, 6) DESC, term) AS rank FROM prop JOIN ic USING (term)) WHERE rank <= 8",
    "global_bridges": f"{_S} SELECT term, n, round(ic, 6) AS ic FROM ic WHERE n >= 2 ORDER BY round(ic, 6) DESC, term LIMIT 40",
    "modularity": f"""{_S}, e AS (SELECT a, b, combined AS w FROM full_rel WHERE relation NOT IN ('not_linked', 'phenotype_lookalike_different_mechanism') AND NOT class_only AND combined > 0),
      p AS (SELECT w, x.scope AS ca, y.scope AS cb FROM e JOIN scopes x ON x.entity = a JOIN scopes y ON y.entity = b), m AS (SELECT sum(w) AS m FROM p),
      k AS (SELECT c, sum(w) AS k FROM (SELECT ca AS c, w FROM p UNION ALL SELECT cb, w FROM p) GROUP BY 1), l AS (SELECT ca AS c, sum(w) AS l FROM p WHERE ca = cb GROUP BY 1)
      SELECT round(coalesce(sum(coalesce(l, 0) / m - pow(k / (2 * m), 2)), 0), 6) AS q FROM k LEFT JOIN l USING (c), m""",
    "cluster_purity": """SELECT c_nationkey || '|' || c_mktsegment AS community, count(*) AS size, count(DISTINCT o_orderpriority) AS families, count(DISTINCT o_orderpriority) > 1 AS mixed, count(*) = 1 AS singleton
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
}
