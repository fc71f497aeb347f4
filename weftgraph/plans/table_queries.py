"""Filters, joins, aggregates, ranks and variant operators over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import align, ranking, superpose, variants
from weftgraph.session import table


def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.lower("l_linestatus") != "o"))
    return li.select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


def conditional_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an association counts: its flag if there is one, else its type."""
    links = table(spark, sf_dir, "cluster_disease_genes").select("row_id", F.coalesce(F.col("used_for_scoring").cast("string"), F.lit("")).alias("flag"), "association_type")
    counts = F.when(F.col("flag") != "", F.lower("flag") == "true").otherwise(F.upper("association_type") == "MENDELIAN")
    return links.select("row_id", counts.alias("counts"))


def ordered_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a study is left out: the first reason that holds; names match if any alternative is part of them."""
    s = table(spark, sf_dir, "studies")
    title = F.lower("official_title")
    named = F.exists(F.split(F.lit("registry|natural history"), r"\|"), lambda x: F.contains(title, x))
    reason = F.when(~named, "name").when(F.upper("overall_status") == "TERMINATED", "status").when(F.col("completion_date").isNull(), "date").otherwise("")
    return s.select("row_id", reason.alias("reason")).distinct()


def inner_join_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers of one segment; the panel side is small or not as its statistics say."""
    panel = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(panel, "o_custkey").select("o_orderkey", "c_name")


def anti_join_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with no urgent order."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def semi_join_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part is of size 50."""
    known = table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(known, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count("*").alias("lines"))


def full_outer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of poor suppliers against nations of rich customers, with what differs."""
    a = table(spark, sf_dir, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").cast("bigint").alias("nation")).agg(F.count("*").alias("suppliers"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").cast("bigint").alias("nation")).agg(F.count("*").alias("customers"))
    state = F.when(F.col("suppliers").isNull(), "new").when(F.col("customers").isNull(), "missing").when(F.col("suppliers") != F.col("customers"), "changed").otherwise("same")
    return a.join(b, "nation", "full").select("nation", "suppliers", "customers", state.alias("state"))


def priority_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation a contact: its customer of most balance if any is rich, else its supplier of least key."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").cast("bigint").alias("nation"), F.lit(0).alias("source"), F.col("c_custkey").alias("contact"))
    other = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("nation"), F.lit(1).alias("source"), F.col("s_suppkey").alias("contact"))
    return rich.unionByName(other).groupBy("nation").agg(F.min(F.struct("source", "contact")).alias("m")).select("nation", F.col("m.source").cast("bigint").alias("source"), F.col("m.contact").alias("contact"))


def theta_shift_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best shift of supplier positions against customer positions of a nation, letters being the last digits of keys."""
    v = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("gene"), F.pmod("s_suppkey", F.lit(200)).alias("position"), (F.col("s_suppkey") % 2).cast("string").alias("ref"))
    r = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("gene"), F.pmod("c_custkey", F.lit(200)).alias("position"), (F.col("c_custkey") % 2).cast("string").alias("residue")).distinct()
    return variants.best_shift(v, r)


def positional_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disease labels whose letter at a given place is the one named in their id."""
    d = table(spark, sf_dir, "cluster_diseases").select("row_id", "label").distinct()
    s = d.select(F.col("row_id").cast("string").alias("gene"), F.col("label").alias("seq"), F.array().cast("array<int>").alias("plddt"), F.lit(1).alias("first_residue"))
    v = d.select(F.col("row_id").cast("string").alias("gene"), (F.col("row_id") % 20 + 1).alias("position"), F.substring(F.lit("aeiou"), (F.col("row_id") % 5 + 1).cast("int"), F.lit(1)).alias("ref"))
    kept, _ = variants.place(v, variants.residues(s), v.select("gene", F.lit(0).alias("shift")).distinct())
    return kept.select("gene", "position", "ref")


def position_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: number of records, distinct flags and distinct words of the states, as text."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("gene"), F.col("l_partkey").alias("position"), F.col("l_returnflag").alias("change"), F.concat_ws("; ", "l_linestatus", "l_returnflag").alias("conditions"))
    return variants.roll_up(li)


def hypergeometric_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rich customers among those of one segment, against all customers of their nation."""
    c = table(spark, sf_dir, "customer")
    rich, seg = F.col("c_acctbal") > 5000, F.col("c_mktsegment") == "BUILDING"
    per = c.groupBy("c_nationkey").agg(F.count_if(seg).alias("n"), F.count_if(seg & rich).alias("hits"), F.count_if(rich).alias("k"), F.count("*").alias("t"))
    e = variants.enrichment(per)
    return e.select("observed", *(F.round(x, 6).alias(x) for x in ("expected", "variance", "ratio", "z")))


def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return ranking.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event, an error if there is any."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", (F.col("event_type") != "error").alias("other"))
    return ranking.first(e, ["user_id"], ["other", "ts", "event_id"]).select("user_id", "event_id", "event_type")


def newest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest structure model of each accession."""
    g = table(spark, sf_dir, "gene_profiles").where("alphafold_model_id is not null").select(F.col("uniprot_accession").alias("accession"), F.col("alphafold_version").cast("string").alias("version"), F.col("retrieved_at").alias("created"), F.col("alphafold_model_id").alias("model_id"), "row_id")
    return ranking.best_model(g).select("accession", "version", "model_id")


def karlin_altschul(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "gene_profiles").select("row_id", F.col("protein_length").cast("double").alias("m"), (F.col("alphafold_mean_plddt") * 2).alias("s")).distinct()
    e = align.expect(F.col("s"), F.col("m"), F.lit(500.0))
    return p.select("row_id", F.round(F.log(e), 6).alias("log_e"), F.round(align.bits(F.col("s")), 6).alias("bits"), (e < align.SIGNIFICANT).alias("significant"))


def smith_waterman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local alignments of all pairs of distinct part names, by both methods."""
    names = table(spark, sf_dir, "part").select(F.regexp_replace(F.upper("p_name"), "[^ARNDCQEGHILKMFPSTWYV]", "").alias("s"), F.col("p_name").alias("id")).distinct()
    a, b = names.toDF("a", "a_id"), names.toDF("b", "b_id")
    pairs = a.join(b, a.a_id < b.b_id)  # a few dozen names at any scale
    return align.align_pairs(pairs.repartition(16)).select("a_id", "b_id", "method", "score", "paired", "identical", "gaps", F.round("identity", 6).alias("identity"), F.round("coverage_a", 6).alias("coverage_a"), F.round("coverage_b", 6).alias("coverage_b"))


def superposition_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit of consecutive embeddings of one label, read as points of three coordinates."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = e.join(nxt, "vec_id").select(F.col("vec_id").alias("pair"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"), "embedding", "other")
    at = lambda c, k: F.get(c, F.col("i") * 3 + k).cast("double")
    points = both.select("pair", *(at("embedding", k).alias(n) for k, n in enumerate(("sx", "sy", "sz"))), *(at("other", k).alias(n) for k, n in enumerate(("tx", "ty", "tz"))))
    return superpose.superpose(points).select("pair", "n", F.round("rmsd", 6).alias("rmsd"))


def structure_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "gene_profiles").select("row_id", (F.col("protein_length") % 60).alias("mapped"), (F.col("protein_length") % 100).cast("double").alias("coverage"), F.col("alphafold_mean_plddt").alias("plddt_a"), (F.col("alphafold_mean_plddt") + 5).alias("plddt_b"), (F.col("protein_length") % 55).alias("confident")).distinct()
    return superpose.gate(p).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_filter_project, conditional_flag, ordered_reasons, inner_join_panel, anti_join_dedupe, semi_join_known, full_outer_compare, priority_resolution, theta_shift_match, positional_placement, position_rollup,
        hypergeometric_enrichment, latest_record, first_record, newest_model, karlin_altschul, smith_waterman, superposition_rmsd, structure_gates,
    )
}
ORACLE = {
    "scan_filter_project": "SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_returnflag = 'R' AND lower(l_linestatus) <> 'o'",
    "conditional_flag": "SELECT row_id, CASE WHEN used_for_scoring IS NOT NULL THEN used_for_scoring ELSE upper(association_type) = 'MENDELIAN' END AS counts FROM cluster_disease_genes",
    "ordered_reasons": """SELECT DISTINCT row_id, CASE WHEN NOT (contains(lower(official_title), 'registry') OR contains(lower(official_title), 'natural history')) THEN 'name' WHEN upper(overall_status) = 'TERMINATED' THEN 'status'
      WHEN completion_date IS NULL THEN 'date' ELSE '' END AS reason FROM studies""",
    "inner_join_panel": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "anti_join_dedupe": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "semi_join_known": "SELECT l_partkey, count(*) AS lines FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 50) GROUP BY 1",
    "full_outer_compare": """WITH a AS (SELECT CAST(s_nationkey AS BIGINT) AS nation, count(*) AS suppliers FROM supplier WHERE s_acctbal < 0 GROUP BY 1), b AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS customers FROM customer WHERE c_acctbal > 9500 GROUP BY 1)
      SELECT nation, suppliers, customers, CASE WHEN suppliers IS NULL THEN 'new' WHEN customers IS NULL THEN 'missing' WHEN suppliers <> customers THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b USING (nation)""",
    "priority_resolution": """WITH x AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, 0 AS source, c_custkey AS contact FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 1, s_suppkey FROM supplier)
      SELECT nation, CAST(source AS BIGINT) AS source, contact FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY source, contact) AS r FROM x) WHERE r = 1""",
    "theta_shift_match": """WITH v AS (SELECT CAST(s_nationkey AS VARCHAR) AS gene, s_suppkey % 200 AS position, CAST(s_suppkey % 2 AS VARCHAR) AS ref FROM supplier),
      r AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS gene, c_custkey % 200 AS position, CAST(c_custkey % 2 AS VARCHAR) AS residue FROM customer),
      t AS (SELECT gene, count(*) AS total FROM v GROUP BY 1), k AS (SELECT unnest(range(-60, 61)) AS shift),
      h AS (SELECT v.gene, shift, count(*) AS hits FROM v, k, r WHERE r.gene = v.gene AND r.position = v.position + shift AND r.residue = v.ref GROUP BY 1, 2),
      b AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY hits DESC, abs(shift), shift) AS rank FROM h)
      SELECT t.gene, CAST(CASE WHEN total >= 10 AND coalesce(p.hits, 0) < 0.5 * total AND b.hits >= 0.9 * total THEN b.shift ELSE 0 END AS BIGINT) AS shift
      FROM t LEFT JOIN b ON b.gene = t.gene AND b.rank = 1 LEFT JOIN h p ON p.gene = t.gene AND p.shift = 0""",
    "positional_placement": "SELECT CAST(row_id AS VARCHAR) AS gene, row_id % 20 + 1 AS position, substr('aeiou', row_id % 5 + 1, 1) AS ref FROM (SELECT DISTINCT row_id, label FROM cluster_diseases) WHERE array_extract(label, row_id % 20 + 1) = substr('aeiou', row_id % 5 + 1, 1)",
    "position_rollup": """WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS gene, l_partkey AS position, l_returnflag AS change, l_linestatus AS c FROM lineitem),
      c AS (SELECT DISTINCT gene, position, unnest([c, change]) AS c FROM x), cc AS (SELECT gene, position, string_agg(c, '; ' ORDER BY c) AS conditions FROM c GROUP BY 1, 2),
      d AS (SELECT gene, position, string_agg(change, ' / ' ORDER BY change) AS changes FROM (SELECT DISTINCT gene, position, change FROM x) GROUP BY 1, 2)
      SELECT gene, position, n, changes, conditions FROM (SELECT gene, position, count(*) AS n FROM x GROUP BY 1, 2) JOIN d USING (gene, position) JOIN cc USING (gene, position)""",
    "hypergeometric_enrichment": """WITH g AS (SELECT c_nationkey, count_if(c_mktsegment = 'BUILDING')::DOUBLE AS n, count_if(c_mktsegment = 'BUILDING' AND c_acctbal > 5000) AS hits, count_if(c_acctbal > 5000)::DOUBLE AS k, count(*)::DOUBLE AS t FROM customer GROUP BY 1),
      s AS (SELECT CAST(sum(hits) AS BIGINT) AS observed, sum(n * k / t) AS expected, sum(CASE WHEN t > 1 THEN n * k * (t - k) * (t - n) / (t * t * (t - 1)) ELSE 0 END) AS variance FROM g)
      SELECT observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round(observed / nullif(expected, 0), 6) AS ratio, round((observed - expected) / nullif(sqrt(variance), 0), 6) AS z FROM s""",
    "latest_record": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "first_record": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'error', ts, event_id) AS r FROM events) WHERE r = 1",
    "newest_model": """SELECT accession, version, model_id FROM (SELECT uniprot_accession AS accession, CAST(alphafold_version AS VARCHAR) AS version, alphafold_model_id AS model_id,
      row_number() OVER (PARTITION BY uniprot_accession ORDER BY coalesce(alphafold_version, -1) DESC, retrieved_at DESC, alphafold_model_id DESC) AS r FROM gene_profiles WHERE alphafold_model_id IS NOT NULL) WHERE r = 1""",
    "karlin_altschul": """WITH p AS (SELECT DISTINCT row_id, CAST(protein_length AS DOUBLE) AS m, alphafold_mean_plddt * 2 AS s FROM gene_profiles)
      SELECT row_id, round(ln(0.041::DOUBLE * m * 500.0::DOUBLE * exp(-0.267::DOUBLE * s)), 6) AS log_e, round((0.267::DOUBLE * s - ln(0.041::DOUBLE)) / ln(2.0::DOUBLE), 6) AS bits, 0.041::DOUBLE * m * 500.0::DOUBLE * exp(-0.267::DOUBLE * s) < 0.001 AS significant FROM p""",
    "structure_gates": """WITH p AS (SELECT DISTINCT row_id, protein_length, alphafold_mean_plddt AS q FROM gene_profiles)
      SELECT CASE WHEN protein_length % 60 < 30 OR protein_length % 100 < 25 THEN 'insufficient_mapping' WHEN q IS NULL OR q < 70 OR q + 5 < 70 THEN 'low_confidence' WHEN protein_length % 55 < 30 THEN 'too_few_confident_pairs' ELSE 'computed' END AS status, count(*) AS n FROM p GROUP BY 1""",
}
