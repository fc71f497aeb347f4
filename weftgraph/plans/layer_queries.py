"""Graph layers and cleaned text out of the project's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators import layers, ontology, ranking, similarity
from weftgraph.plans import analogue, similarity_queries
from weftgraph.session import cut, table


def _latest_diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "cluster_diseases").select("disease_id", "label", "family", "panel_role", "hpo_disease_id", "synonyms", "retrieved_at", "row_id")
    return ranking.latest(d, ["disease_id"], ["retrieved_at", "row_id"])


def layer_diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disease nodes of the last snapshots with their clusters."""
    clusters = ranking.first(table(spark, sf_dir, "disease_clusters").select("disease_id", "cluster_combined", "cluster_mechanism", "cluster_phenotype"), ["disease_id"], ["cluster_combined", "cluster_mechanism", "cluster_phenotype"])
    n = layers.disease_nodes(_latest_diseases(spark, sf_dir), clusters)
    at = lambda p, name: F.get_json_object("properties_json", p).alias(name)
    return n.select("node_id", "label", "status", at("$.family", "family"), at("$.cluster.combined", "combined"), at("$.cluster.panel_role", "panel_role"))


def layer_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = table(spark, sf_dir, "cluster_disease_genes")
    profiles = ranking.first(table(spark, sf_dir, "gene_profiles").select("gene_symbol", "protein_length", "protein_name", "uniprot_accession", "row_id"), ["gene_symbol"], ["row_id"])
    n = layers.gene_layer(genes, profiles)[0]
    return n.select("node_id", "label", "external_id", F.get_json_object("properties_json", "$.protein.length").cast("bigint").alias("length"))


def layer_gene_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "gene_profiles")
    return layers.gene_layer(table(spark, sf_dir, "cluster_disease_genes"), profiles)[1].select("edge_id", "source_id", "target_id")


def disease_gene_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of diseases that share a causal gene, by the information content of their genes."""
    genes = cut(layer_gene_edges(spark, sf_dir).select(F.col("source_id").alias("entity"), F.col("target_id").alias("term")).distinct())
    return similarity.simgic(genes, cut(ontology.information_content(genes))).select("a", "b", F.round("score", 6).alias("score"))


def layer_pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pathways that two or more suppliers share, in the star-schema reading."""
    li = analogue.lines(spark, sf_dir)
    p = analogue.pathways(li).select(F.col("gene").cast("string").alias("gene_symbol"), F.col("pathway").alias("pathway_id"), F.col("pathway").alias("pathway_label"), F.lit("false").alias("is_in_disease"))
    nodes, edges = layers.pathway_layer(p, analogue.genes(li).select(F.col("gene").cast("string").alias("gene_symbol")))
    return nodes.select("node_id").join(edges.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("genes")), "node_id")


def layer_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = layers.similarity_edges(similarity_queries._relations(spark, sf_dir))
    return e.select("edge_id", "source_id", "edge_type", "target_id", "confidence")


def resource_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies as resources of the diseases whose label they name, with those that no disease answers."""
    d = _latest_diseases(spark, sf_dir).select(F.col("label").alias("alias"), "disease_id")
    s = table(spark, sf_dir, "studies").select(F.concat(F.lit("NCT:"), "nct_id").alias("resource_id"), F.lit("Study").alias("kind"), F.col("brief_title").alias("label"), F.lit("").alias("short_name"), F.col("source_url").alias("url"), F.col("conditions").alias("disease_ids"), "row_id").distinct()
    _, edges, problems = layers.resource_layer(s.drop("row_id"), d, d.select(F.col("disease_id").alias("node_id")).distinct())
    return edges.groupBy(F.col("source_id").alias("resource_id")).agg(F.count("*").alias("links")).join(problems.groupBy("resource_id").agg(F.count("*").alias("problems")), "resource_id", "full").select("resource_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("problems", F.lit(0)).alias("problems"))


def sentence_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "gene_profiles").select("row_id", "function_text").distinct()
    return g.select("row_id", text.first_sentences(F.col("function_text"), 120, 40).alias("short"))


def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return layers.checks({"no null key": F.count_if(F.col("c_custkey").isNull()), "keys are unique": F.count("*") == F.count_distinct("c_custkey"), "no debt": F.count_if(F.col("c_acctbal") < 0)}, c)


QUERIES = {f.__name__: f for f in (layer_diseases, layer_genes, layer_gene_edges, disease_gene_pairs, layer_pathways, layer_similarity, resource_links, sentence_cut, table_checks)}
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY retrieved_at DESC, row_id DESC) AS r FROM cluster_diseases) WHERE r = 1"
ORACLE = {
    "layer_diseases": f"""WITH d AS ({_LATEST}), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY cluster_combined, cluster_mechanism, cluster_phenotype) AS r FROM disease_clusters) WHERE r = 1)
      SELECT disease_id AS node_id, d.label, 'cluster_expansion' AS status, coalesce(d.family, '') AS family, coalesce(cluster_combined, '') AS combined, coalesce(d.panel_role, '') AS panel_role FROM d LEFT JOIN c USING (disease_id)""",
    "layer_genes": """WITH s AS (SELECT gene_symbol, max(coalesce(ncbi_gene_id, '')) AS external_id FROM cluster_disease_genes WHERE coalesce(used_for_scoring, upper(association_type) = 'MENDELIAN') AND coalesce(gene_symbol, '') <> '' GROUP BY 1),
      p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_symbol ORDER BY row_id) AS r FROM gene_profiles) WHERE r = 1)
      SELECT 'GENE_SYMBOL:' || gene_symbol AS node_id, gene_symbol AS label, external_id, protein_length AS length FROM s LEFT JOIN p USING (gene_symbol)""",
    "layer_gene_edges": """SELECT DISTINCT 'EDGE:CLX-GENE-' || disease_id || '-' || gene_symbol AS edge_id, disease_id AS source_id, 'GENE_SYMBOL:' || gene_symbol AS target_id FROM cluster_disease_genes
      WHERE coalesce(used_for_scoring, upper(association_type) = 'MENDELIAN') AND coalesce(gene_symbol, '') <> '' AND coalesce(disease_id, '') <> ''""",
    "disease_gene_pairs": """WITH g AS (SELECT DISTINCT disease_id AS e, gene_symbol AS f FROM cluster_disease_genes
        WHERE coalesce(used_for_scoring, upper(association_type) = 'MENDELIAN') AND coalesce(gene_symbol, '') <> '' AND coalesce(disease_id, '') <> ''),
      ic AS (SELECT f, -ln(count(*) / (SELECT count(DISTINCT e) FROM g)) AS w FROM g GROUP BY 1), s AS (SELECT e, sum(w) AS s FROM g JOIN ic USING (f) GROUP BY 1),
      i AS (SELECT x.e AS a, y.e AS b, sum(w) AS i FROM g x JOIN g y ON x.f = y.f AND x.e < y.e JOIN ic ON ic.f = x.f WHERE w > 0 GROUP BY 1, 2)
      SELECT a, b, round(i / (p.s + q.s - i), 6) AS score FROM i JOIN s p ON p.e = a JOIN s q ON q.e = b""",
    "layer_pathways": f"WITH {analogue.SQL} SELECT 'REACTOME:' || pathway AS node_id, count(DISTINCT gene) AS genes FROM pw GROUP BY pathway HAVING count(DISTINCT gene) >= 2",
    "layer_similarity": f"""WITH {analogue.SQL} SELECT 'EDGE:CLX-SIM-' || a || '-' || b AS edge_id, CAST(a AS VARCHAR) AS source_id, CASE WHEN relation LIKE 'same_gene%' THEN 'SHARES_CAUSAL_GENE' WHEN relation LIKE 'mechanism%' THEN 'MECHANISM_NEIGHBOR'
      WHEN relation LIKE 'phenotype_look%' THEN 'PHENOTYPE_LOOKALIKE' ELSE 'PHENOTYPE_NEIGHBOR' END AS edge_type, CAST(b AS VARCHAR) AS target_id,
      CASE WHEN relation LIKE 'same_gene%' THEN 'high' WHEN relation IN ('mechanism_and_phenotype_neighbor', 'phenotype_neighbor_weak_mechanism') THEN 'medium' ELSE 'low' END AS confidence FROM full_rel WHERE relation <> 'not_linked'""",
    "resource_links": f"""WITH d AS ({_LATEST}), a AS (SELECT ref, min(target) AS target FROM (SELECT label AS ref, disease_id AS target FROM d UNION ALL SELECT disease_id, disease_id FROM d) GROUP BY 1),
      s AS (SELECT DISTINCT row_id, nct_id, brief_title, source_url, conditions FROM studies), r AS (SELECT nct_id, trim(unnest(string_split(coalesce(conditions, ''), ';'))) AS ref FROM s)
      SELECT 'NCT:' || nct_id AS resource_id, count(target) AS links, count(*) - count(target) AS problems FROM r LEFT JOIN a USING (ref) WHERE ref <> '' GROUP BY 1""",
    "sentence_cut": """WITH g AS (SELECT DISTINCT row_id, function_text AS t FROM gene_profiles), c AS (SELECT *, left(t, 120) AS c, strpos(reverse(left(t, 120)), ' .') AS b FROM g)
      SELECT row_id, CASE WHEN length(t) <= 120 THEN t WHEN b > 0 AND length(c) - b - 1 > 40 THEN left(c, length(c) - b) ELSE rtrim(c) || '…' END AS short FROM c""",
    "table_checks": """SELECT 'no null key' AS name, count_if(c_custkey IS NULL) = 0 AS ok, CAST(count_if(c_custkey IS NULL) AS VARCHAR) AS detail FROM customer UNION ALL
      SELECT 'keys are unique', count(*) = count(DISTINCT c_custkey), CAST(count(*) = count(DISTINCT c_custkey) AS VARCHAR) FROM customer UNION ALL SELECT 'no debt', count_if(c_acctbal < 0) = 0, CAST(count_if(c_acctbal < 0) AS VARCHAR) FROM customer""",
}
