"""Intake, verdicts, payload and ordered outputs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import evaluate, graph, intake, ontology, payload, ranking
from weftgraph.plans import analogue, graph_queries, similarity_queries
from weftgraph.session import cut, table


def annotation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as annotations of parts: observed ones of live terms under one brand, by part."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("term"), F.when(F.col("l_linestatus") == "O", "P").otherwise("I").alias("aspect"), F.when(F.col("l_returnflag") == "R", "not").alias("qualifier"))
    terms = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") <= 5).alias("obsolete"))
    closed = ontology.closure(analogue.ontology(spark, sf_dir))
    kept = intake.known_terms(li.where(intake.counts_as_observed(F.col("aspect"), F.col("qualifier"))), terms, closed, "B:Brand#13")
    return kept.groupBy("term").agg(F.count("*").alias("rows"))


def curated_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which associations count where the disease's panel lists its genes."""
    d = ranking.latest(table(spark, sf_dir, "cluster_diseases").select("disease_id", "curated_genes", "retrieved_at", "row_id"), ["disease_id"], ["retrieved_at", "row_id"])
    links = table(spark, sf_dir, "cluster_disease_genes").select("row_id", "disease_id", "gene_symbol", "association_type").distinct()
    return links.join(d.select("disease_id", "curated_genes"), "disease_id").select("row_id", intake.curated_use(F.col("association_type"), F.col("gene_symbol"), F.col("curated_genes")).alias("used"))


def full_length_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "gene_profiles").where("alphafold_model_id is not null")
    rows = g.select(F.col("uniprot_accession").alias("accession"), F.col("alphafold_model_id").alias("model_id"), (F.col("alphafold_version") % 2 + 1).alias("start"), F.col("protein_length").alias("end"), F.col("protein_length").alias("length"), F.col("row_id").alias("place"))
    return intake.full_length_model(rows).select("accession", "model_id", "place")


def pathway_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "gene_profiles").select(F.col("subcellular_location").alias("pathway_id"), F.concat_ws("-", "uniprot_accession", F.col("alphafold_version").cast("string")).alias("accession"))
    return intake.pathway_sizes(g)


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = analogue.ontology(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    members = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
    anchors = part.select(F.concat(F.lit("B:"), "p_brand").alias("id"), F.lit("series").alias("grouping")).distinct().unionAll(spark.range(1).select(F.lit("ALL"), F.lit("class")))
    return intake.anchored_hierarchy(cut(ontology.closure(links)), links, members, anchors)


def anchored_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and the root above each part."""
    return _hierarchy(spark, sf_dir)


def hierarchy_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and IS_A edges of the hierarchy, transitive links left out where a direct one is."""
    h = _hierarchy(spark, sf_dir).withColumn("parent_label", F.lower("parent_id"))
    nodes, edges = payload.hierarchy_layer(h, table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node_id")))
    return nodes.select(F.col("node_id").alias("id"), F.col("node_type").alias("kind"), F.col("label").alias("target")).unionAll(edges.select("edge_id", "edge_type", "target_id"))


def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related pairs by combined score to four places, largest first, with their place."""
    rows = similarity_queries.relation_classes(spark, sf_dir).select("a", "b", F.round("combined", 4).alias("combined"))
    return ranking.numbered(rows, [F.desc("combined"), F.asc("a"), F.asc("b")], "place").select("a", "b", "combined", F.col("place").cast("bigint").alias("place"))


def shared_pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common pathways of each pair by weight, largest first, then name."""
    return similarity_queries.shared_by_weight(spark, sf_dir)


def shared_leaf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six of the most specific common terms of each pair, by information content of 2 or more."""
    return similarity_queries.first_leaves(spark, sf_dir)


def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers judged by what their group of cases asks for."""
    c = table(spark, sf_dir, "chat_eval_cases").select("record_id", "case_group", "answer", "fact_ids", "answered_from_facts").distinct()
    ids = F.filter(F.split(F.coalesce("fact_ids", F.lit("")), r";\s*"), lambda x: x != "")
    cases = c.select(
        "record_id", "answer", ids.alias("fact_ids"), F.transform(ids, lambda i: F.create_map(F.lit("id"), i)).alias("facts"), F.lit(None).cast("string").alias("switch_to"), F.array().cast("array<string>").alias("switched"),
        F.when(F.col("case_group") == "answerable", F.array(F.create_map(F.lit("id"), F.lit("f1")))).alias("must_cite"),
        F.when(F.col("case_group") == "lookalike", F.array(F.lit("Look-Alikes"), F.lit("registry"))).alias("must_mention"),
        F.array().cast("array<string>").alias("defer_to"), (F.col("case_group") == "unanswerable").alias("abstain"), F.col("answered_from_facts").alias("from_facts"),
    )
    return evaluate.verdicts(cases).select("record_id", F.array_join("problems", ";").alias("problems"), "passed")


def families_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all diseases of a family and role are in one cluster."""
    d = table(spark, sf_dir, "disease_clusters").select("disease_id", F.concat_ws("|", "family", "panel_role").alias("name"), F.col("cluster_mechanism").alias("cluster"))
    return evaluate.together(d.select("name", F.col("disease_id").alias("member")).distinct(), d.select(F.col("disease_id").alias("member"), "cluster"))


def listed_genes_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every gene that a disease lists has a profile."""
    d = table(spark, sf_dir, "disease_clusters").where("genes is not null").select(F.col("disease_id").alias("name"), F.explode(F.split("genes", "; ")).alias("item")).distinct()
    return evaluate.all_known(d, table(spark, sf_dir, "gene_profiles").select(F.col("gene_symbol").alias("item")))


def decorated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diseases and studies as an export shows them."""
    d = ranking.first(table(spark, sf_dir, "disease_clusters").select("disease_id", "label", "genes", "family"), ["disease_id"], ["label", "genes", "family"])
    s = ranking.first(table(spark, sf_dir, "studies"), ["nct_id"], ["row_id"])
    nodes = graph.as_nodes(d.select(F.col("disease_id").alias("node_id"), F.lit("Disease").alias("node_type"), "label", F.to_json(F.struct(F.array("family").alias("synonyms"))).alias("properties_json")))
    nodes = nodes.unionAll(graph.as_nodes(s.select(F.concat(F.lit("NCT:"), "nct_id").alias("node_id"), F.lit("Study").alias("node_type"), F.col("brief_title").alias("label"))))
    none = spark.range(0).select(F.lit("").alias("evidence_id"), F.lit("").alias("wording"))
    out = payload.decorated_nodes(nodes, d.select("disease_id", F.col("genes").alias("synonyms"), F.col("genes").alias("xrefs")), s, none)
    return out.select("id", "kind", F.array_join("synonyms", "|").alias("synonyms"), F.array_join("xrefs", "|").alias("xrefs"), F.col("study.overall_status").alias("study_status"))


def flat_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and properties of the graph after a run, one row each."""
    nodes, _ = graph_queries._synced(spark, sf_dir)
    return payload.flat_properties(nodes.select("node_id", "label", "external_id", "properties_json"), "node_id")


def pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that the graph no longer has after a run."""
    before, _ = graph_queries._base(spark, sf_dir)
    return payload.surplus(before, graph_queries._synced(spark, sf_dir)[0], "node_id")


def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers in one table with the columns of both."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


def variant_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each distinct variant by gene, position and letter."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("position"), F.col("l_returnflag").alias("alt")).distinct()
    return ranking.numbered(v, [F.asc("gene"), F.asc("position"), F.asc("alt")], "place").select("gene", "position", "alt", F.col("place").cast("bigint").alias("place"))


QUERIES = {
    f.__name__: f
    for f in (
        annotation_filter, curated_restriction, full_length_model, pathway_sizes, anchored_hierarchy, hierarchy_layer, ranked_pairs, shared_pathways, shared_leaf_terms, case_verdicts, families_together, listed_genes_known,
        decorated_nodes, flat_properties, pruned_nodes, schema_union, variant_order,
    )
}
_S = "WITH " + analogue.SQL
_G = graph_queries._G
_H = """WITH h AS (SELECT 'P' || p_partkey AS child_id, 'B:' || p_brand AS parent_id, 'is_a' AS relation, 'series' AS grouping FROM part UNION ALL SELECT 'P' || p_partkey, 'ALL', 'is_a_transitive', 'class' FROM part)"""
_LISTED = "list_filter(list_transform(string_split(coalesce({0}, ''), ';'), lambda x: trim(x)), lambda x: x <> '')"
ORACLE = {
    "annotation_filter": """SELECT 'P' || l_partkey AS term, count(*) AS rows FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O' AND l_returnflag <> 'R' AND p_size > 5 AND p_brand = 'Brand#13' GROUP BY 1""",
    "curated_restriction": f"""WITH d AS (SELECT * FROM (SELECT disease_id, curated_genes, row_number() OVER (PARTITION BY disease_id ORDER BY retrieved_at DESC, row_id DESC) AS r FROM cluster_diseases) WHERE r = 1),
      l AS (SELECT DISTINCT row_id, disease_id, gene_symbol, association_type FROM cluster_disease_genes)
      SELECT row_id, coalesce(upper(association_type) = 'MENDELIAN', false) AND coalesce(gene_symbol, '') NOT IN ('', '-')
        AND (coalesce(curated_genes, '') = '' OR coalesce(list_contains(list_filter({_LISTED.format("curated_genes")}, lambda x: x <> '-'), gene_symbol), false)) AS used FROM l JOIN d USING (disease_id)""",
    "full_length_model": """SELECT accession, model_id, place FROM (SELECT uniprot_accession AS accession, alphafold_model_id AS model_id, row_id AS place, row_number() OVER (PARTITION BY uniprot_accession ORDER BY row_id) AS r FROM gene_profiles
      WHERE alphafold_model_id LIKE '%-F1' AND alphafold_version % 2 = 0) WHERE r = 1""",
    "pathway_sizes": """WITH m AS (SELECT DISTINCT subcellular_location AS p, uniprot_accession AS a FROM gene_profiles WHERE subcellular_location IS NOT NULL AND uniprot_accession IS NOT NULL)
      SELECT p AS pathway_id, count(*) AS size, (SELECT count(DISTINCT a) FROM m) AS background FROM m GROUP BY 1""",
    "anchored_hierarchy": f"{_H} SELECT * FROM h",
    "hierarchy_layer": f"""{_H} SELECT parent_id AS id, 'Disease' AS kind, lower(parent_id) AS target FROM (SELECT DISTINCT parent_id FROM h WHERE relation = 'is_a')
      UNION ALL SELECT 'EVIDENCE:CLX-MONDO', 'Evidence', 'disease hierarchy' UNION ALL SELECT 'EDGE:CLX-ISA-' || child_id || '-' || parent_id, 'IS_A', parent_id FROM h WHERE relation = 'is_a'""",
    "ranked_pairs": f"""{_S} SELECT a, b, c AS combined, row_number() OVER (ORDER BY c DESC, a, b) AS place FROM (SELECT a, b, round(round(combined, 6), 4) AS c FROM full_rel WHERE {similarity_queries._SHARES})""",
    "shared_pathways": f"""{_S} SELECT a, b, string_agg(x.feature, ';' ORDER BY round(weight, 9) DESC, x.feature) AS pathways FROM pairs p JOIN ep x ON x.entity = a JOIN ep y ON y.entity = b AND y.feature = x.feature
      JOIN rar ON rar.scope = p.scope AND rar.feature = x.feature GROUP BY 1, 2""",
    "shared_leaf_terms": f"""{_S}, sh AS (SELECT x.entity AS a, y.entity AS b, x.term FROM prop x JOIN prop y ON x.term = y.term AND x.entity < y.entity WHERE x.term IN (SELECT term FROM ic WHERE ic > 0)),
      cov AS (SELECT DISTINCT a, b, ancestor AS term FROM sh JOIN clo ON node = term WHERE node <> ancestor),
      r AS (SELECT a, b, term, round(ic, 9) AS ic, row_number() OVER (PARTITION BY a, b ORDER BY round(ic, 9) DESC, term) AS r FROM (SELECT * FROM sh ANTI JOIN cov USING (a, b, term)) JOIN ic USING (term) WHERE ic >= 2)
      SELECT a, b, string_agg(term, ';' ORDER BY r) AS terms FROM r WHERE r <= 6 GROUP BY 1, 2""",
    "case_verdicts": f"""WITH c AS (SELECT DISTINCT record_id, case_group AS g, translate(coalesce(answer, ''), '’‘', '''''') AS answer, fact_ids, answered_from_facts AS f FROM chat_eval_cases),
      x AS (SELECT record_id, CASE WHEN g = 'answerable' AND NOT contains(lower(coalesce(fact_ids, '')), 'f1') THEN 'cites' WHEN g = 'lookalike' AND NOT (contains(lower(answer), 'look-alikes') OR contains(lower(answer), 'registry')) THEN 'mentions'
        WHEN g = 'unanswerable' AND NOT (coalesce(NOT f, false) OR {graph_queries._ABSTAINS}) THEN 'abstains' ELSE '' END AS problems FROM c)
      SELECT record_id, problems, problems = '' AS passed FROM x""",
    "families_together": """WITH d AS (SELECT DISTINCT concat_ws('|', family, panel_role) AS name, disease_id, cluster_mechanism AS c FROM disease_clusters)
      SELECT name, count(DISTINCT c) = 1 AND count(*) = count(c) AS ok, CAST(count(DISTINCT c) AS VARCHAR) AS detail FROM d GROUP BY 1""",
    "listed_genes_known": """WITH d AS (SELECT DISTINCT disease_id AS name, unnest(string_split(genes, '; ')) AS item FROM disease_clusters WHERE genes IS NOT NULL), k AS (SELECT DISTINCT gene_symbol AS item, 1 AS k FROM gene_profiles)
      SELECT name, count(k) = count(*) AS ok, count(*) - count(k) AS missing FROM d LEFT JOIN k USING (item) GROUP BY 1""",
    "decorated_nodes": f"""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY label, genes NULLS FIRST, family) AS r FROM disease_clusters) WHERE r = 1), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nct_id ORDER BY row_id) AS r FROM studies) WHERE r = 1)
      SELECT disease_id AS id, 'Disease' AS kind, array_to_string(list_sort(list_distinct(list_concat([family], {_LISTED.format("genes")}))), '|') AS synonyms, CASE WHEN genes IS NOT NULL THEN array_to_string({_LISTED.format("genes")}, '|') END AS xrefs, NULL AS study_status FROM d
      UNION ALL SELECT 'NCT:' || nct_id, 'Study', '', NULL, coalesce(overall_status, '') FROM s""",
    "flat_properties": f"""{_G} SELECT node_id AS id, 'label' AS key, label AS value, 'scalar' AS kind FROM n1 WHERE label <> '' UNION ALL SELECT node_id, 'external_id', external_id, 'scalar' FROM n1 WHERE external_id <> ''
      UNION ALL SELECT node_id, 'family', json_extract_string(properties_json, '$.family'), 'scalar' FROM n1 WHERE properties_json <> '' UNION ALL SELECT node_id, 'synonyms', CAST(json_extract(properties_json, '$.synonyms') AS VARCHAR), 'list' FROM n1 WHERE properties_json <> ''
      UNION ALL SELECT node_id, 'cluster', CAST(json_extract(properties_json, '$.cluster') AS VARCHAR), 'nested' FROM n1 WHERE node_id LIKE 'NATION:%'""",
    "pruned_nodes": f"{_G} SELECT DISTINCT node_id FROM n0 WHERE node_id NOT IN (SELECT node_id FROM n1)",
    "schema_union": "SELECT c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_name, NULL, round(s_acctbal, 2) FROM supplier",
    "variant_order": "SELECT *, row_number() OVER (ORDER BY gene, position, alt) AS place FROM (SELECT DISTINCT l_suppkey AS gene, l_partkey AS position, l_returnflag AS alt FROM lineitem)",
}
