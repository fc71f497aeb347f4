"""Graph maintenance, retrieval, grounding and feedback queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import feedback, graph, retrieval
from weftgraph.session import table
from weftgraph.sources import readers
from weftgraph.streaming import limiter


def _s(c: str):
    return F.col(c).cast("string")


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph before a run: regions, nations, all suppliers as an older run left them and links of another layer."""
    return _graph(spark, sf_dir, table(spark, sf_dir, "supplier"))


def _graph(spark: SparkSession, sf_dir: str, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    nodes = (
        graph.as_nodes(r.select(F.concat(F.lit("REGION:"), _s("r_regionkey")).alias("node_id"), F.lit("Region").alias("node_type"), F.col("r_name").alias("label"), F.lit("seed").alias("status"), F.lit('{"cluster":{"combined":"C9","n":1},"family":"x","synonyms":["a","b"]}').alias("properties_json")))
        .unionAll(graph.as_nodes(n.select(F.concat(F.lit("NATION:"), _s("n_nationkey")).alias("node_id"), F.lit("Nation").alias("node_type"), F.col("n_name").alias("label"), F.lit("seed").alias("status"))))
        .unionAll(graph.as_nodes(old.select(F.concat(F.lit("SUPPLIER:"), _s("s_suppkey")).alias("node_id"), F.lit("Supplier").alias("node_type"), F.col("s_name").alias("label"), F.lit("cluster_expansion").alias("status"))))
    )
    edges = (
        graph.as_edges(n.select(F.concat(F.lit("EDGE:SEED-"), _s("n_nationkey")).alias("edge_id"), F.concat(F.lit("NATION:"), _s("n_nationkey")).alias("source_id"), F.lit("PART_OF").alias("edge_type"), F.concat(F.lit("REGION:"), _s("n_regionkey")).alias("target_id")))
        .unionAll(graph.as_edges(old.select(F.concat(F.lit("EDGE:CLX-old-"), _s("s_suppkey")).alias("edge_id"), F.concat(F.lit("SUPPLIER:"), _s("s_suppkey")).alias("source_id"), F.lit("LOCATED_IN").alias("edge_type"), F.concat(F.lit("NATION:"), _s("s_nationkey")).alias("target_id"))))
        .unionAll(graph.as_edges(old.select(F.concat(F.lit("EDGE:CUR-"), _s("s_suppkey")).alias("edge_id"), F.concat(F.lit("SUPPLIER:"), _s("s_suppkey")).alias("source_id"), F.lit("SUPPORTS").alias("edge_type"), F.concat(F.lit("NATION:"), _s("s_nationkey")).alias("target_id"))))
    )
    return nodes, edges


def _layer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The new layer: nations again, with more properties, and suppliers of positive balance."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    props = F.to_json(F.struct(F.struct(F.concat(F.lit("C"), _s("n_nationkey")).alias("combined"), F.col("n_nationkey").alias("n")).alias("cluster"), F.concat(F.lit("R"), _s("n_regionkey")).alias("family"), F.lit("z").alias("other"), F.array("n_name").alias("synonyms")))
    nodes = graph.as_nodes(n.select(F.concat(F.lit("NATION:"), _s("n_nationkey")).alias("node_id"), F.lit("Nation").alias("node_type"), F.col("n_name").alias("label"), F.concat(F.lit("X"), _s("n_nationkey")).alias("external_id"), F.lit("cluster_expansion").alias("status"), props.alias("properties_json")))
    nodes = nodes.unionAll(graph.as_nodes(s.select(F.concat(F.lit("SUPPLIER:"), _s("s_suppkey")).alias("node_id"), F.lit("Supplier").alias("node_type"), F.col("s_name").alias("label"), F.lit("cluster_expansion").alias("status"))))
    edges = graph.as_edges(s.select(F.concat(F.lit("EDGE:CLX-"), _s("s_suppkey")).alias("edge_id"), F.concat(F.lit("SUPPLIER:"), _s("s_suppkey")).alias("source_id"), F.lit("LOCATED_IN").alias("edge_type"), F.concat(F.lit("NATION:"), _s("s_nationkey")).alias("target_id")))
    again = graph.as_edges(n.select(F.concat(F.lit("EDGE:CLX-n-"), _s("n_nationkey")).alias("edge_id"), F.concat(F.lit("NATION:"), _s("n_nationkey")).alias("source_id"), F.lit("PART_OF").alias("edge_type"), F.concat(F.lit("REGION:"), _s("n_regionkey")).alias("target_id")))
    return nodes, edges.unionAll(again)


def _synced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges, _ = graph.replace_layer(*_base(spark, sf_dir), *_layer(spark, sf_dir))
    return nodes, edges


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir)[0].select("node_id", "node_type", "label", "status", "properties_json")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir)[1].select("edge_id", "source_id", "edge_type", "target_id")


def layer_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir)[0].select("node_id", "label", "external_id", "status", "properties_json")


def layer_sync_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir)[1].select("edge_id", "source_id", "edge_type", "target_id")


def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with faults: parts as nodes by name, lines as edges, ends and evidence that are not there."""
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 50")
    nodes = graph.as_nodes(part.where("p_size <= 25").select(F.concat(F.lit("PART:"), _s("p_partkey")).alias("node_id"), F.lit("Part").alias("node_type")))
    nodes = nodes.unionAll(graph.as_nodes(part.where("p_size = 1").select(F.concat(F.lit("PART:"), _s("p_partkey")).alias("node_id"), F.lit("Part").alias("node_type"))))
    nodes = nodes.unionAll(graph.as_nodes(part.where("p_size = 2").select(F.concat(F.lit("EVIDENCE:E"), _s("p_partkey")).alias("node_id"), F.lit("Evidence").alias("node_type"))))
    edges = graph.as_edges(li.select(F.concat_ws("-", F.lit("EDGE:L"), _s("l_orderkey"), _s("l_linenumber")).alias("edge_id"), F.concat(F.lit("PART:"), _s("l_partkey")).alias("source_id"), F.when(F.col("l_linenumber") == 3, "bad kind").otherwise("SOLD_WITH").alias("edge_type"), F.concat(F.lit("PART:"), F.pmod(F.col("l_partkey") + 1, F.lit(500)).cast("string")).alias("target_id"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("E"), _s("l_partkey"))).alias("evidence_id")))
    return graph.violations(nodes, edges)


def graph_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _base(spark, sf_dir)
    return graph.fingerprint(nodes, edges)


def multi_hop_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that two suppliers' nations lead to, through the graph."""
    nodes, edges = _base(spark, sf_dir)
    start = nodes.where("node_type = 'Supplier'").select("node_id")
    p = graph.follow(edges, start, [("LOCATED_IN", "out"), ("PART_OF", "out"), ("PART_OF", "in")])
    return p.groupBy(F.col("n0").alias("supplier"), F.col("n2").alias("region")).agg(F.count("*").alias("nations"))


def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _base(spark, sf_dir)
    return graph.neighbours(edges, nodes.where("node_type = 'Nation'"))


def edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of nodes and edges of each kind."""
    nodes, edges = _synced(spark, sf_dir)
    return nodes.groupBy(F.col("node_type").alias("kind")).count().unionAll(edges.groupBy(F.col("edge_type").alias("kind")).count()).toDF("kind", "n")


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = graph.search_terms(_base(spark, sf_dir)[0])
    return terms.select("node_id", F.array_join("terms", "|").alias("terms"))


QUESTIONS = ((1, "registry that lists families with enlarged spleen"), (2, "gene therapy exclusion criteria criteria"), (3, "α-deficiency type 2 F10 NCT94772978"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = spark.createDataFrame(QUESTIONS, "query_id bigint, text string")
    top = retrieval.bm25(docs, q, k=10)
    return top.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(F.size(retrieval.tokens(F.col("text"))), F.lit(0)).cast("bigint").alias("tokens")).select("doc_id", F.greatest("tokens", F.lit(0)).alias("tokens"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.content_hash(F.col("text")).alias("hash"))


def row_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "studies").select("row_id", "nct_id", "brief_title", "phases", "lead_sponsor").distinct()
    return s.select("row_id", retrieval.row_text(["nct_id", "brief_title", "phases", "lead_sponsor"]).alias("text"))


def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed by lines into chunks of 400 characters."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(retrieval.chunks(F.col("text"), 400, r"\n", "\n")).alias("chunk", "text"))


def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document cited by a claim: half of them by a claim on its own first words, half by one on others'."""
    d = table(spark, sf_dir, "documents")
    docs = d.select(F.concat(F.lit("D"), _s("doc_id")).alias("doc_id"), "text", "source_tier", "kind", F.col("source").alias("origin"))
    claims = d.select(
        F.col("doc_id").alias("claim_id"),
        F.concat(F.lit("D"), (F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1)).cast("string")).alias("evidence_id"),
        F.concat(F.lit("MONDO:"), F.lit("disease")).alias("source_id"),
        F.element_at(F.array(*map(F.lit, ("similar_to", "causes", "has_gene"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("edge_type"),
        F.lit("KIND:registry").alias("target_id"),
        F.substring("text", 1, 20).alias("source_span"),
    )
    out = retrieval.score_claims(claims, docs, {"similar_to": 0.45, "hypothesizes": 0.35}, ["has_gene"])
    return out.select("claim_id", "confidence_score", "confidence", F.array_join("confidence_basis", "|").alias("basis"))


def citation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers with only the citations of facts that were sent."""
    c = table(spark, sf_dir, "chat_eval_cases").select("record_id", "answer", F.split(F.coalesce("fact_ids", F.lit("")), r";\s*").alias("sent")).distinct()
    return retrieval.filter_citations(c, "answer", "sent").select("record_id", "clean", F.array_join("cited", ",").alias("cited"))


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which recorded answers say that the facts do not contain this, and which send the reader to a team."""
    c = table(spark, sf_dir, "chat_eval_cases").select("record_id", "answer").distinct()
    return c.select("record_id", F.coalesce(retrieval.abstains(F.col("answer")), F.lit(False)).alias("abstains"), F.coalesce(retrieval.mentions(F.col("answer"), ["care team", "Doctor"]), F.lit(False)).alias("defers"))


def forbidden_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chat_eval_cases").select("record_id", "answer").distinct()
    return retrieval.forbidden_hits(c, "answer", [r"carry over", r"loss of speech"]).where("forbidden is not null").select("record_id", "forbidden")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of a JSON column, summed by kind."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("p.k").alias("n"))


def regex_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers out of addresses, and short names out of titles."""
    g = table(spark, sf_dir, "studies").select("row_id", "source_url", "brief_title").distinct()
    slug = F.btrim(F.regexp_replace(F.lower("brief_title"), "[^a-z0-9]+", "-"), F.lit("-"))
    return g.select("row_id", readers.curie(F.regexp_replace("source_url", "NCT", "NCT_")).alias("curie"), F.regexp_extract("source_url", r"([0-9]+)$", 1).alias("number"), slug.alias("slug"))


_CATEGORY = {"view": "useful", "signup": "source_broken", "error": "relationship_wrong", "click": "display_issue", "purchase": "answer_unsupported"}


def _feedback(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    category = F.create_map(*(F.lit(x) for kv in _CATEGORY.items() for x in kv))[F.col("event_type")]
    rows = e.select(F.lit("edge").alias("target_kind"), F.concat(F.lit("U"), _s("user_id")).alias("target_id"), category.alias("category"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'").alias("received_at"))
    status = F.element_at(F.array(*map(F.lit, ("reviewing", "confirmed_issue", "rejected", "fixed_in_next_graph", "not a status"))), (F.col("event_id") % 5 + 1).cast("int"))
    done = e.where("event_type = 'signup'").select(F.concat(F.lit("U"), _s("user_id")).alias("target_id"), status.alias("status"), F.concat(F.lit("g"), (F.col("event_id") % 2).cast("string")).alias("graph_version"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'").alias("decided_at"), F.col("event_id").alias("seq"))
    return rows, done


def feedback_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, done = _feedback(spark, sf_dir)
    return feedback.queue(rows, done, "g1").select("target_id", "n_useful", "problems", "later", "last_seen", "status", "open")


def rate_limited_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of events, twenty a minute for each kind of event."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return feedback.rate_limited(e, "event_type", "ts", "event_id").select("event_id", "event_type", "accepted")


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = limiter.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "6 hours")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        graph_nodes, graph_edges, layer_sync, layer_sync_edges, graph_violations, graph_version, multi_hop_path, neighbourhood, edge_kinds, search_index, bm25_topk, token_counts, content_hash, row_documents, paragraph_chunks,
        claim_scores, citation_filter, answer_scores, forbidden_phrases, json_props, regex_cleanup, feedback_queue, rate_limited_events, windowed_events,
    )
}
_G = """WITH n0 AS (
  SELECT 'REGION:' || r_regionkey AS node_id, 'Region' AS node_type, r_name AS label, '' AS external_id, 'seed' AS status, '{"cluster":{"combined":"C9","n":1},"family":"x","synonyms":["a","b"]}' AS properties_json FROM region
  UNION ALL SELECT 'NATION:' || n_nationkey, 'Nation', n_name, '', 'seed', '' FROM nation
  UNION ALL SELECT 'SUPPLIER:' || s_suppkey, 'Supplier', s_name, '', 'cluster_expansion', '' FROM supplier),
e0 AS (SELECT 'EDGE:SEED-' || n_nationkey AS edge_id, 'NATION:' || n_nationkey AS source_id, 'PART_OF' AS edge_type, 'REGION:' || n_regionkey AS target_id FROM nation
  UNION ALL SELECT 'EDGE:CLX-old-' || s_suppkey, 'SUPPLIER:' || s_suppkey, 'LOCATED_IN', 'NATION:' || s_nationkey FROM supplier
  UNION ALL SELECT 'EDGE:CUR-' || s_suppkey, 'SUPPLIER:' || s_suppkey, 'SUPPORTS', 'NATION:' || s_nationkey FROM supplier),
n1 AS (SELECT 'REGION:' || r_regionkey AS node_id, 'Region' AS node_type, r_name AS label, '' AS external_id, 'seed' AS status, '{"family":"x","synonyms":["a","b"]}' AS properties_json FROM region
  UNION ALL SELECT 'NATION:' || n_nationkey, 'Nation', n_name, 'X' || n_nationkey, 'seed', '{"cluster":{"combined":"C' || n_nationkey || '","n":' || n_nationkey || '},"family":"R' || n_regionkey || '","synonyms":["' || n_name || '"]}' FROM nation
  UNION ALL SELECT 'SUPPLIER:' || s_suppkey, 'Supplier', s_name, '', 'cluster_expansion', '' FROM supplier WHERE s_acctbal > 0),
e1 AS (SELECT * FROM e0 WHERE edge_id LIKE 'EDGE:SEED-%' UNION ALL SELECT * FROM e0 WHERE edge_id LIKE 'EDGE:CUR-%' AND source_id IN (SELECT node_id FROM n1)
  UNION ALL SELECT 'EDGE:CLX-' || s_suppkey, 'SUPPLIER:' || s_suppkey, 'LOCATED_IN', 'NATION:' || s_nationkey FROM supplier WHERE s_acctbal > 0)"""
_TOK = r"regexp_extract_all(lower(text), '[A-Za-z0-9_:.+\-]+')"
_Q = ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS)
_ANY = {k: "(?:" + "|".join(v) + ")" for k, v in retrieval.LACKING.items()}
_ABSTAIN = [
    rf"\b{_ANY['subject']}\b[^.!?]{{0,40}}?\b{_ANY['lacks']}\b",
    rf"\b(?:{_ANY['own']}|{_ANY['absent']})\b",
    rf"\b{_ANY['refer']} {_ANY['whom']}\b",
]
_ABSTAINS = " OR ".join("regexp_matches(lower(translate(answer, '’‘', '''''')), '" + p.replace("'", "''") + "')" for p in _ABSTAIN)
ORACLE = {
    "graph_nodes": f"{_G} SELECT node_id, node_type, label, status, properties_json FROM n0",
    "graph_edges": f"{_G} SELECT * FROM e0",
    "layer_sync": f"{_G} SELECT node_id, label, external_id, status, properties_json FROM n1",
    "layer_sync_edges": f"{_G} SELECT * FROM e1",
    "graph_violations": """WITH n AS (SELECT 'PART:' || p_partkey AS node_id, 'Part' AS t FROM part WHERE p_size <= 25 UNION ALL SELECT 'PART:' || p_partkey, 'Part' FROM part WHERE p_size = 1 UNION ALL SELECT 'EVIDENCE:E' || p_partkey, 'Evidence' FROM part WHERE p_size = 2),
      e AS (SELECT 'EDGE:L-' || l_orderkey || '-' || l_linenumber AS edge_id, 'PART:' || l_partkey AS s, CASE WHEN l_linenumber = 3 THEN 'bad kind' ELSE 'SOLD_WITH' END AS k, 'PART:' || ((l_partkey + 1) % 500) AS t, CASE WHEN l_linenumber = 1 THEN 'E' || l_partkey ELSE '' END AS ev FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50)
      SELECT CAST(1 AS BIGINT) AS rank, 'duplicate_node' AS kind, node_id AS subject, CAST(count(*) AS VARCHAR) AS detail FROM n GROUP BY node_id HAVING count(*) > 1
      UNION ALL SELECT 2, 'duplicate_edge', edge_id, CAST(count(*) AS VARCHAR) FROM e GROUP BY edge_id HAVING count(*) > 1
      UNION ALL SELECT 3, 'missing_endpoint', edge_id, x FROM (SELECT edge_id, unnest([s, t]) AS x FROM e) WHERE x NOT IN (SELECT node_id FROM n)
      UNION ALL SELECT 4, 'invalid_relation', edge_id, k FROM e WHERE k = 'bad kind'
      UNION ALL SELECT 5, 'missing_evidence', edge_id, ev FROM e WHERE ev <> '' AND ev NOT IN (SELECT substr(node_id, 10) FROM n WHERE t = 'Evidence')""",
    "graph_version": f"""{_G}, r AS (SELECT 'n' AS t, 'external_id=' || external_id || chr(31) || 'label=' || label || chr(31) || 'node_id=' || node_id || chr(31) || 'node_type=' || node_type || chr(31) || 'properties_json=' || properties_json || chr(31) || 'source_url=' || chr(31) || 'status=' || status AS x FROM n0 UNION ALL SELECT 'e', 'assertion_level=' || chr(31) || 'confidence=' || chr(31) || 'edge_id=' || edge_id || chr(31) || 'edge_type=' || edge_type || chr(31) || 'evidence_id=' || chr(31) || 'limitations=' || chr(31) || 'notes=' || chr(31) || 'properties_json=' || chr(31) || 'source_id=' || source_id || chr(31) || 'source_url=' || chr(31) || 'target_id=' || target_id FROM e0),
      h AS (SELECT sha256(t || chr(30) || x) AS h FROM r)
      SELECT 'g' || left(sha256(count(*) || '|' || {" || '|' || ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(4))}), 10) AS graph_version FROM h""",
    "multi_hop_path": f"{_G} SELECT a.source_id AS supplier, b.target_id AS region, count(*) AS nations FROM e0 a JOIN e0 b ON a.target_id = b.source_id AND b.edge_type = 'PART_OF' JOIN e0 c ON c.target_id = b.target_id AND c.edge_type = 'PART_OF' WHERE a.edge_type = 'LOCATED_IN' GROUP BY 1, 2",
    "neighbourhood": f"{_G} SELECT source_id AS node_id, edge_type, target_id AS neighbour, 'out' AS direction FROM e0 WHERE source_id LIKE 'NATION:%' UNION ALL SELECT target_id, edge_type, source_id, 'in' FROM e0 WHERE target_id LIKE 'NATION:%'",
    "edge_kinds": f"{_G} SELECT node_type AS kind, count(*) AS n FROM n1 GROUP BY 1 UNION ALL SELECT edge_type, count(*) FROM e1 GROUP BY 1",
    "search_index": f"{_G} SELECT node_id, CASE WHEN label < node_id THEN label || '|' || node_id ELSE node_id || '|' || label END || CASE WHEN node_id LIKE 'REGION:%' THEN '|a|b' ELSE '' END AS terms FROM n0",
    "bm25_topk": f"""WITH d AS (SELECT doc_id, {_TOK} AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
      df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS token FROM d) GROUP BY 1), idf AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, s), f AS (SELECT 0.25 * avg(idf) AS f FROM idf),
      q AS (SELECT query_id, unnest({_TOK}) AS token FROM (VALUES {_Q}) x(query_id, text)), w AS (SELECT query_id, token, count(*) * CASE WHEN any_value(idf) < 0 THEN any_value(f) ELSE any_value(idf) END AS w FROM q JOIN idf USING (token), f GROUP BY 1, 2),
      tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM d) GROUP BY 1, 2, 3),
      sc AS (SELECT query_id, doc_id, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM tf JOIN w USING (token), s GROUP BY 1, 2)
      SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC) AS rank FROM sc) WHERE rank <= 10""",
    "token_counts": f"SELECT doc_id, CAST(coalesce(len({_TOK}), 0) AS BIGINT) AS tokens FROM documents",
    "content_hash": "SELECT doc_id, left(sha256(text), 16) AS hash FROM documents",
    "row_documents": "SELECT row_id, concat_ws(chr(10), 'nct_id: ' || nullif(nct_id, ''), 'brief_title: ' || nullif(brief_title, ''), 'phases: ' || nullif(phases, ''), 'lead_sponsor: ' || nullif(lead_sponsor, '')) AS text FROM (SELECT DISTINCT row_id, nct_id, brief_title, phases, lead_sponsor FROM studies)",
    "claim_scores": """WITH c AS (SELECT doc_id AS claim_id, doc_id + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS ev, ['similar_to', 'causes', 'has_gene'][doc_id % 3 + 1] AS k, substr(text, 1, 20) AS span FROM documents),
      j AS (SELECT claim_id, k, d.doc_id IS NOT NULL AS found, source_tier, coalesce(kind = 'structured_record', false) AS rec, lower(coalesce(text, '')) AS low, lower(trim(coalesce(span, ''))) AS sp FROM c LEFT JOIN documents d ON d.doc_id = ev),
      x AS (SELECT *, sp <> '' AND contains(low, sp) AS hit, contains(low, 'disease') OR contains(low, 'registry') AS named FROM j),
      r AS (SELECT *, CASE source_tier WHEN '1' THEN 0.45 WHEN '2' THEN 0.3 ELSE 0.1 END + CASE WHEN rec THEN 0.25 ELSE 0 END + CASE WHEN hit THEN 0.2 ELSE 0 END + CASE WHEN named THEN 0.1 ELSE 0 END AS raw FROM x),
      s AS (SELECT *, CASE WHEN found THEN round(CAST(least(CASE k WHEN 'has_gene' THEN raw WHEN 'similar_to' THEN least(raw, 0.45) ELSE least(raw, 0.55) END, 1.0) AS DOUBLE), 2) ELSE 0.0 END AS score FROM r)
      SELECT claim_id, CAST(score AS DOUBLE) AS confidence_score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN found THEN
        CASE source_tier WHEN '1' THEN 'tier_1_official_source' WHEN '2' THEN 'tier_2_specialist_source' ELSE 'internal_or_unranked_source' END || CASE WHEN rec THEN '|structured_source_record' ELSE '' END || CASE WHEN hit THEN '|exact_source_span_match' ELSE '|source_span_not_verified' END ||
        CASE WHEN named THEN '|endpoint_appears_in_source' ELSE '' END || CASE k WHEN 'has_gene' THEN '|direct_record_relationship' WHEN 'similar_to' THEN '|relationship_cap_similar_to' ELSE '|unclassified_relationship_cap' END ELSE 'evidence_id_not_in_retrieved_context' END AS basis FROM s""",
    "answer_scores": f"""SELECT record_id, coalesce({_ABSTAINS}, false) AS abstains, coalesce(contains(lower(answer), 'care team') OR contains(lower(answer), 'doctor'), false) AS defers FROM (SELECT DISTINCT record_id, answer FROM chat_eval_cases)""",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1",
    "regex_cleanup": r"""SELECT DISTINCT row_id, regexp_replace(replace(string_split(source_url, '/')[-1], 'NCT', 'NCT_'), '^([^_]*)_', '\1:') AS curie, regexp_extract(source_url, '([0-9]+)$', 1) AS number, trim(regexp_replace(lower(brief_title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM studies""",
    "feedback_queue": f"""WITH f AS (SELECT 'U' || user_id AS target_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CATEGORY.items())} END AS c, strftime(ts, '%Y-%m-%dT%H:%MZ') AS seen FROM events),
      d0 AS (SELECT 'U' || user_id AS target_id, ['reviewing', 'confirmed_issue', 'rejected', 'fixed_in_next_graph', 'x'][event_id % 5 + 1] AS s, 'g' || (event_id % 2) AS v, strftime(ts, '%Y-%m-%dT%H:%MZ') AS decided, event_id FROM events WHERE event_type = 'signup'),
      d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY event_id DESC) AS r FROM d0 WHERE s <> 'x') WHERE r = 1),
      g AS (SELECT f.target_id, count_if(c = 'useful') AS n_useful, count_if(c <> 'useful') AS problems, count_if(coalesce(seen > decided, false) AND c <> 'useful') AS later, max(seen) AS last_seen, any_value(s) AS s, any_value(v) AS v FROM f LEFT JOIN d USING (target_id) GROUP BY 1),
      h AS (SELECT *, CASE WHEN s IS NULL THEN 'new' WHEN s = 'fixed_in_next_graph' AND v <> 'g1' THEN 'fixed' ELSE s END AS status FROM g)
      SELECT target_id, n_useful, problems, later, last_seen, status, status IN ('new', 'reviewing', 'confirmed_issue') OR later > 0 AS open FROM h""",
    "windowed_events": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
