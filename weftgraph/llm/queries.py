"""Queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.keys import key
from weftgraph.llm import abuse, lookalike, mixing, pairs, setjoin, tokenizer
from weftgraph.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "chat_eval_cases"), "record_id", "question", "answer").select(F.col("id").alias("record_id"), "defect_type")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field_name, id, text`` of the three fields that are compared by look."""
    diseases, cases = table(spark, sf_dir, "cluster_diseases"), table(spark, sf_dir, "chat_eval_cases")
    of = lambda df, name, i, c: df.select(F.lit(name).alias("field_name"), F.col(i).alias("id"), F.col(c).alias("text"))
    return (
        of(diseases, "cluster_diseases.label", "row_id", "label")
        .unionAll(of(diseases, "cluster_diseases.synonyms", "row_id", "synonyms"))
        .unionAll(of(cases, "chat_eval_cases.answer", "record_id", "answer"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look_pairs(_texts(spark, sf_dir))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's class of look, with the number of texts that only look the same."""
    return lookalike.look_classes(_texts(spark, sf_dir))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its one form."""
    return lookalike.canonicalise(_texts(spark, sf_dir).distinct(), "text").select("field_name", "id", "canonical")


def _gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "disease_clusters").select(F.concat(F.lit("c:"), key(F.col("disease_id"))).alias("key"), F.explode(F.split("genes", ";")).alias("item"))
    linked = table(spark, sf_dir, "cluster_disease_genes").select(F.concat(F.lit("g:"), key(F.col("disease_id"))).alias("key"), F.col("gene_symbol").alias("item"))
    return listed.unionAll(linked).select("key", key(F.col("item")).alias("item"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, membership = setjoin.similar_records(_gene_sets(spark, sf_dir), 0.6, least=4)
    return setjoin.record_pairs(pairs, membership).where(F.substring("key_a", 3, 10_000) != F.substring("key_b", 3, 10_000))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of four genes or more with its class of equal sets and its number of similar records."""
    pairs, membership = setjoin.similar_records(_gene_sets(spark, sf_dir), 0.6, least=4)
    return setjoin.record_links(pairs, membership)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the ids of every document decode to."""
    return p6_ids(spark, sf_dir).select("doc_id", tokenizer.decode(F.col("ids")).alias("text"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    sized = tokenizer.with_tokens(docs.select("doc_id", "source", "text"), "text")
    return mixing.mix(sized.select(F.col("doc_id").alias("id"), "source", F.col("n_tokens").alias("size")), targets), targets


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents taken, each with its number of copies."""
    return _mixed(spark, sf_dir)[0].select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copies")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, targets = _mixed(spark, sf_dir)
    return mixing.shares(mixed, targets)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, thresholds, _ = abuse.learn(docs, table(spark, sf_dir, "content_reviews"))
    return abuse.score_documents(docs, model, thresholds, keep=("source",))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("flagged").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "source", "lang", "score", "flagged")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_scored(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_forms": p3_forms, "p3_classes": p3_classes, "p4_found": p4_found, "p4_classes": p4_classes, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
_SETS = """
    WITH m AS (
      SELECT 'c:' || replace(upper(trim(disease_id, E' \\t\\n\\r')), '_', ':') AS key, unnest(string_split(genes, ';')) AS item FROM disease_clusters WHERE genes IS NOT NULL
      UNION ALL
      SELECT 'g:' || nullif(nullif(replace(upper(trim(disease_id, E' \\t\\n\\r')), '_', ':'), ''), '-'), gene_symbol FROM cluster_disease_genes),
    s AS (SELECT DISTINCT key, replace(upper(trim(item, E' \\t\\n\\r')), '_', ':') AS item FROM m WHERE key IS NOT NULL AND trim(item, E' \\t\\n\\r') NOT IN ('', '-')),
    n AS (SELECT key, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 4),
    b AS (SELECT a.key AS key_a, c.key AS key_b, count(*) AS shared FROM s a JOIN s c ON a.item = c.item AND a.key < c.key GROUP BY 1, 2)"""
ORACLE = {
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_found": f"""{_SETS}
    SELECT key_a, key_b FROM b JOIN n x ON x.key = key_a JOIN n y ON y.key = key_b
    WHERE shared >= 0.6 * (x.n + y.n - shared) AND substr(key_a, 3) <> substr(key_b, 3)""",
    "p4_classes": f"""{_SETS},
    w AS (SELECT key, string_agg(item, ';' ORDER BY item) AS items FROM s GROUP BY 1),
    p AS (SELECT key_a, key_b FROM b JOIN n x ON x.key = key_a JOIN n y ON y.key = key_b WHERE shared >= 0.6 * (x.n + y.n - shared)),
    k AS (SELECT key, count(*) AS links FROM (SELECT key_a AS key FROM p UNION ALL SELECT key_b FROM p) GROUP BY 1)
    SELECT key, min(key) OVER (PARTITION BY items) AS class, coalesce(links, 0) AS links FROM n JOIN w USING (key) LEFT JOIN k USING (key)""",
}
