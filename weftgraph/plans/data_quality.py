"""Queries of the data-quality operators over the project's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.orphans import orphan_references, parents
from weftgraph.operators.packed import unpack
from weftgraph.session import cut, table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, diseases, genes, retired = (table(spark, sf_dir, t) for t in ("cluster_disease_genes", "cluster_diseases", "gene_profiles", "retired_ids"))
    of = lambda kind: retired.where(F.lower(F.trim("id_kind")) == kind)
    links = cut(links.select("row_id", "disease_id", "gene_symbol", "hpo_release_tag", "loaded_at").distinct())
    genes = cut(genes.select("row_id", "gene_symbol", "retrieved_at").distinct())
    found = {
        "cluster_disease_genes.disease_id": orphan_references(links, "row_id", "disease_id", parents(diseases, "disease_id", "retrieved_at", of("disease")), at="loaded_at", period=F.col("hpo_release_tag")),
        "cluster_disease_genes.gene_symbol": orphan_references(links, "row_id", "gene_symbol", parents(genes, "gene_symbol", "retrieved_at", of("gene")), at="loaded_at", period=F.col("hpo_release_tag")),
        "gene_profiles.gene_symbol": orphan_references(genes, "row_id", "gene_symbol", parents(links, "gene_symbol", None), period=F.date_format("retrieved_at", "yyyy-MM")),
    }
    return reduce(DataFrame.unionAll, [m.select(F.lit(name).alias("field_name"), "ref_id", "period", "reason") for name, m in found.items()])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("field_name", F.col("ref_id").alias("row_id"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per field and period."""
    return _orphans(spark, sf_dir).groupBy("field_name", "period").agg(F.count("*").alias("orphans"))


PACKED = (("cluster_diseases", "synonyms"), ("cluster_diseases", "xrefs"), ("cluster_diseases", "curated_genes"), ("studies", "conditions"))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its position and error flag; repeats of a row are taken once."""
    return reduce(DataFrame.unionAll, [unpack(table(spark, sf_dir, t).select("row_id", f).distinct(), "row_id", f, f"{t}.{f}") for t, f in PACKED])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_values(spark, sf_dir).select("field_name", "row_id", "pos", "item")


_KEY = "nullif(nullif(replace(upper(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '_', ':'), ''), '-')"


def _p1_sql() -> str:
    k = _KEY.format
    return f"""
    WITH l AS (SELECT DISTINCT row_id, {k('disease_id')} AS d, {k('gene_symbol')} AS g, loaded_at, hpo_release_tag FROM cluster_disease_genes),
    gp AS (SELECT DISTINCT row_id, {k('gene_symbol')} AS g, retrieved_at FROM gene_profiles),
    d AS (SELECT {k('disease_id')} AS k, min(retrieved_at) AS t FROM cluster_diseases GROUP BY 1),
    g AS (SELECT g AS k, min(retrieved_at) AS t FROM gp GROUP BY 1),
    r AS (SELECT id_kind, {k('old_id')} AS k, min(retired_at) AS t FROM retired_ids GROUP BY 1, 2),
    found AS (
      SELECT 'cluster_disease_genes.disease_id' AS field_name, row_id, hpo_release_tag AS period FROM l
        LEFT JOIN d ON l.d = d.k LEFT JOIN r ON r.id_kind = 'disease' AND r.k = l.d
        WHERE l.d IS NOT NULL AND (d.k IS NULL OR d.t > loaded_at OR r.t <= loaded_at)
      UNION ALL
      SELECT 'cluster_disease_genes.gene_symbol', row_id, hpo_release_tag FROM l
        LEFT JOIN g ON l.g = g.k LEFT JOIN r ON r.id_kind = 'gene' AND r.k = l.g
        WHERE l.g IS NOT NULL AND (g.k IS NULL OR g.t > loaded_at OR r.t <= loaded_at)
      UNION ALL
      SELECT 'gene_profiles.gene_symbol', row_id, strftime(retrieved_at, '%Y-%m') FROM gp
        WHERE g IS NOT NULL AND g NOT IN (SELECT g FROM l WHERE g IS NOT NULL))"""


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p5_found": p5_found, "p5_values": p5_values}
ORACLE = {
    "p1_found": _p1_sql() + " SELECT DISTINCT field_name, row_id FROM found",
    "p1_report": _p1_sql() + " SELECT field_name, period, count(*) AS orphans FROM found GROUP BY 1, 2",
}
