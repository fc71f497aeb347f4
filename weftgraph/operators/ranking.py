"""Ranks, cutoffs and choices of one record per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.session import cut


def numbered(df: DataFrame, order: list[Column], out: str = "number") -> DataFrame:
    """Adds the place of each row, from 1, in the order of the whole table, without sorting it in one task.

    Rows are range-partitioned by the order; a row's number is its place in its range plus the rows of earlier ranges.
    """
    rows = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    before = rows.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__off", F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.join(F.broadcast(before.select("__p", F.coalesce("__off", F.lit(0)).alias("__off"))), "__p")  # one row per partition
    return rows.withColumn(out, F.row_number().over(W.partitionBy("__p").orderBy(*order)) + F.col("__off")).drop("__p", "__off")


def counts_below(counts: DataFrame, value: str, by: list[str], n: str = "n") -> DataFrame:
    """Adds ``below``, the sum of ``n`` of smaller values in ``by``, and ``total``; one row per ``by`` and value comes in.

    Values are range-partitioned, so a group of any size is spread over tasks; sums of whole ranges are few rows.
    """
    rows = cut(counts.repartitionByRange(*by, value).withColumn("__p", F.spark_partition_id()))
    parts = rows.groupBy(*by, "__p").agg(F.sum(n).alias("__s"))
    w = W.partitionBy(*by)
    parts = parts.select(*by, "__p", F.coalesce(F.sum("__s").over(w.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"), F.sum("__s").over(w).alias("total"))
    rows = rows.join(parts, [*by, "__p"])
    inside = F.coalesce(F.sum(n).over(W.partitionBy(*by, "__p").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("below", inside + F.col("__off")).drop("__p", "__off")


def midrank(df: DataFrame, value: str, by: list[str], out: str = "pct") -> DataFrame:
    """``(below + equal / 2) / n`` of each value within ``by``; null values and groups have null."""
    steps = counts_below(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), value, by)
    return df.join(steps.select(*by, value, ((F.col("below") + 0.5 * F.col("n")) / F.col("total")).alias(out)), [*by, value], "left").select(*df.columns, out)


def midrank_against(probes: DataFrame, reference: DataFrame, value: str, by: list[str], out: str = "pct") -> DataFrame:
    """Mid-rank of each probe's value among the reference's values of the same ``by``; null without a reference.

    Both sides are reduced to distinct values first.
    """
    steps = reference.groupBy(*by, value).agg(F.count("*").alias("n")).unionByName(probes.select(*by, value, F.lit(0).cast("bigint").alias("n")).distinct())
    steps = counts_below(steps.groupBy(*by, value).agg(F.sum("n").alias("n")), value, by)
    return probes.join(steps.select(*by, value, ((F.col("below") + 0.5 * F.col("n")) / F.nullif(F.col("total"), F.lit(0))).alias(out)), [*by, value])


def nearest_rank(df: DataFrame, value: str, by: list[str], q: float = 0.75, out: str = "cutoff") -> DataFrame:
    """The value at 0-based place ``min(n - 1, floor(q n))`` of each group."""
    counts = counts_below(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), value, by)
    at = F.least(F.col("total") - 1, F.floor(q * F.col("total")))
    return counts.where((F.col("below") <= at) & (F.col("below") + F.col("n") > at)).select(*by, F.col(value).alias(out), F.col("total").alias("n"))


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col(out) <= k)


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order`` columns; one aggregate with map-side combine, no sort."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*by, *(F.col(f"__r.{c}").alias(c) for c in rest))


def first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the least ``order`` columns."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*by, *(F.col(f"__r.{c}").alias(c) for c in rest))


def best_model(models: DataFrame, by: str = "accession") -> DataFrame:
    """Newest model of each accession: greatest version (a number, else -1), creation time, then id."""
    version = F.coalesce(F.expr("try_cast(version AS int)"), F.lit(-1))
    return latest(models.withColumn("__v", version), [by], ["__v", "created", "model_id"]).drop("__v")
