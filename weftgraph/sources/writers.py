"""Sinks: fixed-order CSV, JSON lines, FASTA, manifests and batched upserts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: list[str], one_file: bool = True) -> None:
    """Columns in the given order, others dropped; Spark's committer makes the write atomic."""
    out = df.select(*columns)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def jsonl(df: DataFrame, path: str, order: str) -> None:
    """Sorted by ``order``, keys in alphabetical order."""
    df.select(*sorted(df.columns)).orderBy(order).coalesce(1).write.mode("overwrite").json(path)


def fasta_text(id_col: Column, sequence: Column, width: int = 80) -> Column:
    """A record with its sequence in lines of ``width``."""
    return F.concat(F.lit(">"), id_col, F.lit("\n"), F.regexp_replace(sequence, rf"(.{{{width}}})(?!$)", "$1\n"))


def fasta(df: DataFrame, path: str) -> None:
    """``id, sequence`` as FASTA, by id."""
    df.orderBy("id").coalesce(1).select(fasta_text(F.col("id"), F.col("sequence")).alias("value")).write.mode("overwrite").text(path)


def append_decision(df: DataFrame, path: str) -> None:
    """Append to a decision log."""
    df.write.mode("append").option("header", True).csv(path)


def file_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, sha256`` of whole files."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("sha256"))


def manifest(path: str, spark: SparkSession, **values) -> None:
    """A one-line JSON manifest with sorted keys."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def merge_batches(df: DataFrame, send: Callable[[list[dict]], None], size: int = 500) -> None:
    """Hand rows to ``send`` in batches, on the executors; ``send`` must be idempotent, as tasks may run again."""

    def run(rows) -> None:
        batch: list[dict] = []
        for r in rows:
            batch.append(r.asDict(recursive=True))
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(run)
