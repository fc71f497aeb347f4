"""Pairs within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_within(rows: DataFrame, keys: list[str], id_col: str, block_rows: int = 2_000) -> DataFrame:
    """``keys`` and the other columns twice, as ``c_a`` and ``c_b``, of all pairs of a group with ``id_a < id_b``.

    A group of n rows is cut into ``ceil(n / block_rows)`` blocks by a hash of the id, and each pair of blocks is a cell
    of its own. So both sides of a cell are bounded however hot its key is, and every pair is formed in one cell only.
    Groups of one row are dropped before anything is copied. Null keys and ids form no pair; ids must be unique in
    their group, else a repeated row repeats its pairs; an empty table gives none.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys, F.ceil(F.col("__n") / block_rows).cast("int").alias("__blocks"))
    placed = rows.where(F.col(id_col).isNotNull()).join(sizes, keys).withColumn("__own", F.pmod(F.xxhash64(id_col), F.col("__blocks")).cast("int"))
    cells = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    cells = cells.withColumns({"__lo": F.least("__own", "__other"), "__hi": F.greatest("__own", "__other")})
    values = [c for c in rows.columns if c not in keys]
    side = lambda s: cells.select(*keys, "__lo", "__hi", F.col("__own").alias(f"__own{s}"), *(F.col(c).alias(c + s) for c in values))
    met = side("_a").join(side("_b"), [*keys, "__lo", "__hi"])
    once = (F.col("__lo") == F.col("__hi")) | (F.col("__own_a") != F.col("__own_b"))
    return met.where(once & (F.col(f"{id_col}_a") < F.col(f"{id_col}_b"))).select(*keys, *(c + s for s in ("_a", "_b") for c in values))
