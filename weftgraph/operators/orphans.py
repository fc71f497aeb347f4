"""References to records that do not exist.

Parents are reduced to one entry per key, cut into ranges at quantiles of the key order and kept as one sorted array
per range. References go to the same ranges and are probed batch by batch with a binary search.

* The driver holds the bounds of at most ``RANGES`` ranges, whatever the size of the parents. Beyond that a range is cut
  once more by a hash of the key, so that no array has more than about ``range_keys`` entries.
* A range that many references hit (one key may hold a third of all rows) is split into cells of at most ``cell_rows``
  references, or a ``RANGES``-th of all; its array is copied to each. At most ``RANGES`` cells can be that large.
* Cells are streamed: a task holds one array and one batch of references, so it needs no memory for a large cell.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import key
from weftgraph.session import cut

RANGES = 4096
_NEVER = np.iinfo(np.int64).max
_ALWAYS = np.iinfo(np.int64).min


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def parents(rows: DataFrame, key_col: str, since: str | None, retired: DataFrame | None = None) -> DataFrame:
    """One row per key: ``k``, ``live_from`` and ``dead_from`` in microseconds.

    ``since`` names the arrival time; without it, or where no row of a key has one, the key counts as always there.
    ``retired`` has columns ``old_id`` and ``retired_at``; a retired key without a row of its own never arrives.
    """
    live = rows.select(key(F.col(key_col)).alias("k"), (_micros(F.col(since)) if since else F.lit(_ALWAYS)).alias("t")).where("k is not null")
    live = live.groupBy("k").agg(F.coalesce(F.min("t"), F.lit(_ALWAYS)).alias("live_from"))
    if retired is None:
        return live.withColumn("dead_from", F.lit(_NEVER))
    dead = retired.select(key(F.col("old_id")).alias("k"), _micros(F.col("retired_at")).alias("t")).where("k is not null and t is not null")
    dead = dead.groupBy("k").agg(F.min("t").alias("dead_from"))
    return live.join(dead, "k", "full").select("k", F.coalesce("live_from", F.lit(_NEVER)).alias("live_from"), F.coalesce("dead_from", F.lit(_NEVER)).alias("dead_from"))


def _bounds(par: DataFrame, range_keys: int) -> tuple[list[str], int]:
    """The first key of each range but the first, and the number of parents; never more than ``RANGES`` keys."""
    n = par.count()
    ranges = min(RANGES, max(1, -(-n // range_keys)))
    if ranges == 1:
        return [], n
    firsts = par.select("k").repartitionByRange(ranges, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k"))
    return sorted(r.k for r in firsts.collect())[1:], n


def _range_of(bounds: list[str], k: Column) -> Column:
    """The range of a key in two steps: among every 64th bound, then among the bounds behind it."""
    if not bounds:
        return F.lit(0)
    step = 64
    after = lambda some: F.size(F.filter(F.array(*map(F.lit, some)), lambda b: b <= k))
    if len(bounds) <= step:
        return after(bounds)
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    table = F.from_json(F.lit(json.dumps(groups)), "array<array<string>>")
    coarse = F.greatest(after([g[0] for g in groups]) - 1, F.lit(0))
    return coarse * step + F.size(F.filter(F.get(table, coarse), lambda b: b <= k))


_ROW = "ref_id bigint, period string, reason string"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream of cells: a row with a sorted array of parents, then the references of the cell, in batches of any size."""
    ks, live, dead = np.empty(0, dtype=object), np.empty(0, "int64"), np.empty(0, "int64")
    cell = None
    for batch in batches:
        if not batch.num_rows:
            continue
        slots = batch.column(0).to_numpy()
        turns = np.flatnonzero(slots[1:] != slots[:-1]) + 1
        for at, end in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
            if slots[at] >> 1 != cell:
                cell, ks, live, dead = slots[at] >> 1, np.empty(0, dtype=object), np.empty(0, "int64"), np.empty(0, "int64")
            if slots[at] & 1 == 0:
                entry = batch.column(1)[at].values
                ks = np.array(entry.field("k").to_pylist(), dtype=object)
                live, dead = (entry.field(c).to_numpy() for c in ("live_from", "dead_from"))
                continue
            part = batch.slice(at, end - at)
            coded = part.column(2).dictionary_encode()
            codes, uniques = coded.indices.to_numpy(), np.array(coded.dictionary.to_pylist(), dtype=object)
            place = np.searchsorted(ks, uniques)
            inside = place < len(ks)
            hit = np.zeros(len(uniques), dtype=bool)
            hit[inside] = ks[place[inside]] == uniques[inside]
            born, died = np.full(len(uniques), _NEVER), np.full(len(uniques), _NEVER)
            born[hit], died[hit] = live[place[hit]], dead[place[hit]]
            known = part.column(3).is_valid().to_numpy(zero_copy_only=False)
            when = part.column(3).fill_null(0).to_numpy()
            missing = born[codes] == _NEVER
            early, late = known & (born[codes] > when), known & (died[codes] <= when)
            reason = np.select([missing & ~late, late, early], ["missing", "retired", "arrives_later"], default="")
            bad = pa.array(missing | early | late)
            yield pa.RecordBatch.from_arrays([part.column(4).filter(bad), part.column(5).filter(bad), pa.array(reason, pa.string()).filter(bad)], names=["ref_id", "period", "reason"])


def orphan_references(
    refs: DataFrame, ref_id: str, ref_key: str, par: DataFrame, *, at: str | None = None, period: Column | None = None, range_keys: int = 20_000, cell_rows: int = 200_000
) -> DataFrame:
    """References of ``refs`` that no live parent answers: ``ref_id, period, reason``, one row per reference row.

    ``par`` comes from :func:`parents`. A reference is an orphan when its key is in no parent (``missing``), first
    arrived after ``at`` (``arrives_later``) or was retired at or before ``at`` (``retired``). Null, blank and ``-``
    keys refer to nothing and never come out; with a null ``at`` only ``missing`` can be told; a null id or period
    comes out as it is, and ids of any size unchanged; repeated rows come out repeated; an empty parent table makes
    every reference an orphan and an empty reference table gives no rows. Only the named columns are read, so others
    may have any name.
    """
    when = _micros(F.col(at)) if at else F.lit(None).cast("bigint")
    rows = refs.select(
        F.col(ref_id).cast("bigint").alias("ref_id"), key(F.col(ref_key)).alias("k"), when.alias("at"), (period if period is not None else F.lit(None)).cast("string").alias("period")
    ).where("k is not null")
    par = cut(par)
    bounds, n = _bounds(par, range_keys)
    # beyond RANGES ranges each is cut once more by a hash of the key, so that an array never exceeds about range_keys
    subs = max(1, -(-n // (RANGES * range_keys)))
    r, s = _range_of(bounds, F.col("k")).cast("int").alias("r"), F.pmod(F.xxhash64("k"), F.lit(subs)).cast("int").alias("s")
    arrays = par.select(r, s, F.struct("k", "live_from", "dead_from").alias("e")).groupBy("r", "s").agg(F.array_sort(F.collect_list("e")).alias("e"))
    rows = rows.select("*", r, s)
    # a cell with more than its share of the references is split; at most RANGES cells can have a RANGES-th of them
    counted = rows.groupBy("r", "s").agg(F.count("*").alias("n"))
    total = counted.groupBy().agg(F.greatest(F.lit(cell_rows), F.ceil(F.sum("n") / RANGES)).alias("share"))
    hot = cut(counted.join(F.broadcast(total)).where("n > share").select("r", "s", F.ceil(F.col("n") / F.col("share")).cast("int").alias("cells")))
    spread = F.coalesce("cells", F.lit(1))
    # one number a row: range and sub-range, then the cell, then whether it is the array or a reference
    slot = lambda cell, side: (F.col("r").cast("bigint") * subs + F.col("s")) * (1 << 31) + cell * 2 + side
    rows = rows.join(F.broadcast(hot), ["r", "s"], "left").select(slot(F.pmod(F.xxhash64("ref_id", "at"), spread), 1).alias("slot"), "k", "at", "ref_id", "period")
    arrays = arrays.join(F.broadcast(hot), ["r", "s"], "left").select("r", "s", "e", F.explode(F.sequence(F.lit(0), spread - 1)).alias("cell")).select(slot(F.col("cell"), 0).alias("slot"), "e")
    both = arrays.unionByName(rows, allowMissingColumns=True).select("slot", "e", "k", "at", "ref_id", "period")
    return both.repartition(F.shiftright("slot", 1)).sortWithinPartitions("slot").mapInArrow(_probe, _ROW)


def orphan_report(misses: DataFrame, *by: str) -> DataFrame:
    """Orphans per group and reason; ``by`` defaults to the period."""
    by = by or ("period",)
    return misses.groupBy(*by, "reason").agg(F.count("*").alias("orphans"))
