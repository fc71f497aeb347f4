"""All similar pairs between set-valued records, by binary sketches.

Each distinct set gets ``BITS`` one-bit minhashes packed into a code: two sets of Jaccard similarity J agree in a bit
with probability (1 + J) / 2. At the similarities of interest about a fifth of the bits differ, so whole disjoint
segments of a code seldom agree and the plain pigeonhole (as many segments as the radius, plus one) would leave
segments of three bits. The index therefore has more, overlapping segments: ``m`` fixed random selections of ``b``
bits, of which two codes within the radius share at least one with a probability that is computed, not hoped for.
``calibrate`` chooses the radius and ``m`` so that a pair exactly at the threshold is found with ``recall``; pairs
above it are found more surely. ``b`` follows the number of sets, so that rows and chance meetings stay in balance.

Candidates are filtered by Hamming distance within the radius and verified on the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.blocks import pairs_within
from weftgraph.session import cut

BITS = 512
#: The first bits of the code travel with each segment and are compared before anything else.
HEAD = 128


def _tail_radius(n: int, p: float, miss: float) -> int:
    """The least r with P(Binomial(n, p) > r) <= miss."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(n + 1)]
    left, r = 1.0, -1
    while left > miss:
        r += 1
        left -= math.exp(logs[r])
    return r


@lru_cache(maxsize=64)
def calibrate(threshold: float, b: int, recall: float) -> tuple[int, int, int]:
    """(segments, radius of the head, radius of the code) for a recall at the threshold."""
    p, miss = (1 - threshold) / 2, 1 - recall
    if p <= 0:
        return 1, 0, 0
    head, whole = _tail_radius(HEAD, p, miss / 4), _tail_radius(BITS, p, miss / 4)
    d = np.arange(BITS + 1)
    log_pmf = np.array([math.lgamma(BITS + 1) - math.lgamma(k + 1) - math.lgamma(BITS - k + 1) + k * math.log(p) + (BITS - k) * math.log1p(-p) for k in d])
    same = np.array([math.exp(sum(math.log(max(BITS - k - i, 1e-300) / (BITS - i)) for i in range(b))) if BITS - k >= b else 0.0 for k in d])
    lost = lambda m: float(np.sum(np.exp(log_pmf) * (1 - same) ** m))
    low, high = 1, 1
    while lost(high) > miss / 2:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if lost(mid) > miss / 2 else (low, mid)
    return low, head, whole


def best_width(count: int, threshold: float, recall: float, row_cost: float = 3.0, pair_cost: float = 0.1) -> int:
    """The width of a segment with the least cost: rows of the index (sorted and shuffled), and chance meetings of two
    unlike sets in a segment (compared by their heads)."""
    return min(range(8, 31), key=lambda b: calibrate(threshold, b, recall)[0] * count * (row_cost + pair_cost * count / 2 ** (b + 1)))


def _sketch(b: int, m: int):
    """Batches of ``sid, hashes`` to ``sid, c0 … c7, segs``."""
    rng = np.random.default_rng(20_250_101)
    seeds = rng.integers(1, 2**63, BITS, dtype=np.uint64)
    picks = np.stack([rng.choice(BITS, b, replace=False) for _ in range(m)])
    powers = (1 << np.arange(b)).astype(np.int64)
    kind = pa.schema([("sid", pa.int64()), ("code", pa.list_(pa.int64())), ("segs", pa.list_(pa.int64()))])

    def bits_of(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), BITS), dtype=np.uint8)
        for j in range(0, BITS, 64):
            h = values[:, None] ^ seeds[None, j : j + 64]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
            out[:, j : j + 64] = (np.minimum.reduceat(h, starts, axis=0) & np.uint64(1)).astype(np.uint8)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = part.column(1)
                sizes = np.diff(np.asarray(lists.offsets))
                values = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                bits = np.concatenate([bits_of(values[lo:hi], starts[i:k] - lo) for i, k, lo, hi in _chunks(starts, len(values))])
                code = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                segs = np.empty((len(bits), m), dtype=np.int64)
                for s in range(m):
                    segs[:, s] = (bits[:, picks[s]].astype(np.int64) @ powers) | (s << 40)
                lens = np.arange(len(bits) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(lens * (BITS // 64), code.ravel()), pa.ListArray.from_arrays(lens * m, segs.ravel())], schema=kind
                )

    return run


def _chunks(starts: np.ndarray, total: int, most: int = 50_000):
    """Runs of whole sets with about ``most`` values, so that a batch of very large sets stays within memory."""
    i = 0
    while i < len(starts):
        k = max(i + 1, int(np.searchsorted(starts, starts[i] + most)))
        yield i, k, int(starts[i]), int(starts[k]) if k < len(starts) else total
        i = k


def distinct_sets(members: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """From ``key, item`` rows: sets ``sid, items, n`` and membership ``key, sid``; sets under ``least`` items drop out."""
    pairs = members.where("key is not null and item is not null").select("key", "item").distinct()
    sets = pairs.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") >= least)
    sets = cut(sets.withColumn("h", F.md5(F.array_join("items", "\x1f"))))
    unique = cut(sets.groupBy("h").agg(F.first("items").alias("items")).withColumn("sid", F.monotonically_increasing_id()))
    return unique.select("sid", "items", F.size("items").alias("n")), sets.select("key", "h").join(unique.select("h", "sid"), "h").select("key", "sid")


def similar_sets(sets: DataFrame, threshold: float, recall: float = 0.99995) -> DataFrame:
    """``a, b, similarity`` (a < b) of all pairs of distinct sets at or above the threshold; see the module."""
    count = sets.count()
    b = best_width(count, threshold, recall)
    m, head, whole = calibrate(threshold, b, recall)
    spread = max(sets.sparkSession.sparkContext.defaultParallelism, count // 2_000)
    hashed = sets.select("sid", F.transform("items", lambda x: F.xxhash64(x)).alias("hashes")).repartition(spread)
    codes = cut(hashed.mapInArrow(_sketch(b, m), "sid bigint, code array<bigint>, segs array<bigint>").join(sets.select("sid", "n"), "sid"))
    rows = codes.select("sid", "n", F.col("code")[0].alias("c0"), F.col("code")[1].alias("c1"), F.explode("segs").alias("seg"))
    left = rows.select("seg", *(F.col(c).alias(f"{c}_a") for c in ("sid", "n", "c0", "c1")))
    right = rows.select("seg", *(F.col(c).alias(f"{c}_b") for c in ("sid", "n", "c0", "c1")))
    near = F.bit_count(F.col("c0_a").bitwiseXOR(F.col("c0_b"))) + F.bit_count(F.col("c1_a").bitwiseXOR(F.col("c1_b"))) <= head
    sized = (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    met = left.join(right, "seg").where((F.col("sid_a") < F.col("sid_b")) & sized & near).select("sid_a", "sid_b").distinct()
    code = codes.select("sid", "code")
    far = sum((F.bit_count(F.get("code_a", i).bitwiseXOR(F.get("code_b", i))) for i in range(BITS // 64)), F.lit(0))
    met = met.join(code.toDF("sid_a", "code_a"), "sid_a").join(code.toDF("sid_b", "code_b"), "sid_b").where(far <= whole).select("sid_a", "sid_b")
    full = met.join(sets.toDF("sid_a", "items_a", "n_a"), "sid_a").join(sets.toDF("sid_b", "items_b", "n_b"), "sid_b")
    full = full.withColumn("both", F.size(F.array_intersect("items_a", "items_b")))
    similarity = F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    return full.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"), similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def similar_records(members: DataFrame, threshold: float, least: int = 1, recall: float = 0.99995) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of distinct sets, and the membership ``key, sid`` of records in them.

    ``members`` has ``key, item``: nulls in either are left out, repeated rows count once, records of fewer than
    ``least`` items are left out, an empty table gives no pairs. Records with the same set share a ``sid``.
    """
    sets, membership = distinct_sets(members, least)
    return similar_sets(sets, threshold, recall), membership


def record_pairs(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """``key_a, key_b`` (key_a < key_b): pairs of sets written out as pairs of records, equal sets included; those of one set
    are formed in cells of two blocks. :func:`record_links` says the same in one row a record."""
    membership = cut(membership)
    a, b = membership.toDF("key_a", "a"), membership.toDF("key_b", "b")
    between = pairs.select("a", "b").join(a, "a").join(b, "b").select("key_a", "key_b")
    within = pairs_within(membership.select("sid", "key"), ["sid"], "key").select("key_a", "key_b")
    return between.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).unionAll(within)


def record_links(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """``key, class, links``: each record with its class, the least key with the same set, and the number of records
    whose set is similar or equal. Nothing is written out in pairs of records."""
    membership = cut(membership)
    sizes = membership.groupBy("sid").agg(F.count("*").alias("n"), F.min("key").alias("class"))
    both = pairs.select("a", "b").unionAll(pairs.select("b", "a")).toDF("sid", "other")
    near = both.join(sizes.select(F.col("sid").alias("other"), "n"), "other").groupBy("sid").agg(F.sum("n").alias("near"))
    links = sizes.join(near, "sid", "left").select("sid", "class", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("links"))
    return membership.join(links, "sid").select("key", "class", "links")
