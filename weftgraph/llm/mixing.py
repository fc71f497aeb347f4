"""Mixing sources to target weights by entropy balancing.

Of all document rates, those nearest to one copy each (in relative entropy) that give every source its tokens are
``min(max_repeats, exp(lambda_source * size / mean size))``. The dual is convex and has one variable per source; its
gradient and curvature are sums over documents, which Spark takes over the histogram of sizes, once per Newton step.
Rates are rounded to copies systematically, from the distribution of sizes down to buckets of documents, so that a
source's tokens miss its target by about the size of one document.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.session import cut

#: The targets are a parameter of the caller's, not data; more sources than this are refused.
MAX_SOURCES = 10_000
BUCKETS = 256


def _literal(values: dict[str, float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,double>")


def plan(hist: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, steps: int = 100, tolerance: float = 1e-9) -> dict[str, dict[str, float]]:
    """Per source ``lambda, mean, cap, budget``; ``hist`` has ``source, size, n``.

    The whole is as large as all tokens of the sources, or ``total``, but no larger than the scarcest source allows
    with its repeats. Sources without tokens get nothing, and the others keep their relation to each other.
    """
    sums = {r.source: (float(r.tokens), float(r.docs)) for r in hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.sum("n").alias("docs")).collect()}
    live = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and sums.get(s, (0, 0))[0] > 0}
    if not live:
        return {}
    scale = sum(share for share, _ in live.values())
    share = {s: x[0] / scale for s, x in live.items()}
    whole = min(total or sum(sums[s][0] for s in live), min(live[s][1] * sums[s][0] / share[s] for s in live))
    state = {s: {"mean": sums[s][0] / sums[s][1], "cap": float(live[s][1]), "budget": share[s] * whole, "lambda": 0.0, "low": -math.inf, "high": math.inf} for s in live}
    for x, s in ((state[s], s) for s in live):
        x["full"] = x["budget"] >= x["cap"] * sums[s][0] * (1 - 1e-12)
    for _ in range(steps):
        open_ = {s: x for s, x in state.items() if not x["full"]}
        if not open_:
            break
        rate = rate_of(F.col("source"), F.col("size"), state)
        tilt = F.col("size") / F.element_at(_literal({s: x["mean"] for s, x in state.items()}), F.col("source"))
        cap = F.element_at(_literal({s: x["cap"] for s, x in state.items()}), F.col("source"))
        sums_ = (
            hist.where(F.col("source").isin(list(open_)))
            .select("source", (F.col("n") * F.col("size") * rate).alias("f"), F.when(rate < cap, F.col("n") * F.col("size") * tilt * rate).otherwise(0.0).alias("g"))
            .groupBy("source")
            .agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
            .collect()
        )
        worst = 0.0
        for r in sums_:
            x = state[r.source]
            off = r.f - x["budget"]
            worst = max(worst, abs(off) / x["budget"])
            if abs(off) < tolerance * x["budget"]:
                continue
            x["low" if off < 0 else "high"] = x["lambda"]
            step = x["lambda"] - off / r.g if r.g > 0 else (math.inf if off < 0 else -math.inf)
            if not x["low"] < step < x["high"]:
                step = (x["low"] + x["high"]) / 2 if math.isfinite(x["low"] + x["high"]) else x["lambda"] + (1.0 if off < 0 else -1.0) * (1 + abs(x["lambda"]))
            x["lambda"] = step
        if worst < tolerance:
            break
    return state


def rate_of(source: Column, size: Column, state: dict[str, dict[str, float]]) -> Column:
    """Expected copies of a document; 0 for a source that has no target."""
    at = lambda k: F.element_at(_literal({s: float(x[k]) for s, x in state.items()}), source)
    rate = F.when(at("full") > 0, at("cap")).otherwise(F.least(at("cap"), F.exp(F.least(at("lambda") * size / at("mean"), F.lit(700.0)))))
    return F.coalesce(rate, F.lit(0.0))


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """``id, source, size, copies`` of every document that is taken at least once; ``docs`` has ``id, source, size``.

    Null sources and sources without a target have share 0; a null size counts as 0, and a document without tokens
    is taken once where its source has a target. Ids must be unique; a repeated row of a source counts as one more
    document. No document is taken more often than its source's ``max_repeats``. Empty tables give no rows.
    """
    wanted = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect() if r.source is not None}
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    docs = cut(docs.select("id", "source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")).where(F.col("source").isin([s for s in wanted]) if wanted else F.lit(False)))
    hist = cut(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    state = plan(hist, wanted, total)
    if not state:
        return docs.select("id", "source", "size", F.lit(0).cast("bigint").alias("copies")).where(F.lit(False))
    rate = rate_of(F.col("source"), F.col("size"), state)
    # extra copies of each size: systematic over the sizes of a source
    by_size = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    extra = F.col("n") * (rate - F.floor(rate))
    sizes = hist.withColumn("e", extra).withColumn("to", F.sum("e").over(by_size))
    sizes = sizes.select("source", "size", "n", (F.floor(F.col("to") + 0.5 + 1e-9) - F.floor(F.col("to") - F.col("e") + 0.5 + 1e-9)).alias("k"))
    sizes = sizes.withColumn("k", F.least("k", "n"))
    # and of each bucket of documents of one size
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    by_bucket = W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    cells = docs.groupBy("source", "size", "bucket").agg(F.count("*").alias("m")).withColumn("to", F.sum("m").over(by_bucket)).join(sizes, ["source", "size"])
    share = lambda c: F.floor(c.cast("decimal(38,0)") * F.col("k") / F.col("n"))
    cells = cells.select("source", "size", "bucket", (share(F.col("to")) - share(F.col("to") - F.col("m"))).cast("bigint").alias("k"))
    rank = F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("id", F.lit(7)), "id"))
    ranked = docs.withColumn("rank", rank).join(cells, ["source", "size", "bucket"])
    copies = (F.floor(rate) + F.when(F.col("rank") <= F.col("k"), 1).otherwise(0)).cast("bigint")
    taken = cut(ranked.select("id", "source", "size", copies.alias("copies")))
    for _ in range(2):
        taken = _mend(taken, state)
    return taken.where("copies > 0")


def _mend(taken: DataFrame, state: dict[str, dict[str, float]]) -> DataFrame:
    """One copy more or less, in each source, of the document whose size is nearest to what the source is off by."""
    got = {r.source: r.t for r in taken.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()}
    off = {s: x["budget"] - got[s] for s, x in state.items() if s in got}
    if not off:
        return taken
    gap = F.element_at(_literal(off), F.col("source"))
    cap = F.element_at(_literal({s: x["cap"] for s, x in state.items()}), F.col("source"))
    movable = F.when(gap > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0) & (F.abs(F.abs(gap) - F.col("size")) < F.abs(gap) - 0.5)
    best = taken.where(movable).groupBy("source").agg(F.min(F.struct(F.abs(F.abs(gap) - F.col("size")).alias("d"), "id")).alias("b")).collect()
    chosen = F.from_json(F.lit(json.dumps({r.source: str(r.b["id"]) for r in best})), "map<string,string>")
    change = F.when(F.element_at(chosen, F.col("source")) == F.col("id").cast("string"), F.when(gap > 0, 1).otherwise(-1)).otherwise(0)
    return taken.withColumn("copies", (F.col("copies") + change).cast("bigint"))


def repeat(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1."""
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each source that has a target."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("size")).alias("tokens"), F.max("copies").alias("most_copies"))
    out = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").fillna(0, ["documents", "copies", "tokens", "most_copies"])
    whole = out.agg(F.sum("tokens").alias("whole"))
    return out.join(F.broadcast(whole)).select("source", "target_share", "max_repeats", "documents", "copies", "tokens", "most_copies", F.coalesce(F.col("tokens") / F.nullif(F.col("whole"), F.lit(0)), F.lit(0.0)).alias("reached_share"))
