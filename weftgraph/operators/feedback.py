"""Validation, review and rate limiting of reader feedback."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ranking import latest

# fixed values
CATEGORIES = ("useful", "relationship_wrong", "source_broken", "missing_resource", "display_issue", "answer_unsupported")
TARGETS = ("link", "edge", "gene", "resource", "answer")
STATUSES = ("new", "reviewing", "confirmed_issue", "rejected", "fixed_in_next_graph")
OPEN = ("new", "reviewing", "confirmed_issue")
PER_MINUTE = 20


def validate(rows: DataFrame, known: DataFrame, genes: DataFrame, version: str) -> DataFrame:
    """Feedback of known categories and kinds about a known record, with fixed columns only.

    ``known`` has ``id``, ``genes`` ``label``. An unknown focus and a malformed page version become empty; fact ids and
    the answer's source are kept for answers only.
    """
    good = rows.where(F.col("category").isin(*CATEGORIES) & F.col("target_kind").isin(*TARGETS))
    targets = known.select(F.col("id").alias("target_id"), F.lit(False).alias("__gene")).union(genes.select("label", F.lit(True))).groupBy("target_id").agg(F.bool_and("__gene").alias("__gene_only"))
    good = good.join(targets, "target_id").where(~F.col("__gene_only") | (F.col("target_kind") == "gene"))
    good = good.join(known.select(F.col("id").alias("focus_id"), F.lit(True).alias("__focus")).distinct(), "focus_id", "left")
    answer = F.col("target_kind") == "answer"
    return good.select(
        "received_at", "category", "target_kind", "target_id",
        F.when(F.col("__focus"), F.col("focus_id")).otherwise("").alias("focus_id"),
        F.when(F.col("graph_version").rlike(r"^[A-Za-z0-9._-]{1,40}$"), F.col("graph_version")).otherwise("").alias("page_graph_version"),
        F.lit(version).alias("server_graph_version"),
        F.when(answer, F.slice(F.filter(F.coalesce("fact_ids", F.array().cast("array<string>")), lambda f: f.rlike(r"^F\d{1,3}$")), 1, 20)).alias("fact_ids"),
        F.when(answer, F.when(F.col("answer_source").isin("openai", "offline"), F.col("answer_source")).otherwise("")).alias("answer_source"),
    )


def note(text: Column) -> Column:
    """White space collapsed, at most 300 characters."""
    return F.substring(F.regexp_replace(F.btrim(text), r"(?U)\s+", " "), 1, 300)


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each target by ``seq``, among those with a known status."""
    return latest(decisions.where(F.col("status").isin(*STATUSES) & (F.coalesce("target_id", F.lit("")) != "")), ["target_id"], ["seq"])


def queue(feedback: DataFrame, decisions: DataFrame, version: str) -> DataFrame:
    """One row per target: problems, last seen, status and whether it is open.

    A target fixed in the next graph counts as fixed once the graph's version is another one than decided on; problems
    received after a decision open it again. Sort with :func:`queue_order`.
    """
    last = latest_decisions(decisions).select("target_id", F.col("status").alias("d_status"), F.col("graph_version").alias("d_version"), "decided_at")
    rows = feedback.join(last, "target_id", "left")
    bad = F.col("category") != "useful"
    late = F.col("decided_at").isNotNull() & (F.col("received_at") > F.col("decided_at")) & bad
    out = rows.groupBy("target_kind", "target_id").agg(
        *(F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES),
        F.count_if(bad).alias("problems"),
        F.count_if(late).alias("later"),
        F.max("received_at").alias("last_seen"),
        F.first("d_status").alias("d_status"),
        F.first("d_version").alias("d_version"),
    )
    changed = (F.lit(version) != "") & (F.col("d_version") != "") & (F.col("d_version") != version)
    status = F.when(F.col("d_status").isNull(), "new").when((F.col("d_status") == "fixed_in_next_graph") & changed, "fixed").otherwise(F.col("d_status"))
    return out.withColumn("status", status).withColumn("open", F.col("status").isin(*OPEN) | (F.col("later") > 0)).drop("d_status", "d_version")


def queue_order() -> list[Column]:
    """Open ones first, then by problems, then newest."""
    return [F.desc("open"), F.desc("problems"), F.desc("last_seen"), F.asc("target_kind"), F.asc("target_id")]


def admit(times: list[float], window: float = 60.0, most: int = PER_MINUTE, held: deque | None = None) -> list[bool]:
    """Which calls are accepted: fewer than ``most`` accepted ones in the last ``window`` seconds. Times ascend."""
    held = deque() if held is None else held
    out = []
    for t in times:
        while held and t - held[0] > window:
            held.popleft()
        ok = len(held) < most
        if ok:
            held.append(t)
        out.append(ok)
    return out


def rate_limited(events: DataFrame, key: str, time: str, order: str, window: float = 60.0, most: int = PER_MINUTE) -> DataFrame:
    """Batch form: adds ``accepted`` to the columns ``key, time, order``, by key in the order of time.

    Each key is a limiter of its own, as acceptance depends on every earlier call. Rows are sorted within partitions and
    streamed, so a task holds a batch and the accepted times of the last window, however many calls a key has. A null
    key is one limiter; a null time comes first and is never accepted.
    """
    kind = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = object(), deque()
        for batch in batches:
            keys, micros, out = batch.column(0).to_pylist(), batch.column(3).to_pylist(), []
            for k, t in zip(keys, micros):
                if k != current:
                    current, held = k, deque()
                out.append(t is not None and admit([t / 1e6], window, most, held)[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.bool_())], names=[key, time, order, "accepted"])

    rows = events.select(key, time, order, F.unix_micros(F.col(time).cast("timestamp")).alias("__micros"))
    rows = rows.repartition(F.col(key)).sortWithinPartitions(key, "__micros", order)
    return rows.mapInArrow(run, f"{key} {kind[key]}, {time} {kind[time]}, {order} {kind[order]}, accepted boolean")
