"""Streaming admission control and an append-only event log."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftgraph.operators.feedback import PER_MINUTE, admit


class SlidingLimiter(StatefulProcessor):
    """Accepted times of each key in a list state; only accepted calls occupy the window, so it holds ``most`` at most."""

    def __init__(self, window: float = 60.0, most: int = PER_MINUTE):
        self.window, self.most = window, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "seconds double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = deque(r[0] for r in self.held.get()) if self.held.exists() else deque()
        batch = pd.concat(list(rows)).sort_values(["seconds", "id"], kind="stable")
        ok = admit(batch["seconds"].tolist(), self.window, self.most, held)
        if held:
            self.held.put([(x,) for x in held])
        else:
            self.held.clear()
        yield pd.DataFrame({"key": [str(key[0])] * len(batch), "id": batch["id"].tolist(), "accepted": ok})

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, key: str, time: str, id_col: str, window: float = 60.0, most: int = PER_MINUTE) -> DataFrame:
    """``key, id, accepted`` of a streaming ``events``."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("bigint").alias("id"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("seconds"))
    return rows.groupBy("key").transformWithStateInPandas(SlidingLimiter(window, most), outputStructType="key string, id bigint, accepted boolean", outputMode="Append", timeMode="None")


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Write a stream to an append-only JSON-lines log; started, with all available data."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind under a watermark; for batch and streaming input."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(kind)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
