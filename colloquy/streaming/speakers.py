"""Online clustering of voice windows as a stream: the state of a meeting is its centroids.

Windows of a meeting may come late by ``late``; they wait in the state until the
watermark has passed them and are then taken in the order of (ts, idx), so the labels
are those of ``clustering.sequential`` over the whole. When ``idle`` has passed without
a window, the meeting's state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.operators.clustering import Online
from colloquy.shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = "meeting_id string, idx long, speaker_id int"


class Speakers(StatefulProcessor):
    def __init__(self, at_least: float, pull: float, idle_ms: int):
        self.at_least, self.pull, self.idle_ms = at_least, pull, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, idx long, embedding binary")
        self.centroids = handle.getValueState("centroids", "size int, centroids binary")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        for frame in rows:
            got = [(int(ms), int(i), np.asarray(v, np.float64).tobytes()) for ms, i, v in zip(frame["ms"], frame["idx"], frame["embedding"], strict=True)]
            self.waiting.appendList(got)
            # one timer for all that wait: when it is due, the next one is set
            self.handle.registerTimer(min(g[0] for g in got))
            last = max(last, *[g[0] for g in got])
        self.last.update((last,))
        self.handle.registerTimer(last + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        due = [w for w in waiting if w[0] <= now]
        if due:
            size, raw = self.centroids.get() if self.centroids.exists() else (0, b"")
            online = Online(self.at_least, self.pull, np.frombuffer(raw, np.float64).reshape(size, -1) if size else None)
            labels = [online.take(np.frombuffer(v, np.float64)) for _, _, v in due]
            self.centroids.update((len(online.centroids), online.centroids.tobytes()))
            if len(due) < len(waiting):
                self.waiting.put(waiting[len(due) :])
                self.handle.registerTimer(waiting[len(due)][0])
            else:
                self.waiting.clear()
            yield pd.DataFrame({"meeting_id": key[0], "idx": [i for _, i, _ in due], "speaker_id": np.array(labels, np.int32)})
        if self.last.exists() and self.last.get()[0] + self.idle_ms <= now and len(due) == len(waiting):
            for state in (self.waiting, self.centroids, self.last):
                state.clear()

    def close(self) -> None:
        pass


def clustered(windows: DataFrame, at_least: float = 0.8, pull: float = 0.2, late: str = "10 seconds", idle_seconds: int = 3600) -> DataFrame:
    """(meeting_id, idx, speaker_id) of a stream of windows (meeting_id, idx, ts, embedding)."""
    spark = windows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    w = windows.withWatermark("ts", late).select("ts", F.col("meeting_id").cast("string").alias("meeting_id"), F.col("idx").cast("long").alias("idx"), F.unix_millis("ts").alias("ms"), F.col("embedding").cast("array<double>").alias("embedding"))
    return w.groupBy("meeting_id").transformWithStateInPandas(Speakers(at_least, pull, idle_seconds * 1000), FIELDS, "Append", "EventTime")
