"""Structured Streaming forms of the time operators (extensions of the batch ones).

Windows come out in append mode: a window is written once, when the watermark has
passed its end, and its state goes. Rows behind the watermark are dropped, and the run
says how many there were. The sink writes a folder for each batch number, so a batch
that is repeated after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.tables import table

#: How long after an event earlier ones still count.
LATE = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def in_parts(rows: DataFrame, at: str = "ts", parts: int = 4) -> list[DataFrame]:
    """``rows`` cut into ``parts`` of about as many rows, in the order of ``at``."""
    cuts = rows.agg(F.percentile_approx(F.unix_micros(at), [k / parts for k in range(1, parts)])).first()[0] or []
    micros, low, out = F.unix_micros(at), None, []
    for high in [*cuts, None]:
        part = rows if low is None else rows.where(micros > low)
        out.append(part if high is None else part.where(micros <= high))
        low = high
    return out


def staged(rows: DataFrame, folder: str, at: str = "ts", parts: int = 4) -> DataFrame:
    """Few ``rows`` as a file stream of ``parts`` batches in the order of ``at``: each is one file, written when the one before is there."""
    for part in in_parts(rows, at, parts):
        part.coalesce(1).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("w_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """A user's turns as sessions that a gap ends."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("s_start"), F.col("w.end").alias("s_end"), "n")


@dataclass
class Run:
    """What a run over all that is there has written, and its batches: (batch, rows, state_rows, late)."""

    rows: DataFrame
    batches: list[tuple[int, int, int, int]]

    def late(self) -> int:
        return sum(b[3] for b in self.batches)


#: Whether a batch without rows follows when the watermark has moved.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def appended(stream: DataFrame, folder: str, ends: bool = True) -> Run:
    """Run a stream over all that is there, in append mode; called again with the same folder, it goes on from the checkpoint.

    A batch's rows are in a folder of its number, which a repeated batch overwrites.
    If more is to come (``ends`` is false), what the watermark has passed last is written by the next run.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, before if ends else "false")
    try:
        run = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(NO_DATA, before)
    run.awaitTermination()
    told = [p for p in run.recentProgress if p["stateOperators"] or p["numInputRows"]]
    batches = [(p["batchId"], p["numInputRows"], sum(s["numRowsTotal"] for s in p["stateOperators"]), sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])) for p in told]
    return Run(spark.read.schema(stream.schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").select(stream.columns), batches)


def fed(rows: DataFrame, through: Callable[[DataFrame], DataFrame], folder: str, at: str = "ts", parts: int = 4) -> Run:
    """What the stream ``through`` makes of ``rows`` that come in ``parts``, in the order of ``at``.

    Many tasks write a part. The run goes on from its checkpoint when all of the part
    is there, so that one batch takes it whole and no row of it is behind the watermark.
    """
    spark, come, batches = rows.sparkSession, in_parts(rows, at, parts), []
    for k, part in enumerate(come, 1):
        part.write.mode("append").parquet(f"{folder}/in")
        run = appended(through(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")), folder, k == len(come))
        batches += run.batches
    return Run(run.rows, batches)
