"""Average linkage of a large meeting, spread over tasks.

Clusters are rows (sum of unit vectors, size); the mean distance of two of them is
1 - (sum . sum) / (size * size). In each round every cluster's nearest neighbour is
known, and all pairs that are each other's nearest merge at once: a merge is never
nearer to a third cluster than its nearer part was, so this gives the clusters of the
greedy order. Only clusters that merged, or whose neighbour did, look for a neighbour
again, in blocks as matrix products; a task holds two blocks.

Work grows with the square of a meeting's windows, memory with a block. Distances are
rounded to 12 places, and of equally near neighbours the smaller number is taken, so
that there is always a pair to merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.shipping import ship
from colloquy.sources.commits import delete
from colloquy.sources.store import scratch

#: Clusters of a block.
BLOCK = 1024
NEAR = "meeting_id string, cid long, d double, other long"


def matrix(sums: pa.Array) -> np.ndarray:
    return sums.flatten().to_numpy().reshape(len(sums), -1)


def nearest(queries: DataFrame, clusters: DataFrame) -> DataFrame:
    """(meeting_id, cid, d, other): the nearest cluster of each of ``queries`` among all ``clusters`` of its meeting."""
    ship(clusters.sparkSession)
    blocks = clusters.groupBy("meeting_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    row = F.struct("cid", "size", "total")

    def packed(rows: DataFrame, name: str) -> DataFrame:
        dealt = rows.join(blocks, "meeting_id").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
        return dealt.groupBy("meeting_id", "block").agg(F.array_sort(F.collect_list(row)).alias(name), F.first("blocks").alias("blocks"))

    # each block of queries meets each block of its meeting under a key of its own
    qs = packed(queries, "qs").select("meeting_id", "qs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    pairs = qs.join(packed(clusters, "cs").drop("blocks"), ["meeting_id", "block"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for meeting, q, c in zip(b.column("meeting_id"), b.column("qs"), b.column("cs"), strict=True):
                (qi, qn, qx), (ci, cn, cx) = ((x.values.field("cid").to_numpy(), x.values.field("size").to_numpy(), matrix(x.values.field("total"))) for x in (q, c))
                d = np.round(1 - (qx @ cx.T) / np.outer(qn, cn), 12)
                d[qi[:, None] == ci[None, :]] = np.inf
                at = d.argmin(1)  # blocks are in order of their numbers: the smallest of equals
                least = d[np.arange(len(qi)), at]
                some = np.isfinite(least)
                yield pa.RecordBatch.from_arrays([pa.array([meeting.as_py()] * int(some.sum()), pa.string()), pa.array(qi[some]), pa.array(least[some]), pa.array(ci[at][some])], names=["meeting_id", "cid", "d", "other"])

    found = pairs.select("meeting_id", "qs", "cs").mapInArrow(task, NEAR)
    return found.groupBy("meeting_id", "cid").agg(F.min(F.struct("d", "other")).alias("b")).select("meeting_id", "cid", "b.d", "b.other")


class Tables:
    """Tables that replace one another, each below the shared folder."""

    def __init__(self, spark):
        self.spark, self.paths, self.replaced = spark, {}, []

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        if name in self.paths:
            self.replaced.append(self.paths[name])
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self) -> None:
        """Drop what has been replaced."""
        for path in self.replaced:
            delete(self.spark, path)
        self.replaced = []


def linked(windows: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """(members (meeting_id, idx, cid), clusters (meeting_id, cid, total, size)) of unit vectors (meeting_id, idx, unit); ``cid`` is the smallest ``idx`` of the cluster."""
    spark = windows.sparkSession
    t = Tables(spark)
    clusters = t.put("clusters", windows.select("meeting_id", F.col("idx").alias("cid"), F.col("unit").alias("total"), F.lit(1).cast("long").alias("size")))
    near = t.put("neighbours", nearest(clusters, clusters))
    links = None
    while True:
        back = near.select("meeting_id", F.col("cid").alias("other"), F.col("other").alias("cid"))
        pairs = t.put("merges", near.where((F.col("d") <= limit) & (F.col("cid") < F.col("other"))).join(back, ["meeting_id", "cid", "other"]).select("meeting_id", F.col("cid").alias("low"), F.col("other").alias("high")))
        if pairs.isEmpty():
            break
        links = t.put("links", pairs if links is None else links.unionByName(pairs))
        into = pairs.select("meeting_id", F.col("high").alias("cid"), "low")
        moved = clusters.join(into, ["meeting_id", "cid"], "left").withColumn("cid", F.coalesce("low", "cid"))
        added = F.aggregate(F.slice(F.collect_list("total"), 2, 1), F.first("total"), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        clusters = t.put("clusters", moved.groupBy("meeting_id", "cid").agg(added.alias("total"), F.sum("size").alias("size")))
        touched = pairs.select("meeting_id", F.explode(F.array("low", "high")).alias("cid"))
        lost = touched.withColumnRenamed("cid", "other")
        stays = near.join(touched, ["meeting_id", "cid"], "left_anti").join(lost, ["meeting_id", "other"], "left_anti").select("meeting_id", "cid", "d", "other")
        near_now = stays.unionByName(nearest(clusters.join(stays, ["meeting_id", "cid"], "left_anti"), clusters))
        near = t.put("neighbours", near_now)
        t.forget()
    return members(windows, links), clusters


def members(windows: DataFrame, links: DataFrame | None) -> DataFrame:
    """Follow the merges from each window to its cluster, in doubling steps."""
    rows = windows.select("meeting_id", "idx")
    if links is None:
        return rows.withColumn("cid", F.col("idx"))
    t = Tables(windows.sparkSession)
    now = links.select("meeting_id", F.col("high").alias("idx"), F.col("low").alias("to"))
    while True:
        on = now.select("meeting_id", F.col("idx").alias("to"), F.col("to").alias("further"))
        step = t.put("ways", now.join(on, ["meeting_id", "to"], "left").select("meeting_id", "idx", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        now = step.select("meeting_id", "idx", "to")
        if step.where("moved").isEmpty():
            return rows.join(now, ["meeting_id", "idx"], "left").select("meeting_id", "idx", F.coalesce("to", "idx").alias("cid"))
