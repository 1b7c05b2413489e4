"""Range sharding by sampled splitters. DataFrame and SQL functions only.

Law: ``bytes``. The key is a hash of the text, so equal texts (a group) lie next
to each other; of keys weighted by size a bounded sample is drawn and its
quantiles are the splitters of many narrow ranges, whose exact sizes are then
counted over all rows. A range above its share is subdivided: its small groups by
another hash of the key, which keeps each together, and a single group that is
above a share by itself (a text that a third of all rows have) by the number that
each row got when the keys were written. The cells in order are dealt to the
shards by their running size.

The driver holds the splitters, one (bytes, rows) pair for each cell and the
groups above a share (no more than there are shares). Their number follows from
the number of ranges, which grows with the rows up to ``most_ranges`` a shard.

Defined results: a null text has size 8 and a null ``text_crc32``; rows that
repeat a ``doc_id`` each get a slot; null ids are ordinary rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import table, written

#: Bytes of a record besides its text.
OVERHEAD = 8


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, row): all that sharding needs; the text is read once."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode("text", "utf-8")).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def splitters(rows: DataFrame, total: int, ranges: int, per_range: int = 16) -> list[int]:
    """Quantiles of a size-weighted key sample of about ``ranges * per_range`` keys.

    A row is drawn with the chance size * rate (a hash of its id and size decides,
    so a repeated run draws the same rows); larger rows count by their weight.
    """
    rate = ranges * per_range / max(total, 1)
    u = F.pmod(F.xxhash64(F.lit(17), "doc_id", "size"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(u < F.col("size") * F.lit(rate)).select("key", F.greatest(F.lit(1.0), F.col("size") * F.lit(rate)).alias("w"))
    sample = sorted(drawn.groupBy("key").agg(F.sum("w").alias("w")).limit(8 * ranges * per_range).collect())
    running = list(accumulate(w for _, w in sample))
    if not running:
        return []
    cuts = [bisect.bisect_left(running, running[-1] * i / ranges) for i in range(1, ranges)]
    return sorted({sample[i][0] for i in cuts})


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of splitters at or below ``key``: a binary search over one literal array."""
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(b) for b in bounds])
    top = 1 << (len(bounds).bit_length() - 1)
    steps = F.array(*[F.lit(top >> i) for i in range(len(bounds).bit_length())])
    n = len(bounds)

    def step(lo: Column, s: Column) -> Column:
        at = lo + s
        return F.when((at <= n) & (F.element_at(arr, F.least(at, F.lit(n))) <= key), at).otherwise(lo)

    return F.aggregate(steps, F.lit(0), step)


def shard(docs: DataFrame, shards: int, ranges_per_shard: int = 64, most_ranges: int = 2048, rows_per_range: int = 1_000_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), slots gapless from 0 in each shard."""
    rows = written(measured(docs), "shard-rows")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = shards * min(most_ranges, max(ranges_per_shard, n_rows // (shards * rows_per_range)))
    bounds = splitters(rows, total, ranges)
    rows = written(rows.withColumn("range", range_of(F.col("key"), bounds)), "shard-ranges")
    share, n_ranges = max(1, total // ranges), len(bounds) + 1
    got = {r["range"]: r["b"] for r in rows.groupBy("range").agg(F.sum("size").alias("b")).collect()}
    over = [got.get(r, 0) > 2 * share for r in range(n_ranges)]
    lookup = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    # groups above a share are cells of their own, cut by row; their number is at most total / share
    heavy = rows.where(lookup(over, F.col("range"))).groupBy("key").agg(F.sum("size").alias("b"), F.first("range").alias("range")).where(F.col("b") > share)
    heavy = sorted((r["key"], r["range"], r["b"]) for r in heavy.collect())
    for _, r, b in heavy:
        got[r] -= b
    cuts = [max(1, -(-got.get(r, 0) // share)) if over[r] else 1 for r in range(n_ranges)]
    heavy_cuts = [-(-b // share) for _, _, b in heavy]
    # a range's own cells come first, then those of its heavy groups, range by range
    first, heavy_first, at, k = [], [], 0, sorted(range(len(heavy)), key=lambda i: (heavy[i][1], heavy[i][0]))
    heavy_first = [0] * len(heavy)
    for r in range(n_ranges):
        first.append(at)
        at += cuts[r]
        while k and heavy[k[0]][1] == r:
            heavy_first[k[0]] = at
            at += heavy_cuts[k.pop(0)]
    cell = lookup(first, F.col("range")) + F.pmod(F.xxhash64(F.lit(3), "key"), lookup(cuts, F.col("range"))).cast("int")
    if heavy:
        known = docs.sparkSession.createDataFrame([(x[0], f, c) for x, f, c in zip(heavy, heavy_first, heavy_cuts, strict=True)], "key long, heavy int, ways int")
        rows = rows.join(F.broadcast(known), "key", "left")
        cell = F.when(F.col("heavy").isNull(), cell).otherwise(F.col("heavy") + F.pmod(F.xxhash64("row"), F.col("ways")).cast("int"))
    rows = rows.withColumn("cell", cell)
    cells = {r["cell"]: (r["b"], r["n"]) for r in rows.groupBy("cell").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    to_shard, base, taken, before = [], [], [0] * shards, 0
    for c in range(at):
        b, n = cells.get(c, (0, 0))
        s = min(shards - 1, (2 * before + b) * shards // (2 * total)) if total else 0
        to_shard.append(s)
        base.append(taken[s])
        taken[s] += n
        before += b
    within = F.row_number().over(W.partitionBy("cell").orderBy("key", "doc_id", "row"))
    out = rows.withColumn("within", within)
    return out.select("doc_id", "size", "text_crc32", lookup(to_shard, F.col("cell")).alias("shard"), (lookup(base, F.col("cell")).cast("long") + F.col("within") - 1).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
