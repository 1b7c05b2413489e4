"""Prefix join by sorted ranges: a prefix is an interval of the sorted names.

Names and the two ends of each prefix's interval are sorted together; the number of
names before an end is its rank, so how many names a prefix has is the difference of
two ranks, and which they are is an equality of ranks. No name is compared with a
prefix, and a short prefix costs no more than a long one until its pairs are asked for.

Order is that of the UTF-8 bytes; an interval ends at the prefix with the byte 0xFF
after it, which no text has. Defined results: null names and prefixes match nothing,
the empty prefix every name; equal names count each; equal prefixes are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators.scans import BEFORE, SO_FAR
from colloquy.sources.store import written

LOW, NAME, HIGH = 0, 1, 2


def ranked(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(key, kind, name, prefix, rank): names with their rank from 1, ends of prefixes with the number of names before them.

    Rows are dealt out by range, so that each task has a stretch of the order, and
    written; what a stretch has to know is the number of names in those before it.
    """
    raw = lambda c: F.encode(F.col(c), "UTF-8")
    none = F.lit(None).cast("string")
    once = prefixes.select("prefix").where("prefix IS NOT NULL").distinct()
    ends = F.explode(F.array(F.struct(raw("prefix").alias("key"), F.lit(LOW).alias("kind")), F.struct(F.concat(raw("prefix"), F.unhex(F.lit("FF"))).alias("key"), F.lit(HIGH).alias("kind"))))
    rows = names.where("name IS NOT NULL").select(raw("name").alias("key"), F.lit(NAME).alias("kind"), "name", none.alias("prefix"))
    rows = rows.unionByName(once.select(ends.alias("e"), "prefix").select("e.key", "e.kind", none.alias("name"), "prefix"))
    dealt = written(rows.repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()), "sorted-names")
    is_name = F.when(F.col("kind") == NAME, 1).otherwise(0)
    before = dealt.groupBy("part").agg(F.sum(is_name).alias("n"))
    before = before.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(*BEFORE)), F.lit(0)).alias("before"))  # a row a task
    within = F.sum(is_name).over(W.partitionBy("part").orderBy("key", "kind").rowsBetween(*SO_FAR))
    return dealt.withColumn("within", within).join(before, "part").select("kind", "name", "prefix", (F.col("within") + F.col("before")).alias("rank"))


def intervals(ranks: DataFrame) -> DataFrame:
    """(prefix, low, high): the names of ranks low + 1 to high begin with the prefix."""
    ends = ranks.where(F.col("kind") != NAME)
    return ends.groupBy("prefix").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))


def prefix_counts(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, n): how many ``names`` (name) begin with each of ``prefixes`` (prefix); no pairs are made."""
    return intervals(ranked(names, prefixes)).select("prefix", (F.col("high") - F.col("low")).cast("long").alias("n"))


def prefix_pairs(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, name) of all matches, by equality of ranks; equal names come as often as they stand in ``names``."""
    ranks = written(ranked(names, prefixes), "ranked-names")
    wanted = intervals(ranks).where("high > low").select("prefix", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("rank"))
    return wanted.join(ranks.where(F.col("kind") == NAME).select("rank", "name"), "rank").select("prefix", "name")
