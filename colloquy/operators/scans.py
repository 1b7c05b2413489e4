"""Sequential rules over long sequences: chunks are folded apart, a small pass carries the state across.

A window over a whole sequence (a meeting) is one task, however long. Here rows carry
the number of a chunk of their axis, windows go over (sequence, chunk), each chunk gives
one row that says what the next has to know, and a window over these few rows carries
it along. The rows then take what was carried into their chunk. Chunks follow from the
axis alone, so nothing is sampled or counted beforehand.

Without a ``width`` a sequence is one chunk: plain windows, one task a sequence, nothing
carried. With one, rows are written before they are used twice, so that the plan of
several rules one after the other doesn't double with each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.sources.store import written

BEFORE = (W.unboundedPreceding, -1)
SO_FAR = (W.unboundedPreceding, 0)
CHUNK = "_chunk"


class Chunks:
    """Sequences ``by`` in ``order``, whose first column is the axis; ``width`` of it makes a chunk (None: one chunk)."""

    def __init__(self, by: str, order: list[str], width=None):
        self.by, self.order, self.width = by, order, width

    def cut(self, df: DataFrame) -> DataFrame:
        at = F.lit(0) if self.width is None else F.floor(F.col(self.order[0]) / self.width)
        return df.withColumn(CHUNK, at.cast("long"))

    def window(self, *more: str):
        """Over the rows of a chunk (and ``more``) in order."""
        return W.partitionBy(self.by, CHUNK, *more).orderBy(*self.order)

    def place(self) -> Column:
        """What orders the rows of a chunk in an aggregate."""
        return F.struct(*self.order)

    def carried(self, df: DataFrame, says: list[Column], carry: Callable, columns: list[str]) -> DataFrame:
        """``df`` with ``columns`` that ``carry(rows, window)`` makes of the chunks' rows of ``says``; null in a sequence's first chunk."""
        df = df if self.width is None else written(df, "scan-rows")
        chunks = carry(df.groupBy(self.by, CHUNK).agg(*says), W.partitionBy(self.by).orderBy(CHUNK))
        if self.width is None:
            kinds = {f.name: f.dataType for f in chunks.schema.fields}
            return df.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in columns])
        some = chunks.select(F.col(self.by).alias("_by"), F.col(CHUNK).alias("_at"), *columns)
        return df.join(some, F.col(self.by).eqNullSafe(F.col("_by")) & (F.col(CHUNK) == F.col("_at"))).drop("_by", "_at")

    def islands(self, df: DataFrame, new: Column, name: str, parts: list[Column], whole: list[Column]) -> DataFrame:
        """One row for each island: ``new`` is true where one begins; numbers count through the sequence.

        ``parts`` aggregates an island's rows within a chunk, ``whole`` the parts of one
        island. Rows before a chunk's first beginning belong to the island that is open there.
        """
        local = df.withColumn("_island", F.sum(F.when(new, 1).otherwise(0)).over(self.window().rowsBetween(*SO_FAR)))
        local = local if self.width is None else written(local, "scan-islands")
        pieces = local.groupBy(self.by, CHUNK, "_island").agg(*parts)
        if self.width is None:
            return pieces.groupBy(self.by, CHUNK, "_island").agg(*whole).drop(CHUNK).withColumnRenamed("_island", name)
        ends = local.groupBy(self.by, CHUNK).agg(F.max("_island").alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy(self.by).orderBy(CHUNK).rowsBetween(*BEFORE)), F.lit(0))
        ends = ends.select(F.col(self.by).alias("_by"), F.col(CHUNK).alias("_at"), before.alias("_before"))
        joined = pieces.join(ends, F.col(self.by).eqNullSafe(F.col("_by")) & (F.col(CHUNK) == F.col("_at")))
        return joined.groupBy(self.by, (F.col("_island") + F.col("_before")).alias(name)).agg(*whole)
