"""A stored table of chunk vectors: upserts, deletes with a count, versions.

Rows lie in Parquet files by a hash bucket of their meeting. An upsert or a delete
writes the buckets that it touches anew, under a name of its own, and puts the next
version of the manifest in place, which names the folder of each bucket. Whoever
reads, reads one version: its files don't change. Of two writers that touch the same
bucket the later one applies its rows to what the earlier one left.

Defined results: of several fresh rows with one ``chunk_id`` the last by ``order``
stays, of equally late ones that of the greatest hash and text; a null
``meeting_id`` is a meeting like others; an empty upsert and the deletion of an
unknown meeting make no version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.sources.commits import Log, delete, names

FIELDS = "chunk_id string, meeting_id string, source_type string, chunk_index int, text string, content_hash string, embedding array<double>"
#: Tries of a writer that others keep overtaking.
TRIES = 20
#: Files that a bucket is written as, at most.
FILES = 8


class VectorTable:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        """``buckets`` counts for a new table; one that is there keeps its own."""
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Log(spark, folder.rstrip("/"))
        self.buckets = self.log.latest()[1].get("buckets", buckets)

    def bucket_of(self, meeting: Column) -> Column:
        return F.pmod(F.xxhash64(meeting), F.lit(self.buckets)).cast("int")

    def rows(self, meeting_id: str | None = None, version: int | None = None) -> DataFrame:
        """The vectors of the latest (or a kept) version, or of one meeting, for which one bucket is read."""
        at = self._paths((self.log.latest()[1] if version is None else self.log.read(version)).get("at", {}))
        if meeting_id is None:
            return self._read(list(at.values()))
        b = self._bucket(meeting_id)
        return self._read([at[b]] if b in at else []).where(F.col("meeting_id") == meeting_id)

    def _bucket(self, meeting_id: str | None) -> str:
        return str(self.spark.range(1).select(self.bucket_of(F.lit(meeting_id).cast("string"))).first()[0])

    def _paths(self, at: dict) -> dict:
        return {b: f"{self.folder}/data/{write}/bucket={b}" for b, write in at.items() if write}

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(FIELDS).parquet(*paths) if paths else self.spark.createDataFrame([], FIELDS)

    def count(self, meeting_id: str | None = None) -> int:
        return self.rows(meeting_id).count()

    def hashes(self, meeting_id: str | None = None) -> DataFrame:
        return self.rows(meeting_id).select("meeting_id", "content_hash").distinct()

    def _rewrite(self, touched: list[str], change) -> None:
        """Make a version in which ``change`` has been applied to the rows of the ``touched`` buckets."""
        seen, write = None, None
        for _ in range(TRIES):
            number, state = self.log.latest()
            at = state.get("at", {})
            now = {b: at.get(b) for b in touched}
            if seen != now:  # another writer was there: what was prepared is of no use
                if write:
                    delete(self.spark, f"{self.folder}/data/{write}")
                seen, write = now, uuid.uuid4().hex
                paths = self._paths(now)
                new = change(self._read(list(paths.values()))).withColumn("bucket", self.bucket_of(F.col("meeting_id")))
                part = F.pmod(F.xxhash64("chunk_id"), F.lit(FILES))
                new.repartition("bucket", part).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/data/{write}")
                made = {n.partition("=")[2] for n in names(self.spark, f"{self.folder}/data/{write}") if n.startswith("bucket=")}
            fresh = {**at, **{b: write if b in made else None for b in touched}}
            if self.log.commit(number + 1, {"buckets": self.buckets, "at": {b: w for b, w in fresh.items() if w}}):
                return
        raise RuntimeError(f"{TRIES} versions came in between")

    def upsert(self, fresh: DataFrame, order: str | None = None) -> None:
        """Store rows by ``chunk_id``. ``fresh`` is read twice, so give a written table."""
        touched = [str(r["b"]) for r in fresh.select(self.bucket_of(F.col("meeting_id")).alias("b")).distinct().collect()]  # a row a bucket
        last = [F.desc(order)] if order else []
        rank = F.row_number().over(W.partitionBy("chunk_id").orderBy(*last, F.desc("content_hash"), F.desc("text")))
        once = fresh.withColumn("_rank", rank).where("_rank = 1").select([f.strip().split()[0] for f in FIELDS.split(", ")])
        if touched:
            # a chunk's id begins with its meeting, so what it replaces is in its own bucket
            self._rewrite(sorted(touched), lambda old: old.join(once.select("chunk_id"), "chunk_id", "left_anti").unionByName(once))

    def delete_meeting(self, meeting_id: str) -> int:
        """Drop a meeting's vectors; returns how many there were."""
        n = self.rows(meeting_id).count()
        if n:
            self._rewrite([self._bucket(meeting_id)], lambda old: old.where(~F.col("meeting_id").eqNullSafe(F.lit(meeting_id))))
        return n

    def vacuum(self, keep: int = 2) -> int:
        """Drop data that none of the last ``keep`` versions has; returns how many writes went. Run it when no older reader is left."""
        numbers = self.log.numbers()[-keep:]
        used = {w for n in numbers for w in self.log.read(n).get("at", {}).values()}
        gone = [w for w in names(self.spark, f"{self.folder}/data") if w not in used]
        self.log.forget(numbers[0] if numbers else 0)
        for w in gone:
            delete(self.spark, f"{self.folder}/data/{w}")
        return len(gone)
