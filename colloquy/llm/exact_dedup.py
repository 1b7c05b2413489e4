"""Exact deduplication with a persistent digest index.

The index is a Parquet table in the shared folder, bucketed and sorted by digest.
New data is reduced to one row for each digest first (partial aggregation, so a
text that a third of all rows share costs one row a task), then anti-joined
against the index by sort-merge without shuffling the index, and what is new is
appended. ``compact`` makes one sorted file a bucket of what the batches appended,
with as many buckets as the rows by then ask for.

``deduplicated`` feeds a table to one index in batches of ascending ``doc_id``, so
that the smallest id of equal texts stays whichever batch it is in.

Defined results: null text counts as empty; a null ``doc_id`` never stays if the
group has another (null ids are the last batch); rows with equal ``doc_id`` and
text are one document and share the decision; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import all_salts, dealt_salt, dropped, fresh_path, table, text_or_empty, written
from colloquy.sources.commits import Log, names

SALTS = 16
#: Digests (of 40 bytes) for which a bucket is made.
BUCKET_ROWS = 4_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): 32 bytes instead of the text from here on."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text_or_empty()), 256)).alias("digest"))


def buckets_for(rows: int) -> int:
    return 1 << max(2, (-(-rows // BUCKET_ROWS) - 1).bit_length())


class DigestIndex:
    """Digests seen so far, with the id of the row that stays for each."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int = 4):
        """An index in the folder ``path``, known to this session as the table ``name``.

        The folder's log says where the rows are and how many buckets they have, so an
        index that is there already needs no more than its path.
        """
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or fresh_path(spark, "digest-index")
        self.log = Log(spark, self.path)
        self.version, state = self.log.latest()
        self.buckets, self.data = state.get("buckets", buckets), state.get("data")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)  # another session may have appended
        return self.spark.table(self.name)

    def attach(self) -> None:
        """Register the index as its log's latest version has it."""
        self.version, state = self.log.latest()
        self.buckets, self.data = state["buckets"], state["data"]
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # the table is external: files stay
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.data}'"
        )

    def _committed(self, data: str, buckets: int) -> None:
        if not self.log.commit(self.version + 1, {"data": data, "buckets": buckets}):
            raise RuntimeError("another session has changed the index; attach it anew")
        self.version, self.data, self.buckets = self.version + 1, data, buckets

    def _write(self, fresh: DataFrame, name: str, data: str, buckets: int) -> None:
        dealt = fresh.select("digest", "keep_id").repartition(buckets, "digest")
        dealt.write.format("parquet").option("path", data).mode("append").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)

    def append(self, fresh: DataFrame) -> None:
        """One sorted file for each bucket of this batch."""
        data = self.data or f"{self.path}/rows-{uuid.uuid4().hex}"
        self._write(fresh, self.name, data, self.buckets)
        if self.data is None:
            self._committed(data, self.buckets)

    def compact(self) -> None:
        """One sorted file for each bucket, in a new folder that the next version names; the old one stays for its readers (``vacuum``)."""
        rows = self.spark.read.schema("digest BINARY, keep_id BIGINT").parquet(self.data)
        buckets, data, made = buckets_for(rows.count()), f"{self.path}/rows-{uuid.uuid4().hex}", f"{self.name}_{uuid.uuid4().hex[:8]}"
        self._write(rows, made, data, buckets)
        self.spark.sql(f"DROP TABLE {made}")
        self._committed(data, buckets)
        self.attach()

    def vacuum(self) -> None:
        """Drop the rows of older versions, when no session reads them any more."""
        for name in names(self.spark, self.path):
            if name.startswith("rows-") and f"{self.path}/{name}" != self.data:
                dropped(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        dropped(self.spark, self.path)

    def add(self, groups: DataFrame) -> None:
        """Append the groups (digest, low_id) whose digest is new: a sort-merge anti-join."""
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti") if self.exists() else groups
        self.append(written(fresh.select("digest", F.col("low_id").alias("keep_id")), "digest-fresh"))

    def ingest(self, docs: DataFrame, batches: int = 1) -> DataFrame:
        """Add ``docs``; returns a row for each: doc_id, digest, keep_id, group_size, kept.

        A digest that the index has keeps the id it has there; of the others the
        smallest ``doc_id`` stays. ``group_size`` counts the rows of this call.
        """
        seen = written(digests(docs), "digests")
        grouped = lambda rows: rows.groupBy("digest").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("group_size"))
        cuts = seen.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
        if not self.exists():
            self.buckets = max(self.buckets, buckets_for(seen.count()))
        batch = F.lit(0)
        for cut in cuts or []:
            batch = batch + F.when(F.col("doc_id") <= cut, 0).otherwise(1)  # a null id is in the last batch
        for k in range(len(cuts or []) + 1):
            self.add(grouped(seen.where(batch == k)))
        settled = grouped(seen).join(self.rows().hint("merge"), "digest").where("group_size > 1 OR NOT keep_id <=> low_id")
        settled = written(settled.select("digest", "keep_id", "group_size"), "digest-settled")
        # only repeated digests come back, each under all salts; a row without one stays by itself
        right = settled.select("*", F.lit(True).alias("met"), all_salts(SALTS).alias("salt"))
        out = seen.withColumn("salt", dealt_salt(SALTS)).join(right, ["digest", "salt"], "left")
        keep = F.when(F.col("met"), F.col("keep_id")).otherwise(F.col("doc_id"))
        out = out.withColumn("keep_id", keep).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
        return out.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def deduplicated(docs: DataFrame, batches: int = 3) -> DataFrame:
    """``docs`` through a new index in ``batches`` of ascending id; the index goes when all is settled."""
    index = DigestIndex(docs.sparkSession)
    out = index.ingest(docs, batches)
    index.drop()
    return out


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
