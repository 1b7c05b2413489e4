"""Incremental vector index: chunk, leave out what is indexed, embed, upsert, count; errors stay with their meeting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.documents import chunk_meetings, delete_meeting, upsert
from colloquy.operators.models import BATCH, DELAYS, Embed, hashed_vectors, with_retries
from colloquy.shipping import ship
from colloquy.sources.store import written
from colloquy.sources.vector_table import FIELDS as INDEX
from colloquy.sources.vector_table import VectorTable

CHUNK = "chunk_id string, meeting_id string, source_type string, chunk_index int, text string, content_hash string"


def fresh_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``known``: whether the meeting's index has the chunk's hash."""
    seen = index.select("meeting_id", "content_hash").distinct().withColumn("known", F.lit(True))
    return chunks.join(seen, ["meeting_id", "content_hash"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def embedded_by_meeting(fresh: DataFrame, embed: Embed, batch: int, delays) -> DataFrame:
    """Adds ``embedding`` and ``error``: what the model raises for a meeting's texts is the error of that meeting alone.

    Rows come sorted by meeting, so a meeting's texts go to the model together
    (at most ``batch`` at once); a meeting may go on in the next Arrow batch.
    """

    ship(fresh.sparkSession)

    def one(texts: list[str]) -> tuple[list, str | None]:
        vectors: list = [None] * len(texts)
        wanted = [i for i, t in enumerate(texts) if t and t.strip()]
        try:
            for k in range(0, len(wanted), batch):
                part = wanted[k : k + batch]
                for i, v in zip(part, with_retries([lambda part=part: embed([texts[i] for i in part])], delays=delays), strict=False):
                    vectors[i] = v
        except Exception as e:
            return [None] * len(texts), str(e)
        return vectors, None

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, part in f.groupby("meeting_id", sort=False, dropna=False):
                vectors, error = one(part["text"].tolist())
                yield part.assign(embedding=pd.Series(vectors, index=part.index, dtype=object), error=error)

    dealt = fresh.select([c.split()[0] for c in CHUNK.split(", ")]).repartition("meeting_id").sortWithinPartitions("meeting_id", "source_type", "chunk_index")
    return dealt.mapInPandas(task, f"{INDEX}, error string")


def fresh_rows(meetings: DataFrame, index: DataFrame, embed: Embed, batch: int, delays, chunks: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(new rows, result): chunks and vectors are written once, so storing, counting and errors read the same answers of the model."""
    chunks = written(fresh_chunks(chunk_meetings(meetings) if chunks is None else chunks, index), "chunks")
    got = written(embedded_by_meeting(chunks.where("NOT known"), embed, batch, delays), "embedded")
    failed = got.groupBy("meeting_id").agg(F.max("error").alias("error"))
    stored = got.join(failed.where("error IS NOT NULL").select("meeting_id"), "meeting_id", "left_anti").where("embedding IS NOT NULL")
    stored = stored.select([c.split()[0] for c in INDEX.split(", ")])
    counts = chunks.groupBy("meeting_id").agg(F.count_if("known").alias("skipped"))
    done = stored.groupBy("meeting_id").agg(F.count("*").alias("indexed"))
    result = counts.join(done, "meeting_id", "left").join(failed, "meeting_id", "left").withColumn("indexed", F.coalesce("indexed", F.lit(0).cast("long")))
    return stored, result.select("meeting_id", "indexed", "skipped", "error", (F.col("indexed") > 0).alias("processed"))


def index_meetings(meetings: DataFrame, index: DataFrame, embed: Embed = hashed_vectors, batch: int = BATCH, delays=DELAYS, chunks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new index, result) after adding ``meetings`` (meeting_id, transcript, summary, decisions, tasks).

    The result has a row for each meeting with chunks: indexed, skipped, error and
    ``processed`` (whether anything was indexed). A chunk without a vector isn't
    stored; a meeting with an error stores none of its new chunks. The model is asked
    once for each new chunk, when this is called.
    """
    stored, result = fresh_rows(meetings, index, embed, batch, delays, chunks)
    return upsert(index.select(stored.columns), stored), result


def index_into(kept: VectorTable, meetings: DataFrame, embed: Embed = hashed_vectors, batch: int = BATCH, delays=DELAYS, chunks: DataFrame | None = None) -> DataFrame:
    """As ``index_meetings``, into a stored table; returns the result."""
    stored, result = fresh_rows(meetings, kept.hashes(), embed, batch, delays, chunks)
    kept.upsert(stored)
    return result


def reindex_meeting(meetings: DataFrame, index: DataFrame, meeting_id: str, embed: Embed = hashed_vectors, **how) -> tuple[DataFrame, DataFrame, int]:
    """(new index, result, rows deleted): all of a meeting's vectors go, then it is indexed anew."""
    deleted = index.where(F.col("meeting_id") == meeting_id).count()
    new, result = index_meetings(meetings.where(F.col("meeting_id") == meeting_id), delete_meeting(index, meeting_id), embed, **how)
    return new, result, deleted


def reindex_into(kept: VectorTable, meetings: DataFrame, meeting_id: str, embed: Embed = hashed_vectors, **how) -> tuple[DataFrame, int]:
    """(result, rows deleted) of re-indexing one meeting of a stored table."""
    deleted = kept.delete_meeting(meeting_id)
    return index_into(kept, meetings.where(F.col("meeting_id") == meeting_id), embed, **how), deleted
