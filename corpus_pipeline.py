"""Corpus pipeline: language ID, line dedup, near duplicates, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's rows as Parquet to the shared folder and rereads them for the
next, so a lost executor repeats one stage's tasks at most. All stages but the
last return the columns of ``documents``; the last adds the ids and the decoded
text to the ids of the documents that are left.

Defined results, all stages: an empty table gives an empty table; extra columns
stay; rows that repeat a ``doc_id`` are told apart by their text, and rows that are
equal in both share their fate; a null ``doc_id`` is an id like others. By stage: a
null or letterless text goes in the language stage; of ties in the near-duplicate
stage the least ``doc_id`` stays, then the smaller hash of the text, and null ids
only where no member has an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontamination, language_id, line_dedup, ngram_join, sentencepiece_rounds
from colloquy.llm.common import alone, fewer_than, table, unused, written

#: A document whose best language leads by less than this is in no language for sure: of held-out
#: texts below it (6 of 10,000 at sf0.1: fragments of a word or two, mixed texts) 4 were named rightly.
LEAST_MARGIN = 0.05
#: Rows (of 16 bytes) up to which the list of documents to drop is sent along; beyond it both sides are shuffled.
BROADCAST_ROWS = 2_000_000

# SentencePiece encoding can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows in ``gone`` (doc_id, text_key); null ids are equal."""
    doc, key = unused(["gone_doc", "gone_key"], docs.columns)
    rows = written(gone.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)), "gone")
    rows = F.broadcast(rows) if fewer_than(rows, BROADCAST_ROWS) else rows
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key))
    return docs.join(rows, same, "left_anti").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay: texts without a letter or without a clear language go."""
    return without(docs, language_id.unclear(language_id.identify(docs, language_id.train(docs)), LEAST_MARGIN))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or nearly equal lines the first stays; documents left without a line go."""
    out = line_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(F.char_length("text").cast("long")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return without(docs, ngram_join.near_duplicates(docs).where("NOT kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return without(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document."""
    import public_tokenizers

    return sentencepiece_rounds.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages wrote on the way is dropped when the next one's rows are there."""
    docs, path = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES:
        docs, made = alone(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"stage-{name}", path)
        path = (made,)
    return docs
