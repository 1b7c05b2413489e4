"""Sources: star-schema tables read as meetings, segments, turns, vectors and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "meeting_id string, seg_no int, start_sec double, end_sec double, text string"
TURNS = "meeting_id string, turn_no int, start_sec double, end_sec double, speaker string, speaker_id int"
CHUNKS = "meeting_id string, source_type string, chunk_index int, text string, content_hash string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a costly map: a table with fewer partitions than there are cores is dealt out anew, others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns on an exact integer axis: start = words spoken before (running sum)."""
    from colloquy.operators.turns import word_axis

    return word_axis(table(spark, sf_dir, "conversations"))


def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns: centiseconds of the hour bucket, by user."""
    e = table(spark, sf_dir, "events")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) / 10_000).cast("long")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("meeting_id"),
        F.col("event_id").alias("turn_no"),
        start.alias("start_cs"),
        (start + F.round(F.greatest("value", F.lit(0.0)) * 400).cast("long")).alias("end_cs"),
        F.concat(F.lit("Speaker "), ((F.col("user_id") % 3) + 1).cast("string")).alias("speaker"),
    )


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length) of a folder's files, from metadata alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def recording_pairs(names: DataFrame, recordings: list[str], references: list[str]) -> DataFrame:
    """(stem, recording, reference): files with the same stem; dot-files don't count."""
    stem, suffix = F.regexp_extract("name", r"^(.*)(\.[^.]*)$", 1), F.lower(F.regexp_extract("name", r"^(.*)(\.[^.]*)$", 2))
    n = names.where(~F.col("name").startswith(".")).select("name", stem.alias("stem"), suffix.alias("suffix"))
    a = n.where(F.col("suffix").isin(recordings)).select("stem", F.col("name").alias("recording"))
    b = n.where(F.col("suffix").isin(references)).select("stem", F.col("name").alias("reference"))
    return a.join(b, "stem")


def fill_prompt(template: str, **values: str) -> str:
    """Replace ``{name}`` placeholders; a placeholder without a value is an error."""
    import re

    missing = sorted(set(re.findall(r"\{(\w+)\}", template)) - set(values))
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    for k, v in values.items():
        template = template.replace("{" + k + "}", v)
    return template
