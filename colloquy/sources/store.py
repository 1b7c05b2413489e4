"""Files that the engine itself writes and reads: meeting records, evaluation tables, transcripts, test cases."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.commits import Log, delete

CHILDREN = {"participants": "struct<name:string,is_unknown_assignee:boolean>", "action_items": "struct<task:string,assignee:string,deadline:string,priority:string,status:string>"}
EVALUATION = (
    "recording string, model string, duration_sec double, ref_words int, gen_words int, substitutions int, deletions int, insertions int, "
    "wer double, accuracy_pct double, pass_fail string, notes string"
)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names; a local session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written below the shared folder and read back: what it rests on isn't computed again."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """A table of the finished inserts; None before the first."""
    done = Log(spark, folder).latest()[1].get("batches", [])
    return _batches(spark, folder, table, done) if done else None


def _batches(spark: SparkSession, folder: str, table: str, batches: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/{table}").parquet(*[f"{folder}/{table}/batch={b}" for b in batches]).drop("batch")


def insert_meetings(records: DataFrame, folder: str) -> DataFrame:
    """Insert meetings with their participants and action items; returns the ids.

    ``records`` has id (null: a new one is made), transcript, summary, key_points,
    decisions, participants and action_items. An id that is there already, or twice
    in ``records``, is an error and nothing is inserted. All three tables are written
    under the insert's own name and count from the version on that names it. The ids
    are compared with exactly the version that the new one follows: if another insert
    came first, with its ids as well.
    """
    spark, batch, log = records.sparkSession, uuid.uuid4().hex, Log(records.sparkSession, folder)
    rows = records.withColumn("id", F.coalesce(F.col("id").cast("string"), F.uuid())).withColumn("created_at", F.current_timestamp())
    tables = (*CHILDREN, "meetings")
    done = False
    try:
        rows.write.parquet(f"{folder}/_aside/batch={batch}")
        rows = spark.read.parquet(f"{folder}/_aside/batch={batch}")
        refuse(rows.groupBy("id").count().where("count > 1"))
        for name, kind in CHILDREN.items():
            rows.select(F.col("id").alias("meeting_id"), F.explode(F.col(name).cast(f"array<{kind}>")).alias("c")).select("meeting_id", "c.*").write.parquet(f"{folder}/{name}/batch={batch}")
        rows.drop(*CHILDREN).write.parquet(f"{folder}/meetings/batch={batch}")
        compared: list[str] = []
        while not done:
            number, state = log.latest()
            there = state.get("batches", [])
            if new := [b for b in there if b not in compared]:
                refuse(rows.select("id").join(_batches(spark, folder, "meetings", new).select("id"), "id", "left_semi"))
            compared = there
            done = log.commit(number + 1, {"batches": [*there, batch]})
    finally:
        delete(spark, f"{folder}/_aside/batch={batch}")
        if not done:
            for name in tables:
                delete(spark, f"{folder}/{name}/batch={batch}")
    return spark.read.parquet(f"{folder}/meetings/batch={batch}").select("id")


def refuse(clash: DataFrame) -> None:
    if found := clash.limit(3).collect():
        raise ValueError(f"duplicate meeting id {', '.join(r['id'] for r in found)}")


def write_evaluation(rows: DataFrame, folder: str) -> None:
    """The evaluation's CSV, with a header."""
    rows.select([c.split()[0] for c in EVALUATION.split(", ")]).write.mode("overwrite").option("header", True).csv(folder)


def read_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("header", True).schema(EVALUATION).csv(folder)


def write_files(rows: DataFrame, folder: str) -> None:
    """A file of each row (name, content: binary), written by the executors.

    Each is written aside and renamed, so that a repeated task leaves no half file.
    """

    def task(batches):
        from pyarrow import fs

        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                at, root = fs.FileSystem.from_uri(folder)
                at.create_dir(root, recursive=True)
                with at.open_output_stream(aside := f"{root}/.{uuid.uuid4().hex}.part") as f:
                    f.write(content or b"")
                at.move(aside, f"{root}/{name}")
            yield from ()

    rows.select(F.col("name").cast("string").alias("name"), "content").mapInArrow(task, "name string").write.format("noop").mode("overwrite").save()


def write_transcripts(rows: DataFrame, folder: str, stamp: str) -> None:
    """A file ``{stem}_{stamp}_transcript.txt`` for each row (stem, body)."""
    write_files(rows.select(F.concat(F.col("stem").cast("string"), F.lit(f"_{stamp}_transcript.txt")).alias("name"), F.encode("body", "UTF-8").alias("content")), folder)


def read_transcripts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(name, text) of whole text files."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test cases (reference, hypothesis) of a JSON file that is one array."""
    return spark.read.option("multiLine", True).schema("reference string, hypothesis string").json(path)
