"""Shared folder, intermediate tables and small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.shipping import ship  # noqa: F401

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset in a local session (as in tests) a temporary folder is made and set; on
    a cluster a folder of one machine would lose data, so it is an error there.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set(CHECKPOINT_KEY, named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Paths of the tables that this process has written and not dropped.
_KEPT: list[str] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: after the loss of an executor only the reading of the
    table is repeated. The table is an ordinary file set on shared storage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    _KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def alone(make: Callable[[], DataFrame], what: str, no_more: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """(what ``make`` gives, written; its path): the tables written on the way, and those ``no_more`` needed, are dropped."""
    before = set(_KEPT)
    out = written(make(), what)
    path = _KEPT[-1]
    for old in [p for p in _KEPT if p not in before and p != path] + list(no_more):
        dropped(out.sparkSession, old)
        _KEPT.remove(old)
    return out, path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder or file on the shared storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fewer_than(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a costly map: a table with fewer partitions than there are cores is dealt out anew, others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def unused(names: list[str], columns: list[str]) -> list[str]:
    """``names``, each with as many underscores before it as it takes to differ from all ``columns`` (in any case)."""
    there, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        out.append(name)
        there.add(name.lower())
    return out


def salted(key: Column, ways: int) -> Column:
    """Salt in 0..ways-1 that depends on ``key`` alone."""
    return F.pmod(F.xxhash64(key), F.lit(ways)).cast("int")


def dealt_salt(ways: int) -> Column:
    """Salt in 0..ways-1 by the row's place in its partition: rows that are equal in everything get different ones.

    For rows read from a table, whose places stay the same when a task is repeated.
    """
    return F.pmod(F.monotonically_increasing_id(), F.lit(ways)).cast("int")


def all_salts(ways: int) -> Column:
    """One row for each salt, for the small side of a salted join."""
    return F.explode(F.array(*[F.lit(i) for i in range(ways)]))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: (node, root), root the smallest node reached.

    ``edges`` has long columns ``a`` and ``b``; nodes without an edge to another
    node don't appear. Alternates large-star and small-star steps, so that the
    number of rows never exceeds the number of edges, and a node with very many
    neighbours is only ever aggregated (``min``), never gathered. Each round is
    written to the shared folder. Ends when a round changes nothing.
    """
    spark = edges.sparkSession
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    stamp = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a hangs on the least around a
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a and its smaller neighbours hang on the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        e = written(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct(),
            "cc",
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == stamp:
            break
        stamp = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])


def filesystem(path: str):
    """(pyarrow file system, path within it) for a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)
