"""What tasks hold and how rows are dealt out, where a larger table would show it."""

import weakref

from pyspark.sql import functions as F

from colloquy.operators import models
from colloquy.plans import composites


def test_no_task_writes_most_recordings(spark):
    keys = composites.recording_keys(spark, "/root/testdata/sf0.1")
    sizes = [r["count"] for r in keys.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1001 and max(sizes) < 250


def test_a_task_keeps_the_vectors_of_one_call(spark):
    class Vector(list):
        pass

    made = []

    def embed(texts):
        if sum(r() is not None for r in made) > 4:
            raise RuntimeError("vectors of earlier calls are kept")
        out = [Vector([float(len(t))]) for t in texts]
        made.extend(weakref.ref(v) for v in out)
        return out

    rows = spark.range(40).select("id", F.when(F.col("id") % 5 > 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("text")).coalesce(1)
    got = {r.id: r.embedding for r in models.embedded(rows, embed, batch=4, delays=()).collect()}
    assert got == {i: [float(i)] if i % 5 else None for i in range(40)}
