"""Inverted file: recall and share of rows looked at, exact results, filters, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import inverted as I
from colloquy.operators import search as S


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in row], f"k{i % 3}") for i, row in enumerate(x)] + list(extra), "vec_id long, embedding array<float>, kind string")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (60, 24))[rng.integers(0, 60, 6000)] + rng.normal(0, 0.25, (6000, 24))
    copies = [(9000 + i, [1.0] * 24, "k9") for i in range(2500)]  # one cell with more than a block
    odd = [(20_000, [0.0] * 24, "k0"), (20_001, [0.0] * 24, "k1")]
    return frame(spark, x, copies + odd).repartition(8).cache()


def pairs(df):
    return {(r.q_id, r.vec_id): r.sim for r in df.collect()}


def test_recall_and_share(spark, clustered):
    file = I.built(clustered)
    queries = clustered.where("vec_id % 50 = 0")
    found, truth = pairs(file.nearest(queries, 10)), pairs(S.nearest_vectors(queries, clustered, 10))
    right = sum(s >= min(t for (a, _), t in truth.items() if a == q) for (q, _), s in found.items())  # equal similarities count
    assert right >= 0.95 * len(truth)
    asked = np.array([r.embedding for r in queries.collect()])
    assert file.share(asked) < 0.35 and file.probes < len(file.centroids) / 4
    assert file.size.sum() == clustered.count()  # every row is in a cell


def test_recall_on_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    file, queries = I.built(e), e.where("vec_id % 50 = 0")
    truth = pairs(S.nearest_vectors(queries, e, 10))
    assert len(truth.keys() & pairs(file.nearest(queries, 10)).keys()) >= 0.95 * len(truth)
    assert file.share(np.array([r.embedding for r in queries.collect()])) < 1


def test_exact_goes_on(spark, clustered):
    file, queries = I.built(clustered, cells=50), clustered.where("vec_id % 97 = 0 OR vec_id >= 20000")
    truth = pairs(S.nearest_vectors(queries, clustered, 7))
    for probes in (1, 5, 50):
        assert pairs(file.nearest(queries, 7, probes=probes, exact=True)) == truth, probes
    one = file.nearest(queries, 7, where=F.col("kind") == "k1", probes=3, exact=True)
    assert pairs(one) == pairs(S.nearest_vectors(queries, clustered.where("kind = 'k1'"), 7))


def test_one_request(spark, clustered):
    file = I.built(clustered)
    q = list(clustered.where("vec_id = 4").first().embedding)
    want = [r.vec_id for r in S.top_k(clustered, q, 10, id_col="vec_id").collect()]
    assert len(set(want) & {r.vec_id for r in file.search(q, 10).collect()}) >= 9
    few = F.col("vec_id") % 1000 == 7  # fewer rows than asked for: all cells are looked at
    assert [r.vec_id for r in file.search(q, 50, few).collect()] == [r.vec_id for r in S.top_k(clustered, q, 50, few, "vec_id").collect()]
    plan = file.search(q, 3)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(cell" in plan or "PushedFilters: [Or" in plan or "cell" in plan.split("PushedFilters")[1][:200]


def test_no_rows_and_one_row(spark, clustered):
    none = I.built(clustered.limit(0))
    assert none.nearest(clustered, 5).count() == 0 and none.search([1.0] * 24, 5).count() == 0
    one = I.built(clustered.where("vec_id = 4"))
    assert pairs(one.nearest(clustered.where("vec_id = 4"), 5)) == {(4, 4): 1.0}
