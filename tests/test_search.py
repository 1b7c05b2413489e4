"""The vector join against brute force."""

import numpy as np

from colloquy.operators import search as S
from colloquy.plans import registry
from colloquy.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_small_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (90, 3)).astype(float)  # many equal similarities, and vectors without a length
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted((r.q_id, -r.sim, r.vec_id) for r in S.nearest_vectors(df.where("vec_id % 3 = 0"), df, 4, 7, 11).collect())
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    want = [(q, *r) for q in range(0, 90, 3) for r in sorted((-round(float(u[q] @ u[v]), 6), v) for v in range(90))[:4]]
    assert got == want


def test_every_fiftieth_vector_is_a_query(spark):
    asked = {r.q_id for r in registry.QUERIES["j9_vector_join"](spark, SF).collect()}
    assert asked == {r.vec_id for r in table(spark, SF, "embeddings").where("vec_id % 50 = 0").collect()}
