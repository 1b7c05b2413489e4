"""Speaker clustering against the whole matrix of distances."""

import numpy as np
import pytest

from colloquy.operators import clustering as C


def linkage(x, limit, k):
    """Greedy average linkage on an n x n matrix."""
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(len(x)), np.ones(len(x), bool), np.arange(len(x))
    while alive.sum() > (k or 1):
        i, j = sorted(divmod(int(np.argmin(d)), len(x)))
        if k is None and d[i, j] > limit:
            break
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j], label[label == j] = False, i
    return label


def merged(x, label, at_least):
    label = label.copy()
    while True:
        names = np.unique(label)
        c = C.units(np.array([x[label == n].mean(0) for n in names]))
        close = np.argwhere(np.triu(c @ c.T >= at_least, 1))
        if not len(close):
            return label
        label[label == names[close[0][1]]] = names[close[0][0]]


def windows(rng, n, voices, noise):
    cents = rng.normal(size=(voices, 16))
    return C.units(cents[rng.integers(0, voices, n)] + noise * rng.normal(size=(n, 16)))


@pytest.mark.parametrize("seed", range(12))
def test_linkage_and_merging_equal_the_whole_matrix(seed):
    rng = np.random.default_rng(seed)
    x = windows(rng, 150, 1 + seed, 0.3 + 0.1 * (seed % 4))
    for limit, k in ((0.2, None), (0.05, None), (0.5, None), (None, 1), (None, 4), (None, 400)):
        label = C.average_linkage(x, limit, k)
        assert label.tolist() == linkage(x, limit, k).tolist()
        for at_least in (0.95, 0.8, 0.5):
            assert C.merge_centroids(x, label, at_least).tolist() == merged(x, label, at_least).tolist()


def test_equal_and_zero_windows():
    x = np.zeros((300, 4))
    x[:100, 0] = x[100:200, 1] = 1
    assert len(set(C.cluster(x))) == 2  # windows without a length are pruned to a voice


def test_large_meetings_are_clustered_alike():
    rng = np.random.default_rng(1)
    x = windows(rng, 4300, 3, 0.1)
    x[[50, 900]] = C.units(rng.normal(size=(2, 16)))  # alone, so pruned to a voice
    assert len(set(C.cluster(x).tolist())) == 3
    assert len(set(C.cluster(x, k=2).tolist())) == 2


def test_sequential_equals_plain_loops():
    x = windows(np.random.default_rng(3), 200, 5, 0.4)
    cents, want = [], []
    for v in x.tolist():
        sims = [sum(a * b for a, b in zip(c, v, strict=True)) for c in cents]
        if sims and max(sims) >= 0.8:
            k = sims.index(max(sims))
            c = [0.8 * a + 0.2 * b for a, b in zip(cents[k], v, strict=True)]
            n = sum(a * a for a in c) ** 0.5
            cents[k] = [a / n for a in c]
        else:
            k = len(cents)
            cents.append(v)
        want.append(k)
    assert C.sequential(x).tolist() == want


def partition(labels):
    """Sets of places with one label."""
    return {frozenset(np.flatnonzero(np.asarray(labels) == k).tolist()) for k in set(labels)}


def test_rounds_of_mutual_neighbours_equal_greedy_linkage(spark, monkeypatch):
    from pyspark.sql import functions as F

    from colloquy.operators import linkage as L

    monkeypatch.setattr(L, "BLOCK", 32)  # several blocks
    rng = np.random.default_rng(9)
    meetings = {"a": windows(rng, 150, 4, 0.4), "b": windows(rng, 90, 2, 0.2), "c": windows(rng, 1, 1, 0.1), "d": np.repeat(windows(rng, 5, 5, 0.1), 12, axis=0)}
    df = spark.createDataFrame([(m, i, v.tolist()) for m, x in meetings.items() for i, v in enumerate(x)], "meeting_id string, idx long, unit array<double>")
    for limit in (0.05, 0.3):
        members, clusters = L.linked(df, limit)
        got = {}
        for r in members.collect():
            got.setdefault(r.meeting_id, {})[r.idx] = r.cid
        sizes = {(r.meeting_id, r.cid): r["size"] for r in clusters.collect()}
        for m, x in meetings.items():
            found = [got[m][i] for i in range(len(x))]
            assert partition(found) == partition(C.average_linkage(x, limit).tolist()), (m, limit)
            assert all(min(p) == found[min(p)] and sizes[m, min(p)] == len(p) for p in partition(found))
        assert clusters.agg(F.sum("size")).first()[0] == df.count()


def test_large_and_small_meetings_are_clustered_by_the_same_rules(spark, monkeypatch):
    from colloquy.operators import linkage as L

    monkeypatch.setattr(L, "BLOCK", 64)
    rng = np.random.default_rng(4)
    meetings = {"big": windows(rng, 180, 4, 0.15), "odd": windows(rng, 120, 30, 0.5), "small": windows(rng, 20, 2, 0.1)}
    meetings["big"][[3, 70]] = C.units(rng.normal(size=(2, 16)))  # alone, so pruned to a voice
    df = spark.createDataFrame([(m, i, v.tolist()) for m, x in meetings.items() for i, v in enumerate(x)], "meeting_id string, idx long, embedding array<double>")
    got = {}
    for r in C.cluster_meetings(df, large=100).collect():
        got.setdefault(r.meeting_id, {})[r.idx] = r.speaker_id
    for m, x in meetings.items():
        assert [got[m][i] for i in range(len(x))] == C.cluster(x).tolist(), m
