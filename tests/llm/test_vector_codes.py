"""Product codes against plain Lloyd rounds that measure every distance."""

import math
import random

import numpy as np
import pytest

from colloquy.llm import vector_codes as V

FIELDS = "vec_id long, embedding array<float>, label int, code string, error int, salt string, of_label int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{(vec_id, vector): (code, error)} and the codebooks, with Python integers."""
    good = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(scale * x) for x in v] for _, v, _ in good]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (d(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at, strict=True) if a[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for (i, _, lab), c, a in zip(good, cut, assign(), strict=True):
        out.append((i, "".join(f"{e:02x}" for e in a), sum(d(c[p], books[p][a[p]]) for p in range(parts)), lab))
    by = {}
    for _, _, error, lab in out:
        by[lab] = by.get(lab, 0) + error
    return sorted([(i, code, error, by[lab]) for i, code, error, lab in out], key=str), books


def f32(x):
    return float(np.float32(x))


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(2), []
    for i in range(400):
        grid = i % 3 == 0  # ties: few distinct values
        v = [f32(rng.choice([-1, 0, 1]) / 4096 if grid else rng.gauss(0, 1) * rng.choice([0.01, 1, 30])) for _ in range(16)]
        out.append((i * 7 % 401, v, rng.choice([None, 1, 2])))
    out += [(None, out[0][1], 1), (None, [f32(5)] * 16, None), (3, out[5][1], 2), (3, out[5][1], 2), (out[9][0], out[10][1], 1)]
    bad = [(900, None, 1), (901, [None] * 16, 1), (902, [f32(1)] * 15 + [float("nan")], 2), (903, [float("inf")] + [f32(1)] * 15, None), (904, [-float("inf")] + [f32(1)] * 15, None)]
    return out + bad


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "s", 9) for r in rows], FIELDS)


def found(codes):
    return sorted([(r.vec_id, r.code, r.error, r.label_error) for r in V.with_label_errors(codes).collect()], key=str)


@pytest.mark.parametrize("groups", [1, 2, 5])
def test_plain_rounds(spark, rows, groups):
    codes, book = V.encoded(frame(spark, rows), parts=4, groups=groups)
    want, books = plain(rows, parts=4)
    assert found(codes) == want
    assert book.entries.tolist() == books


def test_few_rows_none_and_salted_labels(spark, rows, monkeypatch):
    monkeypatch.setattr(V, "SMALL", 0)
    few = rows[:9] + rows[-5:]
    codes, book = V.encoded(frame(spark, few))
    assert found(codes) == plain(few)[0]
    assert book.entries.shape == (8, 9, 2)
    for none in (rows[-5:], []):
        codes, book = V.encoded(frame(spark, none))
        assert book is None and found(codes) == []


def test_vectors_that_cant_be_coded_are_errors(spark, rows):
    with pytest.raises(ValueError, match="can't be cut"):
        V.encoded(frame(spark, rows), parts=5)
    with pytest.raises(Exception, match="components"):
        V.encoded(frame(spark, [*rows, (7, [f32(1)] * 12, 1)]), parts=4)
    with pytest.raises(Exception, match="too large"):
        V.encoded(frame(spark, [*rows, (7, [f32(1e30)] * 16, 1)]), parts=4)


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(1)
    x = rng.integers(-9, 9, (4000, 4)) + rng.integers(0, 8, (4000, 1)) * 1000
    book = np.stack([x[np.flatnonzero(x[:, 0] // 1000 == k)[0]] for k in range(1, 8)])
    group = V.grouped(book, 3)
    near, upper, lower = np.zeros(4000, np.uint8), np.full(4000, np.inf, np.float32), np.zeros((4000, 3), np.float32)
    first = V.reassigned(x, book, group, 3, near, upper, lower)
    assert first >= 4000 * 7 and (near == V.squares(x, book).argmin(1)).all()
    for _ in range(4):
        moved = book + rng.integers(-3, 3, book.shape)
        drift = V.drifts(book[None], moved[None])[0]
        upper, lower, book = V.raised(upper + drift[near]), V.lowered(np.maximum(lower - drift.max(), 0)), moved
        assert V.reassigned(x, book, group, 3, near, upper, lower) < 0.2 * first
        assert (near == V.squares(x, book).argmin(1)).all()
