"""Containment search against brute force, its recall by item size, and ids that repeat or are null."""

import random
import re

import pytest

from colloquy.llm import decontamination as D

A = "seven green lanterns hang above the quiet harbour tonight while sailors sleep below deck until morning comes again"
B = "twelve old clocks on the mantel tick slowly through winter as nobody winds the spring or counts the hours anymore"


def grams(text, n=5):
    ws = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def brute(docs, items, threshold=0.8):
    out = {}
    for d, t in docs:
        for i, x in items:
            g = grams(x)
            if g and len(g & grams(t)) >= threshold * len(g) - 1e-9:
                out[d, i] = max(out.get((d, i), 0), len(g & grams(t)) / len(g))
    return out


def found(spark, docs, items):
    rows = D.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): r.containment for r in rows}


def edited(rng, ws):
    ws = list(ws)
    for _ in range(rng.randint(0, max(1, len(ws) // 25))):
        at = rng.randrange(len(ws))
        ws[at : at + 1] = rng.choice([[], ["odd"], [ws[at], "extra"]])
    return ws[rng.randint(0, 2) : len(ws) - rng.randint(0, 2)]


def test_recall_by_item_size(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=size))) for k, size in enumerate([5, 6, 7, 9, 11, 15, 16, 20, 30, 59, 120, 400] * 4)]
    docs = []
    for d in range(600):
        ws = rng.choices(vocabulary, k=rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(ws))
            ws[at:at] = edited(rng, items[rng.randrange(len(items))][1].split())
        docs.append((d, " ".join(ws)))
    docs.append((600, " ".join(rng.choices(vocabulary, k=30000)) + " " + items[5][1]))
    want, got = brute(docs, items), found(spark, docs, items)
    assert got.items() <= want.items()
    by_size = {}
    for (d, i), _ in want.items():
        by_size.setdefault(len(items[i][1].split()), []).append((d, i) in got)
    assert len(by_size) == 12 and all(sum(x) >= 0.9 * len(x) for x in by_size.values())
    assert len(got) >= 0.995 * len(want) and (600, 5) in got


def test_signatures_are_a_small_share(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(rng.choices([f"w{k}" for k in range(5000)], k=400))) for i in range(50)], "doc_id long, text string")
    g = D.shingled(docs, "doc_id", 5)
    kept, every = g.selectExpr("grams").select(D.F.sum(D.F.size(D.window_minima(D.F.col("grams"), D.F.lit(8)))), D.F.sum(D.F.size("grams"))).first()
    assert kept < 0.25 * every


def test_ids_that_repeat_or_are_null(spark):
    assert found(spark, [(1, A)], [(0, A), (0, B)]) == {(1, 0): 1.0}
    assert found(spark, [(1, A), (1, B), (2, B)], [(0, A), (0, B)]) == {(1, 0): 1.0, (2, 0): 1.0}
    assert found(spark, [(None, A), (3, None), (4, "")], [(0, A), (None, "x " + A)]) == {(None, 0): 1.0, (None, None): pytest.approx(len(grams(A)) / (len(grams(A)) + 1))}


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, A, 1, 2, 3, "k")], "doc_id long, text string, grams int, h int, id int, item string")
    items = spark.createDataFrame([(0, A, "k", 1)], "item_id long, text string, key string, need int")
    assert [(r.doc_id, r.item_id) for r in D.contained_items(docs, items).collect()] == [(1, 0)]


def test_shuffled_path_equals_the_broadcast_one(spark, monkeypatch):
    docs, items = [(i, f"{A} {i}" if i % 3 else B) for i in range(30)], [(0, A), (1, B)]
    want = found(spark, docs, items)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert found(spark, docs, items) == want and len(want) == 30
