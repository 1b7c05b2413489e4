"""Language identification against a plain kernel, on awkward ids, and on held-out rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import language_id as L

WORDS = {"en": "the and with from house river people water garden", "de": "der und mit von haus fluss leute wasser garten"}
FIELDS = "doc_id long, text string, lang string"


def texts(lang, n):
    w = WORDS[lang].split()
    return [" ".join(w[(i * 5 + j * (1 + i % 7)) % 9] for j in range(12)) + f" {lang}x{chr(97 + i % 9)}" for i in range(n)]


@pytest.mark.parametrize("english, german", [(lambda i: i, lambda i: 8), (lambda i: None, lambda i: None), (lambda i: 8, lambda i: 9)])
def test_no_language_is_lost_when_ids_repeat(spark, english, german):
    rows = [(english(i), t, "en") for i, t in enumerate(texts("en", 1500))] + [(german(i), t, "de") for i, t in enumerate(texts("de", 1500))]
    docs = spark.createDataFrame(rows, FIELDS)
    model = L.train(docs)
    assert model.langs == ["de", "en"]
    found = L.identify(docs, model).join(docs.select("text", "lang").distinct().select(F.xxhash64("text").alias("text_key"), "lang"), "text_key")
    assert found.where("lang_pred = lang").count() == found.count()


def test_a_language_whose_rows_are_all_alike_is_drawn(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts("en", 2000))] + [(8, "und der fluss", f"d{i % 5}") for i in range(5000)]
    assert L.train(spark.createDataFrame(rows, FIELDS), per_lang=3).langs == ["d0", "d1", "d2", "d3", "d4", "en"]


def test_sets_of_places_stay_small():
    for n in (0, 1, L.DIMS // 32 - 1, L.DIMS // 32, L.DIMS):
        places = np.sort(np.random.default_rng(n).permutation(L.DIMS)[:n]).astype(np.int32)
        raw = L.packed(places)
        assert len(raw) <= L.DIMS // 8 and (L.unpacked(raw) == places).all()


def plain_grams(text):
    """Character n-grams of the letter words, as text."""
    return {g for w in re.findall(r"[^\W\d_]+", text.lower()) for s in [f" {w} "] for n in L.ORDERS for i in range(len(s) - n + 1) if (g := s[i : i + n]) != " "}


def test_scores_equal_a_plain_kernel():
    """Kernel matrix from sets of n-grams, Nystroem map and ridge regression by plain numpy."""
    docs = [(lang, t) for lang in WORDS for t in texts(lang, 60)]
    marks = np.zeros(L.DIMS, bool)
    model = L.fit([x for x, _ in docs], L.presences([t for _, t in docs], marks), landmarks=20, ridge=1e-2)
    new = [*texts("en", 70)[60:], *texts("de", 70)[60:], "wasser people", "zzz"]
    got = model.scores(L.presences(new, marks))
    sets, asked = [plain_grams(t) for _, t in docs], [plain_grams(t) for t in new]
    kernel = lambda a, b: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    langs = sorted(WORDS)
    chosen = sorted(i for x in langs for i in [k for k, (lang, _) in enumerate(docs) if lang == x][:10])
    own = [sets[i] for i in chosen]
    values, vectors = np.linalg.eigh(kernel(own, own))
    good = values > 1e-6 * values[-1]
    half = vectors[:, good] / np.sqrt(values[good])
    z, y = kernel(sets, own) @ half, np.array([[lang == x for x in langs] for lang, _ in docs], float)
    offset = y.mean(0)  # languages of one size
    beta = np.linalg.solve(z.T @ z + 1e-2 * len(docs) / 100 * np.eye(z.shape[1]), z.T @ (y - offset))
    want = kernel(asked, own) @ half @ beta + offset
    assert len({h for t in [*sets, *asked] for h in t}) == len(np.unique(np.concatenate(L.presences([t for _, t in docs] + new, marks))))  # no collision here
    assert np.abs(got - want).max() < 1e-4  # the folded weights have 32 bits


def test_held_out_documents_are_named_rightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.op6_language_id(spark, "/root/testdata/sf0.01").where("held_out AND lang_pred <> 'und'").join(docs.where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id")
    n = found.count()
    assert n > 100 and found.where("lang_pred = lang").count() >= 0.97 * n
