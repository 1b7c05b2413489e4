"""Spelling variants against all pairs of words, with and without colliding keys."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import spelling_variants as S

FIELDS = "doc_id long, text string, word string, n int, key string, wid string"


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts: dict, ratio: int = 5) -> dict:
    out = {}
    for w, n in counts.items():
        beside = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = beside[0] if beside and -beside[0][0] >= ratio * n else None
        out[w] = (n, len(beside), form and form[1], form and -form[0])
    roots = {}
    for w in out:
        end = w
        while out[end][2]:
            end = out[end][2]
        roots[w] = end
    return {w: (*v, roots[w]) for w, v in out.items()}


def rows(df) -> dict:
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(260)}
    long = "".join(rng.choice("xyz") for _ in range(3000))
    words |= {"a" * n for n in range(1, 12)} | {long, long[:50] + "q" + long[51:], long[:-1], long[:9] + "é" + long[9:], "z" * 5000, "z" * 5001, "😀bc", "bc", "😀b"}
    return {w: rng.choice([1, 1, 2, 5, 5, 25, 130, 4000]) for w in sorted(words)}


def test_all_pairs(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n int")
    assert rows(S.spelling_variants(df)) == brute(counts)
    assert rows(S.spelling_variants(df, ratio=2)) == brute(counts, 2)


def test_colliding_keys_join_nothing(spark, counts):
    few = {w: n for w, n in counts.items() if len(w) < 8}
    whole, of = S.deletion_keys, S.keys_of

    def keys_of(batches):  # 5 bits of each key are left
        for b in of(batches):
            cut = pa.array(b.column("key").to_numpy() & 31)
            yield pa.RecordBatch.from_arrays([cut, *b.columns[1:]], names=b.schema.names)

    assert len(np.unique(whole(sorted(few))[0] & 31)) == 32
    words = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(few.items())], "wid long, word string, n long")
    got = {r.wid: (r.n_near, r.best.word) for r in S.near_words(words, keys_of).collect()}
    want = {i: (v[1], min((-m, x) for x, m in few.items() if near(w, x))[1]) for i, (w, v) in enumerate(brute(few).items()) if v[1]}
    assert got == want


def test_keys_go_on_in_the_next_batch():
    key = np.array([1, 1, 2, 3, 3, 3, 3, 9], np.int64)
    cols = [key, np.arange(8), np.zeros(8, np.int8), np.zeros(8, np.int32)]
    cut = [pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in cols], names=["key", "wid", "kind", "at"]) for a, b in ((0, 1), (1, 1), (1, 4), (4, 6), (6, 8))]
    assert [i for b in S.shared_keys(iter(cut)) for i in b.column("wid").to_pylist()] == [0, 1, 3, 4, 5, 6]


def test_texts_with_awkward_rows(spark):
    text = "Straße STRASSE élevée Élevée anderes andere Andere anderex a×b÷c " + "q" * 300_000 + " 12ab_cdefgh"
    texts = [(i, text) for i in range(40)] + [(None, text), (None, None), (3, None), (4, ""), (5, "...  "), (7, text), (7, text)]
    docs = spark.createDataFrame([(i, t, "w", 1, "k", "x") for i, t in texts], FIELDS)
    found = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            found[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    want = {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}
    counts = S.word_counts(S.with_slips(S.folded_runs(docs)))
    assert {r.word: r.n for r in counts.collect()} == want
    assert rows(S.spelling_variants(counts)) == brute(want)
    none = S.spelling_variants(S.word_counts(S.with_slips(S.folded_runs(docs.limit(0)))))
    assert none.columns == ["word", "n", "n_near", "form", "form_n", "root"] and none.count() == 0
