"""Language identification by string kernels.

Kernel: blended spectrum of presence. phi(x) marks which character n-grams
(n = 1..4, of the letter words of x, padded by a space on both sides) occur in x,
hashed to ``DIMS`` places; k(x, y) = <phi(x), phi(y)> / (|phi(x)| |phi(y)|).
Landmarks give the Nystroem map z(x) = K_mm^(-1/2) k(x, landmarks), on which
one-versus-rest kernel ridge regression is solved. As the kernel is linear in
phi, landmarks and weights fold into one n-gram by language matrix, so a batch is
scored by one sparse-by-dense product.

The classifier is fitted on a bounded sample of labelled rows (parameter
``per_lang`` for each language, fewer if ``most`` rows in all would be exceeded:
the bound is met evenly, no language is left out); every whole text is scored.
Rows are drawn by a hash of id and text, so ids that repeat or are null don't tie
rows together; a language that the draw missed gives its first row by that hash.
A drawn row reaches the driver as its set of places, at most ``DIMS / 8`` bytes.

``margin`` is the lead of the best score over the second (1 if there is one language);
unlike the score it doesn't depend on the number of languages. ``unclear`` rejects by it.

Defined results: null text or a text without a letter is ``und`` with score and margin 0;
if there is nothing to learn from, every document is ``und``; ties go to the
language that sorts first; repeated rows get equal answers; other columns are
never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import ship, spread, table

DIMS = 1 << 18
ORDERS = (1, 2, 3, 4)
MEMO_WORDS = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)
LETTERS = re.compile(r"[^\W\d_]+")
RESULT = "doc_id long, text_key long, lang_pred string, score double, margin double"
UNKNOWN = "und"

_MEMO: dict[str, np.ndarray] = {}


def word_grams(words: list[str]) -> list[np.ndarray]:
    """Hashed n-grams of each word, for all words at once; a place may repeat."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = "".join([f" {w} " for w in words]).encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(flat, np.uint32).astype(np.uint64)
    word, ends = np.repeat(np.arange(len(words)), lens), np.repeat(np.cumsum(lens), lens)
    at, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
    owner, found = [], []
    for n in ORDERS:
        fits = at[at + n <= ends[at]]
        h[fits] = (h[fits] ^ code[fits + n - 1]) * MIX
        h[fits] ^= h[fits] >> np.uint64(29)
        if n == 1:
            fits = fits[code[fits] != 32]
        owner.append(word[fits])
        found.append((h[fits] % np.uint64(DIMS)).astype(np.int32))
        at = at[at + n <= ends[at]]
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return [x.copy() for x in np.split(found[order], np.searchsorted(owner[order], np.arange(1, len(words))))]


def presences(texts: list[str | None], marks: np.ndarray) -> list[np.ndarray]:
    """Sorted places of the n-grams that occur in each text; ``marks`` is scratch space, all false."""
    global _MEMO
    if len(_MEMO) > MEMO_WORDS:
        _MEMO = {}
    split = [set(LETTERS.findall((t or "").lower())) for t in texts]
    new = list(set().union(*split).difference(_MEMO))
    if new:
        # the pattern also takes number characters that aren't decimal digits; words of these alone have no letter
        real = [w for w in new if w.isalpha() or any(map(str.isalpha, w))]
        _MEMO.update(dict.fromkeys(new, np.zeros(0, np.int32)))
        _MEMO.update(zip(real, word_grams(real), strict=True) if real else ())
    out = []
    for words in split:
        if words:
            marks[np.concatenate([_MEMO[w] for w in words])] = True
        places = np.flatnonzero(marks).astype(np.int32)
        marks[places] = False
        out.append(places)
    return out


@dataclass
class Classifier:
    langs: list[str]
    weights: np.ndarray  # DIMS x languages
    offset: np.ndarray

    def scores(self, batch: list[np.ndarray]) -> np.ndarray:
        """Ridge scores: the batch's sparse presence matrix times the folded weights."""
        sizes = np.array([len(x) for x in batch])
        out = np.zeros((len(batch), len(self.langs)))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.cumsum(sizes[full]) - sizes[full]
            rows = self.weights[np.concatenate([batch[i] for i in full])]
            out[full] = np.add.reduceat(rows, starts, axis=0) / np.sqrt(sizes[full])[:, None]
        return out + self.offset


def fit(langs: list[str], texts: list[np.ndarray], landmarks: int = 240, ridge: float = 1e-2) -> Classifier | None:
    """Nystroem kernel ridge regression on presence sets."""
    usable = [i for i, x in enumerate(texts) if len(x)]
    if not usable:
        return None
    labels = sorted({langs[i] for i in usable})
    by_lang = [[i for i in usable if langs[i] == x] for x in labels]
    chosen = sorted(i for own in by_lang for i in own[: max(1, landmarks // len(labels))])
    places = np.unique(np.concatenate([texts[i] for i in chosen]))
    column = np.full(DIMS, -1, np.int32)
    column[places] = np.arange(len(places))
    marks = np.zeros((len(places), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[column[texts[i]], j] = 1 / np.sqrt(len(texts[i]))
    k = np.empty((len(usable), len(chosen)))
    for row, i in enumerate(usable):
        at = column[texts[i]]
        k[row] = marks[at[at >= 0]].sum(0) / np.sqrt(len(texts[i]))
    where = {i: r for r, i in enumerate(usable)}
    kmm = k[[where[i] for i in chosen]]
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
    good = values > 1e-6 * values[-1]
    half = vectors[:, good] / np.sqrt(values[good])
    z = k @ half
    y = np.array([[langs[i] == x for x in labels] for i in usable], float)
    share = 1 / y.sum(0)[y.argmax(1)]  # languages weigh the same
    share *= len(usable) / share.sum()
    offset = (y * share[:, None]).mean(0)
    zw = z * share[:, None]
    beta = np.linalg.solve(zw.T @ z + ridge * len(usable) / 100 * np.eye(z.shape[1]), zw.T @ (y - offset))
    weights = np.zeros((DIMS, len(labels)), np.float32)
    weights[places] = marks @ (half @ beta)
    return Classifier(labels, weights, offset)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: labelled, with text, crc32(doc_id) mod 5 not 0."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def packed(places: np.ndarray) -> bytes:
    """A set of places as a list of them or as a bit map, whichever is smaller."""
    if 4 * len(places) < DIMS // 8:
        return places.tobytes()
    marks = np.zeros(DIMS, bool)
    marks[places] = True
    return np.packbits(marks).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) < DIMS // 8:
        return np.frombuffer(raw, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))).astype(np.int32)


def train(docs: DataFrame, per_lang: int = 400, most: int = 4000) -> Classifier | None:
    """Fit on about ``per_lang`` rows of each language, drawn by a hash of id and text."""
    ship(docs.sparkSession)
    rows = learnable(docs).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return None
    cap = max(1, most // len(counts))
    # with more languages than fit, some more are drawn, so that each has rows to fill its share
    per_lang = per_lang if per_lang <= cap else cap + 4 * cap**0.5 + 8
    u = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 30))
    bound = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_lang / n) * (1 << 30)))]), F.col("lang"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(DIMS, bool)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                got = [packed(x) for x in presences(b.column("text").slice(start, 256).to_pylist(), marks)]
                yield pa.RecordBatch.from_arrays([b.column("lang").slice(start, 256), b.column("u").slice(start, 256), pa.array(got, pa.binary())], names=["lang", "u", "grams"])

    as_grams = lambda some: some.select("lang", "u", "text").mapInArrow(grams, "lang string, u long, grams binary")
    drawn = as_grams(rows.withColumn("u", u).where(F.col("u") < bound))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("u", "grams"))
    sample = drawn.withColumn("_r", rank).where(F.col("_r") <= cap).collect()
    missed = sorted(set(counts).difference(r["lang"] for r in sample))
    if missed:
        first = rows.where(F.col("lang").isin(missed)).withColumn("u", u).groupBy("lang").agg(F.min("u").alias("u"), F.min_by("text", "u").alias("text"))
        sample += as_grams(first).collect()
    sample.sort(key=lambda r: (r["lang"], r["u"]))
    return fit([r["lang"] for r in sample], [unpacked(r["grams"]) for r in sample])


def judged(texts: list[str | None], model: Classifier | None, marks: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, margin) of each text."""
    found = presences(texts, marks)
    if model is None:
        return [UNKNOWN] * len(found), np.zeros(len(found)), np.zeros(len(found))
    s, seen = model.scores(found), np.array([len(x) > 0 for x in found])
    top = np.sort(s, axis=1)
    margin = top[:, -1] - top[:, -2] if s.shape[1] > 1 else np.ones(len(s))
    names = [model.langs[k] if ok else UNKNOWN for k, ok in zip(s.argmax(1), seen, strict=True)]
    return names, np.where(seen, np.clip(top[:, -1], 0, 1), 0), np.where(seen, margin, 0)


def unclear(found: DataFrame, least_margin: float) -> DataFrame:
    """(doc_id, text_key) of identified rows without a letter or with a margin below ``least_margin``."""
    return found.where((F.col("lang_pred") == UNKNOWN) | (F.col("margin") < least_margin)).select("doc_id", "text_key").distinct()


def identify(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """(doc_id, text_key, lang_pred, score, margin) of every whole text, the key its hash; one narrow map, no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # DIMS x languages: its size doesn't follow the rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(DIMS, bool)
        for b in batches:
            texts = b.column("text")
            for start in range(0, b.num_rows, 256):
                names, best, margin = judged(texts.slice(start, 256).to_pylist(), sent.value, marks)
                ids = [b.column(c).slice(start, 256) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(names), pa.array(best), pa.array(margin)], names=["doc_id", "text_key", "lang_pred", "score", "margin"])

    return spread(docs.selectExpr("CAST(doc_id AS long) AS doc_id", "xxhash64(text) AS text_key", "CAST(text AS string) AS text")).mapInArrow(task, RESULT)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
