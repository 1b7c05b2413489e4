"""Spelling variants: words one edit apart, and the common form of a rare one.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point. Replacing the code point at a place leaves the rest equal, and an
insertion is a deletion seen from the other side, so near words share a deletion.
A word's deletions are never spelled out: with prefix and suffix sums of a
polynomial hash (modulo 2^64, odd base) each is one integer, and those of a whole
batch are a few numpy operations. Keys are dealt out by their leading digits
(radix) and sorted; one scan drops the keys that only one word has, which are
nearly all. The rest is verified on the strings: rows are grouped by the remaining
text itself, so a collision of hashes joins nothing.

A key says which kind it is: (length, place, rest) for a replacement, so two words
share at most one; (rest) for a deletion, where of a run of equal code points the
first stands for all, so a word and a longer one share at most one. Each near pair
is found once, and none is written out: a group's members take its size, its first
and its second word by (count, code points), which is all that they need.

The common form is the near word of largest count if that is ``ratio`` times the
word's own or more. Counts grow along forms, so the way to the last form ends; it
is found by doubling steps.

Defined results: null and empty texts have no words; a null ``doc_id`` hashes as
the empty text; repeated rows count each time; ties go to the smallest word in
code-point order; an empty table gives no rows; words of any length are whole;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from colloquy.llm.common import dropped, fresh_path, ship, spread, table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base of the polynomial and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
REPLACED, DELETED = 0, 1
#: The place of a word that nothing was deleted from.
WHOLE = -1
#: Code points of words that are hashed together.
SLICE = 1 << 19
#: Leading bits of a key by which keys are dealt out.
RADIX_BITS = 16
KEY_FIELDS = "key long, wid long, kind byte, at int"
HELD_FIELDS = "wid long, kind byte, at int"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit to all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the word, kind, place) of all deletions of all words, and of the words themselves."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner, ends = np.repeat(np.arange(len(words)), lens), np.cumsum(lens)
    starts = ends - lens
    place = np.arange(len(code)) - starts[owner]
    powers = np.ones(int(lens.max(initial=0)) + 1, np.uint64)
    powers[1:] = np.uint64(BASE)
    powers = np.cumprod(powers, dtype=np.uint64)
    term = mixed(code.astype(np.uint64) + np.uint64(1)) * powers[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    whole = sums[ends] - sums[starts]
    prefix = sums[:-1] - sums[starts][owner]
    suffix = whole[owner] - prefix - term
    rest = prefix + suffix * np.uint64(UNBASE)
    length = lens.astype(np.uint64)
    seat = (length[owner] << np.uint64(32)) + place.astype(np.uint64)
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (place[1:] == 0)
    of_kind = lambda k, h, by: mixed(h ^ mixed((by << np.uint64(1)) + np.uint64(k)))
    keys = [of_kind(REPLACED, rest, seat), of_kind(DELETED, rest[first], length[owner[first]] - np.uint64(1)), of_kind(DELETED, whole, length)]
    owners, places = [owner, owner[first], np.arange(len(words))], [place, place[first], np.full(len(words), WHOLE)]
    kinds = [np.full(len(k), kind, np.int8) for k, kind in zip(keys, (REPLACED, DELETED, DELETED), strict=True)]
    return np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(kinds), np.concatenate(places).astype(np.int32)


def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of (wid, word) rows, some ``SLICE`` code points at a time."""
    for b in batches:
        words, wid = b.column("word").to_pylist(), b.column("wid").to_numpy()
        cuts = np.cumsum([len(w) for w in words]) // SLICE
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(cuts)) + 1):
            if len(part):
                key, owner, kind, at = deletion_keys(words[part[0] : part[-1] + 1])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(wid[part[0] + owner]), pa.array(kind), pa.array(at)], names=["key", "wid", "kind", "at"])


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key another word has too; a deletion counts if a whole word has the key.

    The last key's rows wait for the next batch, in which the key may go on.
    """
    names, kept = ("key", "wid", "kind", "at"), None
    for b in batches:
        cols = [b.column(n).to_numpy() for n in names]
        cols = cols if kept is None else [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        if not len(cols[0]):
            continue
        open_from = int(np.searchsorted(cols[0], cols[0][-1]))
        kept = [c[open_from:] for c in cols]
        yield held([c[:open_from] for c in cols])
    if kept is not None:
        yield held(kept)


def held(cols: list[np.ndarray]) -> pa.RecordBatch:
    key, wid, kind, at = cols
    if len(key):
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        good = (sizes > 1) & np.logical_or.reduceat((kind == REPLACED) | (at == WHOLE), starts)
        take = np.repeat(good, sizes)
        wid, kind, at = wid[take], kind[take], at[take]
    return pa.RecordBatch.from_arrays([pa.array(wid), pa.array(kind), pa.array(at)], names=["wid", "kind", "at"])


def without(word: Column, at: Column) -> Column:
    """``word`` less its code point number ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def near_words(words: DataFrame, keys_of: Callable = keys_of) -> DataFrame:
    """(wid, n_near, best) of the (wid, word, n) rows that have near words; ``best`` is a struct (less, word, wid), less = -n."""
    ship(words.sparkSession)
    keys = spread(words.select("wid", "word")).mapInArrow(keys_of, KEY_FIELDS)
    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    met = dealt.mapInArrow(shared_keys, HELD_FIELDS).join(words, "wid")
    rest = F.when(F.col("at") == WHOLE, F.col("word")).otherwise(without(F.col("word"), F.col("at")))
    met = met.select("wid", "word", "n", "kind", (F.col("at") == WHOLE).alias("whole"), rest.alias("rest"), F.when(F.col("kind") == REPLACED, F.col("at")).otherwise(WHOLE).alias("seat"))
    alike = W.Window.partitionBy("rest", "seat", "kind")
    order = alike.orderBy(F.desc("whole"), F.desc("n"), "word")
    everything = order.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    this = F.struct((-F.col("n")).alias("less"), "word", "wid")
    ranked = met.select(
        "wid", "kind", F.row_number().over(order).alias("rank"), F.count("*").over(alike).alias("size"), F.max("whole").over(alike).alias("with_whole"),
        F.first(this).over(everything).alias("first"), F.nth_value(this, 2).over(everything).alias("second"),
    ).where((F.col("size") > 1) & ((F.col("kind") == REPLACED) | F.col("with_whole")))
    # of a deletion's group the whole word comes first: it is near to all, the others to it alone
    beside = F.when((F.col("kind") == REPLACED) | (F.col("rank") == 1), F.col("size") - 1).otherwise(1)
    best = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first"))
    return ranked.select("wid", beside.alias("beside"), best.alias("best")).groupBy("wid").agg(F.sum("beside").alias("n_near"), F.min("best").alias("best"))


def kept_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def last_links(links: DataFrame) -> DataFrame:
    """(wid, to) with ``to`` the end of the way that starts at ``wid``; each round doubles the steps, so rounds grow as the logarithm of the longest way."""
    now, path = kept_at(links, "spelling-links")
    while True:
        on = now.select(F.col("wid").alias("to"), F.col("to").alias("further"))
        step, new = kept_at(now.join(on, "to", "left").select("wid", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "spelling-links")
        moved = not step.where("moved").isEmpty()
        dropped(links.sparkSession, path)
        now, path = step.select("wid", "to"), new
        if not moved:
            return now


def spelling_variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for distinct words with their counts (word, n)."""
    words, _ = kept_at(counts.select(F.monotonically_increasing_id().alias("wid"), "word", F.col("n").cast("long").alias("n")), "spelling-words")
    near, _ = kept_at(near_words(words), "spelling-near")
    found = words.join(near, "wid", "left")
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    found = found.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"))
    ends = last_links(found.where("form IS NOT NULL").select("wid", F.col("form.wid").alias("to")))
    roots = ends.join(words.select(F.col("wid").alias("to"), F.col("word").alias("end")), "to").select("wid", "end")
    out = found.join(roots, "wid", "left")
    return out.select("word", "n", "n_near", F.col("form.word").alias("form"), (-F.col("form.less")).alias("form_n"), F.coalesce("end", "word").alias("root"))


def word_counts(runs: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of the ``word`` rows that are long and common enough; added up before the shuffle."""
    long = runs.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def folded_runs(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc, word): every run of letters of every text, A to Z in lower case; runs under ``least`` code points left out."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    run = F.col("run")
    return runs.where(F.length("run") >= least).select("doc", F.when(run.rlike("[A-Z]"), F.translate(run, UPPER, LOWER)).otherwise(run).alias("word"))


def with_slips(runs: DataFrame, every: int = 199) -> DataFrame:
    """The contract's slips: where ``every`` divides the checksum of document and run, one code point of the run goes."""
    h, word = F.crc32(F.concat("doc", F.lit(":"), "word")), F.col("word")
    cut = without(word, (h % F.length(word)).cast("int"))
    return runs.select(F.when(h % every == 0, cut).otherwise(word).alias("word"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling_variants(word_counts(with_slips(folded_runs(docs, least=6))), ratio=5)


def checksum_steps() -> list[int]:
    """CRC-32 (polynomial 0xEDB88320) of the sixteen half bytes."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ 0xEDB88320 * (x & 1)
        out.append(x)
    return out


OP11_SQL = rf"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
folded AS (SELECT doc, translate(run, '{UPPER}', '{LOWER}') AS word, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT *, hex(encode(doc || ':' || word)) AS x FROM folded),
halves AS (SELECT *, list_transform(range(0, length(x)), lambda i: CAST('0x' || substr(x, CAST(CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END AS INT), 1) AS BIGINT)) AS h FROM bytes),
summed AS (SELECT word, times, xor(4294967295, list_reduce(h, lambda a, b: xor(a >> 4, CAST({checksum_steps()} AS BIGINT[])[CAST(xor(a, b) & 15 AS INT) + 1]), CAST(4294967295 AS BIGINT))) AS crc FROM halves),
slipped AS (SELECT times, CASE WHEN crc % 199 = 0 THEN substr(word, 1, CAST(crc % length(word) AS INT)) || substr(word, CAST(crc % length(word) AS INT) + 2) ELSE word END AS word FROM summed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
holes AS (SELECT word, n, unnest(range(0, length(word))) AS gap FROM words),
rests AS (SELECT word, n, gap, substr(word, 1, CAST(gap AS INT)) || substr(word, CAST(gap AS INT) + 2) AS rest FROM holes),
one_less AS (SELECT DISTINCT r.word AS a, r.n AS an, w.word AS b, w.n AS bn FROM rests r JOIN words w ON w.word = r.rest),
pairs AS (
  SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM rests a JOIN rests b ON a.gap = b.gap AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a, an, b, bn FROM one_less UNION ALL SELECT b, bn, a, an FROM one_less),
near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY bn DESC, b) AS best, max(bn) AS best_n FROM pairs GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)),
way AS (SELECT word, word AS root FROM forms WHERE form IS NULL UNION ALL SELECT f.word, w.root FROM forms f JOIN way w ON f.form = w.word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.root FROM forms f JOIN way w USING (word)
"""
