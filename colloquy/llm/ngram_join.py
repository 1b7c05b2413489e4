"""N-gram Jaccard join with MinHash banding.

1. Every text becomes its set of word n-grams (64-bit hashes); texts with equal
   sets are one class from here on and are joined through one representative.
2. Band and row counts follow from the threshold and the target recall; each
   representative has one hash for each band, and those that share a band hash are
   a bucket. Buckets of the same members (near copies share most bands) are one,
   under the least of their bands: found by a fingerprint, without gathering them.
3. A bucket is dealt into blocks of bounded size by a hash of the member, and the
   pairs of each two blocks are verified on the full n-gram sets by products of
   presence matrices. A pair is looked at in the bucket of the least band that it
   shares and nowhere else. A block pair returns one row for each member (its
   number of links there and the least member it reaches), never the pairs.
4. Classes are the connected components of links.

A link joins two different n-gram sets with a Jaccard similarity at or above the
threshold. The work on a bucket of n different sets grows with n squared (as
matrix products; rows grow with n squared / ``BLOCK_MEMBERS``), as exact counts of
links within it need; it doesn't depend on what the bucket's members are
otherwise near to. Texts of candidates alone are read again, by their ids where
these can be sent along; only beyond ``BROADCAST_ROWS`` are all texts shuffled.

Defined results: a text with fewer words than n has one n-gram, all its words; a
text without words (null, empty) is a class of its own, without links; rows that
repeat a ``doc_id`` are told apart by their text's hash; null ids are rows like
others, but a class is named by an id if a member has one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import all_salts, components, fewer_than, salted, ship, spread, table, written

WORDS = re.compile(r"[^\W_]+")
SALTS = 16
#: Candidates (of about 200 bytes, with their band hashes) up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: A block holds at most about so many n-grams and members (a single larger set is a block).
BLOCK_GRAMS, BLOCK_MEMBERS = 400_000, 512
COLUMNS = 4096
MEMO_WORDS = 150_000
_MEMO: dict[str, int] = {}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_plan(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective plan that reaches ``recall`` at ``threshold``."""
    best = (most_hashes, 1)
    for rows in range(1, 17):
        for bands in range(1, most_hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                if bands * rows <= 128 and rows > best[1]:
                    best = (bands, rows)
                break
    return best


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    global _MEMO
    if len(_MEMO) > MEMO_WORDS:
        _MEMO = {}
    memo, out = _MEMO, np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        out[i] = h
    return out


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text."""
    words = WORDS.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash signature folded to one 64-bit hash for each band."""
    rng = np.random.default_rng(20240501)
    a, b = rng.integers(1, 1 << 63, bands * rows, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, bands * rows, np.uint64)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096, None] * a + b
        part ^= part >> np.uint64(32)
        low = np.minimum(low, (part * _MIX).min(0))
    out = np.zeros(bands, np.uint64)
    for r in range(rows):
        out = (out ^ low.reshape(bands, rows)[:, r]) * _MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def with_key(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): the key tells rows of one id apart."""
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text").select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, set_key, size, bands); the key of an empty set is null."""
    ship(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part, keys, sizes, hashes = batch.slice(start, 512), [], [], []
                for t in part.column("text"):
                    g = gram_set(t.as_py(), n)
                    keys.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                    sizes.append(len(g))
                    hashes.append(band_hashes(g, bands, rows) if len(g) else np.zeros(0, np.int64))
                offsets = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(hashes)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), lists], names=["doc_id", "text_key", "set_key", "size", "bands"]
                )

    return spread(with_key(docs)).mapInArrow(task, "doc_id long, text_key long, set_key binary, size int, bands array<long>")


def bucket_members(reps: DataFrame) -> DataFrame:
    """(band, h, rep, block, blocks) of the buckets, each set of members once."""
    banded = reps.select("rep", "size", F.posexplode("bands").alias("band", "h"))
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "rep"))
    shared = banded.groupBy("band", "h").agg(F.count("*").alias("n"), F.sum("size").alias("grams"), mark(1).alias("m1"), mark(2).alias("m2")).where("n > 1")
    kept = shared.groupBy("n", "grams", "m1", "m2").agg(F.min(F.struct("band", "h")).alias("b"))
    blocks = F.greatest(F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("n") / BLOCK_MEMBERS)).cast("int")
    kept = kept.select("b.band", "b.h", blocks.alias("blocks"), all_salts(SALTS).alias("salt"))
    dealt = banded.select("rep", "band", "h", salted(F.col("rep"), SALTS).alias("salt")).join(kept, ["band", "h", "salt"])
    return dealt.select("band", "h", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "blocks")


def gram_rows(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rep, bands, grams) of the ``wanted`` rows (doc_id, text_key, rep, bands), the sets as 64-bit words."""
    wanted = wanted.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    wanted = F.broadcast(wanted) if fewer_than(wanted, BROADCAST_ROWS) else wanted.hint("merge")
    texts = with_key(docs)
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]) & (texts["text_key"] == wanted["_key"])).select("rep", "bands", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                got = [gram_set(t.as_py(), n).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("bands"), pa.array(got, pa.binary())], names=["rep", "bands", "grams"])

    # rows that repeat id and text are equal
    return found.mapInArrow(task, "rep long, bands array<long>, grams binary").dropDuplicates(["rep"])


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of exact Jaccard similarity at or above the threshold."""
    every = np.concatenate([*left, *right])
    values, counts = np.unique(every, return_counts=True)
    values = values[counts > 1]
    common = np.zeros((len(left), len(right)), np.float32)

    def marked(sets: list[np.ndarray], low: int) -> np.ndarray:
        part = values[low : low + COLUMNS]
        out = np.zeros((len(sets), len(part)), np.float32)
        for i, s in enumerate(sets):
            s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
            at = np.searchsorted(part, s)
            out[i, at[part[np.minimum(at, len(part) - 1)] == s]] = 1
        return out

    for low in range(0, len(values), COLUMNS):
        common += marked(left, low) @ marked(right, low).T
    total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - common
    return common >= threshold * total - 1e-6


def owned(left: np.ndarray, right: np.ndarray, band: int) -> np.ndarray:
    """Boolean matrix of the pairs (rows of band hashes) whose least shared band is ``band``."""
    out = left[:, band, None] == right[None, :, band]
    for b in range(band):
        out &= left[:, b, None] != right[None, :, b]
    return out


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(node, low, links) for each member and block pair."""

    def block_pair(t: pa.Table) -> pa.Table:
        nodes = t.column("rep").to_numpy()
        order = np.argsort(nodes)
        nodes, block, n = nodes[order], t.column("block").to_numpy()[order], len(nodes)
        band, i, j = (t.column(c)[0].as_py() for c in ("band", "i", "j"))
        hashes = t.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)[order]
        grams = t.column("grams")
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        own = owned(hashes[first], hashes[second], band)
        if i == j:
            np.fill_diagonal(own, False)
        rows, cols = np.flatnonzero(own.any(1)), np.flatnonzero(own.any(0))
        ok = np.zeros((n, n), bool)
        if len(rows):
            sets = {k: np.frombuffer(grams[int(order[k])].as_py(), np.uint64) for k in {*first[rows].tolist(), *second[cols].tolist()}}
            near = linked([sets[k] for k in first[rows]], [sets[k] for k in second[cols]], threshold) & own[np.ix_(rows, cols)]
            ok[np.ix_(first[rows], second[cols])] = near
            ok[np.ix_(second[cols], first[rows])] |= near.T
        low = np.arange(n)
        while ok.any():  # least member reached; each pass at least doubles the reach along a path
            new = np.minimum(low, np.where(ok, low[None, :], n).min(1, initial=n))
            new = np.minimum(new, new[new])
            if (new == low).all():
                break
            low = new
        return pa.table({"node": nodes, "low": nodes[low], "links": ok.sum(1)})

    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("band", "h", "rep", "block", "bands", "grams", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return pairs.groupBy("band", "h", "i", "j").applyInArrow(block_pair, "node long, low long, links long")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """(doc_id, text_key, class_id, n_links, n_copies, kept): class_id is the least doc_id of the class.

    ``n_links`` counts the different n-gram sets that link to the document's own;
    ``n_copies`` the documents with the same set. ``kept`` is the row that names the
    class (of equal ids, that of the smaller ``text_key``, the hash of its text).
    """
    bands, rows = band_plan(threshold, recall)
    sig = written(signatures(docs, n, bands, rows).withColumn("row", F.monotonically_increasing_id()), "ngram-sig")
    lead = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    sets = sig.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("row", "doc_id", "text_key", "size", "bands")).alias("r"), F.min(lead).alias("lead"), F.count("*").alias("n_copies"))
    reps = written(sets.select("set_key", "n_copies", "lead", F.col("r.row").alias("rep"), "r.doc_id", "r.text_key", "r.size", "r.bands"), "ngram-reps")
    members = written(bucket_members(reps), "ngram-members")
    met = members.select("rep").distinct()
    wanted = written(reps.select("doc_id", "text_key", "rep", "bands").join(met, "rep", "left_semi"), "ngram-wanted")
    found = written(verified(members.join(gram_rows(docs, wanted, n), "rep"), threshold).where("links > 0"), "ngram-links")
    classes = components(found.where("low <> node").select(F.col("node").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked_sets = reps.select("lead", F.col("rep").alias("node")).join(links, "node").join(classes, "node")
    linked_sets = written(linked_sets, "ngram-linked")
    leads = linked_sets.groupBy("root").agg(F.min("lead").alias("class_lead"))
    of_class = linked_sets.join(leads, "root").select(F.col("node").alias("rep"), "class_lead", "n_links")
    of_rep = reps.select("set_key", "n_copies", "lead", "rep").join(of_class, "rep", "left")
    of_rep = of_rep.select("set_key", "n_copies", F.coalesce("class_lead", "lead").alias("lead"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # sets with one document and no link answer for themselves; the others meet their documents under a salt
    right = written(of_rep.where("n_copies > 1 OR n_links > 0"), "ngram-classes").select("*", F.lit(True).alias("met"), all_salts(SALTS).alias("salt"))
    out = sig.select("doc_id", "text_key", "set_key", salted(F.col("row"), SALTS).alias("salt")).join(right, ["set_key", "salt"], "left")
    first = F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.text_key") == F.col("text_key"))
    return out.select(
        "doc_id",
        "text_key",
        F.when(F.col("met"), F.col("lead.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.when(F.col("met"), first).otherwise(F.lit(True)).alias("kept"),
    )


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS grams FROM w WHERE len(ws) > 0),
c AS (SELECT min(doc_id) AS rep, count(*) AS n_copies, grams, len(grams) AS n FROM s GROUP BY grams),
g AS (SELECT rep, n, unnest(grams) AS gram FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.gram = b.gram AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS node, rep AS other FROM c UNION SELECT reach.node, p.b FROM reach JOIN p ON p.a = reach.other),
k AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
l AS (SELECT a AS node, count(*) AS n_links FROM p GROUP BY a)
SELECT w.doc_id, coalesce(k.class_id, w.doc_id) AS class_id, coalesce(l.n_links, 0)::BIGINT AS n_links, coalesce(c.n_copies, 1)::BIGINT AS n_copies
FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN c ON c.grams = s.grams LEFT JOIN k ON k.node = c.rep LEFT JOIN l ON l.node = c.rep
"""
