"""Benchmark decontamination by size-partitioned MinHash containment search.
DataFrame and SQL functions only.

A short item and a long document have next to no Jaccard similarity, so whole
documents can't be sketched: long documents are searched by windows of an item's
size. Items are partitioned by the size of their shingle set; a partition's
window width is the widest power of two that every text that contains the
threshold's share of the item must hold intact somewhere (see ``plan``). The
MinHash of a window is its least shingle hash; a row's signature is the set of its
windows' MinHashes, about 2 of each width + 1 shingles. A document has the
signature of the narrowest width in use, which holds those of all wider ones.

1. A document that shares enough MinHashes with an item (``need``, also from the
   plan, more for larger items) is a candidate for it.
2. Candidates are verified by exact containment of the item's shingles. Shingle
   hashes meet the items', never texts: a document's text is not shuffled.

Items' rows are broadcast up to ``BROADCAST_ROWS`` (the count is checked); beyond
it both sides are shuffled by hash under a salt, so a very common shingle is
spread over ``SALTS`` tasks.

Defined results: null or empty texts and texts of fewer than ``n`` words have no
shingles and match nothing; a null ``doc_id`` or ``item_id`` is an id like others;
rows that repeat an id are sets of their own, and the result has one row for each
pair of ids, that of the largest containment (then of the larger item); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import all_salts, spread, table, written

#: Rows of items or candidates (8 to 32 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 2_000_000
#: Ways in which the rows of one shingle are dealt out where both sides are shuffled.
SALTS = 32


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingled(rows: DataFrame, id_col: str, n: int, only: DataFrame | None = None) -> DataFrame:
    """(id, key, grams): the hashes of a text's n-word shingles in their order; ``key`` is the text's hash.

    ``only`` has the (id, key) of the rows that are wanted.
    """
    # a projection for each step: what a lambda reads must be a column, or it is computed at every element
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    if only is not None:
        out = out.join(only, out["id"].eqNullSafe(only["id"]) & (out["key"] == only["key"]), "left_semi")
    out = out.select("id", "key", words(F.col("text")).alias("ws"))
    out = out.select("id", "key", F.transform("ws", lambda w: F.xxhash64(w)).alias("hs")).where(F.size("hs") >= n)
    return out.select("id", "key", F.transform(F.sequence(F.lit(1), F.size("hs") - (n - 1)), lambda i: F.xxhash64(*[F.element_at("hs", i + k) for k in range(n)])).alias("grams"))


def plan(size: Column, n: int, threshold: float) -> tuple[Column, Column, Column]:
    """(least, width, need) of an item of ``size`` shingles.

    ``least`` shingles are shared at the threshold. A word inserted, left out or
    replaced within a passage costs n - 1 shingles at least, so the lost ones
    break the item at (size - least) / (n - 1) places at most, and ``least``
    shingles lie in one run more than that. A run of r shingles has r / width
    (rounded down) windows without a common place, each with a MinHash of its own.
    """
    least = F.ceil(size * F.lit(threshold) - F.lit(1e-9))
    runs = F.floor((size - least) / max(1, n - 1)) + 1
    width = F.pow(F.lit(2), F.floor(F.log2((F.floor((least - 1) / runs) + 1).cast("double")) + F.lit(1e-9)))
    need = F.greatest(F.lit(1), F.ceil((least - runs * (width - 1)) / width))
    return least.cast("long"), width.cast("int"), need.cast("long")


def window_minima(grams: Column, width: Column) -> Column:
    """The distinct least hashes of all windows of ``width`` shingles (of the whole, if it is shorter)."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(grams) - width + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(grams, i, width))))


def met(rows: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """``rows`` (id, key, h) joined with the items' rows by ``h``."""
    if small:
        return rows.join(F.broadcast(wanted), "h")
    salt = F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(wanted.withColumn("salt", all_salts(SALTS)), ["h", "salt"]).drop("salt")


def item_rows(items: DataFrame, n: int, threshold: float) -> DataFrame:
    """(item, item_id, grams, n_item, least, width, need): an item for each id and text."""
    it = shingled(items, "item_id", n).dropDuplicates(["id", "key"])
    it = it.select(F.xxhash64("id", "key").alias("item"), F.col("id").alias("item_id"), "grams", F.size(F.array_distinct("grams")).cast("long").alias("n_item"))
    least, width, need = plan(F.col("n_item"), n, threshold)
    # where shingles repeat within the item, a lost one may break it more often: one MinHash is asked for
    return it.select("*", least.alias("least"), width.alias("width"), F.when(F.size("grams") == F.col("n_item"), need).otherwise(F.lit(1).cast("long")).alias("need"))


def candidates(docs: DataFrame, it: DataFrame, n: int) -> DataFrame:
    """(id, key, item) of the documents that share enough MinHashes with an item."""
    width, sizes = it.agg(F.min("width"), F.sum(F.size("grams"))).first()
    if width is None:
        return docs.sparkSession.createDataFrame([], "id long, key long, item long")
    probe = it.select("item", "need", F.explode(window_minima(F.col("grams"), F.col("width"))).alias("h"))
    sig = shingled(spread(docs.select("doc_id", "text")), "doc_id", n).select("id", "key", F.explode(window_minima(F.col("grams"), F.lit(width))).alias("h"))
    hits = met(sig, probe, sizes <= BROADCAST_ROWS)
    return hits.groupBy("id", "key", "item", "need").agg(F.count("*").alias("n")).where("n >= need").select("id", "key", "item")


def contained(docs: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, key, item_id, n_shared, n_item) of every document row and item that it contains."""
    it = written(item_rows(items, n, threshold), "items")
    pairs = written(candidates(docs, it, n), "item-pairs")
    n_pairs, all_grams = pairs.count(), it.agg(F.sum("n_item")).first()[0] or 0
    few = n_pairs <= BROADCAST_ROWS
    # shingles of the candidate documents (of all, if these are too many to be sent along) against the items'
    only = F.broadcast(pairs.select("id", "key").distinct()) if few else None
    grams = shingled(docs, "doc_id", n, only).select("id", "key", F.explode(F.array_distinct("grams")).alias("h"))
    wanted = it.select("item", "n_item", "least", F.explode(F.array_distinct("grams")).alias("h"))
    got = met(grams, wanted, all_grams <= BROADCAST_ROWS).groupBy("id", "key", "item", "n_item", "least").agg(F.count("*").alias("n_shared")).where("n_shared >= least")
    same = reduce(Column.__and__, [got["id"].eqNullSafe(pairs["id"]), got["key"] == pairs["key"], got["item"] == pairs["item"]])
    got = got.join(F.broadcast(pairs) if few else pairs, same, "left_semi")
    ids = it.select("item", "item_id")
    return got.join(F.broadcast(ids) if all_grams <= BROADCAST_ROWS else ids, "item").select("id", "key", "item_id", "n_shared", "n_item")


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item found in a document."""
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("b")
    got = contained(docs, items, n, threshold)
    return got.groupBy(F.col("id").alias("doc_id"), "item_id").agg(best).select("doc_id", "item_id", "b.n_shared", "b.n_item", "b.containment")


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, text_key) of the rows of ``docs`` that contain an item; the key is the text's hash."""
    return contained(docs, items, n, threshold).select(F.col("id").alias("doc_id"), F.col("key").alias("text_key")).distinct()


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id AS id, 0 AS kind, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents
  UNION ALL SELECT item_id, 1, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM benchmark),
g AS (SELECT DISTINCT id, kind, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS gram FROM w WHERE len(ws) >= 5),
n AS (SELECT id, count(*) AS n_item FROM g WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n.n_item, count(*) / n.n_item AS containment
FROM g d JOIN g i ON d.gram = i.gram AND d.kind = 0 AND i.kind = 1 JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n_item HAVING count(*) >= 0.8 * n.n_item
"""
