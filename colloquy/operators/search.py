"""Vector search, centroids, clustering boundaries and grounded-answer context."""

from __future__ import annotations

import hmac
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions import vectors as V
from colloquy.functions.text import shortened

SOURCE_TYPES = ("transcript", "summary", "decision", "action_item")
NOTHING_FOUND = "I could not find relevant information in the stored meetings."


def check_request(query: str, top_k: int, most: int = 50, source_type: str | None = None) -> None:
    """Reject bad requests before a plan is built."""
    if not query or not query.strip():
        raise ValueError("query is blank")
    if not 1 <= top_k <= most:
        raise ValueError(f"top_k must be in 1..{most}")
    if source_type is not None and source_type not in SOURCE_TYPES:
        raise ValueError(f"unknown source type {source_type}")


def check_page(limit: int, offset: int, most: int = 500) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be in 1..{most}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def authorised(token: str | None, expected: str | None) -> bool:
    """Whether a request's token is the expected one; without an expected one nobody is let in."""
    return bool(expected) and hmac.compare_digest((token or "").encode(), expected.encode())


def top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, id_col: str = "chunk_id") -> DataFrame:
    """Exact cosine top-k: the query is a literal, so this is a projection and a take-ordered."""
    rows = vectors if where is None else vectors.where(where)
    d = 1 - V.cosine(F.col("embedding"), V.literal(query))
    return rows.withColumn("distance", d).orderBy("distance", id_col).limit(k).withColumn("relevance", V.relevance(F.col("distance")))


def search(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, meetings: DataFrame | None = None, date_from=None, date_to=None, id_col: str = "chunk_id") -> DataFrame:
    """Top-k, then the date window on what is left (a meeting without a date stays), best first."""
    found = top_k(vectors, query, k, where, id_col)
    if meetings is not None:
        found = found.join(meetings.select("meeting_id", "created_at"), "meeting_id", "left")
        for bound, ok in ((date_from, lambda b: F.col("created_at") >= b), (date_to, lambda b: F.col("created_at") <= b)):
            if bound is not None:
                found = found.where(F.col("created_at").isNull() | ok(F.lit(bound)))
    return found.orderBy(F.desc("relevance"), "distance", id_col)


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Renormalised mean of the unit vectors of each label."""
    parts = vectors.select(label, F.posexplode(V.unit(F.col("embedding"))).alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(F.avg("x").alias("x"))
    c = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))
    return c.select(label, V.unit(F.transform("xs", lambda s: s["x"])).alias("centroid"))


def cluster_sizes(vectors: DataFrame, least: int, label: str = "label") -> DataFrame:
    """Labels with at least ``least`` members; the single largest if there is none."""
    n = vectors.groupBy(label).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col(label)).alias("l"))).over(W.partitionBy(F.lit(0)))
    return n.withColumn("_b", best).where((F.col("n") >= least) | ((F.col("_b.n") < least) & (F.col(label) == -F.col("_b.l")))).select(label, "n")


def nearest_centroid(vectors: DataFrame, cents: DataFrame, id_col: str = "vec_id", block: int = 4096) -> DataFrame:
    """Each vector's best centroid by cosine; ties go to the smaller label.

    Up to ``block`` centroids travel as one array column of a single row: a
    projection instead of a pairing of rows. More are several such rows, each
    vector meets each row, and its best of all rows is taken.
    """
    n = max(1, -(-cents.count() // block))
    packed = cents.groupBy(F.pmod(F.xxhash64("label"), F.lit(n))).agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("l"), "centroid"))).alias("cs")).select("cs")
    best = F.array_max(F.transform("cs", lambda c: F.struct(V.cosine(F.col("embedding"), c["centroid"]).alias("sim"), (-c["l"]).alias("neg"))))
    out = vectors.join(F.broadcast(packed) if n == 1 else packed).select(id_col, best.alias("best"))
    if n > 1:
        out = out.groupBy(id_col).agg(F.max("best").alias("best"))
    return out.select(id_col, (-F.col("best.neg")).alias("label"), F.col("best.sim").alias("similarity"))


def prune_satellites(vectors: DataFrame, least: int) -> DataFrame:
    """Members of small clusters move to the nearest centroid of the major ones."""
    major = cluster_sizes(vectors, least).select("label")
    stay = vectors.join(major, "label", "left_semi")
    move = vectors.join(major, "label", "left_anti")
    return stay.select("vec_id", "label").unionByName(nearest_centroid(move, centroids(stay)).select("vec_id", "label"))


def packed_blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Vectors (vec_id, embedding) as rows of one array each, of about ``rows`` vectors."""
    n = max(1, -(-vectors.count() // rows))
    return vectors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias(name)).drop("_b")


def best_pairs(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map of rows (qs, vs), blocks of (vec_id, embedding): the ``k`` best vectors of each query of the block, by one matrix product."""

    def arrays(block: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        ids, x = block.values.field("vec_id").to_numpy(), np.array(block.values.field("embedding").to_pylist(), float)
        order, n = np.argsort(ids), np.linalg.norm(x, axis=1, keepdims=True)
        return ids[order], np.divide(x, n, out=np.zeros_like(x), where=n > 0)[order]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, v in zip(b.column("qs"), b.column("vs"), strict=True):
                (q_ids, q), (v_ids, v) = arrays(q), arrays(v)
                sims, at = np.round(q @ v.T, 6), np.arange(len(q))
                for _ in range(min(k, len(v))):
                    top = sims.argmax(1)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(v_ids[top]), pa.array(sims[at, top])], names=["q_id", "vec_id", "sim"])
                    sims[at, top] = -np.inf

    return best


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, query_rows: int = 256, vector_rows: int = 2048) -> DataFrame:
    """(q_id, vec_id, sim): the ``k`` best vectors of each query, ties to the smaller id.

    Blocks of queries meet blocks of vectors as matrix products, so a task holds two
    blocks; of each pair of blocks ``k`` rows a query are left for the last ranking.
    """
    pairs = packed_blocks(queries, query_rows, "qs").crossJoin(packed_blocks(vectors, vector_rows, "vs"))
    found = pairs.mapInArrow(best_pairs(k), "q_id long, vec_id long, sim double")
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("sim"), "vec_id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def fewer(rows: DataFrame, k: int) -> bool:
    """Whether there are fewer than ``k`` rows; counts no further than that."""
    return rows.limit(k).count() < k


def context(found: DataFrame, most_chars: int = 800) -> DataFrame:
    """One row with the labelled excerpts in rank order."""
    rank = F.row_number().over(W.orderBy(F.desc("relevance"), "distance", "chunk_id"))
    tag = F.concat(F.lit("[Excerpt "), F.col("rank").cast("string"), F.lit(" | Meeting: "), "meeting_id", F.lit(" | Type: "), "source_type", F.lit("]\n"), shortened(F.col("text"), most_chars))
    lines = found.withColumn("rank", rank).withColumn("line", tag)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line", "meeting_id")))
    packed = lines.agg(ordered.alias("x"))
    return packed.select(
        F.array_join(F.transform("x", lambda s: s["line"]), "\n\n---\n\n").alias("context"), F.array_distinct(F.transform("x", lambda s: s["meeting_id"])).alias("meeting_ids"), F.size("x").alias("n_sources")
    )


def answer(found: DataFrame, question: str, generate: Callable[[str], str], template: str) -> DataFrame:
    """Grounded answer: the generator is asked once, on an executor, and never about an empty result."""
    ctx = context(found)
    prompt = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.col("context")), F.lit("{question}"), F.lit(question))
    said = F.pandas_udf(lambda s: s.map(lambda p: generate(p).strip(), na_action="ignore"), "string")(F.when(F.col("n_sources") > 0, prompt))
    return ctx.select(F.coalesce(said, F.lit(NOTHING_FOUND)).alias("answer"), "meeting_ids", "n_sources")
