"""Vector search that doesn't look at every row: an inverted file of cells.

Centroids come from a bounded sample; every row is in the cell of its nearest one,
and rows lie sorted by cell, so that a filter on cells skips row groups. A query
looks at its nearest cells alone, and what it finds there is ranked by exact cosine.
How many cells that are is chosen when the file is built: the fewest that reach a
target recall over a bounded set of rows asked as queries against all rows.

``exact`` goes on: a cell of which no member can be as near as the k-th found so
far (its centroid's angle to the query less the cell's radius says so) is left out,
all others are looked at too, so the result is that of a whole scan.

Defined results: a zero vector has similarity 0 to everything; ties go to the
smaller id; a filter that leaves fewer than ``k`` rows in the cells looked at makes a
search look at all cells; an empty table has no cells and no results. A cell of any
size is cut into blocks of bounded rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators import search as S
from colloquy.shipping import ship
from colloquy.sources.store import scratch, written

#: Rows that centroids are trained on, at most; rows asked to choose the number of cells.
SAMPLE, ASKED = 65_536, 400
MOST_CELLS = 4096
#: Rows of a block of vectors and of queries.
BLOCK, QUERIES = 2048, 256
#: Half a unit of the last place of a similarity, and more.
SLACK = 2e-6


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(vectors: pa.Array) -> np.ndarray:
    """(rows, dim) of an Arrow array of lists of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def trained(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit rows (spherical k-means); an empty cell keeps its centroid."""
    c = x[np.random.default_rng(0).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + BLOCK] @ c.T).argmax(1) for i in range(0, len(x), BLOCK)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = np.linalg.norm(sums, axis=1) > 0
        c[full] = unit_rows(sums[full])
    return c


def cell_order(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cells of each query row, the nearest first."""
    return np.argsort(-(unit_rows(q) @ centroids.T), axis=1, kind="stable")


@dataclass
class InvertedFile:
    rows: DataFrame  # the columns given, and cell
    centroids: np.ndarray
    radius: np.ndarray  # largest angle between a cell's centroid and a member
    size: np.ndarray
    probes: int

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells of each query row, the nearest first."""
        return cell_order(q, self.centroids)

    def share(self, queries: np.ndarray, probes: int | None = None) -> float:
        """Share of all rows that the queries look at, on average."""
        if not len(queries) or not self.size.sum():
            return 0.0
        return float(self.size[self.order(queries)[:, : probes or self.probes]].sum() / self.size.sum() / len(queries))

    def search(self, query: list[float], k: int, where: Column | None = None, probes: int | None = None, id_col: str = "vec_id") -> DataFrame:
        """Top-k of one query in its nearest cells, with distance and relevance as in ``search.top_k``."""
        near = self.order(np.array([query], float))[0, : probes or self.probes].tolist() if len(self.centroids) else []
        some = self.rows.where(F.col("cell").isin(near))
        found = some if where is None else some.where(where)
        return S.top_k(found if not S.fewer(found, k) else self.rows, query, k, where, id_col)

    def _routed(self, queries: DataFrame, probes: int, floor: bool) -> DataFrame:
        """(cell, vec_id, embedding) of each cell that a query looks at; with ``floor``, the cells beyond the first that may still hold one as near as ``floor``."""
        centroids, radius = self.centroids, self.radius

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = matrix(b.column("embedding"))
                if not len(q):
                    continue
                order = cell_order(q, centroids)
                if floor:
                    angle = np.arccos(np.clip(unit_rows(q) @ centroids.T, -1, 1))
                    most = np.cos(np.maximum(angle - radius - 1e-9, 0))
                    ok = most >= b.column("floor").to_numpy()[:, None] - SLACK
                    np.put_along_axis(ok, order[:, :probes], False, axis=1)
                    who, cell = np.nonzero(ok)
                else:
                    who, cell = np.repeat(np.arange(len(q)), order[:, :probes].shape[1]), order[:, :probes].ravel()
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("vec_id").take(pa.array(who)), b.column("embedding").take(pa.array(who))], names=["cell", "vec_id", "embedding"])

        asked = queries.select("vec_id", "embedding", *(["floor"] if floor else []))
        return asked.mapInArrow(task, f"cell int, vec_id long, embedding {dict(queries.dtypes)['embedding']}")

    def _found(self, routed: DataFrame, blocks: DataFrame, k: int, n_queries: int) -> DataFrame:
        """Best pairs of blocks: a cell's queries meet each of the cell's blocks under a key of its own."""
        many = max(1, -(-n_queries // QUERIES))
        qs = routed.groupBy("cell", F.pmod(F.xxhash64("vec_id"), F.lit(many)).alias("_b")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("qs")).drop("_b")
        qs = qs.join(self._block_counts(), "cell").select("cell", "qs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return qs.join(blocks, ["cell", "block"]).select("qs", "vs").mapInArrow(S.best_pairs(k), "q_id long, vec_id long, sim double")

    def _block_counts(self) -> DataFrame:
        """(cell, blocks): at most ``MOST_CELLS`` rows."""
        spark = self.rows.sparkSession
        return F.broadcast(spark.createDataFrame([(i, int(-(-n // BLOCK))) for i, n in enumerate(self.size.tolist()) if n], "cell int, blocks int"))

    def nearest(self, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(q_id, vec_id, sim): the ``k`` best vectors that each query (vec_id, embedding) finds, ties to the smaller id."""
        spark = queries.sparkSession
        ship(spark)
        if not len(self.centroids):
            return spark.createDataFrame([], "q_id long, vec_id long, sim double")
        rows = self.rows if where is None else self.rows.where(where)
        block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
        blocks = rows.join(self._block_counts(), "cell").groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).alias("vs"))
        queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        n, probes = queries.count(), probes or self.probes
        found = written(ranked(self._found(self._routed(queries, probes, False), blocks, k, n), k), "probed")
        whole = probes >= len(self.centroids)
        if whole or not (exact or where is not None):
            return found
        # the k-th similarity found; where there are fewer, every cell is looked at
        floors = found.groupBy("q_id").agg(F.when(F.count("*") >= k, F.min("sim")).alias("floor"))
        rest = queries.join(floors.withColumnRenamed("q_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        rest = rest if exact else rest.where("floor = -2.0")
        return ranked(found.unionByName(self._found(self._routed(rest, probes, True), blocks, k, n)), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("sim"), "vec_id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def built(vectors: DataFrame, cells: int | None = None, recall: float = 0.97, k: int = 10, sample: int = SAMPLE, asked: int = ASKED) -> InvertedFile:
    """An inverted file of all rows of ``vectors`` (vec_id, embedding, and other columns).

    ``cells``: twice the root of the number of rows if not given, ``MOST_CELLS`` at most.
    ``sample`` rows, drawn by a hash, train the centroids; ``asked`` of them are asked
    against all rows to choose the number of cells for ``recall`` at ``k``.
    """
    spark = vectors.sparkSession
    ship(spark)
    n = vectors.count()
    cells = min(cells or max(1, int(2 * n**0.5)), MOST_CELLS)
    draw = F.xxhash64(F.lit(17), "vec_id", "embedding")
    share = F.pmod(draw, F.lit(1 << 30)) < min(1.0, 2 * sample / max(n, 1)) * (1 << 30)
    drawn = [r["embedding"] for r in vectors.where(share).orderBy(draw).limit(sample).select("embedding").collect()]
    if not drawn:
        return InvertedFile(vectors.withColumn("cell", F.lit(0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64), 1)
    centroids = trained(unit_rows(np.array(drawn, float)), cells)
    fields = f"{', '.join(f'`{c}` {t}' for c, t in vectors.dtypes)}, cell int, angle double"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, angle = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            x = unit_rows(matrix(b.column("embedding")))
            for i in range(0, len(x), BLOCK):
                sims = x[i : i + BLOCK] @ centroids.T
                cell[i : i + BLOCK] = sims.argmax(1)
                angle[i : i + BLOCK] = np.arccos(np.clip(sims.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    path = scratch(spark, "inverted")
    placed = vectors.mapInArrow(task, fields).repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell")
    placed.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    size, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("a")).collect():  # a row a cell
        size[r["cell"]], radius[r["cell"]] = r["n"], r["a"]
    file = InvertedFile(rows.drop("angle"), centroids, radius, size, len(centroids))
    file.probes = probes_for(file, vectors.orderBy(F.xxhash64(F.lit(23), "vec_id")).limit(asked).select("vec_id", "embedding"), recall, k)
    return file


def probes_for(file: InvertedFile, queries: DataFrame, recall: float, k: int) -> int:
    """The fewest cells in which the queries find ``recall`` of their true ``k`` nearest."""
    queries = written(queries, "asked")
    truth = S.nearest_vectors(queries, file.rows.select("vec_id", "embedding"), k).join(file.rows.select("vec_id", "cell"), "vec_id")
    cells: dict[int, list[int]] = {}
    for r in truth.select("q_id", "cell").collect():  # ``asked`` times ``k`` rows, repeated ids aside
        cells.setdefault(r["q_id"], []).append(r["cell"])
    places = []
    for r in queries.collect():
        place = np.empty(len(file.centroids), int)
        place[file.order(np.array([r["embedding"]], float))[0]] = np.arange(len(file.centroids))
        places += place[cells.get(r["vec_id"], [])].tolist()
    return int(np.sort(places)[max(0, int(np.ceil(recall * len(places))) - 1)]) + 1 if places else 1
