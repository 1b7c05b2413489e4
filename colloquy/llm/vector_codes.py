"""Product codes of vectors: integer codebooks by Lloyd's rounds with Yinyang bounds.

Components become integers (``floor(scale * x)``), vectors are cut into equal
parts, and each part position has a codebook. The entries of a codebook are put
into groups once; a row keeps, for each part, its entry, an upper bound of the
distance to it and one lower bound for each group. When entries have moved, the
bounds move with them (by the entry's drift, and by the largest drift of a group),
and only rows whose bounds may cross are looked at, and of those only the groups
whose own bound fails. Distances are then exact integers, so that ties go to the
lower index; bounds are rounded outwards, so a group that is passed over holds
neither a nearer entry nor an equally near one.

Each round is one map over the table of the round before, which it replaces: rows
carry their bounds, and each task adds one row with its sums by entry. These are
added up in Spark; what reaches the driver are the codebooks alone, whose size
doesn't depend on the table.

Defined results: rows whose vector is null or holds a null, NaN or infinite
component are dropped; null ``vec_id`` counts as larger than all others, repeated
ones are ordered by their vectors; with fewer rows than entries there are fewer
entries; an unused entry stays; null labels are one label; an empty table gives no
rows; other columns are ignored. Vectors of different lengths, a length that the
number of parts doesn't divide, and components too large for exact squares in 64
bits (over ``largest(width)``, at width 8 some 92,000 in the input's unit) are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import all_salts, dropped, fewer_than, fresh_path, salted, ship, spread, table, written

#: Rows whose bounds a task holds at once.
ROWS = 8192
#: Share by which bounds are widened before they are rounded to 32 bits.
SLACK = 1e-9
NEVER = np.iinfo(np.int64).max
#: Sums by label that are sent along; beyond, the sums are joined under salts.
SMALL = 100_000
SALTS = 16


def largest(width: int) -> int:
    """Largest component whose squared differences, summed over a part, stay below 2^62."""
    return int((2**60 // width) ** 0.5)


@dataclass
class Codebooks:
    """(parts, entries, width) integer entries and the group of each entry."""

    entries: np.ndarray
    group: np.ndarray
    groups: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group for each of a codebook's entries: Lloyd's rounds over the entries themselves."""
    spread_out = entries[np.linspace(0, len(entries) - 1, groups).astype(int)].astype(float)
    for _ in range(5):
        at = ((entries[:, None] - spread_out[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (at == g).any():
                spread_out[g] = entries[at == g].mean(0)
    return at


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def as_integers(vectors: pa.Array, dim: int, parts: int, scale: int) -> np.ndarray:
    """(rows, dim) integer components."""
    lens = vectors.value_lengths().to_numpy()
    if (lens != dim).any():
        raise ValueError(f"vectors of {dim} and of {int(lens[lens != dim][0])} components")
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if np.abs(x).max(initial=0) > largest(max(dim // parts, 1)):
        raise ValueError("a component is too large for exact squares in 64 bits")
    return x.astype(np.int64).reshape(-1, dim)


def lowered(x: np.ndarray) -> np.ndarray:
    """Lower bounds in 32 bits."""
    return np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


def raised(x: np.ndarray) -> np.ndarray:
    """Upper bounds in 32 bits."""
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of (rows, width) to (entries, width)."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - entries[None, :, j]) ** 2
    return out


def reassigned(x: np.ndarray, book: np.ndarray, group: np.ndarray, groups: int, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Move rows to their nearest entries and mend the bounds, in place; returns how many distances were measured.

    ``lower[:, g]`` bounds the distance to the entries of group ``g`` other than the row's own.
    """
    rows = np.flatnonzero(~(upper < lower.min(1)))
    if not len(rows):
        return 0
    own = ((x[rows] - book[near[rows]]) ** 2).sum(1)
    upper[rows] = raised(np.sqrt(own))
    fails = ~(upper[rows, None] < lower[rows])
    d = np.full((len(rows), len(book)), NEVER)
    d[np.arange(len(rows)), near[rows]] = own
    measured = len(rows)
    for g in range(groups):
        at, members = np.flatnonzero(fails[:, g]), np.flatnonzero(group == g)
        if len(at) and len(members):
            d[np.ix_(at, members)] = squares(x[rows[at]], book[members])
            measured += len(at) * len(members)
    best = d.argmin(1)  # the lowest index of the nearest
    moved = np.arange(len(rows)), best
    upper[rows] = raised(np.sqrt(d[moved]))
    near[rows] = best
    d[moved] = NEVER
    for g in range(groups):
        members = np.flatnonzero(group == g)
        if len(members):
            least = d[:, members].min(1)
            seen = np.where(least == NEVER, np.float32(np.inf), lowered(np.sqrt(least.astype(np.float64))))
            # a group that was passed over keeps its bound, but for the entry that the row has left
            lower[rows, g] = np.where(fails[:, g], seen, np.minimum(lower[rows, g], seen))
    return measured


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry of each part moved, rounded up."""
    return raised(np.sqrt(((old - new) ** 2).sum(2).astype(np.float64))) * (old != new).any(2)


STATE = "flat binary, near binary, bounds binary, sums array<long>"


def first_state(vectors: pa.Array, book: Codebooks, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(integers, entries, upper and lower bounds) that ask for every group of every part."""
    parts, _, width = book.entries.shape
    flat = as_integers(vectors, parts * width, parts, scale)
    n = len(flat)
    return flat, np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, book.groups), np.float32)


def held_state(b: pa.RecordBatch, book: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts, _, width = book.entries.shape
    n = b.num_rows
    of = lambda name, kind: np.frombuffer(b"".join(b.column(name).to_pylist()), kind)
    bounds = of("bounds", np.float32).reshape(n, parts, 1 + book.groups)
    return of("flat", np.int32).reshape(n, parts * width).astype(np.int64), of("near", np.uint8).reshape(n, parts).copy(), bounds[:, :, 0].copy(), bounds[:, :, 1:].copy()


def round_of(book: Codebooks, moved: np.ndarray | None, scale: int, keep: list[str], last: bool):
    """One assignment of every row; ``moved`` are the entries' drifts (None: rows are vectors without a state).

    Gives the rows with their new state and, last, a row with the task's sums; in the last round (code, error) instead.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = book.entries.shape
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        kind, any_rows = None, False
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                flat, near, upper, lower = first_state(b.column("embedding"), book, scale) if moved is None else held_state(b, book)
                n, errors = len(flat), np.zeros(b.num_rows, np.int64)
                for p in range(parts):
                    x, mine = flat[:, p * width : (p + 1) * width], near[:, p]
                    if moved is not None:
                        upper[:, p] = raised(upper[:, p] + moved[p][mine])
                        far = np.array([moved[p][book.group[p] == g].max(initial=0) for g in range(book.groups)], np.float32)
                        lower[:, p] = np.maximum(np.nextafter(lower[:, p] - far, np.float32(-np.inf)), 0)
                    reassigned(x, book.entries[p], book.group[p], book.groups, mine, upper[:, p], lower[:, p])
                    if last:
                        errors += ((x - book.entries[p][mine]) ** 2).sum(1)
                        continue
                    counts[p] += np.bincount(mine, minlength=k)
                    for j in range(width):  # below 2^53: exact
                        sums[p, :, j] += np.bincount(mine, x[:, j], k).astype(np.int64)
                kept = [b.column(c) for c in keep]
                if last:
                    codes = near.tobytes().hex()
                    made = [pa.array([codes[i : i + 2 * parts] for i in range(0, len(codes), 2 * parts)], pa.string()), pa.array(errors)]
                    yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, "code", "error"])
                    continue
                any_rows, kind = True, [c.type for c in kept]
                bounds = np.concatenate([upper[:, :, None], lower], 2)
                state = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (flat.astype(np.int32), near, bounds)]
                yield pa.RecordBatch.from_arrays([*kept, *state, pa.nulls(n, pa.list_(pa.int64()))], names=[*keep, "flat", "near", "bounds", "sums"])
        if any_rows:
            total = np.concatenate([counts[:, :, None], sums], 2).ravel()
            none = [pa.nulls(1, t) for t in kind] + [pa.nulls(1, pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*none, pa.array([total], pa.list_(pa.int64()))], names=[*keep, "flat", "near", "bounds", "sums"])

    return task


def averaged(state: DataFrame, book: Codebooks) -> np.ndarray:
    """New entries: floors of the means of the rows that have them; the tasks' sums are added up in Spark."""
    parts, k, width = book.entries.shape
    totals = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("seat", "x")).groupBy("seat").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    flat = np.zeros(parts * k * (1 + width), object)
    for r in totals:
        flat[r["seat"]] = int(r["x"])
    flat = flat.reshape(parts, k, 1 + width)
    new = book.entries.copy()
    for p, e in zip(*np.nonzero(flat[:, :, 0]), strict=True):
        new[p, e] = [int(s) // int(flat[p, e, 0]) for s in flat[p, e, 1:]]
    return new


def first_books(rows: DataFrame, parts: int, entries: int, groups: int, scale: int) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; None without a row."""
    few = [r["embedding"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()]
    if not few:
        return None
    dim = len(few[0])
    if not dim or dim % parts:
        raise ValueError(f"{dim} components can't be cut into {parts} parts")
    flat = as_integers(pa.array(few, pa.list_(pa.float64())), dim, parts, scale)
    books = flat.reshape(len(few), parts, dim // parts).transpose(1, 0, 2)
    groups = min(groups, len(few))
    return Codebooks(books, np.stack([grouped(b, groups) for b in books]), groups)


def encoded(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 2, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, code, error) of the usable vectors, the codebooks); at most 256 entries."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select("vec_id", "embedding", "label").where(usable(F.col("embedding")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    if entries > 256:
        raise ValueError("a code has one byte for each part")
    book = first_books(rows, parts, entries, groups, scale)
    if book is None:
        return spark.createDataFrame([], f"{head}, code string, error long"), None
    now, at, moved = spread(rows), None, None
    for _ in range(rounds):
        task = round_of(book, moved, scale, ["vec_id", "label"], last=False)
        state, path = now.mapInArrow(task, f"{head}, {STATE}"), fresh_path(spark, "vector-state")
        state.write.option("compression", "zstd").parquet(path)
        if at is not None:
            dropped(spark, at)
        at, state = path, spark.read.schema(state.schema).parquet(path)
        entries_now = averaged(state, book)
        moved, book = drifts(book.entries, entries_now), Codebooks(entries_now, book.group, book.groups)
        now = state.where("sums IS NULL").drop("sums")
    task = round_of(book, moved, scale, ["vec_id", "label"], last=True)
    out = written(now.mapInArrow(task, f"{head}, code string, error long"), "vector-codes")
    if at is not None:
        dropped(spark, at)
    return out, book


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``: the errors of all rows of a label, nulls together; a large label is split."""
    sums = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    of = sums.select(F.col("label").alias("of_label"), "label_error")
    alike = F.col("label").eqNullSafe(F.col("of_label"))
    if fewer_than(sums, SMALL):
        return codes.join(F.broadcast(of), alike).drop("of_label")
    of = of.select("*", all_salts(SALTS).alias("of_salt"))
    dealt = codes.withColumn("salt", salted(F.struct("vec_id", "code", "error"), SALTS))
    return dealt.join(of, alike & (F.col("salt") == F.col("of_salt"))).drop("of_label", "of_salt", "salt")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, book = encoded(table(spark, sf_dir, "embeddings"))
    out = with_label_errors(codes)
    return out.select("vec_id", "code", "error", "label_error", F.lit(book.sha256() if book else None).cast("string").alias("codebooks_sha256"))


def lloyd_sql(rounds: int = 6) -> str:
    """The rounds written out, one after the other."""
    d = "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))"
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS rid
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS MATERIALIZED (SELECT rid, CAST(p AS INT) AS p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) t(p))",
        "b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM parts WHERE rid <= 16)",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, a.p, any_value(a.x) AS x, min(CAST({d} AS HUGEINT) * 16 + e) AS m FROM parts a JOIN b{r} b ON a.p = b.p GROUP BY rid, a.p)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT p, CAST(m % 16 AS BIGINT) AS e, unnest(x) AS c, unnest(range(len(x))) AS j FROM a{r})")
            steps.append(f"f{r} AS (SELECT p, e, j, CAST((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS c FROM s{r} GROUP BY p, e, j)")
            steps.append(f"n{r} AS (SELECT p, e, list(c ORDER BY j) AS x FROM f{r} GROUP BY p, e)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN n{r} n ON b.p = n.p AND b.e = n.e)")
    steps.append(f"codes AS (SELECT rid, string_agg(printf('%02x', CAST(m % 16 AS INT)), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)")
    steps.append(f"book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN kept USING (rid), book"


OP12_SQL = lloyd_sql()
