"""Speaker clustering per meeting, by average linkage whatever the number of windows.

The mean distance of two clusters of unit vectors follows from their sums and sizes,
so memory grows with the windows; time grows with their square. A meeting of up to
``LARGE`` windows is one group in one task (grouped pandas); a larger one is linked in
rounds over blocks (``linkage``), and its centroids alone come together for merging.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import vectors as V
from colloquy.operators.linkage import linked
from colloquy.operators.turns import relabel
from colloquy.shipping import ship
from colloquy.sources.store import written

#: Windows of a meeting that one task clusters.
LARGE = 20_000


def units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


#: Entries of a block of similarities.
BLOCK = 1 << 20


def merges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """(distance, i, j) of all merges of average linkage, by a chain of nearest neighbours.

    Each cluster stands at the place of one of its members. A merge is never closer
    than those within its two clusters, so ordering by distance gives the greedy order.
    """
    total, size, high, place = x.copy(), np.ones(len(x)), np.zeros(len(x)), np.arange(len(x))
    chain, out, left = [], [], len(x)
    while left > 1:
        if left < 0.8 * len(size):  # what was merged away isn't compared any more
            alive = size > 0
            chain = list((np.cumsum(alive) - 1)[chain])
            total, size, high, place = total[alive], size[alive], high[alive], place[alive]
        if not chain:
            chain = [int(np.argmax(size > 0))]
        i = chain[-1]
        d = np.full(len(size), np.inf)
        np.divide(total @ total[i], size * -size[i], out=d, where=size > 0)
        d[i] = np.inf
        j = int(np.argmin(d))
        # of equally near neighbours the one before is taken, so the chain ends
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]
            del chain[-2:]
            high[i] = max(1 + d[j], high[i], high[j])
            out.append((high[i], place[i], place[j]))
            total[i] += total[j]
            size[i] += size[j]
            size[j] = 0
            left -= 1
        else:
            chain.append(j)
    return sorted(out, key=lambda m: m[0])


def average_linkage(x: np.ndarray, limit: float | None = None, k: int | None = None) -> np.ndarray:
    """Agglomerative clustering on cosine distance until ``limit`` is passed or ``k`` remain."""
    found = merges(x)
    taken = found[: max(0, len(x) - k)] if k else [m for m in found if k is not None or m[0] <= limit]
    label = np.arange(len(x))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for _, i, j in taken:
        i, j = root(i), root(j)
        label[max(i, j)] = min(i, j)
    return np.array([root(i) for i in range(len(x))])


def means(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, own, n = np.unique(label, return_inverse=True, return_counts=True)
    order = np.argsort(own, kind="stable")
    return names, units(np.add.reduceat(x[order], np.cumsum(n) - n, axis=0) / n[:, None])


def merge_centroids(x: np.ndarray, label: np.ndarray, at_least: float) -> np.ndarray:
    """Merge the first pair of labels whose centroids are that similar; begin again after each.

    Labels before the one at hand are near no other, so beginning again only has
    to compare them with the centroid that the merge has moved.
    """
    label = label.copy()
    names, c = means(x, label)
    alive, i = np.ones(len(names), bool), 0
    while i < len(names):
        close = (c @ c[i] >= at_least) & alive
        close[i] = False
        if not alive[i] or not close.any():
            i += 1
            continue
        i, j = sorted((i, int(close.argmax())))
        label[label == names[j]] = names[i]
        alive[j], c[i] = False, units(x[label == names[i]].mean(0, keepdims=True))[0]
    return label


def prune(x: np.ndarray, label: np.ndarray, least: int) -> np.ndarray:
    names, n = np.unique(label, return_counts=True)
    major = names[n >= least] if (n >= least).any() else names[[n.argmax()]]
    keep = np.isin(label, major)
    own, c = means(x[keep], label[keep])
    out = label.copy()
    moved, rows = np.flatnonzero(~keep), max(1, BLOCK // len(own))
    for start in range(0, len(moved), rows):
        part = moved[start : start + rows]
        out[part] = own[(x[part] @ c.T).argmax(1)]
    return out


class Online:
    """Centroids that vectors join one after the other: the best one if it is similar enough (and is pulled), else a new one."""

    def __init__(self, at_least: float = 0.8, pull: float = 0.2, centroids: np.ndarray | None = None):
        self.at_least, self.pull, self.count = at_least, pull, 0 if centroids is None else len(centroids)
        self.held = np.zeros((0, 0)) if centroids is None else centroids.copy()

    @property
    def centroids(self) -> np.ndarray:
        return self.held[: self.count]

    def take(self, v: np.ndarray) -> int:
        """The label of the next (unit) vector."""
        sims = (self.centroids * v).sum(1) if self.count else np.zeros(0)
        if self.count and sims.max() >= self.at_least:
            k = int(sims.argmax())
            c = (1 - self.pull) * self.held[k] + self.pull * v
            self.held[k] = c / (np.linalg.norm(c) or 1)
            return k
        if self.count == len(self.held):  # room for twice as many
            grown = np.zeros((max(4, 2 * self.count), len(v)))
            if self.count:
                grown[: self.count] = self.centroids
            self.held = grown
        self.held[self.count] = v
        self.count += 1
        return self.count - 1


def sequential(x: np.ndarray, at_least: float = 0.8, pull: float = 0.2) -> np.ndarray:
    """Labels of the rows, taken one after the other."""
    online = Online(at_least, pull)
    return np.array([online.take(v) for v in x], int)


def by_appearance(label: np.ndarray) -> np.ndarray:
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def cluster(x: np.ndarray, k: int | None = None, threshold: float = 0.8, merge: float = 0.88, least: int = 3) -> np.ndarray:
    if len(x) == 0:
        return np.zeros(0, int)
    x = units(x.astype(float))
    if len(x) == 1 or not x.any():
        return np.zeros(len(x), int)
    label = average_linkage(x, max(0.05, 1 - threshold), k)
    if k is None:
        label = prune(x, merge_centroids(x, label, merge), least)
    return by_appearance(label)


def merge_totals(totals: np.ndarray, at_least: float) -> np.ndarray:
    """As ``merge_centroids``, of clusters in the order of their labels that are given by their sums: the place of the one that each joins."""
    totals, into = totals.copy(), np.arange(len(totals))
    c, alive, i = units(totals), np.ones(len(totals), bool), 0
    while i < len(totals):
        close = (c @ c[i] >= at_least) & alive
        close[i] = False
        if not alive[i] or not close.any():
            i += 1
            continue
        i, j = sorted((i, int(close.argmax())))
        into[into == j] = i
        totals[i] += totals[j]
        alive[j], c[i] = False, units(totals[i : i + 1])[0]
    return into


def cluster_large(windows: DataFrame, threshold: float = 0.8, merge: float = 0.88, least: int = 3) -> DataFrame:
    """(meeting_id, idx, speaker_id) as ``cluster`` gives them without ``k``, for meetings of any size."""
    x = windows.select("meeting_id", F.col("idx").cast("long").alias("idx"), V.unit(F.col("embedding").cast("array<double>")).alias("unit"))
    x = written(x, "unit-windows")
    members, clusters = linked(x, max(0.05, 1 - threshold))

    def judged(pdf):
        """Merged clusters of one meeting, and whether a cluster's windows stay in it."""
        pdf = pdf.sort_values("cid")
        total, size = np.array(pdf["total"].tolist()), pdf["size"].to_numpy()
        into = merge_totals(total, merge)
        n = np.bincount(into, size, len(into))
        stays = n >= least if (n >= least).any() else np.arange(len(n)) == n.argmax()
        summed = np.zeros_like(total)
        np.add.at(summed, into, total)
        cid = pdf["cid"].to_numpy()
        return pdf[["meeting_id", "cid"]].assign(label=cid[into], stays=stays[into], centroid=[list(c) for c in units(summed[into])])

    out = written(clusters.groupBy("meeting_id").applyInPandas(judged, "meeting_id string, cid long, label long, stays boolean, centroid array<double>"), "merged-clusters")
    placed = members.join(out.select("meeting_id", "cid", "label", "stays"), ["meeting_id", "cid"])
    major = out.where("stays AND cid = label").groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("l"), "centroid"))).alias("cs"))
    best = F.array_max(F.transform("cs", lambda c: F.struct(V.dot(F.col("unit"), c["centroid"]).alias("sim"), (-c["l"]).alias("neg"))))
    moved = placed.where("NOT stays").join(x, ["meeting_id", "idx"]).join(major, "meeting_id").select("meeting_id", "idx", (-best["neg"]).alias("label"))
    every = placed.where("stays").select("meeting_id", "idx", "label").unionByName(moved)
    return relabel(every, "label", "idx").select("meeting_id", "idx", F.col("label").cast("int").alias("speaker_id"))


def cluster_meetings(windows: DataFrame, k: int | None = None, large: int = LARGE) -> DataFrame:
    """(meeting_id, idx, speaker_id) for windows (meeting_id, idx, embedding).

    With an exact number ``k`` of speakers a meeting is one group whatever its size.
    """
    ship(windows.sparkSession)

    def one(pdf):
        pdf = pdf.sort_values("idx")
        return pdf[["meeting_id", "idx"]].assign(speaker_id=cluster(np.array(pdf["embedding"].tolist()), k))

    w = windows.select(F.col("meeting_id").cast("string").alias("meeting_id"), "idx", "embedding")
    grouped = lambda some: some.groupBy("meeting_id").applyInPandas(one, "meeting_id string, idx long, speaker_id int")
    if k is not None:
        return grouped(w)
    many = written(w.groupBy("meeting_id").count().where(F.col("count") > large).select("meeting_id"), "large-meetings")
    if many.isEmpty():
        return grouped(w)
    return grouped(w.join(many, "meeting_id", "left_anti")).unionByName(cluster_large(w.join(many, "meeting_id", "left_semi")))
