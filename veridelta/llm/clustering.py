"""Clusters around centroids: exact integer k-means whose nearest-centroid search walks a vantage-point tree.

Each round builds a vantage-point tree over the centroids on the driver and ships it with the tasks; it holds as many
vectors as there are centroids, whatever the table's size. Every vector walks the tree best-first: it opens the node
of its smallest lower bound while that bound doesn't exceed its best distance (the radius is inclusive, so that a tie
with a smaller number is still found). Distances are taken exactly, in integers; only bounds are floating.

A batch of vectors walks together: each has its own bounds and its own next node, and those at the same node are
measured at once. Sums are added up a task, so that a cluster with most of the rows costs no more than others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

ship(__name__)

#: Integers are held to this magnitude, so that a squared distance of a few dozen components fits into a long.
LIMIT = 1 << 27
LEAF = 4


@dataclass(frozen=True)
class Clusters:
    """k: centroids; rounds of assigning and moving; size: components of a vector; scale: of the grid; seed: of the first centroids."""

    k: int = 40
    rounds: int = 5
    size: int = 64
    scale: int = 256
    seed: int = 2


def quantized(col: pa.Array, c: Clusters) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold c.size finite components, and these as integers floor(scale * x)."""
    n = len(col)
    if not n:
        return np.zeros(0, bool), np.zeros((0, c.size), np.int64)
    lens = np.nan_to_num(np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.float64), nan=-1)
    ok = lens == c.size
    flat = col.filter(pa.array(ok)).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, c.size)  # nulls become nan
    fine = np.isfinite(x).all(axis=1)
    ok[np.flatnonzero(ok)[~fine]] = False
    with np.errstate(over="ignore"):
        return ok, np.clip(np.floor(x[fine] * c.scale), -LIMIT, LIMIT).astype(np.int64)


def squared(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v from w, or from the rows of w."""
    d = v - w
    return np.einsum("...i,...i->...", d, d)


@dataclass(frozen=True)
class Tree:
    """Vantage-point tree. A node has the number of its vantage point and its two children, with the range of distances
    from the vantage point in each; a leaf has a list of numbers."""

    points: np.ndarray
    nodes: list

    @staticmethod
    def of(points: np.ndarray) -> Tree:
        nodes: list = []

        def grow(ids: np.ndarray) -> int:
            at = len(nodes)
            nodes.append(None)
            if len(ids) <= LEAF:
                nodes[at] = ids
                return at
            # of all points, the one that the others' distances spread most around
            spread = [np.sqrt(squared(points[ids], points[i]).astype(np.float64)).std() for i in ids]
            top = ids[int(np.argmax(spread))]
            rest = ids[ids != top]
            d = np.sqrt(squared(points[rest], points[top]).astype(np.float64))
            order = np.argsort(d, kind="stable")
            near, far = order[: len(order) // 2], order[len(order) // 2 :]
            kids = [(grow(rest[x]), d[x].min(), d[x].max()) for x in (near, far)]
            nodes[at] = (int(top), kids)
            return at

        if len(points):
            grow(np.arange(len(points)))
        return Tree(points, nodes)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest point of each row (the smaller one of equals), its squared distance, and how many distances were measured."""
        n = len(v)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.points), np.int64)
        bounds = np.full((n, max(len(self.nodes), 1)), np.inf)
        bounds[:, 0] = 0
        measured = 0
        active = np.arange(n)

        def seen(rows: np.ndarray, i: int) -> np.ndarray:
            nonlocal measured
            d = squared(v[rows], self.points[i])
            measured += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (i < who[rows]))
            best[rows[better]], who[rows[better]] = d[better], i
            return d

        while len(active):
            node = bounds[active].argmin(axis=1)
            least = bounds[active, node]
            radius = np.sqrt(best[active].astype(np.float64))
            going = least <= radius * (1 + 1e-9) + 1e-6
            active, node = active[going], node[going]
            for at in np.unique(node):
                rows = active[node == at]
                low = bounds[rows, at]
                bounds[rows, at] = np.inf
                if isinstance(self.nodes[at], tuple):
                    top, kids = self.nodes[at]
                    d = np.sqrt(seen(rows, top).astype(np.float64))
                    for kid, lo, hi in kids:
                        bounds[rows, kid] = np.maximum(low, np.maximum(lo - d, d - hi))
                else:
                    for i in self.nodes[at]:
                        seen(rows, int(i))
            active = active[np.isfinite(bounds[active]).any(axis=1)]
        return who, best, measured


def moved(vectors: DataFrame, tree: Tree, c: Clusters) -> np.ndarray:
    """Centroids after one round: each nearest vector's exact mean, rounded down; those without vectors stay."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(tree.points)
        n, s = np.zeros(k, np.int64), np.zeros((k, c.size), np.int64)
        for b in batches:
            _, v = quantized(b.column(0), c)
            who, _, _ = tree.nearest(v)
            n += np.bincount(who, minlength=k)
            order = np.argsort(who, kind="stable")
            found, at = np.unique(who[order], return_index=True)
            if len(found):
                s[found] += np.add.reduceat(v[order], at, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(s[some]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = vectors.select("__vector").mapInArrow(each, "cluster int, n long, s array<long>")
    sums = parts.select("cluster", "n", F.posexplode("s").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = tree.points.copy()
    for r in sums.collect():  # k * size rows at most
        out[r.cluster, r.i] = r.s // r.n
    return out


def first_centroids(vectors: DataFrame, c: Clusters) -> np.ndarray:
    """Vectors of the c.k smallest hashes of `seed:vec_id`; rows of one id by their components, those without id last."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, v = quantized(b.column(1), c)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(list(v), pa.list_(pa.int64()))], ["vec_id", "v"])

    kept = vectors.select("vec_id", "__vector").mapInArrow(each, f"vec_id {kind}, v array<long>")
    key = F.sha2(F.concat(F.lit(f"{c.seed}:"), F.col("vec_id").cast("string")), 256)
    top = kept.orderBy(key.asc_nulls_last(), "v").limit(c.k).collect()
    return np.array([r.v for r in top], np.int64).reshape(-1, c.size)


def clusters(vectors: DataFrame, c: Clusters = Clusters()) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each kept row of vectors (vec_id, embedding).

    Nulls: rows whose embedding is null, is not of c.size components or holds a null or non-finite one are left out. A
    row without vec_id takes part but is chosen as a first centroid only after all others. Repeated rows are clustered
    one by one. With fewer rows than c.k there are as many centroids as rows; an empty table gives an empty result. Ties
    go to the centroid of the smaller number. Components beyond 2^27 / scale in magnitude count as that, since a
    distance must fit into a long; sums of distances that don't fit are null. Other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("__vector"))
    centroids = first_centroids(rows, c)
    for _ in range(c.rounds if len(centroids) else 0):
        centroids = moved(rows, Tree.of(centroids), c)
    tree, kind = Tree.of(centroids), rows.schema["vec_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, v = quantized(b.column(1), c)
            who, d, _ = tree.nearest(v)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(who, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance"])

    found = cut(rows.mapInArrow(each, f"vec_id {kind}, cluster int, distance long"))
    per = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()  # c.k rows at most
    spark, total = vectors.sparkSession, found.agg(F.try_sum("distance")).first()[0]
    digest = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in centroids]
    about = spark.createDataFrame([(r.cluster, r.cluster_inertia, total, digest[r.cluster]) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
