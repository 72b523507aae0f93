"""Centroid clustering with ball trees.

Vectors are quantised to integers once and dealt, where they are read, to metric trees of a bounded number of rows.  Each
ball of a tree has a centre, a radius, a count and an integer sum.  In a round the balls of a tree are tried from the root on:
where the triangle inequality shows that one centroid is the nearest of every vector of a ball, its count and sum go to that
centroid at once; otherwise its two parts are tried, down to leaves, whose vectors are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Vectors of a tree and of a leaf.
TREE_ROWS, LEAF_ROWS = 2048, 16
#: Components must be smaller than this, so that squared distances fit 64 bits.
MOST = 1 << 27
#: Products below this are exact in doubles.
_EXACT = 2.0**52

_TREE = "ids array<long>, vecs array<int>, lo array<int>, hi array<int>, left array<int>, radius array<double>, sums array<long>"
_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("vecs", pa.list_(pa.int32())), *((c, pa.list_(pa.int32())) for c in ("lo", "hi", "left")), ("radius", pa.list_(pa.float64())), ("sums", pa.list_(pa.int64()))])


class Tree:
    """Balls over rows lo to hi of x; ball i has the two parts left[i] and left[i] + 1, or none (-1)."""

    def __init__(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: np.ndarray, radius: np.ndarray, sums: np.ndarray) -> None:
        self.x, self.lo, self.hi, self.left, self.radius, self.sums = x, lo, hi, left, radius, sums
        self.count = hi - lo
        self.centre = sums / self.count[:, None]

    @classmethod
    def build(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of some rows, and the order in which it holds them."""
        order, real = np.arange(len(x)), x.astype(np.float64)
        lo, hi, left, radius, sums = [0], [len(x)], [-1], [0.0], [None]
        todo = [0]
        while todo:
            i = todo.pop()
            rows = order[lo[i] : hi[i]]
            sums[i] = x[rows].sum(0)
            away = real[rows] - sums[i] / len(rows)
            far = np.sqrt((away**2).sum(1))
            radius[i] = float(far.max())
            if len(rows) <= LEAF_ROWS or not radius[i]:
                continue
            a = real[rows[far.argmax()]]
            to_a = ((real[rows] - a) ** 2).sum(1)
            to_b = ((real[rows] - real[rows[to_a.argmax()]]) ** 2).sum(1)
            near = to_a < to_b
            if near.all() or not near.any():
                near = np.arange(len(rows)) < len(rows) // 2
            order[lo[i] : hi[i]] = np.concatenate([rows[near], rows[~near]])
            left[i], middle = len(lo), lo[i] + int(near.sum())
            lo, hi = [*lo, lo[i], middle], [*hi, middle, hi[i]]
            left, radius, sums = [*left, -1, -1], [*radius, 0.0, 0.0], [*sums, None, None]
            todo += [left[i], left[i] + 1]
        return cls(x[order], np.array(lo), np.array(hi), np.array(left), np.array(radius), np.array(sums)), order

    def split(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(balls, their centroids, True) where whole balls have one nearest centroid, (rows, their centroids, False) at leaves."""
        balls = np.zeros(1, np.int64)
        means = centroids.astype(np.float64)
        widest = max(float(np.abs(self.x).max(initial=0)), float(np.abs(means).max(initial=0)), 1.0)
        room = 1e-9 * widest * np.sqrt(means.shape[1])  # for rounding of distances
        while len(balls):
            far = np.sqrt(((self.centre[balls][:, None, :] - means[None]) ** 2).sum(2))
            best = far.argmin(1)
            nearest = far[np.arange(len(balls)), best]
            far[np.arange(len(balls)), best] = np.inf
            # for any vector of the ball: d(v, best) <= nearest + radius and d(v, other) >= second - radius
            whole = far.min(1) - nearest > 2 * (self.radius[balls] + room)
            if whole.any():
                yield balls[whole], best[whole], True
            balls = balls[~whole]
            leaves = self.left[balls] < 0
            if leaves.any():
                rows = np.concatenate([np.arange(self.lo[b], self.hi[b]) for b in balls[leaves]])
                yield rows, distances(self.x[rows], centroids).argmin(1), False  # ties: the smaller number
            parts = self.left[balls[~leaves]]
            balls = np.concatenate([parts, parts + 1])

    def sums_by_centroid(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for found, best, whole in self.split(centroids):
            np.add.at(counts, best, self.count[found] if whole else 1)
            np.add.at(sums, best, self.sums[found] if whole else self.x[found])
        return counts, sums

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of each row."""
        cluster = np.zeros(len(self.x), np.int32)
        for found, best, whole in self.split(centroids):
            if whole:
                for ball, k in zip(found.tolist(), best.tolist(), strict=True):
                    cluster[self.lo[ball] : self.hi[ball]] = k
            else:
                cluster[found] = best
        away = self.x - centroids[cluster]
        return cluster, (away * away).sum(1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids."""
    widest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4.0 * widest**2 * x.shape[1] < _EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def quantised(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec (long components floor(scale * x)) of the rows with `dims` components, none null or non-finite."""
    x = vectors[vector_col]
    usable = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    return vectors.where(x.isNotNull() & usable).select(vectors[id_col].cast("long").alias("vec_id"), whole.alias("vec"))


def _grower(dims: int):
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def planted() -> Iterator[pa.RecordBatch]:
            ids, x = pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held])
            held.clear()
            for at in range(0, len(x), TREE_ROWS):
                tree, order = Tree.build(x[at : at + TREE_ROWS])
                parts = (tree.x.ravel(), tree.lo, tree.hi, tree.left, tree.radius, tree.sums.ravel())
                own = [ids.slice(at, TREE_ROWS).take(pa.array(order)), *(pa.array(p, f.type.value_type) for p, f in zip(parts, list(_ARROW)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), p) for p in own], schema=_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if np.abs(x).max(initial=0) >= MOST or (x == np.iinfo(np.int64).min).any():
                raise ValueError(f"components of {MOST} or more after scaling have no 64-bit distances")
            held.append((batch.column("vec_id"), x))
            if sum(len(v) for _, v in held) >= TREE_ROWS:
                yield from planted()
        if held:
            yield from planted()

    return grow


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[Tree, pa.Array]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids = batch.column("ids")[k].values
            x, lo, hi, left, radius, sums = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in batch.schema.names[1:])
            yield Tree(x.astype(np.int64).reshape(-1, dims), lo, hi, left, radius, sums.reshape(-1, dims)), ids


def _summer(centroids: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a centroid and component, for the whole task."""
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for tree, _ in _trees(batches, centroids.shape[1]):
            more, added = tree.sums_by_centroid(centroids)
            counts, sums = counts + more, sums + added
        k, i = np.indices(sums.shape)
        columns = (k.ravel().astype(np.int32), i.ravel().astype(np.int32), counts[k.ravel()], sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "i", "n", "s"])

    return add


def _assigner(centroids: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, ids in _trees(batches, centroids.shape[1]):
            cluster, far = tree.assigned(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return assign


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector, after `rounds` of Lloyd's steps.

    Centroids start as the k vectors with the smallest SHA-256 of salt and vec_id.  Each round assigns every vector to
    the nearest centroid (ties: the smaller number) and moves centroids to the floor of their mean; empty ones stay.

    Vectors that are null, of another width, or hold a null or non-finite component have no row; fewer than k
    vectors make fewer centroids; each repeated row is a vector of its own; rows with a null id are clustered and start
    a centroid only where there are not enough others; an empty table gives no rows; components of 2^27 or more after scaling
    raise; other columns are not read.

    Trees are built where rows are read and written once, without a shuffle; a round reads them and sends on k x dims sums a
    task, of which the driver gets the k x dims totals.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    whole = quantised(vectors, dims, scale, id_col, vector_col)
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    starts = whole.orderBy(digest.asc_nulls_last(), "vec").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = common.written(whole.mapInArrow(_grower(dims), _TREE), row_bytes=TREE_ROWS * dims * 8)
    centroids = np.array([r.vec for r in starts], np.int64)
    for _ in range(rounds):
        sums = trees.mapInArrow(_summer(centroids), "cluster int, i int, n long, s long").groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        for r in sums.where("n > 0").collect():
            centroids[r.cluster, r.i] = r.s // r.n
    rows = common.written(trees.mapInArrow(_assigner(centroids), "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: r.d for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = [(c, d, sum(inertia.values()), sha[c]) for c, d in inertia.items()]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
