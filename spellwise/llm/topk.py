"""Exact top-k search by pivot-table elimination.

A table holds the distances of every vector to many fixed pivots, computed once.  For a query q and a candidate x the
distances to all pivots together give the largest lower bound of d(q, x) that follows from them: they fix the
coordinates y of a vector in the span of the pivots and the length r of the rest, so d(q, x)^2 is at least
|y(q) - y(x)|^2 + (r(q) - r(x))^2, and the inner product at most y(q)y(x) + r(q)r(x).  Each query evaluates its candidates
in the order of this bound and stops where the bound falls below its k-th score, which starts from the best of a sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Pivots at most, their share of the vectors' width, and the rows (smallest hashes of the id) that they are picked from.
PIVOTS, PIVOT_SHARE, PIVOT_SAMPLE = 256, 0.875, 1024
#: Queries that a task holds at once, candidates that it holds at once, and the most stripes of candidates.
QUERY_BLOCK, STRIPE_ROWS, MOST_STRIPES = 8192, 4096, 256
#: Queries whose bounds stand in memory at once, and candidates that a query evaluates between two looks at its k-th score.
ROWS_AT_ONCE, STEP = 256, 64
_NONE = np.iinfo(np.int64).min
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and vec (long components floor(scale * x)); rows with a null id or a component that is null or not finite go.

    Rows that repeat an id count once, with the smallest vector.
    """
    x = vectors[vector_col]
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    return vectors.where(usable & vectors[id_col].isNotNull()).select(vectors[id_col].cast("long").alias("vec_id"), whole.alias("vec")).groupBy("vec_id").agg(F.min("vec").alias("vec"))


class Pivots:
    """Pivots of a bounded sample, each the farthest from the span of those before it, and what distances to them tell."""

    def __init__(self, sample: list[list[int]], count: int | None = None) -> None:
        rows = _padded(sample, 0)
        count = min(PIVOTS, math.ceil(PIVOT_SHARE * rows.shape[1])) if count is None else count
        rest, basis, chosen = rows.copy(), np.zeros((0, rows.shape[1])), []
        longest = np.linalg.norm(rows, axis=1).max(initial=0)
        while len(chosen) < count and len(rows):
            lengths = np.linalg.norm(rest, axis=1)
            best = int(lengths.argmax())
            if lengths[best] <= 0.05 * longest:  # nearly in the span: it tells little and would amplify rounding
                break
            chosen.append(best)
            basis = np.vstack([basis, rest[best] / lengths[best]])
            rest = rest - (rest @ basis[-1])[:, None] * basis[-1]
            rest[chosen] = 0
        self.rows = rows[chosen]
        self.solve = np.linalg.inv(np.tril(self.rows @ basis.T)).T if chosen else np.zeros((0, 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """The row of the pivot table of each vector."""
        p, x = _widened(self.rows, max(self.rows.shape[1], x.shape[1])), _widened(x, max(self.rows.shape[1], x.shape[1]))
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1) - 2 * (x @ p.T), 0))

    def embedded(self, x: np.ndarray, far: np.ndarray) -> np.ndarray:
        """y and r of each vector, whose products bound inner products, from its row of the pivot table."""
        norms = (x**2).sum(1)
        y = (norms[:, None] + (self.rows**2).sum(1) - far**2) / 2 @ self.solve
        return np.column_stack([y, np.sqrt(np.maximum(norms - (y**2).sum(1), 0))])


def _padded(rows: list, width: int) -> np.ndarray:
    """Missing components are zero."""
    out = np.zeros((len(rows), max(width, max((len(r) for r in rows), default=0))))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _matrix(column: pa.ListArray) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), lengths[0]).astype(np.float64)
    return _padded(column.to_pylist(), 0)


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class _Search:
    """The running top k of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, far: np.ndarray, floor: np.ndarray, pivots: Pivots, k: int) -> None:
        self.ids, self.k, self.pivots = ids, k, pivots
        self.q, self.bounds = vectors, pivots.embedded(vectors, far)
        self.floor = floor  # no smaller score can be among the best
        self.scores = np.full((len(ids), k), _NONE, np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.evaluated = self.pairs = 0

    def feed(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray) -> None:
        self.held.append((ids, x, far))
        if sum(len(i) for i, _, _ in self.held) >= STRIPE_ROWS:
            self.search()

    def search(self) -> None:
        """All that is held, each query in the order of its bounds."""
        if not self.held:
            return
        width = max(self.q.shape[1], *(x.shape[1] for _, x, _ in self.held))
        ids, far = (np.concatenate([h[i] for h in self.held]) for i in (0, 2))
        x = np.concatenate([_widened(h[1], width) for h in self.held])
        self.held, self.q = [], _widened(self.q, width)
        near = self.pivots.embedded(x, far)
        lengths = np.linalg.norm(x, axis=1)
        exact = max(np.abs(self.q).max(initial=0), np.abs(x).max(initial=0)) ** 2 * max(width, 1) < 2**52
        q, x = (self.q, x) if exact else (self.q.astype(np.int64), x.astype(np.int64))
        for lo in range(0, len(q), ROWS_AT_ONCE):
            rows = np.arange(lo, min(lo + ROWS_AT_ONCE, len(q)))
            upper = self.bounds[rows] @ near.T + 1e-7 * (np.linalg.norm(self.q[rows], axis=1)[:, None] * lengths) + 0.5  # room for rounding
            self.pairs += upper.size
            while len(rows):
                step = min(STEP, upper.shape[1])
                best = np.argpartition(-upper, step - 1, axis=1)[:, :step]
                bound = np.take_along_axis(upper, best, 1)
                least = np.maximum(self.scores[rows, -1], self.floor[rows])
                going = bound.max(1) >= least  # the others have met no candidate that could still be among their best
                rows, upper, best, bound, least = rows[going], upper[going], best[going], bound[going], least[going]
                a, b = np.nonzero(bound >= least[:, None])
                self.evaluated += len(a)
                scores = np.einsum("ij,ij->i", q[rows[a]], x[best[a, b]]).astype(np.int64)
                other = self.ids[rows[a]] != ids[best[a, b]]
                self._merge(rows[a[other]], scores[other], ids[best[a, b]][other])
                np.put_along_axis(upper, best, -np.inf, 1)

    def _merge(self, a: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= np.maximum(self.scores[a, -1], self.floor[a])
        a, scores, ids = a[keep], scores[keep], ids[keep]
        if not len(a):
            return
        rows = np.unique(a)
        a = np.concatenate([a, np.repeat(rows, self.k)])
        scores = np.concatenate([scores, self.scores[rows].ravel()])
        ids = np.concatenate([ids, self.found[rows].ravel()])
        order = np.lexsort((ids, ~scores, a))
        a, scores, ids = a[order], scores[order], ids[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        top = rank < self.k
        self.scores[a[top], rank[top]] = scores[top]
        self.found[a[top], rank[top]] = ids[top]

    def result(self) -> pa.RecordBatch:
        self.search()
        q, r = np.nonzero(self.scores != _NONE)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, r]), pa.array(self.scores[q, r])], schema=_SCHEMA)


def _prepared(pivots: Pivots, sample: list[tuple[int, list[int]]], k: int):
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pivot table, and for queries the k-th best score over the sample, if that has k others."""
        known = np.array([i for i, _ in sample], np.int64)
        picked = _padded([v for _, v in sample], 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, asked = batch.column("vec_id").to_numpy(), _matrix(batch.column("vec")), np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
            floor = np.full(len(ids), _NONE, np.int64)
            width = max(x.shape[1], picked.shape[1])
            wide, others = _widened(x, width)[asked], _widened(picked, width)
            if len(asked) and len(known) > k and max(np.abs(wide).max(initial=0), np.abs(others).max(initial=0)) ** 2 * max(width, 1) < 2**52:
                scores = wide @ others.T
                scores[ids[asked, None] == known] = -np.inf
                floor[asked] = np.partition(scores, -k, axis=1)[:, -k].astype(np.int64)
            far = pivots.distances(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(floor)], names=[*batch.schema.names, "far", "floor"])

    return prepare


def _searcher(pivots: Pivots, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, stripe and kind: the queries of a block, then its stripe of candidates."""
        key, held, now = None, [], None
        for batch in batches:
            block, stripe, kind = (batch.column(c).to_numpy() for c in ("block", "stripe", "kind"))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(stripe) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if hi == lo:
                    continue
                part = batch.slice(lo, hi - lo)
                if key != (this := (block[lo], stripe[lo])):
                    if now:
                        yield now.result()
                    key, held, now = this, [], None
                ids, x, far = part.column("vec_id").to_numpy(), _matrix(part.column("vec")), _matrix(part.column("far"))
                if kind[lo] == 0:
                    held.append((ids, x, far, part.column("floor").to_numpy()))
                    continue
                if now is None:
                    if not held:
                        continue
                    width = max(h[1].shape[1] for h in held)
                    ids_, far_, floor = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3))
                    now = _Search(ids_, np.concatenate([_widened(h[1], width) for h in held]), far_, floor, pivots, k)
                now.feed(ids, x, far)
        if now:
            yield now.result()

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query over all other vectors.

    Ties go to the smaller vec_id; fewer than k candidates give fewer rows.  Rows with a null id, or with a
    vector that is null or holds a null or non-finite component, take no part; repeated ids count once (smallest
    vector); missing components of shorter vectors are zero; an empty table gives no rows.  Other columns
    are not read.  is_query is a condition on vec_id.

    Queries go in blocks of QUERY_BLOCK, candidates in stripes: each (block, stripe) is one streamed group, so
    a task holds one block and STRIPE_ROWS candidates, and each stripe sends on k rows a query at most.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows = common.written(quantised(vectors, id_col, vector_col, scale))
    n, queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    sample = [(r.vec_id, r.vec) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()]
    pivots = Pivots([v for _, v in sample])
    flagged = rows.select("vec_id", "vec", F.coalesce(is_query, F.lit(False)).alias("asked"))
    table = common.written(flagged.mapInArrow(_prepared(pivots, sample, k), "vec_id long, vec array<long>, asked boolean, far array<double>, floor long"))
    blocks = max(1, -(-queries // QUERY_BLOCK))
    stripes = min(MOST_STRIPES, max(8, -(-n // STRIPE_ROWS)))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    number = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(count)).cast("int")
    asked = table.where("asked").select(number("block", blocks).alias("block"), each(stripes).alias("stripe"), F.lit(0).alias("kind"), "vec_id", "vec", "far", "floor")
    held = table.select(each(blocks).alias("block"), number("stripe", stripes).alias("stripe"), F.lit(1).alias("kind"), "vec_id", "vec", "far", "floor")
    dealt = asked.unionAll(held).repartition(max(8, min(blocks * stripes, 4096)), "block", "stripe").sortWithinPartitions("block", "stripe", "kind")
    near = dealt.mapInArrow(_searcher(pivots, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
