"""Ranked lexical search with MaxScore over shards of an inverted index.

An index is a table of shards: blocks of documents, each with the postings of all its terms, made where the texts are
read, without a shuffle.  A search takes the queries in blocks.  In a shard each query splits its terms by their upper bounds:
documents that hold none of the essential ones cannot reach the k-th best score known so far, so only essential postings
give candidates; the other terms are probed in the order of their bounds, and just for the documents that can still qualify.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents and postings of a shard; one document with more postings is a shard of its own.
SHARD_DOCS, SHARD_POSTINGS = 1024, 1 << 20
#: What a shard of documents of some hundreds of words takes where Spark reads it: values, levels of the lists, and room to grow.
SHARD_BYTES = 16 << 20
#: Terms, with repeats, of the queries that are searched in one pass over the index.
BLOCK_TERMS = 500_000
#: The separators of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+
NOT_TERM = common.byte_class("00-2F 3A-40 5B-60 7B-7F")
#: Fixed values of the score.
ONE, FREQUENCY, LENGTH = 1_000_000_000, 1000, 12
_NO_ID = np.iinfo(np.int64).max  # a null id stands after all others

_INDEX = "ids array<long>, lengths array<long>, n_docs long, n_terms long, terms array<long>, starts array<int>, docs array<int>, tfs array<int>"
_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("starts", "docs", "tfs"))])


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term hash and count of each distinct term of each row, and the number of terms of each row."""
    low = common.LOWER[data]
    starts, ends, counts = common.word_bounds(low, offsets, NOT_TERM)
    hashes, rows = common.span_hashes(low, starts, ends), common.row_of(counts)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    heads = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    return rows[heads], hashes[heads].view(np.int64), np.diff(np.append(heads, len(hashes))), np.diff(counts)


def _shard(held: list[tuple]) -> pa.RecordBatch:
    """One shard of some slices: ids, lengths, rows, terms and counts."""
    bases = np.cumsum([0, *(len(h[0]) for h in held)])
    ids, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    docs = np.concatenate([h[2] + base for h, base in zip(held, bases, strict=False)])
    terms, tfs = (np.concatenate([h[i] for h in held]) for i in (3, 4))
    order = np.lexsort((docs, terms))
    docs, terms, tfs = docs[order], terms[order], tfs[order]
    heads = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
    columns = (ids, lengths, None, None, terms[heads], np.append(heads, len(terms)), docs, tfs)
    one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
    arrays = [one(c, f.type.value_type) if c is not None else None for c, f in zip(columns, _ARROW, strict=True)]
    arrays[2], arrays[3] = pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    n_docs = n_postings = 0
    for batch in batches:
        for part, data, offsets in common.slices(batch):
            ids = part.column("doc_id").fill_null(_NO_ID).to_numpy()
            rows, terms, tfs, lengths = term_counts(data, offsets)
            at = 0
            while at < len(ids):
                last = min(len(ids), at + SHARD_DOCS - n_docs)
                a, b = np.searchsorted(rows, [at, last])
                held.append((ids[at:last], lengths[at:last], rows[a:b] - at, terms[a:b], tfs[a:b]))
                n_docs, n_postings, at = n_docs + last - at, n_postings + b - a, last
                if n_docs >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
                    yield _shard(held)
                    held, n_docs, n_postings = [], 0, 0
    if held:
        yield _shard(held)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of all documents, as a written table.

    A row is a shard: the ids and numbers of terms of its documents (a null text has none), its terms in the order of their 64-bit
    hashes, and the postings of each.  Each repeated row is a document of its own; a null id stands for the greatest; an empty table
    has no shards; other columns are not read.
    """
    common.small_batches(docs.sparkSession)
    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return common.written(two.mapInArrow(_indexed, _INDEX), row_bytes=SHARD_BYTES)


class Queries(NamedTuple):
    """A block of queries: the distinct terms of all, sorted, and per query the places of its terms there and their counts."""

    terms: np.ndarray
    places: list[np.ndarray]
    counts: list[np.ndarray]


class Shard:
    """The postings of the terms of a block of queries in one shard, with their impacts and upper bounds."""

    def __init__(self, row: dict, terms: np.ndarray, n: int, total: int) -> None:
        own, starts = row["terms"], row["starts"].astype(np.int64)
        self.ids = row["ids"]
        at = np.searchsorted(own, terms)
        at[at == len(own)] = 0
        known = own[at] == terms if len(own) else np.zeros(len(terms), bool)
        self.starts, self.ends = (np.where(known, starts[at + d], 0) for d in (0, 1)) if len(own) else (np.zeros(len(terms), np.int64),) * 2
        longest = int(row["lengths"].max(initial=0))
        if 25 * longest * n < 2**63:
            m = 75 + 25 * row["lengths"] * n // total
        else:
            m = np.array([75 + 25 * x * n // total for x in row["lengths"].tolist()], np.int64)
        tfs = row["tfs"].astype(np.int64)
        self.docs, self.impacts = row["docs"].astype(np.int64), ONE * tfs // (FREQUENCY * tfs + LENGTH * m[row["docs"]])
        self.most = np.zeros(len(terms), np.int64)
        some = np.flatnonzero(known)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impacts, starts[:-1])[at[some]]

    def search(self, places: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (their places in the shard) and scores of all that reach `least`, which is above 0."""
        bounds = weights * self.most[places]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)  # what the terms from each place of the order on can give
        essential = int((rest >= least).sum())  # without one of these a document stays below
        scores = np.zeros(len(self.ids), np.int64)
        for i in order[:essential]:
            a, b = self.starts[places[i]], self.ends[places[i]]
            scores[self.docs[a:b]] += weights[i] * self.impacts[a:b]
        found = np.flatnonzero(scores)
        for j in range(essential, len(order)):
            found = found[scores[found] + rest[j] >= least]
            if not len(found):
                break
            i = order[j]
            a, b = self.starts[places[i]], self.ends[places[i]]
            at = a + np.searchsorted(self.docs[a:b], found)
            at[at == b] = a
            holds = self.docs[at] == found
            scores[found[holds]] += weights[i] * self.impacts[at[holds]]
        found = found[scores[found] >= least]
        return found, scores[found]


def _searcher(queries: Queries, ids: list, weights: np.ndarray, n: int, total: int, k: int):
    """weights: of each term of the block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each query over all shards of a task: the k-th of them is what later shards must reach."""
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("ids", "lengths", "terms", "starts", "docs", "tfs")}
                shard = Shard(row, queries.terms, n, total)
                for q, (places, counts) in enumerate(zip(queries.places, queries.counts, strict=True)):
                    scores, docs = best[q]
                    found, more = shard.search(places, counts * weights[places], int(scores[-1]) if len(scores) == k else 1)
                    if len(found):
                        scores, docs = np.append(scores, more), np.append(docs, shard.ids[found])
                        order = np.lexsort((docs, -scores))[:k]
                        best[q] = scores[order], docs[order]
        for q, (scores, docs) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([ids[q]] * len(scores), pa.int64()), pa.array(docs, mask=docs == _NO_ID), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return search


def _frequencies(terms: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                own, starts = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("terms", "starts"))
                at = np.flatnonzero(np.isin(own, terms, assume_unique=True))
                df[np.searchsorted(terms, own[at])] += np.diff(starts)[at]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df).astype(np.int32)), pa.array(df[df > 0])], names=["term", "df"])

    return count


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in common.slices(batch):
            rows, terms, tfs, lengths = term_counts(data, offsets)
            cuts = pa.array(np.searchsorted(rows, np.arange(len(offsets))), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (terms, tfs.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([part.column("item_id"), *lists, pa.array(lengths.astype(np.int64))], names=["item_id", "terms", "counts", "n"])


def search(shards: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item, ties to the smaller doc_id.

    shards is the index of all documents.  Items without a term, or without a document that scores above 0, have no rows; rows of items that
    repeat an id are one item, with the smallest text; a null item_id is an item; documents with a null id stand last among
    equal scores; an empty index or no items give no rows; other columns are not read.

    Items are searched in blocks of about BLOCK_TERMS terms, each in one pass over the index, so the driver and a task hold one block.
    A task sends on k rows an item at most.
    """
    spark = shards.sparkSession
    common.small_batches(spark)
    texts = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text")).groupBy("item_id").agg(F.min("text").alias("text"))
    parsed = common.written(texts.mapInArrow(_parsed, "item_id long, terms array<long>, counts array<long>, n long").where("n > 0"))
    n, total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    asked = parsed.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-asked // BLOCK_TERMS))
    found = []
    for block in range(blocks) if n and asked else ():
        rows = parsed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        terms = np.unique(np.concatenate([np.array(r.terms, np.int64) for r in rows]))
        queries = Queries(terms, [np.searchsorted(terms, r.terms) for r in rows], [np.array(r.counts, np.int64) for r in rows])
        df = np.zeros(len(terms), np.int64)
        for r in shards.select("terms", "starts").mapInArrow(_frequencies(terms), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        weights[df == 0] = 0
        near = shards.mapInArrow(_searcher(queries, [r.item_id for r in rows], weights, n, total, k), "item_id long, doc_id long, score long")
        found.append(common.written(near) if blocks > 1 else near)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    near = found[0]
    for more in found[1:]:
        near = near.unionAll(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """search over the index of docs; see both."""
    return search(index(docs), items, k)
