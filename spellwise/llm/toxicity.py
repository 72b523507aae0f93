"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 sparsity (McMahan et al., 2013) leave few non-zero weights, which are broadcast.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Hash bits of the feature space.
BITS = 20
#: Labelled documents that the classifier is fitted on at most, by label: those with the smallest hashes of their ids.
SAMPLE = {1: 3000, 0: 3000}
#: Labelled documents of more bytes are left out of the sample (they are scored whole like all others), so the features
#: that come to the driver are bounded in bytes too: about two bytes a byte of text.
SAMPLE_TEXT_BYTES = 1 << 14
#: FTRL: rate, its smoothing, L1, L2, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 8.0, 0.1, 6
THRESHOLD = 0.3
_KINDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed indices of the words, the pairs of neighbours, and the pairs with one word between them.

    Words are runs of letters, A-Z in lower case.
    """
    low = common.LOWER[data]
    starts, ends, counts = common.word_bounds(low, offsets, common.NOT_LETTER)
    words, rows = common.span_hashes(low, starts, ends), common.row_of(counts)
    found, owners = [words * np.uint64(_KINDS[0])], [rows]
    for gap in (1, 2):
        if len(words) > gap:
            inside = rows[:-gap] == rows[gap:]
            found.append(common.mix(words[:-gap] * np.uint64(_KINDS[gap]) + words[gap:])[inside])
            owners.append(rows[gap:][inside])
    index = np.concatenate(found) >> np.uint64(64 - BITS)
    return np.concatenate(owners), index.astype(np.int64)


@dataclasses.dataclass
class Weights:
    """The non-zero coordinates of the model, ascending, and its intercept."""

    index: np.ndarray
    value: np.ndarray
    intercept: float

    def scores(self, rows: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 of n rows; a feature counts once in a row."""
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.index] = self.value
        hit = np.flatnonzero(dense[index])
        pairs = np.unique((rows[hit] << BITS) | index[hit])
        total = np.bincount(pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=n) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(examples: list[tuple[int, np.ndarray]], share_of_ones: float) -> Weights:
    """FTRL-proximal over (label, indices) examples; share_of_ones is the share of label 1 among all labelled rows."""
    size = (1 << BITS) + 1  # the last coordinate is the intercept, which has no L1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[-1] = 0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, -(zi - np.sign(zi) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    # a coordinate moves by less than 1 an example, so one in too few examples never passes L1
    frequency = np.zeros(size, np.int32)
    for _, i in examples:
        frequency[i] += 1
    usable = frequency * EPOCHS > l1
    examples = [(y, i[usable[i]]) for y, i in examples]
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)):
            y, i = examples[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(size))
    ones = sum(y for y, _ in examples)
    shift = 0.0
    if 0 < ones < len(examples) and 0 < share_of_ones < 1:  # the sample holds more of label 1 than the rows do
        shift = np.log(share_of_ones / (1 - share_of_ones)) - np.log(ones / (len(examples) - ones))
    index = np.flatnonzero(w[:-1])
    return Weights(index, w[index], float(w[-1] + shift))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in common.slices(batch):
            rows, index = features(data, offsets)
            pairs = np.unique((rows << BITS) | index)
            cuts = np.searchsorted(pairs, np.arange(part.num_rows + 1) << BITS)
            each = (pairs & ((1 << BITS) - 1)).astype(np.int32)
            lists = [each[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(lists, pa.binary())], names=["doc_id", "y", "features"])


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Weights:
    """Fits the model on a bounded sample (SAMPLE, SAMPLE_TEXT_BYTES) of the labelled documents whose id meets may_learn.

    A document labelled both ways is toxic.  Whole texts are used; what comes to the driver is the features of the sample.
    """
    common.small_batches(docs.sparkSession)
    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    known = labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull()).groupBy(labels[id_col].cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y")).where(may_learn)
    known = common.written(known)
    total, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    short = two.where(F.octet_length("text") <= SAMPLE_TEXT_BYTES).select("doc_id").join(known, "doc_id").distinct()
    short = common.written(short)
    picks = [short.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in SAMPLE.items()]
    chosen = F.broadcast(picks[0].unionAll(picks[1]))  # SAMPLE bounds it
    found = two.where(F.octet_length("text") <= SAMPLE_TEXT_BYTES).join(chosen, "doc_id").select("doc_id", "y", "text").mapInArrow(_extract, "doc_id long, y int, features binary")
    rows = sorted(found.collect(), key=lambda r: (r.doc_id, r.features))
    examples = [(r.y, np.append(np.frombuffer(r.features, np.int32), np.int32(1 << BITS))) for r in rows]
    del rows
    return fit(examples, ones / total if total else 0.0)


def _scorer(weights):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch):
                rows, index = features(data, offsets)
                found = pa.array(weights.value.scores(rows, index, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), found], names=["row", "id", "score"])

    return score


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with held_out, score and predicted (1 from THRESHOLD on), a row for each row.

    A null or empty text scores as the intercept alone.  Without any label of either kind the score is that of the
    untrained model moved to the share of label 1.  A null id is not held out; repeated rows score alike; an
    empty table gives no rows; columns of docs named like a new one are replaced.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    weights = spark.sparkContext.broadcast(train(docs, labels, ~held_out(F.col("doc_id")), id_col, text_col, label_col))
    new = ("held_out", "score", "predicted")
    own = [c for c in keep or docs.columns if c not in new]
    packed = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    scored = packed.mapInArrow(_scorer(weights), packed.select("row", "id", F.lit(0.0).alias("score")).schema)
    verdict = [held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")]
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in own], *verdict)
