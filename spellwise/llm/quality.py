"""Quality rules: word and line repetition counts, and the divergence of a document from language references.

A document's histograms of character classes and of common words are held against those of each language,
which are gathered over all documents of the language, by the Jensen-Shannon distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bins of a language's word histogram: the words that the most of its documents hold.  Where fewer of its documents than
#: WORD_COVER hold any of them (scripts without spaces between words), the language has no word reference.
COMMON_WORDS, WORD_COVER = 64, 0.9
#: Character classes: a-z, A-Z, digits, white space, sentence punctuation, other ASCII, two-byte and longer characters.
CLASSES = 8
#: A reference needs so many documents.
MIN_REFERENCE_DOCS = 20
#: Guards: shorter texts have no verdict on that histogram.
MIN_CHARS, MIN_WORDS = 100, 40
#: Documents farther than this from the first references do not shape the final ones.
FIRST_CLASS_DISTANCE = 0.2
#: Distances (0 to 1) from the language's reference beyond which a document is not kept.  The histogram of a short text is
#: a small sample, so its limit for character classes is wider by CLASS_NOISE / sqrt(characters).
MAX_CLASS_DISTANCE, CLASS_NOISE, MAX_WORD_DISTANCE = 0.14, 2.2, 0.8

_SYMBOL = common.byte_class("23 2A 24 25 26 7C 3C 3E")
_WINDOW = 8


def _class_of() -> np.ndarray:
    out = np.full(256, 5, np.uint8)
    out[common.byte_class("61-7A")] = 0
    out[common.byte_class("41-5A")] = 1
    out[common.byte_class("30-39")] = 2
    out[common.WHITE] = 3
    out[common.byte_class("21-22 27-29 2C-2E 3A-3B 3F")] = 4
    out[0xC0:0xE0] = 6
    out[0xE0:] = 7
    out[0x80:0xC0] = CLASSES  # the rest of a character that is counted already
    return out


def _letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of letters, in lower case."""
    low = common.LOWER[data]
    starts, ends, counts = common.word_bounds(low, offsets, common.NOT_LETTER)
    return common.span_hashes(low, starts, ends), common.row_of(counts)


def _in_group(words: np.ndarray, groups: np.ndarray) -> np.ndarray:
    return common.mix(words + groups.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def measure(data: np.ndarray, offsets: np.ndarray, bins: list[np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each row's text; which names each row's list of bins, the hashes of common words (-1: it has none)."""
    n = len(offsets) - 1
    starts, ends, counts = common.word_bounds(data, offsets, common.WHITE)
    rows, n_words = common.row_of(counts), np.diff(counts)
    head = (data & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": common.per_row(head & ~common.WHITE[data], offsets), "n_symbols": common.per_row(_SYMBOL[data], offsets)}

    # lines with a word that equal an earlier one: all such lines less the distinct ones
    feed = data == 10
    lines, line_ends, line_counts = _lines(feed, offsets)
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, lines)
    line_rows = common.row_of(line_counts)[with_word]
    keys = common.mix(common.span_hashes(data, lines[with_word], line_ends[with_word]) + line_rows.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    order = np.argsort(keys)
    again = np.append(False, keys[order][1:] == keys[order][:-1]) if len(keys) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(line_rows[order][again], minlength=n)

    # words in windows that occur twice or more in the row
    words = common.span_hashes(data, starts, ends)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= _WINDOW:
        last = len(words) - _WINDOW + 1
        window = np.zeros(last, np.uint64)
        for k in range(_WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + words[k : k + last]
        inside = np.flatnonzero(rows[:last] == rows[_WINDOW - 1 :])
        order, same = common.repeats_in_rows(window[inside], rows[inside])
        at = inside[order[same]]
        covered += np.bincount(at, minlength=len(covered)) - np.bincount(at + _WINDOW, minlength=len(covered))[: len(covered)]
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(covered)[:-1] > 0], minlength=n)

    of_char = np.repeat(np.arange(n), np.diff(offsets))
    classes = _class_of()[data]
    out["classes"] = np.bincount(of_char * (CLASSES + 1) + classes, minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]
    out["words"] = np.zeros((n, COMMON_WORDS), np.int64)
    sizes = np.array([len(b) for b in bins], np.int64)
    if sizes.sum():
        keys = _in_group(np.concatenate(bins).view(np.uint64), np.repeat(np.arange(len(bins)), sizes))
        places = np.concatenate([np.arange(k) for k in sizes])
        order = np.argsort(keys)
        words, rows = _letter_words(data, offsets)
        own = which[rows]
        words, rows = _in_group(words[own >= 0], own[own >= 0]), rows[own >= 0]
        at = np.minimum(np.searchsorted(keys, words, sorter=order), len(keys) - 1)
        hit = keys[order[at]] == words
        out["words"] += np.bincount(rows[hit] * COMMON_WORDS + places[order[at[hit]]], minlength=n * COMMON_WORDS).reshape(n, COMMON_WORDS)
    return out


def _lines(feed: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all rows (k line feeds make k + 1 lines), and each row's first line."""
    at = np.flatnonzero(feed)
    starts = np.sort(np.concatenate([offsets[:-1], at + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], at]), kind="stable")
    return starts, ends, np.searchsorted(at, offsets) + np.arange(len(offsets))


def js_distance(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence in bits) of each row of counts from each reference; 0 for an empty row."""
    return np.array([_own_distance(counts, np.broadcast_to(q, counts.shape)) for q in references]).reshape(len(references), len(counts)).T


def _own_distance(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The same of each row from the reference in the same row."""
    sums = counts.sum(1, keepdims=True)
    p, q = counts / np.maximum(sums, 1), references
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(sums[:, 0] == 0, 0, np.sqrt(np.clip((a + b) / 2, 0, 1)))


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_PROFILE = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", classes array<int>, words array<int>"


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().astype(np.int32)))


def _three(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    common.small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a language, of MIN_WORDS words or more, hold each word."""
    for batch in batches:
        for part, data, offsets in common.slices(batch):
            langs = part.column("lang").dictionary_encode()
            own = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            own[np.diff(common.word_bounds(data, offsets, common.WHITE)[2]) < MIN_WORDS] = -1
            words, rows = _letter_words(data, offsets)
            words, rows = words[own[rows] >= 0], rows[own[rows] >= 0]
            _, once = np.unique(_in_group(words, rows), return_index=True)
            words, groups = words[once], own[rows[once]]
            _, first, counts = np.unique(_in_group(words, groups), return_index=True, return_counts=True)
            columns = [langs.dictionary.take(pa.array(groups[first])), pa.array(words[first].view(np.int64)), pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])


def common_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang and bins: the hashes of the COMMON_WORDS words that most documents of the language hold."""
    held = _three(docs, id_col, text_col, lang_col).mapInArrow(_holders, "lang string, word long, n long")
    counts = held.groupBy("lang", "word").agg(F.sum("n").alias("n")).where("n > 1")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= COMMON_WORDS)
    return top.groupBy("lang").agg(F.array_sort(F.collect_list("word")).alias("bins"))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in common.slices(batch):
            langs = part.column("lang").dictionary_encode()
            own = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = part.column("bins")
            heads = np.unique(own, return_index=True)[1][-len(langs.dictionary) :] if len(langs.dictionary) else []
            bins = [np.array(lists[int(k)].values.to_numpy() if lists[int(k)].is_valid else [], np.int64) for k in heads]
            m = measure(data, offsets, bins, own)
            columns = [part.column("doc_id"), part.column("lang"), *(pa.array(m[c].astype(np.int64)) for c in _COUNTS), _lists(m["classes"]), _lists(m["words"])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", *_COUNTS, "classes", "words"])


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The counts and histograms of each row; the bins of the word histogram are those of its language."""
    bins = common.written(common_words(docs, id_col, text_col, lang_col)).withColumnRenamed("lang", "__lang")
    three = _three(docs, id_col, text_col, lang_col)
    return three.join(bins, F.col("lang") == F.col("__lang"), "left").drop("__lang").mapInArrow(_profile, _PROFILE)


def references(profiled: DataFrame) -> DataFrame:
    """ref_lang, class_ref and word_ref: shares of character classes and of common words, over all documents of the language
    that pass the length guards.

    A language of fewer than MIN_REFERENCE_DOCS such documents has no row; word_ref is null where its documents do not share
    words.  The word histogram holds common words only: shares of rare words differ by topic, not by language.
    """
    sums = {c: F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(c) for c, k in (("classes", CLASSES), ("words", COMMON_WORDS))}
    sum_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    cover = F.avg((sum_of("words") > 0).cast("int")).alias("cover")
    long_enough = (F.col("n_words") >= MIN_WORDS) & F.col("lang").isNotNull()
    found = profiled.where(long_enough).groupBy("lang").agg(F.count("*").alias("n"), *sums.values(), cover).where(F.col("n") >= MIN_REFERENCE_DOCS)
    share = lambda c: F.transform(c, lambda x: x / sum_of(c))
    return found.select(F.col("lang").alias("ref_lang"), share("classes").alias("class_ref"), F.when(F.col("cover") >= WORD_COVER, share("words")).alias("word_ref"))


def _with_references(profiled: DataFrame, found: DataFrame) -> DataFrame:
    refs = common.written(found)
    return profiled.join(refs, F.col("lang") == F.col("ref_lang"), "left")


def _from_own(counts: np.ndarray, references: pa.ListArray) -> np.ndarray:
    """Distance of each row from its own reference; not a number where it has none."""
    out = np.full(len(counts), np.nan)
    known = np.flatnonzero(references.is_valid().to_numpy(zero_copy_only=False))
    if len(known):
        out[known] = _own_distance(counts[known], references.take(pa.array(known)).flatten().to_numpy().reshape(len(known), -1))
    return out


def _near_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        classes = batch.column("classes").flatten().to_numpy().reshape(batch.num_rows, CLASSES)
        near = _from_own(classes, batch.column("class_ref")) <= FIRST_CLASS_DISTANCE
        yield batch.filter(pa.array(near)).select([c for c in batch.schema.names if not c.endswith("_ref") and c != "ref_lang"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        classes = batch.column("classes").flatten().to_numpy().reshape(n, -1)
        words = batch.column("words").flatten().to_numpy().reshape(n, -1)
        n_words = batch.column("n_words").to_numpy()
        c = _from_own(classes, batch.column("class_ref"))
        w = _from_own(words, batch.column("word_ref"))
        w[(words.sum(1) == 0) & ~np.isnan(w)] = 1.0  # no common word at all
        chars = classes.sum(1)
        judged_c, judged_w = chars >= MIN_CHARS, n_words >= MIN_WORDS
        fine = ~(judged_c & (c > MAX_CLASS_DISTANCE + CLASS_NOISE / np.sqrt(np.maximum(chars, 1)))) & ~(judged_w & (w > MAX_WORD_DISTANCE))
        failed = (n_words < 20) | (100 * batch.column("n_repeat_words").to_numpy() > 30 * n_words)
        columns = [batch.column("doc_id"), *(batch.column(x) for x in _COUNTS), pa.array(failed), pa.array(fine & ~failed), pa.array(c, mask=np.isnan(c)), pa.array(w, mask=np.isnan(w))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_COUNTS, "base_failed", "kept", "class_distance", "word_distance"])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the counts of the base rules, base_failed, kept, and the distances from the references of the document's language.

    A null or empty text has no words and fails the base rules.  Texts under MIN_CHARS characters or MIN_WORDS words
    get no verdict from the histogram concerned.  Where the language is null or has no reference the distance is null
    and the base rules decide alone.  Each repeated row has its own result; a null id stays null; an empty table gives no rows; other
    columns are not read.  Lines, words and windows are equal if their 64-bit hashes are.
    """
    profiled = common.written(profiles(docs, id_col, text_col, lang_col))
    sound = profiled.where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= 30 * F.col("n_words")))
    near = _with_references(sound, references(profiled)).mapInArrow(_near_first, profiled.schema)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean, class_distance double, word_distance double"
    return _with_references(profiled, references(near)).mapInArrow(_judge, schema)
