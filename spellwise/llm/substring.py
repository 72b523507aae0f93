"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last bytes meets a mask, so an insertion moves only the chunks around it.
Windows of neighbouring chunks with MIN_WORDS words are matched by digest over all documents, and each match is
extended, character by character, over the text around it and around its first occurrence, and then drawn back to whole words.
So all that is cut are whole words in a passage that stands whole in one earlier place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: One place in CUT_RATE ends a chunk on average; a place within MIN_GAP bytes after another does not, and a chunk of
#: more than MAX_CHUNK bytes is divided from its start.
CUT_RATE, MIN_GAP, MAX_CHUNK = 24, 8, 4096
#: Words of a repeated passage that is removed, in whole chunks.
MIN_WORDS = 15
#: Characters on either side over which a match is extended.  What lies beyond a match is less than a chunk and a window.
REACH = 256


def _gear() -> np.ndarray:
    """One fixed random value a byte."""
    return common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint16)


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all rows, ascending; rows end chunks too.  Each cut depends on the 24 bytes before it in its row."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if n:
        hashes = _gear()[data]
        heads = np.unique(offsets[:-1])
        for shift in (1, 2, 4, 8):  # the hash of the last 2, 4, 8 and 16 bytes: each byte's gear value moves left as it ages
            older = hashes[:-shift] << np.uint16(shift)
            for k in range(shift):  # a row's first bytes have none before them
                at = heads + k - shift
                older[at[(at >= 0) & (at < len(older))]] = 0
            hashes[shift:] = hashes[shift:] + older
        hit = np.flatnonzero(hashes < 65536 // CUT_RATE) + 1
        row = np.searchsorted(heads, hit - 1, "right")
        hit = hit[(np.diff(hit, prepend=-MIN_GAP) >= MIN_GAP) | (np.diff(row, prepend=-1) != 0)]
        step = np.arange(4)
        for _ in step:  # to the next start of a character
            inside = hit < n
            hit[inside] += (data[hit[inside]] & 0xC0) == 0x80
        edge[hit] = True
    ends = np.flatnonzero(edge)
    gaps = np.diff(ends, prepend=0)
    if len(gaps) and gaps.max() > MAX_CHUNK:
        more = [np.arange(e - g + MAX_CHUNK, e, MAX_CHUNK) for e, g in zip(ends[gaps > MAX_CHUNK], gaps[gaps > MAX_CHUNK], strict=True)]
        extra = np.concatenate(more)
        for _ in range(4):
            extra += (data[extra] & 0xC0) == 0x80
        ends = np.union1d(ends, extra)
    return ends


_WINDOW = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), *((c, pa.int32()) for c in ("at", "word", "chars", "words"))])


def _window_bounds(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First chunk and end of the shortest window of MIN_WORDS words from each chunk of a row on."""
    sums = np.append(0, np.cumsum(words))
    ends = np.searchsorted(sums, sums[:-1] + MIN_WORDS, "left")
    inside = np.flatnonzero(ends <= np.searchsorted(rows, rows, "right"))
    return inside, ends[inside]


def _window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in common.slices(batch):
            ends = chunk_ends(data, offsets)
            ends = ends[ends > 0]
            if not len(ends):
                continue
            starts = np.append(0, ends[:-1])
            rows = np.searchsorted(offsets, starts, "right") - 1
            heads = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            word_starts, _, _ = common.word_bounds(data, offsets, common.WHITE)
            words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
            a, e = _window_bounds(words, rows)
            sums = np.append(0, np.cumsum(words))
            starts, ends, before, words, rows = starts[a], ends[e - 1], sums[a], sums[e] - sums[a], rows[a]
            view = memoryview(data.tobytes())
            digest = xxhash.xxh3_128_digest
            d = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
            ids, keys = part.column("doc_id").take(pa.array(rows)), part.column("key").take(pa.array(rows))
            before = before - np.searchsorted(word_starts, offsets[rows])
            places = (heads[starts] - heads[offsets[rows]], before, heads[ends] - heads[starts], words)
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), ids, keys, *(pa.array(x.astype(np.int32)) for x in places)], schema=_WINDOW)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and a key of both: rows that share an id but not a text are told apart."""
    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return two.where("doc_id IS NOT NULL AND text <> ''").withColumn("key", F.xxhash64("doc_id", "text"))


def windows(keyed: DataFrame) -> DataFrame:
    """Digest, document, character and word offset, characters and words of each window of chunks of doc_id, text, key."""
    common.small_batches(keyed.sparkSession)
    return keyed.mapInArrow(_window, "d1 long, d2 long, doc_id long, key long, at int, word int, chars int, words int")


_SPAN = pa.struct([("start", pa.int32()), ("chars", pa.int32()), ("words", pa.int32()), ("first_doc_id", pa.int64()), ("first_key", pa.int64()), ("first_at", pa.int32())])


def _stretches(at, word, end, end_word, first, shift, rows, key) -> tuple[np.ndarray, ...]:
    """Joins the windows of equal row, source document and key that overlap or adjoin; the first one's shift stays."""
    order = np.lexsort((at, key, first, rows))
    at, word, end, end_word, first, shift, rows, key = (x[order] for x in (at, word, end, end_word, first, shift, rows, key))
    other = np.append(True, (rows[1:] != rows[:-1]) | (first[1:] != first[:-1]) | (key[1:] != key[:-1]))
    base = np.cumsum(other) << 32
    most = np.maximum.accumulate(end + base) - base
    heads = np.flatnonzero(other | np.append(True, at[1:] > most[:-1]))
    return at[heads], word[heads], np.maximum.reduceat(end, heads), np.maximum.reduceat(end_word, heads), first[heads], shift[heads], rows[heads]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the later occurrences of each document into passages, each of one stretch of one source."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lists = batch.column("later")
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        at, word, chars, words, first, first_at, first_word = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "word", "chars", "words", "first_key", "first_at", "first_word"))
        id_of = dict(zip(first.tolist(), flat.field("first_doc_id").to_pylist(), strict=True))
        rows = np.repeat(np.arange(n), sizes)
        end, end_word, shift = at + chars, word + words, at - first_at
        # a copy that overlaps its own source is cut from the end of that only
        own = first == batch.column("key").to_numpy()[rows]
        inside = own & (first_at + chars > at)
        at, word = np.where(inside, first_at + chars, at), np.where(inside, first_word + words, word)
        # repeats of a period in one document, then windows of one stretch of one source whatever others stand between them
        found = _stretches(at, word, end, end_word, first, shift, rows, np.where(own, first_at, -1 - np.arange(len(at))))
        at, word, end, end_word, first, shift, rows = _stretches(*found, found[5])
        order = np.lexsort((-end, at, rows))
        at, word, end, end_word, first, shift, rows = (x[order] for x in (at, word, end, end_word, first, shift, rows))
        most = np.maximum.accumulate(end + (rows << 32))  # what lies in an earlier window adds nothing
        more = np.append(True, end[1:] + (rows[1:] << 32) > most[:-1])
        at, word, end, end_word, first, shift, rows = (x[more] for x in (at, word, end, end_word, first, shift, rows))
        met = np.append(False, (rows[1:] == rows[:-1]) & (at[1:] <= end[:-1]))
        at[1:], word[1:] = np.where(met[1:], end[:-1], at[1:]), np.where(met[1:], end_word[:-1], word[1:])
        goes_on = met & np.append(False, (first[1:] == first[:-1]) & (shift[1:] == shift[:-1]))
        heads = np.flatnonzero(~goes_on)
        tails = np.append(heads[1:], len(at)) - 1
        found = (at[heads], end[tails] - at[heads], end_word[tails] - word[heads])
        named = [pa.array([id_of[k] for k in first[heads].tolist()], pa.int64()), pa.array(first[heads]), pa.array((at - shift)[heads].astype(np.int32))]
        spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in found] + named, fields=list(_SPAN))
        cuts = np.searchsorted(rows[heads], np.arange(n + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.ListArray.from_arrays(pa.array(cuts), spans)], names=["doc_id", "key", "spans"])


_FOUND = "array<struct<start: int, chars: int, words: int, first_doc_id: long, first_key: long, first_at: int>>"
SPANS = "array<struct<start: int, chars: int, words: int, first_doc_id: long>>"


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The characters before and after each place of a text (those after begin with the last one of the place), and what of a word the place begins and ends with."""
    for batch in batches:
        for key, text, places in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
            starts, ends = [p["start"] for p in places], [p["end"] for p in places]
            befores, afters = [text[max(0, a - REACH) : a] for a in starts], [text[max(0, b - 1) : b + REACH] for b in ends]
            leads = [_to_word(text[a:b]) if _inside(text, a) else 0 for a, b in zip(starts, ends, strict=True)]
            trails = [_from_word(text[a:b]) if _inside(text, b) else 0 for a, b in zip(starts, ends, strict=True)]
            columns = ([key] * len(places), starts, ends, befores, afters, leads, trails)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _AROUND.types, strict=True)], schema=_AROUND)


_AROUND = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("lead", pa.int32()), ("trail", pa.int32())])
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def _inside(text: str, at: int) -> bool:
    """Whether a place parts a word."""
    return 0 < at < len(text) and text[at - 1] not in _WHITE and text[at] not in _WHITE


def _to_word(text: str) -> int:
    """Characters before the first white one."""
    found = _GAP.search(text)
    return found.start() if found else len(text)


def _from_word(text: str) -> int:
    """Characters after the last white one."""
    return len(text) - 1 - max(text.rfind(c) for c in _WHITE)


_GAP = re.compile(r"[\x20\x09-\x0D]")


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _word_starts(text: str, before: str) -> int:
    """Words that begin in a text that follows the character `before`."""
    return len(_STARTS.findall(before[-1:] + text)) - bool(before and _STARTS.match(before[-1:]))


_STARTS = re.compile(r"(?:(?<=[\x20\x09-\x0D])|^)[^\x20\x09-\x0D]")


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extends the passages of each document over what equals the surroundings of their first occurrences, as far as the next passage, and draws their ends back to whole words."""
    for batch in batches:
        ids, all_spans = [], []
        for doc_id, key, spans in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            spans.sort(key=lambda s: s["start"])
            out, at = [], 0
            for k, s in enumerate(spans):
                start, end = s["start"], s["start"] + s["chars"]
                before, after = s["before"] or "", s["after"] or ""
                left = _shared(before[::-1], (s["first_before"] or "")[::-1])
                right = _shared(after[1:], (s["first_after"] or "")[1:])
                left = min(left, start - at)
                right = min(right, (spans[k + 1]["start"] if k + 1 < len(spans) else end + right) - end)
                if s["first_key"] == key:  # copy and source stay apart
                    room = max(0, start - s["first_at"] - s["chars"])
                    left = min(left, room)
                    right = min(right, room - left)
                more, rest = before[len(before) - left :], before[: len(before) - left]
                if not rest and start > left:
                    rest = "?"  # beyond REACH: taken for a part of the first word
                added = after[1 : right + 1]
                follows = after[right + 1 : right + 2] or ("?" if len(after) > REACH else " ")
                words = s["words"] + _word_starts(more, rest) + _word_starts(added, after[:1])
                lead = trail = 0
                if not more:
                    lead = s["lead"]
                elif rest and rest[-1] not in _WHITE and more[0] not in _WHITE:
                    lead = _to_word(more)
                    lead += s["lead"] if lead == left else 0
                if not added:
                    trail = s["trail"]
                elif added[-1] not in _WHITE and follows not in _WHITE:
                    trail = _from_word(added)
                    trail += s["trail"] if trail == right else 0
                start, end = start - left + lead, end + right - trail
                if start < end:
                    out.append((start, end - start, words - (trail > 0), s["first_doc_id"]))
                    at = end
            ids.append(doc_id)
            all_spans.append((key, out))
        lists = [[dict(zip(("start", "chars", "words", "first_doc_id"), o, strict=True)) for o in out] for _, out in all_spans]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([k for k, _ in all_spans], pa.int64()), pa.array(lists, pa.list_(pa.struct(list(_SPAN)[:4])))], names=["doc_id", "key", "spans"])


def _with_surroundings(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The passages of found, extended.  Texts meet the places asked of them, each place once however many passages have it as their source."""
    one = found.select("doc_id", "key", F.explode("spans").alias("s")).select("doc_id", "key", "s.*", (F.col("s.start") + F.col("s.chars")).alias("end"), (F.col("s.first_at") + F.col("s.chars")).alias("first_end"))
    places = one.select("key", "start", "end").unionAll(one.select("first_key", "first_at", "first_end")).distinct()
    asked = places.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("places"))
    texts = keyed.select("key", "text").join(asked, "key").mapInArrow(_around, "key long, start int, end int, before string, after string, lead int, trail int")
    around = common.written(texts.groupBy("key", "start", "end").agg(*[F.first(c).alias(c) for c in ("before", "after", "lead", "trail")]))
    source = around.select(F.col("key").alias("first_key"), F.col("start").alias("first_at"), F.col("end").alias("first_end"), F.col("before").alias("first_before"), F.col("after").alias("first_after"))
    met = one.join(around, ["key", "start", "end"], "left").join(source, ["first_key", "first_at", "first_end"], "left")
    columns = ("start", "chars", "words", "first_doc_id", "first_key", "first_at", "before", "after", "lead", "trail", "first_before", "first_after")
    packed = met.groupBy("doc_id", "key").agg(F.collect_list(F.struct(*columns)).alias("spans"))
    return packed.mapInArrow(_extended, f"doc_id long, key long, spans {SPANS}").where(F.size("spans") > 0)


def _passages(keyed: DataFrame, counted: bool = True) -> DataFrame:
    """doc_id, key and spans of the rows with a passage.  Without `counted` no words are shuffled, and those of the spans mean nothing."""
    rows = windows(keyed)
    if not counted:
        rows = rows.withColumns({"word": F.lit(0), "words": F.lit(0)})
    top = F.shiftrightunsigned("d1", 24)  # 40 bits tell nearly all that occur once; d1 and d2 decide below
    again = rows.groupBy(top.alias("top")).agg(F.count("*").alias("n")).where("n > 1").select("top")
    some = common.written(rows.join(again, top == F.col("top")).drop("top"))
    firsts = some.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "key", "at", "word")).alias("first"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first")
    met = some.join(firsts, ["d1", "d2"]).where((F.col("key") != F.col("first.key")) | (F.col("at") != F.col("first.at")))
    later = met.groupBy("doc_id", "key").agg(F.collect_list(F.struct("at", "word", "chars", "words", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "key", "at", "word")])).alias("later"))
    found = common.written(later.mapInArrow(_runs, f"doc_id long, key long, spans {_FOUND}").where(F.size("spans") > 0))
    return _with_surroundings(keyed, found)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its repeated passages: offset, characters, words, and the document of the first occurrence.

    Of the occurrences of a window the one with the least (doc_id, offset) is first.  Windows that overlap or adjoin and whose
    first occurrences lie alike in one document are one passage; where that changes a new one begins, and of two that
    overlap the later is listed from the end of the earlier on, so it can have less than MIN_WORDS words there.  A passage
    goes on over the characters on either side that equal those of its first occurrence, up to REACH, and is then drawn back to
    whole words: it neither begins nor ends inside a word, so it can have a word less than MIN_WORDS.  Repeats of a
    period in one document are one passage, and a copy that overlaps its own first occurrence begins at the end of that.
    Only documents with a passage have a row.  Rows with a null id or a null or empty text take no part; rows of one id and one
    text are one document, not held against each other at the same offset, and have one row; rows that share just an id are held
    against each other and have a row each; an empty table gives no rows; other columns are not read.

    Digests are counted with partial aggregates; just the windows whose digest occurs again are shuffled on,
    through joins whose hot keys Spark may split.
    """
    return _passages(_keyed(docs, id_col, text_col)).select("doc_id", "spans")


def _cutter(drop_emptied: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != "spans"]
            texts, stays = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                had = text
                if spans and text:
                    kept, at = "", 0
                    pieces = []
                    for a, b in [*((s["start"], s["start"] + s["chars"]) for s in spans), (len(text), len(text))]:
                        if a > at:
                            if kept and _inside(kept + text[at], 1):  # words that now meet stay apart
                                pieces.append(gap)
                            pieces.append(text[at:a])
                            kept, gap = text[a - 1], text[a : a + 1]
                        at = b
                    text = "".join(pieces)
                texts.append(text)
                stays.append(not drop_emptied or text is had or _STARTS.search(text) is not None or _STARTS.search(had) is None)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays))

    return cut


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """docs with the repeated passages cut out of the texts; all rows and columns stay, and so do whole words only.

    With drop_emptied a row whose text had words and lost all of them goes.  Rows of one id and one text lose the same;
    null ids and null or empty texts are left alone; an empty table gives no rows.
    """
    with common.passing(docs.sparkSession):
        spans = common.written(_passages(_keyed(docs, id_col, text_col), counted=False).select(F.col("key").alias("__key"), "spans"), stays=True)
    rest = F.struct(*[docs[c] for c in docs.columns if c != text_col], F.lit(0).alias("__none"))
    rows = docs.select(rest.alias("rest"), docs[text_col].cast("string").alias("text"), F.when(docs[id_col].isNotNull(), F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string"))).alias("key"))
    packed = rows.join(spans, F.col("key") == F.col("__key"), "left").select("rest", "text", "spans")
    common.small_batches(docs.sparkSession)
    cut = packed.mapInArrow(_cutter(drop_emptied), packed.drop("spans").schema)
    return cut.select(*[F.col("text").alias(text_col) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
