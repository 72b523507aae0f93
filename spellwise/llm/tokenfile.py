"""Token ids in binary shards: a concatenated id array with Elias-Fano coded document boundaries.

A shard holds, little-endian:

    magic EFT1 | partition u32 | shard u32 | first id's place in its partition u64 | documents u64 | documents
    with a null id u64 | bytes per id u8 | Elias-Fano sequence of the document ids | Elias-Fano sequence of the
    boundaries (documents + 1 values) | ids

and each range partition of document ids also leaves a manifest of MANIFEST_BYTES with its totals.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_HEAD, _MANIFEST = "<4sIIQQQB", "<4sIIQQ"
MANIFEST_BYTES = struct.calcsize(_MANIFEST) + 1  # the text writer ends each record with a line feed
#: Ids of a shard before it is closed; a longer document makes its shard longer.
SHARD_IDS = 1 << 22
#: Distinct pieces of text whose ids a worker remembers, by 64-bit hashes.
CACHE_PIECES = 400_000
#: Bytes of text encoded at once: each distinct piece in them is looked up or encoded once.
ENCODE_BYTES = 2 << 20
#: Pieces that the tokenizer gets at once: what it returns takes about a kilobyte each.
ENCODE_PIECES = 8192


class EliasFano:
    """A non-decreasing sequence of unsigned integers: low bits packed, high bits in unary, with select samples."""

    HEAD = "<QQB"
    SAMPLE = 256

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), ones[:: cls.SAMPLE].astype(np.uint64))

    def to_bytes(self) -> bytes:
        return struct.pack(self.HEAD, self.count, len(self.high), self.low_bits) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        count, high_bytes, low_bits = struct.unpack_from(cls.HEAD, data, at)
        at += struct.calcsize(cls.HEAD)
        sizes = ((count * low_bits + 7) // 8, high_bytes, 8 * (-(-count // cls.SAMPLE)))
        parts = []
        for size in sizes:
            parts.append(np.frombuffer(data, np.uint8, count=size, offset=at))
            at += size
        return cls(count, low_bits, parts[0], parts[1], parts[2].view(np.uint64)), at

    def select(self, i: int) -> int:
        """Value i, from the nearest sample before it."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, left = int(self.samples[i // self.SAMPLE]), i % self.SAMPLE
        byte = at // 8
        bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        bits[: at % 8] = 0
        while left >= (here := int(bits.sum())):
            left -= here
            byte += 1
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        position = byte * 8 + int(np.flatnonzero(bits)[left])
        value = (position - i) << self.low_bits
        for b in range(self.low_bits):
            place = i * self.low_bits + b
            value |= ((int(self.low[place // 8]) >> (place % 8)) & 1) << b
        return value

    def select_range(self, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi - 1: the set bits from the nearest sample before lo on, as far as they are needed."""
        if not 0 <= lo <= hi <= self.count:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.zeros(0, np.int64)
        byte, skip = int(self.samples[lo // self.SAMPLE]) // 8, lo % self.SAMPLE
        size, ones = (hi - lo + skip) // 2 + 16, np.zeros(0, np.int64)
        while True:
            bits = np.unpackbits(self.high[byte : byte + size], bitorder="little")
            bits[: int(self.samples[lo // self.SAMPLE]) - 8 * byte] = 0
            ones = np.flatnonzero(bits)
            if len(ones) >= hi - lo + skip:
                break
            size *= 2
        index = np.arange(lo, hi)
        high = (ones[skip : skip + hi - lo] + 8 * byte - index) << self.low_bits
        places = index[:, None] * self.low_bits + np.arange(self.low_bits)
        low = (self.low[places // 8] >> (places % 8).astype(np.uint8)) & 1
        return high + (low.astype(np.int64) << np.arange(self.low_bits)).sum(1, dtype=np.int64)

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        high = (ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits)
        return high + (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


@functools.lru_cache(maxsize=2)
def _tokenizer(spec: bytes):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec.decode("utf-8"))


_LETTER = common.byte_class("41-5A 61-7A")
_PRINTED = common.byte_class("21-7E")
_WIDE = common.byte_class("C3-DF")


def piece_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the byte-level pre-tokenizer always ends a token, so that the pieces between them can be encoded apart.

    These are: before ASCII white space that follows a printed ASCII character or a letter of two bytes from
    U+00C0 on (none of those is white space), and between an ASCII letter and ASCII punctuation or a digit.
    """
    n = len(data)
    if n < 2:
        return np.unique(offsets[(offsets < n)])
    before, here = data[:-1], data[1:]
    wide = np.zeros(n - 1, bool)
    wide[1:] = _WIDE[data[:-2]] & (before[1:] >= 0x80)
    cut = common.WHITE[here] & (_PRINTED[before] | wide)
    cut |= _LETTER[before] & (_PRINTED[here] & ~_LETTER[here])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:n] |= cut
    return np.flatnonzero(edge[:n])


def cuts_hold(spec: bytes) -> bool:
    """Whether piece_cuts is true of a tokenizer: one byte-level pre-tokenizer with its own pattern, and no normalizer."""
    parts = json.loads(spec)
    before = parts.get("pre_tokenizer") or {}
    return before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not parts.get("normalizer")


class Encoder:
    """Encodes texts by the pieces between certain token ends, each distinct piece once."""

    def __init__(self, spec: bytes) -> None:
        self.tokenizer = _tokenizer(spec)
        self.by_pieces = cuts_hold(spec)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        """The pieces met so far: ascending hashes, and where the ids of each stand in one array."""
        self.hashes, self.heads, self.lengths, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        flat, lengths = [np.zeros(0, np.uint32)], []
        for k in range(0, len(texts), ENCODE_PIECES):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts[k : k + ENCODE_PIECES]], add_special_tokens=False)]
            lengths += map(len, found)
            flat.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32))
        return np.concatenate(flat), np.array(lengths, np.int64)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes pieces with ascending hashes that were not met before."""
        ids, lengths = self._ids(pieces)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.lengths = np.insert(self.hashes, at, hashes), np.insert(self.lengths, at, lengths)
        self.heads = np.insert(self.heads, at, len(self.flat) + np.cumsum(lengths) - lengths)
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's ids begin (one more at the end)."""
        whole = data.tobytes()
        starts = piece_cuts(data, offsets) if self.by_pieces else np.unique(offsets[offsets < len(data)])
        ends = np.append(starts[1:], len(data))
        codes, hashes = pd.factorize(common.span_hashes(data, starts, ends))
        if len(self.hashes) > CACHE_PIECES:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero((at == len(self.hashes)) | (np.append(self.hashes, np.uint64(0))[at] != hashes))
        if len(new):
            new = new[np.argsort(hashes[new])]
            first = np.zeros(len(hashes), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            self._learn(hashes[new], [whole[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        at = np.searchsorted(self.hashes, hashes)
        each = self.lengths[at][codes]
        ids = self.flat[np.repeat(self.heads[at][codes] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        ends_of_pieces = np.append(0, np.cumsum(each))
        bounds = ends_of_pieces[np.searchsorted(starts, offsets)]
        odd = [r for r in range(len(offsets) - 1) if any(s in whole[offsets[r] : offsets[r + 1]] for s in self.special)] if any(s in whole for s in self.special) else []
        if odd:  # the strings of special tokens are tokens too: such texts are encoded whole
            parts = [ids[bounds[r] : bounds[r + 1]] for r in range(len(offsets) - 1)]
            own, lengths = self._ids([whole[offsets[r] : offsets[r + 1]] for r in odd])
            for r, part in zip(odd, np.split(own, np.cumsum(lengths)[:-1]), strict=True):
                parts[r] = part
            ids, bounds = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, bounds


def shard_bytes(partition: int, shard: int, base: int, doc_ids: np.ndarray, nulls: int, lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """One shard: the first `nulls` documents have no id, the others' ids ascend."""
    own = doc_ids[nulls:].astype(np.int64)
    first = int(own[0]) if len(own) else 0
    return (
        struct.pack(_HEAD, b"EFT1", partition, shard, base, len(doc_ids), nulls, width)
        + struct.pack("<q", first)
        + EliasFano.encode((own - first).astype(np.uint64)).to_bytes()
        + EliasFano.encode(np.append(0, np.cumsum(lengths))).to_bytes()
        + ids.astype(f"<u{width}").tobytes()
    )


def read_shard(data: bytes) -> tuple[int, int, np.ndarray, int, EliasFano, np.ndarray]:
    """partition, base, document ids, nulls, boundaries and ids of a shard."""
    magic, partition, _, base, count, nulls, width = struct.unpack_from(_HEAD, data, 0)
    if magic != b"EFT1":
        raise ValueError("not a shard of token ids")
    (first,) = struct.unpack_from("<q", data, struct.calcsize(_HEAD))
    view = memoryview(data)
    own, at = EliasFano.from_bytes(view, struct.calcsize(_HEAD) + 8)
    bounds, at = EliasFano.from_bytes(view, at)
    doc_ids = np.zeros(count, np.int64)
    doc_ids[nulls:] = own.decode().astype(np.int64) + first
    total = bounds.select(bounds.count - 1)
    return partition, base, doc_ids, nulls, bounds, np.frombuffer(data, f"<u{width}", count=total, offset=at)


_BLOB = pa.schema([("blob", pa.binary())])


def _writer(spec, end_id: int, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads for short pieces cost more than they bring
        encoder, partition = Encoder(spec.value), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
        size = shard = total = 0

        def blob(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], schema=_BLOB)

        def close() -> pa.RecordBatch:
            data = shard_bytes(partition, shard, total - size, np.concatenate([h[0] for h in held]), sum(h[1] for h in held), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), width)
            return blob(data)

        for batch in batches:
            for part, data, offsets in common.slices(batch, size=ENCODE_BYTES):
                ids, bounds = encoder.encode(data, offsets)
                lengths = np.diff(bounds) + 1
                with_end = np.full(lengths.sum(), end_id, np.uint32)
                inner = np.ones(len(with_end), bool)
                inner[np.cumsum(lengths) - 1] = False
                with_end[inner] = ids
                doc = part.column("doc_id")
                held.append((doc.fill_null(0).to_numpy(), doc.null_count, lengths, with_end))
                size, total = size + len(with_end), total + len(with_end)
                if size >= SHARD_IDS:
                    yield close()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield close()
        if total:
            yield blob(struct.pack(_MANIFEST, b"EFTM", partition, shard + bool(held), total, 0))

    return write


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each text, appends end_id, and writes the ids in ascending order of the document ids (nulls first, ties by text).

    Rows are dealt by ranges of the id, so each partition is an interval of the order; a task holds one shard.  Raises
    ValueError if an id of the tokenizer does not fit width bytes.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    largest = max([end_id, *_tokenizer(content).get_vocab(with_added_tokens=True).values()])
    if largest >= 1 << 8 * width:
        raise ValueError(f"ids up to {largest} do not fit {width} bytes")
    spec = spark.sparkContext.broadcast(content)
    two = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    count = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = two.repartitionByRange(count, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    blobs = ordered.mapInArrow(_writer(spec, end_id, width), "blob binary")
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


#: Documents whose boundaries are selected at once.
_DOCS_AT_ONCE = 512
_DOC = pa.schema([("partition", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            partition, base, doc_ids, nulls, bounds, ids = read_shard(content.as_py())
            for lo in range(0, len(doc_ids), _DOCS_AT_ONCE):
                hi = min(lo + _DOCS_AT_ONCE, len(doc_ids))
                at = bounds.select_range(lo, hi + 1)
                lists = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(ids[at[0] : at[-1]].astype(np.int32)))
                no_id = np.arange(lo, hi) < nulls
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, partition, np.int32)), pa.array(doc_ids[lo:hi], mask=no_id), pa.array(base + at[:-1]), lists], schema=_DOC)


_DIGEST = pa.schema([("partition", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            partition, base, doc_ids, nulls, bounds, ids = read_shard(content.as_py())
            for lo in range(0, len(doc_ids), _DOCS_AT_ONCE):
                hi = min(lo + _DOCS_AT_ONCE, len(doc_ids))
                at = bounds.select_range(lo, hi + 1)
                wide, own = ids[at[0] : at[-1]].astype("<u4").tobytes(), (at - at[0]).tolist()
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(own[:-1], own[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, partition, np.int32)), pa.array(doc_ids[lo:hi], mask=np.arange(lo, hi) < nulls), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=_DIGEST)


def partition_starts(spark: SparkSession, folder: str) -> dict[int, int]:
    """Ids before each range partition, from the manifests: one small entry a partition."""
    files = spark.read.format("binaryFile").load(folder).where(F.col("length") == MANIFEST_BYTES).select("content").collect()
    starts, at = {}, 0
    for _, partition, _, total, _ in sorted(struct.unpack_from(_MANIFEST, f.content) for f in files):
        starts[partition] = at
        at += total
    return starts


def read_shards(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it) and the document's ids, or with digest their count and crc32."""
    starts = partition_starts(spark, folder)
    shards = spark.read.format("binaryFile").load(folder).where(F.col("length") > MANIFEST_BYTES).select("content")
    schema = "partition int, doc_id long, local long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<int>")
    rows = shards.mapInArrow(_digest if digest else _read, schema)
    before = spark.createDataFrame(list(starts.items()), "partition int, before long")  # one row a range partition
    return rows.join(F.broadcast(before), "partition").select("doc_id", (F.col("local") + F.col("before")).alias("start"), *rows.columns[3:])


def token_file(docs: DataFrame, tokenizer_path: str, end_id: int = 0, width: int = 2, digest: bool = False, folder: str | None = None) -> DataFrame:
    """Writes the shards of docs below `folder` (a new shared one by default) and reads them back.

    A null text is empty: its document holds the end id alone.  Null document ids come first, repeated ids keep
    one document a row, ordered by text; an empty table gives no rows; other columns are not read.
    """
    folder = folder or common.shared_folder(docs.sparkSession)
    write_shards(docs, folder, tokenizer_path, end_id, width)
    return read_shards(docs.sparkSession, folder, digest)
