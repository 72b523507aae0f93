"""Helpers that the text operators share: bounded Arrow batches, vectorised word hashing, written tables."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec

#: Bytes of text that a vectorised step takes at once; a longer text is a slice of its own.  A step's arrays take some
#: tens of bytes a byte of text, so this bounds what a worker holds.
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch between the JVM and Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of a row group of tables with large rows.
GROUP_BYTES = 16 << 20

_LENGTH_SALT = np.uint64(0xD6E8FEB86659FD93)
#: Longer spans are hashed one by one, shorter ones in steps of eight bytes.
_LONG_SPAN = 256
#: The low bytes of a word of eight that belong to a span of 0 to 8 bytes.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


_FOLDERS: list[str] = []
_LOCAL: list[str] = []  # the folder of a local session without the setting
#: Folders made in each of the blocks of passing() that are open.
_PASSING: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("passing", default=())


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.  Only a local session may do without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _LOCAL[:] = _LOCAL or [tempfile.mkdtemp(prefix="spellwise-")]
        top = _LOCAL[0]
    _FOLDERS.append(f"{top.rstrip('/')}/{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Deletes the folders made so far.  Results that still read them must be written elsewhere before."""
    while _FOLDERS:
        _delete(spark, _FOLDERS.pop())


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside the block go when it ends, but for those written with `stays`."""
    token = _PASSING.set((*_PASSING.get(), []))
    try:
        yield
    finally:
        for folder in _PASSING.get()[-1]:
            if folder in _FOLDERS:
                _FOLDERS.remove(folder)
                _delete(spark, folder)
        _PASSING.reset(token)


def written(df: DataFrame, row_bytes: int = 0, stays: bool = False) -> DataFrame:
    """df as a table in the shared folder: it is computed once and outlives lost executors.

    With row_bytes, what a large row takes in memory, a row group holds GROUP_BYTES of such rows at most, since Spark reads up to 4096
    rows of one at once and packed rows can be far smaller than read ones.
    With stays it outlives the block of passing() around it, though not a block around that.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    blocks = _PASSING.get()[: -1 if stays else None]
    if blocks:
        blocks[-1].append(path)
    writer = df.write
    if row_bytes:
        writer = writer.option("parquet.block.size", GROUP_BYTES).option("parquet.block.row.count.limit", max(1, GROUP_BYTES // row_bytes)).option("parquet.page.size.row.check.min", 1)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keeps the batches that go to Python small, so that long texts fit a worker's memory.

    Spark reads these settings when the plan runs, after an operator has returned, so they stay; smaller ones of the
    caller are kept.
    """
    for name, most in ((_ROWS, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        now = spark.conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


@contextlib.contextmanager
def narrow_batches(spark: SparkSession, rows: int = 20_000) -> Iterator[None]:
    """More rows a batch, for tables without texts that are computed inside the block; the settings before it come back."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch, of about `size` bytes, with the UTF-8 bytes of a string column and their row offsets (a null has no bytes)."""
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64, count=n + 1 + col.offset)[col.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        lo, hi = offsets[first], offsets[last]
        yield batch.slice(first, last - first), data[lo:hi], offsets[first : last + 1] - lo
        first = last


def byte_class(pattern: str) -> np.ndarray:
    """True for each byte named: ranges like 09-0D in hex, separated by spaces."""
    out = np.zeros(256, bool)
    for part in pattern.split():
        a, _, b = part.partition("-")
        out[int(a, 16) : int(b or a, 16) + 1] = True
    return out


#: The separators of [^\x20\x09-\x0D]+
WHITE = byte_class("20 09-0D")
#: Everything but ASCII letters and bytes of longer characters.
NOT_LETTER = byte_class("00-40 5B-60 7B-7F")
#: ASCII lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in all rows, and the index of each row's first word (one more at the end)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    after[-1], after[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xCA01F9DD51B63D85)
    return x ^ (x >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, chained over its words of eight bytes; it holds nothing beyond the call."""
    left = np.asarray(ends - starts, np.int64)
    out = left.astype(np.uint64) * _LENGTH_SALT
    if not len(left):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), buffer=padded, strides=(1,))  # the eight bytes from each place on
    long = np.flatnonzero(left > _LONG_SPAN)
    live = np.flatnonzero((left > 0) & (left <= _LONG_SPAN))
    at, left = starts[live], left[live]
    while len(live):
        out[live] = mix(out[live] ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    view = memoryview(padded)
    for k, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        out[k] = xxhash.xxh64_intdigest(view[a:b])
    return out


def row_of(counts: np.ndarray) -> np.ndarray:
    """The row of each word, from the first-word index of the rows."""
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def repeats_in_rows(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order, and whether the key at order[i] occurs more than once in its row."""
    both = mix(keys + rows.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    order = np.argsort(both)
    s = both[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        equal = s[1:] == s[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    return order, same


def ordered(partition, *order) -> WindowSpec:
    """A running window."""
    return Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
