"""WARC archives of pages: request, response or revisit, and metadata records, assembled again into transactions."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Smaller payloads are always stored.
MIN_REVISIT_BYTES = 100
#: Bytes of records, before compression, after which an archive is closed; a task holds one archive at a time, and a larger
#: record makes its archive longer.
ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to and the record identifiers of the capture and of what it refers to.

    refers_to is the smallest page_id with an equal payload, if it is another's.  An identifier is made from the page and
    its payload; of rows that repeat both, all but one have a number besides.
    """
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("n"),
    )
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.encode("html", "UTF-8"), 256)})
    # digests are uniform, so grouping by them is even but for copies, which the partial aggregates fold
    captures = common.written(rows.groupBy("payload_digest", "page_id").agg(F.count("*").alias("copies"), F.min("n").alias("n"), F.first("payload_bytes").alias("size")))
    firsts = captures.where(F.col("size") >= MIN_REVISIT_BYTES).groupBy(F.col("payload_digest").alias("d")).agg(F.min("page_id").alias("first_page"), F.sum("copies").alias("copies")).where("copies > 1")
    joined = rows.join(firsts, (F.col("payload_bytes") >= MIN_REVISIT_BYTES) & (F.col("payload_digest") == F.col("d")), "left")
    repeated = captures.where("copies > 1").select(F.col("payload_digest").alias("e"), F.col("page_id").alias("repeated_page"), F.col("n").alias("unnumbered"))
    joined = joined.join(repeated, (F.col("payload_digest") == F.col("e")) & F.col("page_id").eqNullSafe(F.col("repeated_page")), "left")
    refers = F.when(F.col("first_page") != F.col("page_id"), F.col("first_page"))
    name = lambda page: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.substring("payload_digest", 1, 16))
    number = F.when(F.col("n") != F.col("unnumbered"), F.concat(F.lit(":"), F.col("n").cast("string"))).otherwise("")
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", refers.alias("refers_to"), F.concat(name(F.col("page_id")), number).alias("record_id"), name(refers).alias("refers_record"))


def _record(kind: Column | str, record_id: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")), F.lit(f"WARC-Date: {DATE}"), *headers, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), block, F.lit(_CRLF * 2))


def _info_record() -> bytes:
    """The warcinfo record that begins each archive; the identifier is new each time."""
    block = f"software: spellwise{_CRLF}format: WARC file version 1.1{_CRLF}"
    return f"WARC/1.1{_CRLF}WARC-Type: warcinfo{_CRLF}WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>{_CRLF}WARC-Date: {DATE}{_CRLF}Content-Type: application/warc-fields{_CRLF}Content-Length: {len(block)}{_CRLF * 2}{block}{_CRLF * 2}".encode()


def _member(record: bytes) -> bytes:
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of one gzip member a record, less their last byte: the high byte of a record's length, zero under 16 MiB.

    The text writer, told to end lines with a zero byte, puts it there again.
    """
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        if held[-1][-1]:  # a record of 16 MiB or more
            held.append(_member(_info_record()))
        blob = b"".join(held)
        return pa.RecordBatch.from_arrays([pa.array([blob[:-1]], pa.binary())], names=["blob"])

    for batch in batches:
        for records in batch.column("records"):
            if not held:
                held.append(_member(_info_record()))
            for record in records:
                data = record.as_py().encode()
                held.append(_member(data))
                size += len(data)
            if size >= ARCHIVE_BYTES:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Three records a page: its request, its response or revisit, and its metadata, the first and last concurrent to the second.

    A record is a gzip member of its own, an archive begins with a warcinfo record, and archives are bounded by bytes.
    """
    common.small_batches(pages.sparkSession)
    rows = with_revisits(pages, id_col, url_col, html_col)
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    capture = F.col("record_id")
    uri = F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: <"), capture, F.lit(">"))
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    refers = F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: <"), F.col("refers_record"), F.lit(f">{_CRLF}WARC-Profile: {_PROFILE}")))
    kind = F.when(is_revisit, "revisit").otherwise("response")
    answer = _record(kind, capture, [uri, digest, refers], "application/http; msgtype=response", F.concat(http, F.when(is_revisit, "").otherwise(F.col("html"))))
    request = _record("request", F.concat(capture, F.lit(":request")), [uri, concurrent], "application/http; msgtype=request", F.lit(f"GET / HTTP/1.1{_CRLF * 2}"))
    metadata = _record("metadata", F.concat(capture, F.lit(":metadata")), [uri, concurrent], "application/warc-fields", F.concat(F.lit("page-id: "), number, F.lit(f"{_CRLF}charset: utf-8{_CRLF}")))
    blobs = rows.select(F.array(request, answer, metadata).alias("records")).mapInArrow(_archives, "blob binary")
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, a member at a time."""
    at, step = 0, 1 << 14
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            piece = data[at : at + step]
            if not piece:
                raise ValueError("an archive ends inside a record")
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield parse(b"".join(parts))


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, by its stated length."""
    head = record.index(b"\r\n\r\n")
    first, *lines = record[:head].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    end = head + 4 + int(headers["content-length"])
    if record[end:] != b"\r\n\r\n":
        raise ValueError("a record does not have its stated length")
    return headers, record[head + 4 : end]


_FIELDS = [("kind", pa.string()), ("record_id", pa.string()), ("capture", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("http_head", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())]
_SCHEMA = pa.schema(_FIELDS)
RECORD_SCHEMA = "kind string, record_id string, capture string, page_id long, target_uri string, date string, refers_to long, stated_digest string, http_head string, payload_bytes long, payload_digest string, payload string"


def _page(urn: str) -> int | None:
    number = urn.strip("<>").split(":")[2]
    return None if number == "none" else int(number)


def record_row(headers: dict[str, str], block: bytes) -> tuple:
    kind, record_id = headers["warc-type"], headers["warc-record-id"].strip("<>")
    head, payload, size, digest, refers = None, None, None, None, None
    stated = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind in ("request", "response", "revisit"):
        top, _, body = block.partition(b"\r\n\r\n")
        head = top.decode("utf-8")
        if kind == "response":
            payload, size, digest = body.decode("utf-8"), len(body), hashlib.sha256(body).hexdigest()
        elif kind == "revisit":
            fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.split("\r\n")[1:])}
            size, digest, refers = int(fields["content-length"]), stated, _page(headers["warc-refers-to"])
    else:
        payload = block.decode("utf-8")
    capture = headers.get("warc-concurrent-to", record_id).strip("<>")
    return kind, record_id, capture, _page(record_id), headers.get("warc-target-uri"), headers["warc-date"], refers, stated, head, size, digest, payload


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_SCHEMA)

    for batch in batches:
        for content in batch.column("content"):
            held, size = [], 0
            for headers, block in records_of(content.as_py()):
                if headers["warc-type"] == "warcinfo":
                    continue
                held.append(record_row(headers, block))
                size += len(block)
                if size > common.SLICE_BYTES:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives; a folder without records gives no rows.

    A record that lacks a header has null there; an empty payload is empty, not null.
    """
    common.small_batches(spark)
    return spark.read.format("binaryFile").load(folder).where("length > 0").select("content").mapInArrow(_parse_batches, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture, from the records joined through their concurrent-to identifiers.

    A capture lacking a record has null there; of records of one kind in a capture the smallest record_id counts.
    """
    answer = F.col("kind").isin("response", "revisit")
    of = lambda kind, *columns: F.min(F.when(kind, F.struct("record_id", *columns)))
    grouped = records.groupBy("capture").agg(
        of(F.col("kind") == "request", "http_head", "target_uri", "date").alias("request"),
        of(answer, "kind", "page_id", "target_uri", "date", "http_head", "payload_bytes", "payload_digest", "stated_digest", "refers_to").alias("response"),
        F.min(F.when(answer, F.col("payload"))).alias("payload"),
        of(F.col("kind") == "metadata", "payload").alias("metadata"),
    )
    return grouped.select("capture", F.col("response.page_id").alias("page_id"), "request", "response", "payload", "metadata")


def transactions(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Writes the archives of pages below `folder` (a new shared one by default), reads them back and assembles the captures.

    A null html is an empty payload, a null url an empty one; a null page_id stays null; repeated rows are captures
    of their own (those with the smallest page_id of a payload are all responses); an empty table gives no rows; other
    columns are not read.
    """
    folder = folder or common.shared_folder(pages.sparkSession)
    write_archives(pages, folder, **columns)
    return assemble(read_records(pages.sparkSession, folder))
