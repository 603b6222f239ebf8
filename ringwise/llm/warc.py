"""WARC archives with revisit records: header shuffle by payload digest, join of revisits to responses, fresh headers.

Archives are written and read by Spark alone, so they live in any store that Spark reaches.  A record is a header block,
an empty line, the content block and two line ends; the text writer's line separator is exactly that record end, so each
row is written as one record and each file is a valid (gzip) archive of a bounded number of records.  Reading walks
through a file by Content-Length, as payloads may hold anything.

Only headers are shuffled to decide who visits whom: (payload digest, page id).  Payloads move once, to the decision on
their digest; a digest that a third of all pages share is a hot key of a plain left join, which adaptive execution
splits.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwise.session import checkpoint_dir

#: Records of one archive file at most.
FILE_RECORDS = 2_000
#: Bytes taken from a compressed file at a time.
STEP = 1 << 20

_CRLF = "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hex digits in eight groups of 20 bits, each four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS32, _B32)


def headers(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``page_id, url, html, payload_bytes, payload_digest, dedup`` (null html: empty)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         html.alias("html"))
            .withColumn("payload_bytes", F.octet_length("html").cast("long"))
            .withColumn("payload_digest", sha1_base32(F.col("html").cast("binary")))
            .withColumn("dedup", F.col("payload_bytes") >= min_bytes))


def originals(rows: DataFrame) -> DataFrame:
    """Per payload digest held by several records: the original's page_id and url (the smallest page_id)."""
    return (rows.where("dedup").select("payload_digest", "page_id", "url")
            .groupBy("payload_digest")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("o"))
            .where("n > 1").select("payload_digest", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url")))


def with_types(rows: DataFrame) -> DataFrame:
    """Adds ``record_type`` and ``refers_to`` / ``refers_url`` (the response's, for revisits)."""
    joined = rows.join(originals(rows), "payload_digest", "left")
    revisit = F.col("dedup") & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return (joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("original")))
            .withColumn("refers_url", F.when(revisit, F.col("original_url"))).drop("original", "original_url"))


def _urn(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line, empty for null; line ends and percent signs of the value are percent-encoded."""
    safe = value.cast("string")
    for c in ("%", "\r", "\n"):
        safe = F.replace(safe, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(_CRLF)), F.lit(""))


def record_text(date: str) -> Column:
    """A whole record but its end, with headers made anew."""
    response = F.col("record_type") == "response"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(_CRLF + _CRLF))
    block = F.concat(http, F.when(response, F.col("html")).otherwise(F.lit("")))
    return F.concat(
        F.lit(f"WARC/1.1{_CRLF}"), _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _urn(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("WARC-Profile", F.when(~response, F.lit(_REVISIT))),
        _line("WARC-Refers-To", F.when(~response, _urn(F.col("refers_to"), F.col("payload_digest")))),
        _line("WARC-Refers-To-Target-URI", F.col("refers_url")),
        _line("WARC-Refers-To-Date", F.when(~response, F.lit(date))),
        _line("X-Page-ID", F.col("page_id")),
        F.lit(f"Content-Type: application/http;msgtype=response{_CRLF}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(_CRLF + _CRLF), block)


def write_archives(typed: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write typed records as gzip archives of at most FILE_RECORDS records under ``path``."""
    (typed.select(record_text(date).alias("value")).write.option("lineSep", _CRLF + _CRLF)
     .option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path))


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content block of every record of a gzip archive, holding one record at a time."""
    unzip, held, at = zlib.decompressobj(31), bytearray(), 0

    def more() -> bool:
        nonlocal at, unzip
        while True:
            if unzip.eof:  # the next member, if more than zero padding is left
                at -= len(unzip.unused_data)
                while content[at:at + 1] == b"\0":
                    at += 1
                if at >= len(content):
                    return False
                unzip = zlib.decompressobj(31)
            if at >= len(content):
                if at:
                    raise ValueError("archive ends inside a gzip member")
                return False
            step = content[at:at + STEP]
            at += len(step)
            data = unzip.decompress(step)
            if data:
                held.extend(data)
                return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("archive ends inside a record")
                return
        fields = dict(line.split(": ", 1) for line in held[:end].decode("utf-8", "replace").split(_CRLF)[1:])
        size = int(fields["Content-Length"])
        while len(held) < end + 8 + size:
            if not more():
                raise ValueError("archive ends inside a record")
        block = bytes(held[end + 4:end + 4 + size])
        if held[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record does not end where its Content-Length says")
        del held[:end + 8 + size]
        yield fields, block


_PLAIN = "page_id long, url string, record_type string, record_id string, refers_id string, payload_digest string"


def _value(text: str | None) -> str | None:
    if text is None:
        return None
    for code, c in (("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        text = text.replace(code, c)
    return text


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all archives under ``path``: page_id, url, record_type, record_id, refers_id, payload_digest, of the
    payload its payload_bytes and read_digest (computed from the bytes read), and the payload itself if asked for.

    An unreadable record raises.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "record_id", "refers_id", "payload_digest", "payload_bytes", "read_digest",
                 *(["payload"] if payload else [])]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()][:len(names)]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, block in _records(content.as_py()):
                    body = block[block.index(b"\r\n\r\n") + 4:]
                    page = fields.get("X-Page-ID")
                    row = (None if page is None else int(page), _value(fields.get("WARC-Target-URI")), fields["WARC-Type"],
                           fields["WARC-Record-ID"], fields.get("WARC-Refers-To"),
                           fields["WARC-Payload-Digest"].removeprefix("sha1:"), len(body),
                           base64.b32encode(hashlib.sha1(body).digest()).decode(), body)
                    rows.append(row[:len(names)])
                    size += len(body) if payload else 200
                    if size > STEP:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    schema = _PLAIN + ", payload_bytes long, read_digest string" + (", payload binary" if payload else "")
    return files.mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Join revisit records to the responses they refer to: every record with its full payload's size and digest.

    ``refers_to`` is the response's page_id; a revisit whose response is in no archive raises.
    """
    responses = records.where("record_type = 'response'")
    own = responses.select("page_id", "url", "record_type", "payload_bytes", F.col("read_digest").alias("payload_digest"),
                           F.lit(None).cast("long").alias("refers_to"))
    target = (responses.groupBy(F.col("record_id").alias("refers_id"))
              .agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("full_bytes"),
                   F.first("read_digest").alias("full_digest")))
    back = records.where("record_type = 'revisit'").select("page_id", "url", "record_type", "refers_id", "payload_digest") \
        .join(target, "refers_id", "left")
    known = F.when(F.col("full_digest") == F.col("payload_digest"), F.col("full_digest")).otherwise(
        F.raise_error(F.lit("a revisit record's response is missing or has another payload")).cast("string"))
    return own.unionByName(back.select("page_id", "url", "record_type", F.col("full_bytes").alias("payload_bytes"),
                                       known.alias("payload_digest"), "refers_to"))


def deduplicate(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as deduplicated archives under ``path``, read them back and resolve them.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is a response (all
    rows with that page_id are, should it repeat; null ids come last), the others are revisits without payload.  Null
    html is an empty payload, a null url is left out of the headers and read back as null.  Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(with_types(headers(pages, min_bytes)), path)
    return resolve(read_archives(spark, path, payload=False))
