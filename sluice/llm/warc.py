"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: each page is one record in a gzip member of its own.  Of pages with
equal payloads of at least ``SMALLEST`` bytes the one with the largest id is
the response, the others are revisit records that refer to it and carry no
payload.  Payloads are compared by length and SHA-1.  Members are written by
Spark's text sink as raw bytes; its line separator is an empty gzip member,
so a file is a valid sequence of members.

Reading: an archive is split like any large file.  Spark's text source cuts
it at the gzip magic (``1f 8b 08``), so a task scans its byte range for the
magic and owns the candidates that start inside, also the rest of the last
one beyond the range's end.  The magic may occur inside compressed data too:
a candidate counts as a member only if its header decodes and its first bytes
inflate to a WARC version line (or it is an empty member).  Others are put
back behind the member before them.  Where that member began in an earlier
range, both pieces are handed to a second, small step that joins the pieces
of each file in order.

Archives should not have the suffix ``.gz``, for Hadoop's readers would then
inflate whole files before cutting them.

Defined cases: null html is an empty payload, a null url is left out; a null
id is smaller than any.  If all of a group's ids are null, or rows with the
largest id repeat, each of those is a response.  Empty tables give
archives without records.  Rows that repeat other than with the largest id
revisit like others.  Payloads of any length are one record.  Only the named
columns are read, so others cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize
from .common import bound_batches, col, table

SMALLEST = 1000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
_RECORD_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


EMPTY_MEMBER = _member(b"")


def _record(page, url, payload: bytes | None, length: int, sha1: str, refers_to) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block += payload or b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_RECORD_ID}{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_RECORD_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _pack(batches):
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns))
        yield pa.RecordBatch.from_arrays([pa.array([_member(_record(*row)) for row in rows], pa.binary())], names=["member"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one record for each row of ``pages`` to archives in the folder ``path``."""
    bound_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(col(html_col), F.lit("")), "UTF-8")
    described = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), payload.alias("payload"),
                             F.octet_length(payload).cast("long").alias("length"), F.sha1(payload).alias("sha1"))
    groups = described.select("id", "length", "sha1").filter(F.col("length") >= SMALLEST).groupBy("sha1", "length").agg(
        F.max("id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha1", "length", "kept")
    # written first, so that Spark can split a payload that many pages share when it joins
    joined = described.join(materialize(groups), ["sha1", "length"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept"))
    rows = joined.select(F.col("id").cast("string"), "url", F.when(~revisit, F.col("payload")).alias("payload"), "length", "sha1",
                         F.when(revisit, F.col("kept").cast("string")).alias("refers_to"))
    members = rows.mapInArrow(_pack, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def _inflated(data: bytes) -> tuple[bytes, bool]:
    """(bytes of the member at the start of data, whether it ended)."""
    unpacker = zlib.decompressobj(31)
    try:
        return unpacker.decompress(data) + unpacker.flush(), unpacker.eof
    except zlib.error:
        return b"", False


def _starts_member(candidate: bytes) -> bool:
    """Whether a candidate (from its magic on) is a member that holds a record, or nothing."""
    if len(candidate) < 10 or candidate[3] & 0xE0:
        return False
    unpacker = zlib.decompressobj(31)
    try:
        first = unpacker.decompress(candidate[:4096], 16)
    except zlib.error:
        return False
    return first.startswith(b"WARC/") or not first and unpacker.eof


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs if name.strip()}


def parse_record(data: bytes) -> dict | None:
    """Fields of one record, None if there is none."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        return None
    warc = _headers(head)
    block = rest[:int(warc.get("content-length", 0))]
    payload, http = block, {}
    if warc.get("content-type", "").startswith("application/http"):
        http_head, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(http_head)
    return {"warc": warc, "http": http, "payload": payload}


_ROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("nth", pa.int64()), ("piece", pa.binary()),
                  ("warc", pa.map_(pa.string(), pa.string())), ("http", pa.map_(pa.string(), pa.string())),
                  ("payload", pa.binary())])
_ROW_SQL = ("file string, at long, nth long, piece binary, warc map<string,string>, http map<string,string>, "
            "payload binary")


class _Rows:
    """Collects output rows and gives them out as batches of bounded size."""

    def __init__(self):
        self.rows, self.size = [], 0

    def record(self, file, at, data: bytes) -> None:
        if (record := parse_record(data)) is not None:
            self.rows.append((file, at, None, None, list(record["warc"].items()), list(record["http"].items()), record["payload"]))
            self.size += len(record["payload"])

    def piece(self, file, at, nth, data: bytes) -> None:
        self.rows.append((file, at, nth, data, None, None, None))
        self.size += len(data)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(_ROW)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ROW)], schema=_ROW)


def _scan(batches):
    """Whole records of each byte range, and the pieces of members that reach over a range's start or end."""
    def candidates():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    rows = _Rows()
    for (file, at), found in itertools.groupby(candidates(), key=lambda r: r[:2]):
        member: list[bytes] = []  # the current member's candidate and what was put back behind it
        nth = 0

        def close():
            if member:
                data, ended = _inflated(b"".join(member))
                if ended:
                    rows.record(file, at, data)
                else:
                    rows.piece(file, at, nth, b"".join(member))

        for _, _, rest in found:
            if not rest and at == 0 and not nth:  # what stands before a file's first magic
                nth += 1
                continue
            candidate = MAGIC + rest
            nth += 1
            if _starts_member(candidate):
                close()
                member = [candidate]
            elif member:
                member.append(candidate)
            else:
                rows.piece(file, at, nth, candidate)
            if rows.size > 8 << 20 or len(rows.rows) > 5000:
                yield rows.batch()
        close()
    yield rows.batch()


def _join_pieces(batches):
    """Records from the pieces of each file, which come in file order."""
    def pieces():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    rows = _Rows()
    for file, found in itertools.groupby(pieces(), key=lambda r: r[0]):
        member: list[bytes] = []
        for _, at, _, data in found:
            if _starts_member(data):
                member = [data]
            else:
                member.append(data)
            whole, ended = _inflated(b"".join(member))
            if ended:
                rows.record(file, at, whole)
                member = []
            if rows.size > 8 << 20:
                yield rows.batch()
    yield rows.batch()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, warc, http, payload) of every record of the archives in ``path``: header maps with names in lower case."""
    bound_batches(spark)
    cut = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.col("value").cast("binary").alias("rest"))
    rows = cut.mapInArrow(_scan, _ROW_SQL)
    pieces = rows.filter("piece IS NOT NULL").select("file", "at", "nth", "piece")
    joined = pieces.repartition("file").sortWithinPartitions("file", "at", "nth").mapInArrow(_join_pieces, _ROW_SQL)
    return rows.filter("warc IS NOT NULL").unionByName(joined).select("file", "warc", "http", "payload")


def page_records(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that :func:`write_archives` wrote."""
    def page(name: str):
        return F.regexp_extract(F.col("warc")[name], f"<{_RECORD_ID}(.*)>", 1)

    response = F.col("warc")["warc-type"] == "response"
    stated = F.lower(F.hex(_unbase32(F.regexp_extract(F.col("warc")["warc-payload-digest"], "sha1:(.*)", 1))))
    return records.select(
        F.when(page("warc-record-id") != "", page("warc-record-id")).cast(id_type).alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("http")["content-length"].cast("long")).cast("long")
        .alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(stated).alias("payload_digest"),
        F.col("warc")["warc-type"].alias("record_type"),
        F.when(~response, page("warc-refers-to")).cast(id_type).alias("refers_to"))


def _unbase32(text):
    """Bytes of a base32 text of 32 characters (a SHA-1), by way of its bits in hex."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.array_join(F.transform(F.split(text, ""), lambda c: F.lpad(F.bin(F.instr(F.lit(alphabet), c) - 1), 5, "0")), "")
    nibbles = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 2, 16))
    return F.unhex(F.array_join(nibbles, ""))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return page_records(read_archives(spark, path), pages.schema["page_id"].dataType.simpleString())


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM g
"""
