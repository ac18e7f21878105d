"""WARC archives: writing, reading back, and reassembling segmented records.

A record longer than a segment is written as several: the first carries the record's type and
segment number 1, the others are continuation records that name the first one's id as their origin;
the last also carries the total length. Reading groups continuation records by origin id, orders them
by segment number, verifies that the numbers run without gaps and that the lengths sum to the total,
and only then decodes the HTTP message, chunked transfer framing included. Archives are written by
Spark's text writer with the record terminator as its separator, which makes them gzipped .warc
files in any store that Spark can write to.

Cases: null html is an empty payload; a null page id is written as "-" and read back as null; of
equal payloads (empty ones included) the smallest page id is the response and the others revisit it
(null ids last; rows repeated with that smallest id are all responses); an empty table gives an empty
archive and result; other columns are not read. A gap or a wrong length raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, read, scratch

CRLF = b"\r\n"
END = "\r\n\r\n"
#: A record's block longer than this is written in segments.
SEGMENT_BYTES = 32 << 10
#: Payloads longer than this are sent in chunks of that size.
CHUNK_BYTES = 4 << 10
#: Records in an archive file, so that one file is read within a task's memory.
FILE_RECORDS = 500

DIGESTED = "page_id long, url string, payload binary, digest string"
RECORDS = "type string, record_id string, refers_to string, digest string, origin string, segment int, total long, block binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decodes chunked framing; ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def http_response(payload: bytes, chunks: int = CHUNK_BYTES, body: bool = True) -> bytes:
    framing = b"Transfer-Encoding: chunked" if body and len(payload) > chunks else b"Content-Length: %d" % len(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + framing + CRLF + CRLF
    return head + (b"" if not body else chunked(payload, chunks) if len(payload) > chunks else payload)


def http_payload(message: bytes) -> tuple[bytes, int]:
    """The payload of an HTTP message, and the length that its head states (-1: none)."""
    head, _, body = message.partition(CRLF + CRLF)
    fields = dict(line.lower().split(b": ", 1) for line in head.split(CRLF)[1:] if b": " in line)
    if fields.get(b"transfer-encoding") == b"chunked":
        return unchunked(body), -1
    return body, int(fields.get(b"content-length", -1))


def records(kind: str, record_id: str, url: str, digest: str, block: bytes, refers_to: str | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record, as one or more, each without the terminator."""
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)] or [b""]
    for number, piece in enumerate(pieces, 1):
        head = ["WARC/1.1", f"WARC-Type: {kind if number == 1 else 'continuation'}", f"WARC-Record-ID: <{record_id if number == 1 else f'{record_id}:{number}'}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}"]
        if number == 1:
            head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
            if refers_to is not None:
                head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
        else:
            head += [f"WARC-Segment-Origin-ID: <{record_id}>"]
        if len(pieces) > 1:
            head += [f"WARC-Segment-Number: {number}"]
            if number == len(pieces):
                head += [f"WARC-Segment-Total-Length: {len(block)}"]
        yield "\r\n".join([*head, f"Content-Length: {len(piece)}"]).encode() + CRLF + CRLF + piece


def parse(archive: bytes) -> Iterator[dict]:
    """The records of an archive file, as they lie there."""
    at = 0
    while at < len(archive):
        end = archive.index(CRLF + CRLF, at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        start, n = end + 4, int(fields["content-length"])
        if archive[start + n : start + n + 4] != CRLF + CRLF:
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        bare = {k: fields[k].strip("<>") if k in fields else None for k in ("warc-record-id", "warc-refers-to", "warc-segment-origin-id")}
        yield {
            "type": fields["warc-type"], "record_id": bare["warc-record-id"], "refers_to": bare["warc-refers-to"], "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
            "origin": bare["warc-segment-origin-id"] or (bare["warc-record-id"] if "warc-segment-number" in fields else None),
            "segment": int(fields.get("warc-segment-number", 0)), "total": int(fields.get("warc-segment-total-length", -1)), "block": archive[start : start + n],
        }
        at = start + n + 4


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: a response)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.translate(F.coalesce(F.col(url_col), F.lit("")), "\r\n", "  ").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([payload_digest(p) for p in b.column("payload").to_pylist()], pa.string())], schema=_arrow(DIGESTED))

    found = mapped(rows, digests, DIGESTED)
    first = found.select("page_id", "digest").groupBy("digest").agg(F.min("page_id").alias("first"))
    # the payloads of a hot digest are split by the adaptive skew join
    return found.join(first, "digest").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Writes .warc files of pages (page_id, url, payload, digest, refers_to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        urn = lambda i: f"urn:page:{'-' if i is None else i}"
        for b in batches:
            out: list[bytes] = []
            for page_id, url, payload, digest, refers, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                revisit = refers is not None
                out += records("revisit" if revisit else "response", f"{urn(page_id)}:{key}", url, digest, http_response(payload, body=not revisit), urn(refers) if revisit else None, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # a retried task writes its file anew, with new keys throughout; segments never leave their task
    keyed = pages.select("page_id", "url", "payload", "digest", "refers_to", F.expr("uuid()").alias("key"))
    lines = mapped(keyed, run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with continuations joined: type, record_id, refers_to, digest, payload, stated length."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(RECORDS)
        for b in batches:
            for content in b.column("content"):
                content = content.as_py()
                rows = [tuple(r.values()) for r in parse(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)]
                if rows:
                    yield _batch(rows, schema)

    found = mapped(spark.read.format("binaryFile").load(path).select("content"), split, RECORDS)
    # one group is one record's segments
    parts = found.filter("origin IS NOT NULL").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "type", "record_id", "refers_to", "digest", "total", "block"))).alias("parts"))
    numbers, last = F.transform("parts", lambda p: p["segment"]), F.element_at("parts", -1)
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["block"]))
    # an SQL function: concat over an array of binaries
    whole = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    sound = numbers.eqNullSafe(F.sequence(F.lit(1), F.size("parts"))) & (last["total"] == length)
    joined = parts.select("origin", F.when(sound, F.col("parts")).otherwise(F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" are missing or of a wrong length")))).alias("parts")).select(
        *(F.col("parts")[0][c].alias(c) for c in ("type", "record_id", "refers_to", "digest")), whole.alias("block"))
    records = joined.unionByName(found.filter("origin IS NULL").select("type", "record_id", "refers_to", "digest", "block"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [http_payload(m) for m in b.column("block").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([p for p, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["type", "record_id", "refers_to", "digest", "payload", "stated"])

    return mapped(records, decode, "type string, record_id string, refers_to string, digest string, payload binary, stated long")


def op4(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(with_revisits(read(spark, sf_dir, "pages")), path)
    page = lambda c: F.nullif(F.split_part(F.col(c), F.lit(":"), F.lit(3)), F.lit("-")).cast("long")
    response = F.col("type") == "response"
    return read_archives(spark, path).select(
        page("record_id").alias("page_id"), F.when(response, F.length("payload")).otherwise(F.col("stated")).cast("long").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
    )


ORACLE = """
WITH RECURSIVE p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT DISTINCT hex, list_reduce(list_transform(range(0, 40), lambda i: list_element(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], position(hex[i + 1] IN '0123456789abcdef'))), lambda a, b: a || b) AS b FROM p),
d AS (SELECT hex, list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0b' || b[5 * i + 1:5 * i + 5])::INTEGER) + 1]), lambda a, b: a || b) AS digest FROM bits),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, octet_length(payload) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (hex) JOIN d USING (hex)
"""
