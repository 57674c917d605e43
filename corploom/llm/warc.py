"""A content-addressed web archive.

Payloads are stored once each, compressed, under their SHA-256.  Record headers
(the WARC header block and the HTTP header block, byte for byte) are a table of
their own.  A join of the two gives the original records back; each payload is
checked against its SHA-256, its SHA-1 and its length as it is read.

Of the records with equal payloads of at least `least_bytes`, the one with the
smallest page id is a response and the others are revisits that refer to it.
Smaller payloads are all responses.

Payloads shuffle compressed, after a map-side pass that drops repeats, so a
payload that a third of all pages share moves once a task.  Rows that refer to
it meet a slim row of its facts, by `shared.lookup`, never the payload.

Cases: null html is an empty payload; a null url gives a page URN; control
characters in a url are percent-encoded in headers; of repeated rows with the
smallest id of a payload one is the response; a null id counts as largest, so
only a payload all of whose ids are null has a response without one; an empty
table gives an empty archive; other columns are not read, so their names cannot
clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.llm import blocks, shared

_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    """Record headers (page_id, digest, stored, header) and payloads (digest, packed), as written tables."""

    headers: DataFrame
    payloads: DataFrame


def base32_of_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a SHA-1, from built-in functions: 40 bits at a time through base 32."""
    digits = F.sha1(payload)
    quarters = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*quarters), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _B32)


def _header(page_id: int | None, url: str | None, size: int, sha1: str, digest: bytes, stored: bool, refers_to: int | None, date: str) -> bytes:
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = uuid.UUID(bytes=hashlib.sha256(f"{page_id}\n{url}\n{stored}\n".encode() + digest).digest()[:16], version=5)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if stored else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if not stored:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if stored else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] not in (b"", b"\r\n\r\n"):
        raise ValueError("the block of a record has another length than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = http.decode()
    return fields, payload


def write_archive(
    pages: DataFrame, *, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_column: str = "page_id", url_column: str = "url", payload_column: str = "html"
) -> Archive:
    """Writes one record a row into tables in the shared folder."""
    shared.bound_batches(pages.sparkSession)
    payload = F.coalesce(pages[payload_column], F.lit("")).cast("binary")
    keyed = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].alias("url"), payload.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256)).alias("digest")
    slim = shared.written(keyed.select("page_id", "url", F.octet_length("payload").cast("long").alias("size"), base32_of_sha1(F.col("payload")).alias("sha1"), digest), "warc-pages")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"))
    met = shared.written(shared.lookup(slim, first, "digest"), "warc-first")
    big, least = F.col("size") >= least_bytes, F.col("page_id").eqNullSafe(F.col("first"))
    nth = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
    heads = met.where(big & least).withColumn("stored", nth == 1)
    rest = met.where(~(big & least)).withColumn("stored", ~big)
    records = heads.unionByName(rest).select("page_id", "digest", "stored", "url", "size", "sha1", F.when(~F.col("stored"), F.col("first")).alias("refers_to"))

    @blocks.tidy
    def head_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, digest_, stored, url, size, sha1, refers = (batch.column(k).to_pylist() for k in range(7))
            lines = [_header(p, u, n, s, d, k, r, date) for p, u, n, s, d, k, r in zip(page, url, size, sha1, digest_, stored, refers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lines, pa.binary())], names=["page_id", "digest", "stored", "header"])

    headers = shared.written(records.mapInArrow(head_rows, "page_id long, digest binary, stored boolean, header binary"), "warc-headers")

    @blocks.tidy
    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x.as_buffer()) for x in batch.column(1)], pa.binary())], names=["digest", "packed"])

    packed = keyed.select(digest, "payload").mapInArrow(pack_rows, "digest binary, packed binary")
    return Archive(headers, shared.written(packed.groupBy("digest").agg(F.first("packed").alias("packed")), "warc-payloads"))


def responses(archive: Archive) -> DataFrame:
    """Every response as (page_id, digest, record): the whole original record, joined back together."""

    @blocks.tidy
    def join_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            records = []
            for digest, header, packed in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                payload = unpack.decompress(packed) if packed else b""
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError("a stored payload does not match its digest")
                records.append(header + payload + b"\r\n\r\n")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(records, pa.binary())], names=["page_id", "digest", "record"])

    # Only payloads too small to be shared have several responses, so the broadcast part holds small ones.
    whole = shared.lookup(archive.headers.where("stored"), archive.payloads, "digest").select("page_id", "digest", "header", "packed")
    return whole.mapInArrow(join_rows, "page_id long, digest binary, record binary")


def read_archive(archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, from the archive's bytes."""

    @blocks.tidy
    def parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = [], []
            for record in batch.column(2).to_pylist():
                fields, payload = parse_record(record)
                found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if fields["WARC-Payload-Digest"] != f"sha1:{found}":
                    raise ValueError("a payload does not match the digest in its header")
                sizes.append(len(payload))
                sums.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums)], names=["page_id", "digest", "payload_bytes", "payload_digest"])

    @blocks.tidy
    def refer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refers, sums = [], []
            for header in batch.column(2).to_pylist():
                fields, _ = parse_record(header)
                refers.append(int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None)
                sums.append(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(refers, pa.int64()), pa.array(sums)], names=["page_id", "digest", "refers_to", "claimed"])

    found = shared.written(responses(archive).mapInArrow(parse_rows, "page_id long, digest binary, payload_bytes long, payload_digest string"), "warc-read")
    facts = found.groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    revisits = archive.headers.where(~F.col("stored")).select("page_id", "digest", "header").mapInArrow(refer_rows, "page_id long, digest binary, refers_to long, claimed string")
    resolved = shared.lookup(revisits, facts, "digest")
    agrees = F.when(F.col("claimed") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit names another payload than it refers to")).cast("string"))
    return found.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(
        resolved.select("page_id", "payload_bytes", agrees.alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    )
