"""A content-addressed WARC archive.

``archive`` writes two tables to the shared folder (or any path): payloads, each distinct payload once (gzip) under its
SHA-256, and headers, the exact header text of each record with the key of its payload. ``restore`` joins them again,
checks every payload against its key, and gives the original records byte for byte; ``read_records`` reads the fields from
those bytes. Of records with equal payloads the one with the largest page_id is the response, the others are revisits of
it. Payloads shorter than ``LEAST`` bytes are all responses.

Copies: a group of equal payloads is reduced to one before the shuffle of payloads; headers are narrow, and the join of
headers with payloads is one that adaptive execution can split. Defined results: a null html is an empty payload; rows
that repeat the largest page_id of their group are each the response; a null page_id is a revisit unless its whole group
has none; a null url leaves its header out. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import shared_dir, small_batches, text_chunks

LEAST = 0
DATE = "1970-01-01T00:00:00Z"
_CRLF = "\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digested(kind: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "html"):
                data = [(h or "").encode() for h in part.column("html").to_pylist()]
                columns = [part.column("page_id"), pa.array([hashlib.sha256(d).digest() for d in data], pa.binary()), pa.array([sha1_base32(d) for d in data], pa.string()), pa.array(map(len, data), pa.int64())]
                columns.append(pa.array([gzip.compress(d, 6, mtime=0) for d in data], pa.binary()) if with_payload else part.column("url"))
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "key", "sha1", "size", "payload" if with_payload else "url"])

    return run, f"page_id {kind}, key binary, sha1 string, size long, " + ("payload binary" if with_payload else "url string")


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    clean = F.regexp_replace(value.cast("string"), "[\\r\\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(_CRLF)), F.lit(""))


def archive(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> None:
    """Write the records of ``pages`` (page_id, url, html) under ``path``."""
    pages = small_batches(pages.select("page_id", "url", "html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    run, fields = _digested(kind, True)
    stored = pages.mapInArrow(run, fields).groupBy("key").agg(F.max("page_id").alias("response_id"), F.first("size").alias("size"), F.first("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")

    run, fields = _digested(kind, False)
    first = pages.sparkSession.read.parquet(f"{path}/payloads").select("key", "response_id")
    rows = pages.mapInArrow(run, fields).join(first, "key")
    revisit = ~F.col("page_id").eqNullSafe(F.col("response_id")) & (F.col("size") >= least)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(_CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    header = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _field("WARC-Record-ID", _record_id(F.col("page_id"))), _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), _field("WARC-Page-ID", F.col("page_id")),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _field("WARC-Refers-To", _record_id(F.col("response_id"))), _field("WARC-Refers-To-Page-ID", F.col("response_id")))).otherwise(""),
        _field("Content-Type", F.lit("application/http; msgtype=response")), _field("Content-Length", length), F.lit(_CRLF), http,
    )
    rows.select("page_id", "key", revisit.alias("revisit"), header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """record (bytes of the whole WARC record) and payload (of the record, or of the one it revisits) of every header."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads").select("key", "size", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "size", 4 << 20):  # of the expanded payloads
                records, whole = [], []
                for key, header, revisit, data in zip(*(part.column(c).to_pylist() for c in ("key", "header", "revisit", "payload")), strict=True):
                    payload = gzip.decompress(data)
                    if hashlib.sha256(payload).digest() != key:
                        raise ValueError(f"a stored payload does not have its digest {key.hex()}")
                    records.append(header.encode() + (b"" if revisit else payload) + b"\r\n\r\n")
                    whole.append(payload)
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()), pa.array(whole, pa.binary())], names=["record", "payload"])

    return headers.join(payloads, "key").select("key", "header", "revisit", "size", "payload").mapInArrow(run, "record binary, payload binary")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.match(r"WARC/\d", lines[0]):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def read_records(restored: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to, read from restored records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for record, payload in zip(batch.column("record").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                fields, block = parse(record)
                if fields["warc-type"] == "response" and block.partition(b"\r\n\r\n")[2] != payload:
                    raise ValueError(f"the block of {fields['warc-record-id']} is not its payload")
                digest = sha1_base32(payload)
                if fields["warc-payload-digest"] != f"sha1:{digest}":
                    raise ValueError(f"{fields['warc-record-id']} does not have its payload digest")
                rows.append((fields.get("warc-page-id"), fields.get("warc-target-uri"), len(payload), digest, fields["warc-type"], fields.get("warc-refers-to-page-id")))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return restored.mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archive back."""
    import uuid

    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archive(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_records(restore(pages.sparkSession, path)).withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def export(restored: DataFrame, path: str) -> None:
    """Write restored records as .warc text files: each record ends with the two line ends that WARC asks for."""
    restored.select(F.expr("substring(record, 1, length(record) - 4)").cast("string")).write.option("lineSep", "\r\n\r\n").text(path)


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """fields (map) and block of every record of .warc and .warc.gz files; a file is read in one task, as archives are about 1 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                at = 0
                while (start := data.find(b"WARC/", at)) >= 0:
                    head = data.index(b"\r\n\r\n", start) + 4
                    size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", data[start:head])[1])
                    fields, block = parse(data[start : head + size])
                    at = head + size
                    yield pa.RecordBatch.from_arrays([pa.array([list(fields.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], names=["fields", "block"])

    return spark.read.format("binaryFile").load(glob).select("content").mapInArrow(run, "fields map<string,string>, block binary")
