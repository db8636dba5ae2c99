"""WARC archives: writing pages as transactions, reading archives back, assembling captures.

A page becomes three records: request, response (or revisit) and metadata; the other two name
the response in WARC-Concurrent-To.  Spark's text writer puts them into compressed files; the
two line breaks that end a record are its line separator, so the files are plain WARC 1.1 and
the writer's commit protocol covers lost executors.

A revisit has no payload.  It names the response that has it by WARC-Refers-To-Target-URI and
WARC-Refers-To-Date, and by page in the added field WARC-Refers-To-Page, since one address can
be fetched more than once.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ---- fixed values: the format ----
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ---- end of fixed values ----
MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
#: Records in a file at most; a file is read whole by one task.
RECORDS_PER_FILE = 3000
#: Bytes of payload that a reading task holds beside the file itself.
READ_BYTES = 8 << 20


def captures(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, bytes, digest, refers_to`` for every row of ``pages``; the
    payload of a row that refers to another is null.

    Of rows with equal payloads of at least ``min_revisit_bytes`` the one with the largest
    page_id is the response, also several rows that share this id; the others refer to it.  A
    row without id refers to the response too; where no row has an id all are responses.
    """
    rows = pages.select(
        F.col("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")
    )
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1("payload"))
    shared = (
        rows.filter(F.col("bytes") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("original"), F.max_by("url", "page_id").alias("original_url"), F.count("*").alias("n"))
        .filter("n > 1 and original is not null")
        .drop("n")
    )
    refers = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    joined = (
        _packed(rows)
        .join(shared, "digest", "left")
        .withColumn("refers_to", F.when(refers, F.col("original")))
        .withColumn("original_url", F.when(refers, F.col("original_url")))
        .withColumn("payload", F.when(~refers, F.col("payload")))
        .drop("original")
    )
    return _unpacked(joined)


def _mapped(df: DataFrame, function) -> DataFrame:
    """``df`` with the bytes of ``payload`` replaced by ``function()`` of them; null stays null."""
    rows = df.withColumn("payload", F.col("payload").cast("binary"))

    def work(batches):
        change = function()
        for batch in batches:
            at = batch.schema.get_field_index("payload")
            values = [None if v is None else change(v) for v in batch.column("payload").to_pylist()]
            yield batch.set_column(at, "payload", pa.array(values, pa.binary()))

    return rows.mapInArrow(work, rows.schema)


def _packed(rows: DataFrame) -> DataFrame:
    """Payloads compressed, to be shuffled."""

    def packer():
        import zstandard

        return zstandard.ZstdCompressor(level=3).compress

    return _mapped(rows, packer)


def _unpacked(rows: DataFrame) -> DataFrame:
    def unpacker():
        import zstandard

        return zstandard.ZstdDecompressor().decompress

    return _mapped(rows, unpacker).withColumn("payload", F.col("payload").cast("string"))


def _safe(column: str) -> Column:
    """A header value: no white space or control characters, which could end the header."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\x00-\x20\x7F]", "%20")


def _record(kind: Column, identity: str, content_type: str, block: Column, *fields: tuple[str, Column]) -> Column:
    lines = [
        F.concat(F.lit(f"{VERSION}\r\nWARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), F.col(identity), F.lit(">")),
        *(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)) for name, value in fields),
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, date: str = DATE, records_per_file: int = RECORDS_PER_FILE) -> None:
    """The rows of ``pages`` (``page_id, url, html``) as gzip-compressed WARC files below ``path``.

    A null html is an empty payload, a null url an empty address.  Other columns are not kept.
    """
    rows = captures(pages).withColumns({name: F.expr("uuid()") for name in ("request_id", "response_id", "metadata_id")})
    uri, stamp = _safe("url"), F.lit(date)
    concurrent = F.concat(F.lit("<urn:uuid:"), F.col("response_id"), F.lit(">"))
    host = F.regexp_extract(uri, r"^[A-Za-z]+://([^/]*)", 1)
    target = F.regexp_replace(uri, r"^[A-Za-z]+://[^/]*", "")
    asked = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    revisit = F.col("refers_to").isNotNull()
    known = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    common = (("WARC-Date", stamp), ("WARC-Target-URI", uri))
    records = F.array(
        _record(F.lit("request"), "request_id", "application/http;msgtype=request", asked, *common, ("WARC-Concurrent-To", concurrent)),
        _record(
            F.when(revisit, "revisit").otherwise("response"),
            "response_id",
            "application/http;msgtype=response",
            F.concat(head, F.coalesce("payload", F.lit(""))),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("WARC-Refers-To-Target-URI", F.when(revisit, _safe("original_url"))),
            ("WARC-Refers-To-Date", F.when(revisit, stamp)),
            ("WARC-Refers-To-Page", F.col("refers_to").cast("string")),
        ),
        _record(F.lit("metadata"), "metadata_id", "application/warc-fields", known, *common, ("WARC-Concurrent-To", concurrent)),
    )
    written = rows.select(F.explode(records).alias("value")).write.option("lineSep", END)
    written.option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(stream):
    """``(headers, block)`` of each record of an open archive; header names in lower case."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


RECORDS = pa.schema(
    [
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("concurrent_to", pa.string()),
        ("uri", pa.string()),
        ("date", pa.string()),
        ("refers_to", pa.string()),
        ("head", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)
RECORD_COLUMNS = (
    "record_type string, record_id string, concurrent_to string, uri string, date string, refers_to string, "
    "head string, payload binary, payload_bytes bigint, payload_digest string"
)


def _row(headers: dict[str, str], block: bytes) -> dict:
    kind = headers.get("warc-type", "")
    row = {
        "record_type": kind,
        "record_id": headers.get("warc-record-id"),
        "concurrent_to": headers.get("warc-concurrent-to"),
        "uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"),
        "refers_to": headers.get("warc-refers-to-page"),
    }
    if kind in ("request", "response", "revisit"):
        head, _, payload = block.partition(END.encode())
        row["head"] = head.decode("utf-8", "replace")
        if kind == "response":
            row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        elif kind == "revisit":
            sizes = [v for n, _, v in (x.partition(":") for x in row["head"].split("\r\n")) if n.lower() == "content-length"]
            row["payload_bytes"] = int(sizes[0]) if sizes else None
            row["payload_digest"] = headers.get("warc-payload-digest", "").rpartition(":")[2]
    else:
        row["head"] = block.decode("utf-8", "replace")
    return row


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, gzip-compressed or not, with their payloads.

    A response's length and digest are taken from the payload that was read, a revisit's from
    its headers.
    """

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                stream = io.BytesIO(data)
                if data[:2] == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
                rows, held = [], 0
                for headers, block in parse(stream):
                    rows.append(_row(headers, block))
                    held += len(block)
                    if held >= READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0")
    return files.select("content").mapInArrow(read, RECORD_COLUMNS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``page_id, request, response, metadata``.

    Request and metadata join the response or revisit that their WARC-Concurrent-To names.  A
    record without partner still gives a row, with nulls for what is missing; other kinds of
    records (warcinfo, conversion) are passed over.
    """
    answer = F.col("record_type").isin("response", "revisit")
    keyed = records.filter(F.col("record_type").isin("request", "response", "revisit", "metadata")).withColumn(
        "capture", F.when(answer, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    )
    asked = F.when(F.col("record_type") == "request", F.struct("record_id", "uri", "date", "head"))
    answered = F.when(
        answer,
        F.struct("record_type", "record_id", "uri", "date", "refers_to", "head", "payload", "payload_bytes", "payload_digest"),
    )
    noted = F.when(F.col("record_type") == "metadata", F.struct("record_id", "date", F.col("head").alias("fields")))
    rows = keyed.groupBy("capture").agg(
        F.first(asked, True).alias("request"), F.first(answered, True).alias("response"), F.first(noted, True).alias("metadata")
    )
    page = F.regexp_extract("metadata.fields", r"(?:^|\n)page_id: (-?[0-9]+)", 1)
    return rows.select(F.when(page != "", page.cast("bigint")).alias("page_id"), "request", "response", "metadata")
