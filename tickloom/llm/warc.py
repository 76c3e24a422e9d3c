"""WARC archives: write captures, read records back, assemble transactions.

Each page becomes a response (or revisit) record, a request record and a metadata record; the last two name the
first by WARC-Concurrent-To. Records are separate gzip members. A writer task names its files anew on every
attempt and reports them in its result, so files of a lost or repeated attempt are never read. Reading yields
flat records; assembly groups them by the identifier they are concurrent to and emits one nested row a capture.

Payloads that occur more than once are stored with the smallest page_id and revisited by the others.

Defined results: a null html is an empty payload (all empty payloads are equal); a null url leaves the target URI
out; a null page_id stays null, and is the response only where all pages of its payload have none; repeated rows
are captured each, and all rows of the least page_id of a payload are responses; a very
long payload is one record, compressed and read as a stream; other columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import fresh_path, materialize, small_batches, table

#: Uncompressed bytes after which a writer starts another file.
FILE_BYTES = 64 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"
RECORDS = (
    "record_id string, concurrent_to string, record_type string, target_uri string, http_bytes long, "
    "payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + CRLF + CRLF) + z.flush()


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(url.split()) or None


def capture(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """The three records of one page."""
    own, digest = f"<urn:uuid:{uuid.uuid4()}>", base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = [("WARC-Target-URI", u)] if (u := _clean(url)) else []
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kept = [*uri, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        kept.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    main = _record("revisit" if revisit else "response", own, kept, http if revisit else http + payload)
    beside = [*uri, ("WARC-Concurrent-To", own)]
    asked = b"GET / HTTP/1.1\r\n\r\n"
    request = _record("request", f"<urn:uuid:{uuid.uuid4()}>", [*beside, ("Content-Type", "application/http; msgtype=request")], asked)
    said = {"page-id": page_id, "refers-to-page": first if revisit else None}
    fields = "".join(f"{k}: {v}\r\n" for k, v in said.items() if v is not None).encode()
    meta = _record("metadata", f"<urn:uuid:{uuid.uuid4()}>", [*beside, ("Content-Type", "application/warc-fields")], fields)
    return main + request + meta


def write_warc(pages: DataFrame, path: str) -> DataFrame:
    """Write pages (page_id, url, html) below path; the files written, one row each: file, captures."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    copies = pages.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = pages.join(copies, "sha", "left").select(
        "page_id", "url", "html", "first", F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)).alias("revisit")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size, n, at = None, 0, 0, None
        for b in batches:
            for page_id, url, html, first, revisit in zip(b["page_id"], b["url"], b["html"], b["first"], b["revisit"]):
                if out is None:
                    store, root = fs.FileSystem.from_uri(path)
                    store.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, n, at = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0, f"{path}/{name}"
                whole = capture(*(None if pd.isna(x) else int(x) if x is page_id else x for x in (page_id, url)), html.encode("utf-8", "replace"), None if pd.isna(first) else int(first), bool(revisit))
                out.write(whole)
                size, n = size + len(html), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    yield pd.DataFrame({"file": [at], "captures": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [at], "captures": [n]})

    return materialize(rows.mapInPandas(write, "file string, captures long"), "warc-files")


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed records of a file of gzip members."""
    z, parts, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
        if not data:
            data = stream.read(chunk)


def parse(record: bytes, with_payload: bool) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block, kind = rest[: int(h["Content-Length"])], h["WARC-Type"]
    http = size = digest = body = None
    fields: dict[str, str] = {}
    if kind in ("response", "revisit"):
        top, _, body = block.partition(b"\r\n\r\n")
        http = len(top) + 4
        fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
        if kind == "response":
            size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        else:
            size, digest, body = int(fields["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), None
    elif kind == "metadata":
        fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if line)
    return h["WARC-Record-ID"], h.get("WARC-Concurrent-To"), kind, h.get("WARC-Target-URI"), http, size, digest, fields, body if with_payload else None


def read_warc(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the listed files (column file), as RECORDS; a file is streamed, never held whole."""
    small_batches(files.sparkSession)
    names = RECORDS.replace("map<string,string>", "map").split(", ")
    columns = [x.split()[0] for x in names]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["file"]:
                store, at = fs.FileSystem.from_uri(file)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as s:
                    for record in _members(s):
                        rows.append(parse(record, with_payload))
                        held += len(record)
                        if len(rows) >= 4096 or held > FILE_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.select("file").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file").mapInPandas(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: the response or revisit with the request and metadata concurrent to it."""
    whole = F.struct("record_id", "record_type", "target_uri", "http_bytes", "payload_bytes", "payload_digest", "payload")
    of = lambda kind, x: F.first(F.when(F.col("record_type") == kind, x), ignorenulls=True)
    return (
        records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
        .groupBy("capture_id")
        .agg(
            F.first(F.when(F.col("record_type").isin("response", "revisit"), whole), ignorenulls=True).alias("response"),
            of("request", F.struct("record_id", "target_uri")).alias("request"),
            of("metadata", F.struct("record_id", "fields")).alias("metadata"),
        )
        .filter("response IS NOT NULL")
    )


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    field = lambda k: F.col("metadata.fields")[k].cast("long")
    return assemble(read_warc(files)).select(
        field("page-id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        field("refers-to-page").alias("refers_to"),
    )


#: The same rows from the table itself: base 32 digits are cut out of the digest's 160 bits.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
        CAST(4 * (strpos('0123456789abcdef', substr(hex, CAST(i AS INTEGER), 1)) - 1) + 1 AS INTEGER), 4)), '') AS bits,
        min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(i * 5 + j + 1 AS INTEGER), 1) AS INTEGER) * CAST(power(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
