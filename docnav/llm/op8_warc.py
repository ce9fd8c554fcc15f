"""WARC: writing archives, reading them back, and assembling transactions.

Writing: each page gives a request, a response (or revisit) and a metadata record. Request and metadata name the response by
WARC-Concurrent-To. Of pages with equal payloads of at least ``least`` bytes the one with the largest id is the response
and the others are revisits of it, without payload, which name it by WARC-Refers-To, its URI and date. An archive is a warcinfo record
and then records, each a gzip member of its own, up to FILE_BYTES of them before compression. Archives go out as rows of Spark's text
writer, so they land in any store that Spark writes, with its commit protocol: a row is a whole file, and the line separator that
the writer adds is the NUL byte that an (empty) last gzip member ends with.

Reading: files are cut member by member and record by record by Content-Length, never by searching, so payloads may hold anything. A
file is parsed once. Transactions are assembled by joining the three kinds of record on the identifiers; the result is one
row per capture with nested request and metadata.

Defined results: null html is an empty payload; equal pages with the same (largest) id are all responses; a null page_id
counts as smaller than any, and rows that have only null ids are all responses; repeated rows share their identifiers and
repeat; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docnav.llm.common import Scratch, bounded_batches, load

END = b"\r\n\r\n"
#: Bytes of an archive before compression; a page larger than that has an archive of its own.
FILE_BYTES, LEVEL, _CHUNK = 8 << 20, 4, 1 << 14
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(kind: str, headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("Content-Length", str(len(body)))]
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode("utf-8", "surrogatepass") + body + END


def clean_uri(url: str) -> str:
    return "".join(c for c in url if c not in "\r\n")


def record_id(kind: str, page_id: int | None, uri: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page_id} {payload_digest} {uri}')}>"


def transaction(page_id: int | None, url: str, html: str, origin: tuple[int, str] | None) -> list[bytes]:
    """The records of one page; ``origin`` is the (page_id, url) of the page that it revisits."""
    payload = html.encode("utf-8", "surrogatepass")
    own, uri = digest(payload), clean_uri(url)
    name = [record_id(kind, page_id, uri, own) for kind in ("response", "request", "metadata")]
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Record-ID", name[0]), *common, ("WARC-Payload-Digest", f"sha1:{own}"), ("Content-Type", "application/http; msgtype=response")]
    fields = f"page-id: {'' if page_id is None else page_id}\r\npayload-bytes: {len(payload)}\r\n"
    if origin:
        first, first_uri = origin[0], clean_uri(origin[1])
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id("response", first, first_uri, own)), ("WARC-Refers-To-Target-URI", first_uri), ("WARC-Refers-To-Date", DATE)]
        fields += f"refers-to-page: {first}\r\n"
    path = uri.split("/", 3)[3] if uri.count("/") > 2 else ""
    host = uri.split("/", 3)[2] if uri.count("/") > 1 else ""
    return [
        record("request", [("WARC-Record-ID", name[1]), *common, ("WARC-Concurrent-To", name[0]), ("Content-Type", "application/http; msgtype=request")], f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode("utf-8", "surrogatepass")),
        record("revisit" if origin else "response", head, http if origin else http + payload),
        record("metadata", [("WARC-Record-ID", name[2]), *common, ("WARC-Concurrent-To", name[0]), ("Content-Type", "application/warc-fields")], fields.encode()),
    ]


def _archives(file_bytes: int):
    """Whole archives, each without the NUL byte at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = member(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'docnav')}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"software: docnav\r\nformat: WARC File Format 1.0\r\n"))
        last = member(b"")[:-1]
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join([info, *held, last])], pa.binary())], ["value"])

        for batch in batches:
            for page_id, url, html, origin in zip(*(batch.column(c) for c in ("page_id", "url", "html", "origin")), strict=True):
                first = origin.as_py()
                out = transaction(page_id.as_py(), url.as_py(), html.as_py(), (first["page_id"], first["url"]) if first else None)
                grown = sum(map(len, out))
                if held and size + grown > file_bytes:
                    yield archive()
                    held, size = [], 0
                held += [member(r) for r in out]
                size += grown
        if held:
            yield archive()

    return run


def write_archives(pages: DataFrame, path: str, least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """WARC files of ``pages(page_id, url, html)`` below ``path``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text("url").alias("url"), text("html").alias("html"))
    rows = rows.withColumn("sum", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    # one small row for each payload that comes more than once; the join can split a payload that is very common
    firsts = rows.where(F.col("bytes") >= least).groupBy("sum").agg(F.max(F.struct("page_id", "url")).alias("origin"), F.count("*").alias("n")).where("n > 1 and origin.page_id is not null").select("sum", "origin")
    rows = rows.join(firsts, "sum", "left").withColumn("origin", F.when(~F.col("page_id").eqNullSafe(F.col("origin.page_id")), F.col("origin")))
    made = rows.select("page_id", "url", "html", "origin").mapInArrow(_archives(file_bytes), "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").option("compression", "none").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive of gzip members, of which one is unpacked at a time."""
    place = 0
    while place < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not (chunk := data[place : place + _CHUNK]):
                raise ValueError("an archive ends within a member")
            parts.append(z.decompress(chunk))
            place += len(chunk) - len(z.unused_data)
        plain, at = b"".join(parts), 0
        while at < len(plain):
            end = plain.index(END, at)
            lines = plain[at:end].decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record at byte {at} of a member")
            head = dict(x.split(": ", 1) for x in lines[1:])
            size = int(head["Content-Length"])
            yield head, plain[end + 4 : end + 4 + size]
            at = end + 4 + size + len(END)


RECORDS = pa.schema(
    [
        ("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()),
        ("http", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("fields", pa.string()),
    ]
)
_SPARK = "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, http string, payload binary, payload_bytes long, payload_sha1 string, fields string"


def _row(head: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind = head["WARC-Type"]
    http, _, payload = block.partition(END) if kind not in ("metadata", "warcinfo") else (b"", b"", b"")
    told, is_response = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, kind == "response"
    own = digest(payload) if is_response else None
    if is_response and own != told:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
    return {
        "kind": kind, "record_id": head["WARC-Record-ID"], "concurrent_to": head.get("WARC-Concurrent-To"), "refers_to": head.get("WARC-Refers-To"), "target_uri": head.get("WARC-Target-URI"), "date": head.get("WARC-Date"), "payload_digest": told,
        "http": http.decode("utf-8", "replace"), "payload": payload if payloads and is_response else None, "payload_bytes": len(payload) if is_response else None, "payload_sha1": own, "fields": block.decode() if kind == "metadata" else None,
    }


def _parsed(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for head, block in parse(content.as_py()):
                    rows.append(_row(head, block, payloads))
                    size += len(block) if payloads else 500
                    if size > FILE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, RECORDS)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORDS)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record; a file is parsed in one piece and checked against its digests."""
    bounded_batches(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.read.schema(schema).format("binaryFile").load(path).select("content").mapInArrow(_parsed(payloads), _SPARK)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: the response or revisit, with its request and metadata nested. Records that share an identifier are
    copies of each other: they are joined once and repeated after that."""
    once = lambda df, *columns: df.groupBy("record_id").agg(F.first(F.struct(*columns)).alias("x"), F.count("*").alias("copies")).select("record_id", "x.*", "copies")
    main = once(records.where(F.col("kind").isin("response", "revisit")), *[c for c in records.columns if c not in ("record_id", "concurrent_to", "fields")])
    request = once(records.where("kind = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("record_id"), "http", "date").alias("request")), "request").drop("copies")
    about = records.where("kind = 'metadata'")
    field = lambda name: F.nullif(F.regexp_extract("fields", f"(?m)^{name}: ?([^\r\n]*)", 1), F.lit("")).cast("long")
    metadata = F.struct(F.col("record_id").alias("record_id"), field("page-id").alias("page_id"), field("payload-bytes").alias("payload_bytes"), field("refers-to-page").alias("refers_to_page")).alias("metadata")
    about = once(about.select(F.col("concurrent_to").alias("record_id"), metadata), "metadata").drop("copies")
    joined = main.join(request, "record_id", "left").join(about, "record_id", "left")
    return joined.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = f"{scratch.root}/warc"
    write_archives(load(spark, sf_dir, "pages"), path)
    # the three kinds of record are read from one table, so an archive is parsed once
    captures = assemble(scratch.keep(read_archives(spark, path, payloads=False)))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("payload_bytes", F.col("metadata.payload_bytes")).alias("payload_bytes"), F.coalesce("payload_sha1", "payload_digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.when(F.col("kind") == "revisit", F.col("metadata.refers_to_page")).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS origin FROM p),
b AS (SELECT *, CAST(CAST(unhex(hex) AS BIT) AS VARCHAR) AS bits FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = origin OR origin IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = origin OR origin IS NULL THEN NULL ELSE origin END AS refers_to
FROM b
"""
