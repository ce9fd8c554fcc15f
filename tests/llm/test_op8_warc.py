import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from docnav.llm import op8_warc as op

SCHEMA = "page_id long, url string, html string, kind string, record_id string, number int"
HTML = ["<p>é 𝒜</p>", "", None, "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nb", "same", "same", "x" * 200_000, "\x00\x01\r\n", "same", " "]


def brute(rows, least=0):
    top = {}
    for i, _, h, *_ in rows:
        top.setdefault(h or "", []).append(i)
    out = []
    for i, _, h, *_ in rows:
        data, ids = (h or "").encode(), [x for x in top[h or ""] if x is not None]
        first = max(ids) if ids and len(top[h or ""]) > 1 and len(data) >= least else i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


def read(spark, path):
    c = op.assemble(op.read_archives(spark, path))
    return c.select(F.col("metadata.page_id"), F.coalesce("payload_bytes", "metadata.payload_bytes"), F.coalesce("payload_sha1", "payload_digest"), "kind", "metadata.refers_to_page")


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_equals_brute_force(spark, tmp_path, least):
    rows = [(i, f"https://h.example/{i}\n", h, "k", "r", 1) for i, h in enumerate(HTML)] + [(None, None, "same", None, None, None), (None, None, "alone", None, None, None), (8, "u", "same", "k", "r", 1), (3, "u", "other", "k", "r", 1)]
    path = f"file://{tmp_path}/w"
    op.write_archives(spark.createDataFrame(rows, SCHEMA), path, least, 50_000)
    assert sorted((tuple(r) for r in read(spark, path).collect()), key=str) == brute(rows, least)
    payloads = [r.payload for r in op.assemble(op.read_archives(spark, path)).where("kind = 'response'").collect()]
    kept = [(r[2] or "").encode() for r, b in zip(sorted(rows, key=lambda r: str((r[0], len((r[2] or "").encode()), op.digest((r[2] or "").encode())))), brute(rows, least), strict=True) if b[3] == "response"]
    assert sorted(map(bytes, payloads)) == sorted(kept)


def test_each_capture_has_its_own_request_and_metadata(spark, tmp_path):
    rows = [(i % 3, "https://h.example/a/b", "x", "k", "r", 1) for i in range(30)]
    path = f"file://{tmp_path}/w"
    op.write_archives(spark.createDataFrame(rows, SCHEMA), path)
    got = op.assemble(op.read_archives(spark, path))
    assert got.count() == 30 and got.where("request is null or metadata is null").count() == 0
    # repeated rows share their identifiers
    assert got.select("request.record_id").distinct().count() == 3 and got.where("kind = 'response'").count() == 10


def test_records_are_plain_warc():
    data = b"".join(map(op.member, op.transaction(1, "https://h.example/p", "body", None)))
    kinds = [(h["WARC-Type"], b) for h, b in op.parse(data)]
    assert [k for k, _ in kinds] == ["request", "response", "metadata"] and kinds[1][1].endswith(b"\r\n\r\nbody")


def test_files_begin_with_warcinfo_and_have_a_member_for_each_record(spark, tmp_path):
    import gzip
    import zlib

    path = f"{tmp_path}/w"
    op.write_archives(spark.createDataFrame([(i, "https://h.example/a", "same" if i % 2 else f"own {i}", "k", "r", 1) for i in range(40)], SCHEMA), f"file://{path}", file_bytes=3000)
    files = [f.read_bytes() for f in tmp_path.joinpath("w").glob("part-*")]
    files = [f for f in files if f]
    assert len(files) > 4 and sum(gzip.decompress(f).count(b"WARC-Type: re") for f in files) == 80
    for data in files:
        assert next(op.parse(data))[0]["WARC-Type"] == "warcinfo"
        records, members, rest = len(list(op.parse(data))), 0, data
        while rest:
            z = zlib.decompressobj(31)
            members, rest = members + bool(z.decompress(rest)), z.unused_data
        assert members == records
    revisit = [h for f in files for h, _ in op.parse(f) if h["WARC-Type"] == "revisit"]
    response = [h["WARC-Record-ID"] for f in files for h, _ in op.parse(f) if h["WARC-Type"] == "response"]
    assert len(revisit) == 19 and all(h["WARC-Refers-To"] in response for h in revisit)


def test_large_ids_beside_nulls_stay_whole(spark, tmp_path):
    big = 2**53 + 1
    rows = [(big, "u", "same", "k", "r", 1), (7, "u", "same", "k", "r", 1), (None, "u", "x", "k", "r", 1)]
    path = f"file://{tmp_path}/w"
    op.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    assert sorted((tuple(r) for r in read(spark, path).collect()), key=str) == brute(rows)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    op.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert read(spark, path).count() == 0
