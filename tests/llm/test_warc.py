from __future__ import annotations

import gzip
import hashlib

import pytest

from tessera.llm import warc
from tessera.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string"
LONG = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 100


@pytest.fixture
def archive(spark):
    return warc.Archive(fresh_path(spark, "payloads"), fresh_path(spark, "headers"))


def read_back(spark, archive):
    return warc.page_records(warc.parse_records(warc.as_members(warc.archive_records(spark, archive))), archive)


def test_round_trip(spark, archive):
    pages = [(1, "http://a/", LONG), (2, None, LONG), (5, "http://b/\r\nX: y", LONG), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "y" * 1000)]
    warc.write_archive(spark.createDataFrame(pages, SCHEMA), archive)
    rows = {r.page_id: r for r in read_back(spark, archive).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        revisit = html == LONG and i != 5
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (rows[i].record_type, rows[i].refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert rows[i].verified
    assert spark.read.parquet(archive.payloads).count() == len({h or "" for _, _, h in pages})


def test_damage_is_reported(spark, archive):
    warc.write_archive(spark.createDataFrame([(1, "u", LONG)], SCHEMA), archive)
    records = warc.archive_records(spark, archive).collect()
    harmed = [(bytes(r.record).replace(b"<p>", b"<q>", 1),) for r in records]
    parsed = warc.parse_records(spark.createDataFrame(harmed, "member binary"))
    assert [r.verified for r in warc.page_records(parsed, archive).collect()] == [False] and not parsed.first().block_ok


def test_parsed_records_are_the_bytes_written(spark, archive):
    pages = [(i, f"http://a/{i}", LONG if i % 3 else f"page {i} \u00fc") for i in range(30)]
    warc.write_archive(spark.createDataFrame(pages, SCHEMA), archive)
    end = b"\r\n\r\n"
    written = sorted(bytes(r.record) for r in warc.archive_records(spark, archive).collect())
    rows = warc.parse_records(warc.as_members(warc.archive_records(spark, archive))).collect()
    assert sorted(bytes(r.head) + bytes(r.http) + bytes(r.payload) + end for r in rows) == written and len(rows) == 30
    assert all(r.block_ok for r in rows)
    whole = {r.address: bytes(r.payload.encode()) for r in warc.read_archive(spark, archive).collect()}
    assert all(hashlib.sha256(p).hexdigest() == a for a, p in whole.items())
    stored = sum(len(bytes(r.payload)) for r in rows)
    assert stored == len(LONG.encode()) + sum(len(h.encode()) for _, _, h in pages if h != LONG)


FOREIGN = (
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 13\r\n\r\nsoftware: x\r\n\r\n\r\n",
    b"WARC/1.1\nwarc-type: response\nWARC-Target-URI: http://x/\n  folded/more\nContent-Type: application/http; msgtype=response\nContent-Length: 47\n\nHTTP/1.1 200 OK\r\nX: 1\r\n\r\n\x00\xff\r\n\r\nWARC/1.1 not one\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: request\r\nContent-Type: application/http; msgtype=request\r\nContent-Length: 16\r\n\r\nGET / HTTP/1.0\r\n\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
)


@pytest.mark.parametrize("form", ["plain", "members", "one each"])
def test_foreign_records(spark, form):
    values = {"plain": [b"".join(FOREIGN)], "members": [b"".join(map(gzip.compress, FOREIGN))], "one each": [gzip.compress(r) for r in FOREIGN]}[form]
    rows = warc.parse_records(spark.createDataFrame([(v,) for v in [*values, None, b""]], "member binary")).collect()
    found = {r.fields["warc-type"]: r for r in rows}
    assert set(found) == {"warcinfo", "response", "request", "metadata"} and len(rows) == 4
    assert bytes(found["response"].payload) == b"\x00\xff\r\n\r\nWARC/1.1 not one" and bytes(found["response"].http).startswith(b"HTTP/1.1 200")
    assert found["response"].fields["warc-target-uri"] == "http://x/ folded/more" and found["response"].block_ok is None
    assert bytes(found["warcinfo"].payload) == b"software: x\r\n" and bytes(found["request"].http) == b"GET / HTTP/1.0\r\n" and bytes(found["metadata"].payload) == b""


def test_broken_records_fail(spark):
    for raw in (FOREIGN[0][:-10], gzip.compress(FOREIGN[1])[:-12], b"no record"):
        with pytest.raises(Exception, match="WARC record|gzip member"):
            warc.parse_records(spark.createDataFrame([(raw,)], "member binary")).collect()


def test_query_equals_its_sql_with_revisits(spark, tmp_path):
    import duckdb

    from tessera.llm import queries

    pages = [(i, f"u{i}", ("long " * 300 + str(i % 4)) if i % 2 else ("short" if i % 3 else None)) for i in range(40)]
    spark.createDataFrame(pages, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    found = duckdb.connect()
    found.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cursor = found.execute(queries.ORACLE_SQL["op3_warc"])
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    got = sorted(tuple(r[n] for n in names) for r in queries.op3_warc(spark, str(tmp_path)).collect())
    assert got == want and sum(r[names.index("record_type")] == "revisit" for r in got) == 18


def test_exported_records_have_their_lengths(spark, archive, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", LONG), (2, "v", LONG), (3, "w", "s")], SCHEMA), archive)
    warc.export_warc(spark, archive, str(tmp_path / "out"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "out").glob("*.gz")))
    seen, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
        body = raw[end + 4 : end + 4 + int(head["Content-Length"])]
        seen.append((int(head["WARC-Page-Id"]), body.split(b"\r\n\r\n", 1)[1]))
        at = end + 4 + len(body)
        assert raw[at : at + 4] == b"\r\n\r\n"
        at += 4
    assert dict(seen) == {1: b"", 2: LONG.encode(), 3: b"s"}


def test_no_pages_and_repeated_rows(spark, archive):
    warc.write_archive(spark.createDataFrame([], SCHEMA), archive)
    assert read_back(spark, archive).count() == 0
    other = warc.Archive(archive.payloads + "2", archive.headers + "2")
    warc.write_archive(spark.createDataFrame([(1, "u", LONG), (1, "u", LONG), (None, "u", "z")], SCHEMA), other)
    assert sorted((r.page_id or 0, r.record_type) for r in read_back(spark, other).collect()) == [(0, "response"), (1, "response"), (1, "response")]
