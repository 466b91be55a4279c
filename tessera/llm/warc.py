"""Content-addressed WARC archive: payload bytes once by verified digest, exact record headers beside them.

Original records are rebuilt from both by a join, written as gzip members as they stand in WARC
files, and read back by a parser that takes records of any origin.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import plain_text

CRLF = "\r\n"

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Paths of an archive's two tables: ``payloads(address, packed, response_id, n_records)``, ``headers(address, revisit, header)``."""

    payloads: str
    headers: str


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line; null values leave it out and line breaks in values become blanks."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _packed(raw: Column) -> Column:
    """Gzip of each value; equal bytes give equal bytes."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda r: gzip.compress(r, compresslevel=6, mtime=0))

    return run(raw)


def _unpacked(raw: Column) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(gzip.decompress)

    return run(raw)


def _http(size: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _field("Content-Type", F.lit("text/html; charset=UTF-8")), _field("Content-Length", size), F.lit(CRLF))


def write_archive(pages: DataFrame, archive: Archive, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one record per page into the archive's two tables.

    A payload's address is its SHA-256. Payloads are packed by gzip where they are read, so that all
    moves are of packed bytes, and grouped by address *and* bytes, which folds copies on the map side and verifies the digest: two payloads of one address would
    both be stored and reading would report them. Of records with equal payloads of at least
    ``least_bytes`` bytes, the one with the largest id is the response and the others revisit
    it; smaller ones are all responses. A null payload is empty; a null URL leaves the header's
    line out; null ids are smaller than any other. Rows that repeat id and payload are alike,
    so those of the largest id are all responses. No pages give two empty tables.
    """
    payload = plain_text(payload_col)
    (
        pages.select(F.col(id_col).alias("_id"), F.sha2(payload, 256).alias("address"), _packed(payload.cast("binary")).alias("packed"))
        .groupBy("address", "packed")
        .agg(F.max("_id").alias("response_id"), F.count(F.lit(1)).alias("n_records"))
        .write.option("compression", "zstd")
        .parquet(archive.payloads)
    )
    # Digests travel as bytes, and the aggregate's partitions are the join's.
    stored = pages.sparkSession.read.parquet(archive.payloads).groupBy(F.unhex("address").alias("_at")).agg(F.max("response_id").alias("response_id"))
    records = pages.select(
        F.col(id_col).alias("_id"),
        F.col(url_col).cast("string").alias("_url"),
        payload.alias("_payload"),
        F.unhex(F.sha2(payload, 256)).alias("_at"),
        F.unhex(F.sha1(payload.cast("binary"))).alias("_sha1"),
        F.octet_length(payload).cast("long").alias("_bytes"),
    ).withColumn("_http", _http(F.col("_bytes")))
    records = records.withColumn("_block_sha1", F.unhex(F.sha1(F.concat(F.col("_http").cast("binary"), F.col("_payload").cast("binary"))))).drop("_payload", "_http")
    joined = records.join(stored, "_at").withColumn("address", F.lower(F.hex("_at")))
    revisit = (F.col("_bytes") >= least_bytes) & ~F.col("_id").eqNullSafe(F.col("response_id"))
    http = _http(F.col("_bytes"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("_bytes"))
    header = F.concat(
        F.lit(VERSION + CRLF),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(F.lit("record"), F.col("_id").cast("string"), F.col("address"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("_url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.lower(F.hex("_sha1")))),
        _field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.sha1(http.cast("binary"))).otherwise(F.lower(F.hex("_block_sha1"))))),
        _field("WARC-Payload-Address", F.concat(F.lit("sha256:"), F.col("address"))),
        _field("WARC-Page-Id", F.col("_id")),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit(REVISIT_PROFILE)), _field("WARC-Refers-To", _urn(F.lit("record"), F.col("response_id").cast("string"), F.col("address"))), _field("WARC-Refers-To-Page-Id", F.col("response_id")))).otherwise(""),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block),
        F.lit(CRLF),
        http,
    )
    joined.select("address", revisit.alias("revisit"), header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(archive.headers)


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Original records from the two tables: ``address, header, payload`` (full payload, also for revisits)."""
    payloads = spark.read.parquet(archive.payloads).select("address", "packed")
    return spark.read.parquet(archive.headers).join(payloads, "address").select("address", "header", _unpacked(F.col("packed")).cast("string").alias("payload"))


def archive_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """``record``: the original records' bytes, from headers and payloads; records that revisit meet no payload, so a hot one is moved once for each response."""
    headers = spark.read.parquet(archive.headers)
    payloads = spark.read.parquet(archive.payloads).select("address", "packed")
    end = F.lit(CRLF + CRLF).cast("binary")
    whole = headers.where("NOT revisit").join(payloads, "address").select(F.concat(F.col("header"), _unpacked(F.col("packed")), end).alias("record"))
    return whole.union(headers.where("revisit").select(F.concat("header", end).alias("record")))


def as_members(records: DataFrame) -> DataFrame:
    """``member``: each record as a gzip member; members one after the other are a WARC file."""

    return records.select(_packed(F.col("record")).alias("member"))


#: Bytes that are unpacked at once, so that a long run of members costs time linear in it.
_CHUNK = 1 << 16


def _plain(raw: bytes) -> Iterator[bytes]:
    """What a run of gzip members holds, member by member, or the bytes themselves if they aren't compressed."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    at = 0
    while at < len(raw):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(raw):
                raise ValueError("a gzip member breaks off")
            parts.append(member.decompress(raw[at : at + _CHUNK]))
            at = min(at + _CHUNK, len(raw)) - len(member.unused_data)
        yield b"".join(parts)


def split_records(raw: bytes) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """``(head, fields, block)`` of each record: its exact header bytes, the first value of each field by lower-case name, its block.

    Fields may be folded over lines and lines end in CRLF or LF. A record that breaks off or has
    no length is an error.
    """
    at = 0
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":
            at += 1
            continue
        if raw[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        fields: dict[str, str] = {}
        name, begin = "", at
        at = raw.index(b"\n", at) + 1
        while True:
            stop = raw.index(b"\n", at) + 1
            line = raw[at:stop].rstrip(b"\r\n")
            at = stop
            if not line:
                break
            if line[:1] in b" \t":
                fields[name] += " " + line.strip().decode("utf-8", "replace")
            else:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                name = name.strip().lower()
                fields.setdefault(name, value.strip())
        length = int(fields["content-length"])
        if at + length > len(raw):
            raise ValueError("a WARC record breaks off")
        yield raw[begin:at], fields, raw[at : at + length]
        at += length


def parse_records(members: DataFrame, column: str = "member") -> DataFrame:
    """``head, fields, http, payload, block_ok``: the records of a column of gzip members, runs of members or plain records.

    ``head`` and ``http`` are exact header bytes; a block that isn't HTTP is all payload. ``block_ok``
    says whether the block hashes to its SHA-1 digest in hex, null without one. A null or empty value holds no record.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, fields, https, payloads, oks = [], [], [], [], []
            for raw in b.column(0).to_pylist():
                for part in _plain(raw or b""):
                    for head, found, block in split_records(part):
                        cut = 0
                        if found.get("content-type", "").lower().startswith("application/http"):
                            end = block.find(b"\r\n\r\n")
                            cut = end + 4 if end >= 0 else len(block)
                        said = found.get("warc-block-digest", "").lower()
                        heads.append(head)
                        fields.append(list(found.items()))
                        https.append(block[:cut])
                        payloads.append(block[cut:])
                        oks.append(hashlib.sha1(block).hexdigest() == said[5:] if said.startswith("sha1:") and len(said) == 45 else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(heads, pa.binary()), pa.array(fields, pa.map_(pa.string(), pa.string())), pa.array(https, pa.binary()), pa.array(payloads, pa.binary()), pa.array(oks, pa.bool_())],
                names=["head", "fields", "http", "payload", "block_ok"],
            )

    return members.select(column).mapInArrow(run, "head binary, fields map<string,string>, http binary, payload binary, block_ok boolean")


def page_records(parsed: DataFrame, archive: Archive, id_type: str = "long") -> DataFrame:
    """Per parsed record: ``page_id, payload_bytes, payload_digest, record_type, refers_to, verified``.

    Size and digest are those of the payload that was read: the record's own, or for one that
    revisits that of the archive's payload under its address, measured once per payload.
    ``verified`` says whether it has the record's digest and address and, in a response, the block its digest.
    """

    def facts(payload: Column) -> list[Column]:
        return [F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"), F.sha2(payload, 256).alias("_sha")]

    fields = ["page-id", "type", "refers-to-page-id", "payload-digest", "payload-address"]
    named = [F.col("fields")[f"warc-{f}"].alias(f"_{f.replace('-', '_')}") for f in fields]
    own = parsed.where(F.col("fields")["warc-type"] != "revisit").select(*named, "block_ok", *facts(F.col("payload")))
    stored = parsed.sparkSession.read.parquet(archive.payloads).where("n_records > 1").select(_unpacked(F.col("packed")).alias("_raw"), F.concat(F.lit("sha256:"), F.col("address")).alias("_payload_address"))
    stored = stored.select(*facts(F.col("_raw")), "_payload_address")
    again = parsed.where(F.col("fields")["warc-type"] == "revisit").select(*named, "block_ok").join(stored, "_payload_address").select(*own.columns)
    return own.union(again).select(
        F.col("_page_id").cast(id_type).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("_type").alias("record_type"),
        F.col("_refers_to_page_id").cast(id_type).alias("refers_to"),
        ((F.concat(F.lit("sha256:"), F.col("_sha")) == F.col("_payload_address")) & (F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("_payload_digest")) & F.coalesce("block_ok", F.lit(True))).alias("verified"),
    )


def export_warc(spark: SparkSession, archive: Archive, path: str) -> None:
    """WARC files (gzip) from the archive: two line breaks end each record, which is the text writer's line separator."""
    record = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string")
    archive_records(spark, archive).select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
