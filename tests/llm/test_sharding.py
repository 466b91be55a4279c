from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from small import ODD, documents

from tessera.llm.sharding import communication_matrix, hypergeometric, shard_documents, write_shards


def test_matrix_has_exact_margins():
    counts, room = [5, 0, 17, 9, 1], [11, 11, 10]
    m = communication_matrix(counts, room, 3)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == room and (m >= 0).all()


def test_hypergeometric_follows_its_law():
    rng = np.random.default_rng(1)
    drawn = np.array([hypergeometric(rng, 30, 70, 20) for _ in range(20_000)])
    assert drawn.mean() == pytest.approx(6, abs=0.05)
    assert drawn.var() == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.05)
    big = hypergeometric(rng, 4 * 10**11, 6 * 10**11, 10**10)
    assert abs(big - 4 * 10**9) < 10**6


def test_odd_texts(spark):
    rows = shard_documents(documents(spark, ODD)).collect()
    for r in rows:
        raw = (ODD[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert len({r.shard for r in rows}) == len(ODD)


@pytest.mark.parametrize("n", [1000, 23, 24, 0])
def test_shards_are_even_and_gapless(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = shard_documents(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and all(n // 24 <= sizes.get(s, 0) <= n // 24 + 1 for s in range(24))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    place = lambda d: {r.doc_id: (r.shard, r.slot) for r in shard_documents(d).collect()}
    assert place(docs) == place(docs.repartition(7))


def test_repeated_and_null_ids(spark):
    docs = documents(spark, ["a"] * 50, ids=[None] * 25 + [7] * 25)
    sizes = Counter(r.shard for r in shard_documents(docs, n_shards=4).collect())
    assert sorted(sizes.values()) == [12, 12, 13, 13]


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = documents(spark, [f"t{i}" for i in range(60)])
    write_shards(docs, str(tmp_path / "out"), n_shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.text for r in back.select("row.*").collect()) == sorted(f"t{i}" for i in range(60))


def test_written_shards_take_any_column(spark, tmp_path):
    docs = documents(spark, ["a", "b", None]).selectExpr("*", "1 AS size", "'x' AS law", "2 AS shard", "3 AS slot", "4 AS text_crc32", "5 AS _id", "6 AS row")
    write_shards(docs, str(tmp_path / "out"), n_shards=2)
    assert spark.read.parquet(str(tmp_path / "out")).select("row.*").columns == docs.columns
    assert shard_documents(docs).count() == 3


def test_executors_draw_the_matrix(spark, monkeypatch):
    """Several groups of several buckets: even, gapless and uniform."""
    from tessera.llm import sharding

    monkeypatch.setattr(sharding, "TOP", 2)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    base = docs.select(F.col("doc_id").alias("_id"), F.lit(0).alias("_nth"))
    rows = sharding.shard_rows(base, ["_id", "_nth"], 5, rows_per_cell=100).collect()
    assert Counter(r.shard for r in rows) == {s: 1200 for s in range(5)}
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(1200))
        assert sum(r._id for r in rows if r.shard == s) / 1200 == pytest.approx(3000, abs=5 * 6000 / np.sqrt(12 * 1200))


def test_many_null_ids_spread(spark):
    docs = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    assert sorted(Counter(r.shard for r in shard_documents(docs).collect()).values()) == [375] * 24
