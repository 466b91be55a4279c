from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import embedding_dedup
from tessera.llm.embedding_dedup import embedding_near_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    """Links and components by comparing every pair of usable vectors of one label."""
    ok = [(n, i, np.array(v, dtype=np.float64), x) for n, (i, v, x) in enumerate(rows) if v and x is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for p, (a, _, u, x) in enumerate(ok):
        for b, _, v, y in ok[p + 1 :]:
            if x == y and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least: dict = {}
    for n, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted(((i, links[n], least.get(find(n)))) for n, (i, _, _) in enumerate(rows))


def clusters(rng, groups, each, spread, dims=16):
    out = []
    for g in range(groups):
        centre = rng.normal(size=dims)
        out += [((centre + rng.normal(size=dims) * spread).astype(np.float32).tolist(), g % 3) for _ in range(each)]
    return [(i, v, x) for i, (v, x) in enumerate(out)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [None, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 0), (9, [1.0, 2.0], 0), (10, [2.0, 4.0], 0), (11, [1.0, 2.0], 1), (12, [1.0, 2.0, 3.0], 0), (13, [-1.0, -2.0], 0)]
    got = embedding_near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert {r.vec_id: r.n_links for r in got}[10] == 2


def test_matches_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROWS_PER_BLOCK", 16)
    rows = clusters(np.random.default_rng(4), 40, 12, 0.06)
    df = spark.createDataFrame(rows, SCHEMA)
    exact = embedding_near_dedup(df, reach=1.0, rows_per_cell=32).collect()
    want = brute(rows)
    assert sum(n for _, n, _ in want) > 1000
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in exact) == want


def test_default_reach_recalls_links(spark):
    rows = clusters(np.random.default_rng(5), 60, 10, 0.08, 64)
    got = embedding_near_dedup(spark.createDataFrame(rows, SCHEMA), rows_per_cell=40).collect()
    found, there = sum(r.n_links for r in got), sum(n for _, n, _ in brute(rows))
    assert there > 500 and found <= there and found >= 0.99 * there


def test_null_and_repeated_rows(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (4, [0.0, 1.0], 1), (4, [0.0, 1.0], 1), (3, [0.0, 2.0], 1)]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in embedding_near_dedup(spark.createDataFrame(rows, SCHEMA)).collect() if True)
    assert got[2:] == [(3, 2, 3), (4, 2, 3), (4, 2, 3)] and [g[:2] for g in got[:2]] == [(-1, 1), (-1, 1)]
    assert embedding_near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_on_the_supplied_table(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_near_dedup(spark.createDataFrame(rows, SCHEMA), rows_per_cell=64).collect())
    want = brute(rows)
    assert sum(n for _, n, _ in got) >= 0.9 * sum(n for _, n, _ in want)
    assert pytest.approx(1, abs=0.1) == (sum(a == b for a, b in zip(got, want, strict=True)) / len(want))


def test_one_id_with_two_vectors_and_string_ids(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [2.0, 0.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_near_dedup(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS _vec", "2 AS _id")).collect())
    assert got == [(5, 0, 5), (5, 1, 5), (6, 1, 5)]
    named = spark.createDataFrame(rows, SCHEMA).selectExpr("concat('v', vec_id) AS vec_id", "embedding", "label")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_near_dedup(named).collect()) == [("v5", 0, "v5", True), ("v5", 1, "v5", True), ("v6", 1, "v5", False)]


def test_placement_is_done_in_slices(spark):
    import tracemalloc

    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 8)))], "_id long, _vec array<double>")
    pdf, centroids = rows.toPandas(), embedding_dedup.fit_cells(embedding_dedup._unit(rows.toPandas()["_vec"]), 2000)

    class Once:
        schema = rows.schema

        def mapInPandas(self, f, schema):  # noqa: N802
            tracemalloc.start()
            made = sum(len(x) for x in f(iter([pdf])))
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return made, peak

    made, peak = embedding_dedup._placed(Once(), centroids, 0.98, 0.5)
    assert made >= 2000 and peak < 100e6


def test_query_equals_its_sql_on_a_table_with_links(spark, tmp_path):
    """The supplied tables hold no links at 0.98, so rows are copied with small changes and new ids."""
    import duckdb

    from tessera.llm import queries

    rng = np.random.default_rng(7)
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()[:60]
    rows = [(r.vec_id, list(r.embedding), r.label) for r in source]
    for i, r in enumerate(source):
        for k in range(i % 4):
            rows.append((100_000 + 10 * i + k, [float(x + 0.002 * rng.normal()) if k else float(x) for x in r.embedding], r.label))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = duckdb.connect()
    found.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(found.execute(queries.ORACLE_SQL["op6_embedding_dedup"]).fetchall())
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.op6_embedding_dedup(spark, str(tmp_path)).collect())
    assert got == want and sum(n for _, n, *_ in want) > 100
