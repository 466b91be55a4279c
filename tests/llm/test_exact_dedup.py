from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F
from small import ODD, documents

from tessera.llm.exact_dedup import drop_exact_copies, exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {i: (max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_odd_texts(spark):
    docs = documents(spark, ODD)
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs).collect()}
    assert got == expected(list(enumerate(ODD)))


def test_colliding_hashes_are_told_apart(spark):
    docs = documents(spark, ["aa", "bb", "aa", "c", "dd"])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs, content_hash=F.length).collect()}
    assert got == {0: (2, 2), 1: (1, 1), 2: (2, 2), 3: (3, 1), 4: (4, 1)}


def test_repeated_rows_keep_one(spark):
    docs = documents(spark, ["t", "t", "t", "u"], ids=[5, 5, 3, None])
    rows = exact_dedup(docs).collect()
    assert len(rows) == 4 and sum(r.kept for r in rows) == 2
    assert all(r.group_size == 3 for r in rows if r.doc_id is not None)
    kept = drop_exact_copies(docs).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, "u"), (5, "t")]


def test_empty_and_clashing_columns(spark):
    docs = documents(spark, ["t", "t"]).withColumn("keep_id", F.lit("x")).withColumn("_hash", F.lit(1)).withColumn("kept", F.lit(2))
    assert {(r.doc_id, r.keep_id) for r in exact_dedup(docs).collect()} == {(0, 1), (1, 1)}
    assert drop_exact_copies(docs).columns == docs.columns
    assert exact_dedup(documents(spark, ["t"]).limit(0)).count() == 0


def test_matches_sql(spark, sf_dir, duck):
    from compare import assert_same

    from tessera.llm.queries import ORACLE_SQL, QUERIES

    for name in ("op9_exact_dedup", "op3_warc"):
        assert_same(QUERIES[name](spark, sf_dir), duck.execute(ORACLE_SQL[name]))
