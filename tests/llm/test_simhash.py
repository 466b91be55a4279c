from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F
from small import ODD, documents

from tessera.llm import simhash
from tessera.llm.components import connected_components
from tessera.llm.simhash import drop_near_copies, fingerprint, linked_prints, near_duplicates


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    out = list(ODD)
    for _ in range(25):
        base = [rng.choice(words) for _ in range(250)]
        out.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            other[rng.randrange(250)] = "changed"
            out.append(" ".join(other))
    return out


def test_matches_plain_loops(spark):
    made = texts()
    rows = {r.doc_id: r for r in near_duplicates(documents(spark, made)).collect()}
    prints = {i: plain_print(t) for i, t in enumerate(made)}
    want = components(prints)
    assert len(set(want.values())) < len(set(prints.values()))
    for i in prints:
        assert (rows[i].fingerprint, rows[i].component_id) == (f"{prints[i]:016x}", want[i])


@pytest.mark.parametrize("flips", [(0,), (5, 40), (31, 32, 63), (1, 2, 3), (33, 34, 35), (0, 1, 2, 3)])
def test_links_reach_three_bits(spark, flips):
    a = 0x0123456789ABCDEF
    b = a
    for f in flips:
        b ^= 1 << f
    signed = [x - (1 << 64) if x >> 63 else x for x in (a, b)]
    found = linked_prints(spark.createDataFrame([(x,) for x in signed], "_print long")).collect()
    assert len(found) == (1 if len(flips) <= 3 else 0)


def test_hash_is_sparks(spark):
    df = spark.createDataFrame([("a b c",)], "t string")
    assert df.select(F.xxhash64("t")).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)
    assert fingerprint("A b  C") % (1 << 64) == plain_print("a b c")


def test_null_and_repeated_ids(spark):
    docs = documents(spark, ["p q r s"] * 4 + ["z"], ids=[None, 9, 9, 4, None])
    rows = sorted((r.doc_id or -1, r.component_id) for r in near_duplicates(docs).collect() if r.component_id is not None)
    assert rows == [(-1, 4), (4, 4), (9, 4), (9, 4)]
    assert sorted((r.doc_id or -1, r.text) for r in drop_near_copies(docs).collect()) == [(-1, "z"), (4, "p q r s")]
    assert drop_near_copies(documents(spark, ["same"] * 3, ids=[None, None, None])).count() == 1
    assert drop_near_copies(documents(spark, ["same"] * 3, ids=[2, 2, 3])).count() == 1
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    chain = list(range(200))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(1000, 1001), (1002, 1001), (7000, 7000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in chain} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_classes_take_the_other_way(spark, monkeypatch):
    made = [*texts()[-8:], *["one text that many rows hold"] * 40, *[""] * 30]
    docs = documents(spark, made)
    plain = sorted(tuple(r) for r in near_duplicates(docs).collect())
    monkeypatch.setattr(simhash, "ROWS_PER_CELL", 5)
    split = near_duplicates(docs)
    assert sorted(tuple(r) for r in split.collect()) == plain
    assert "BroadcastHashJoin" in split._jdf.queryExecution().toString()
    assert len(plain) == len(made) and len({c for *_, c in plain}) < len({p for _, p, _ in plain})


def test_variants_are_never_broadcast(spark):
    """Their number is unknown to the planner, which takes 64 variants for one row."""
    prints = spark.range(100).select(F.xxhash64("id").alias("_print"))
    plan = linked_prints(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
