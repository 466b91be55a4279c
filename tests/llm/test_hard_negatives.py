from __future__ import annotations

import math
import random

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H
from tessera.llm import queries


def plain(rows, anchor, positives=5, negatives=3):
    """All pairs, in exact numbers."""
    least = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [math.floor(256 * x) for x in v])
        least[i] = min(own, least.get(i, own))
    out = set()
    for i, (label, v) in least.items():
        if not anchor(i):
            continue
        score = {j: sum(a * b for a, b in zip(v, w, strict=True)) for j, (_, w) in least.items() if j != i and len(w) == len(v)}
        best = sorted((-s, j) for j, s in score.items() if least[j][0] == label)[:positives]
        for s, p in ((-s, p) for s, p in best):
            fits = sorted((-n, j) for j, n in score.items() if least[j][0] != label and 50 * s <= 100 * n <= 95 * s)[:negatives]
            out |= {(i, p, r, j, s, -n) for r, (n, j) in enumerate(fits, 1)}
    return out


SCHEMA = "vec_id long, label int, embedding array<double>, score string, block int"


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = H.hard_negatives(df, F.col("_id") % 3 == 0, **more).collect()
    out = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found}
    assert len(out) == len(found)
    return out


def test_hilbert_curve_takes_every_place_once_by_single_steps():
    for d, bits in ((2, 3), (3, 2), (4, 2), (1, 4)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        key = H.hilbert_keys(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(key)], axis=0))
        assert (steps.sum(axis=1) == 1).all()


def test_products_are_exact_at_any_size():
    for most in (300, 1 << 28, 1 << 40):
        rng = random.Random(most)
        a, b = ([[rng.randint(-most, most) for _ in range(5)] for _ in range(4)] for _ in "ab")
        want = [[max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
        assert H.products(np.array(a), np.array(b)).tolist() == want


def test_small_blocks_match_all_pairs(spark, monkeypatch):
    """Clusters, ties, copies and odd rows over many blocks, batches, pages, tiles and slices."""
    for name, value in (("BLOCK_ROWS", 7), ("RANGE_ROWS", 40), ("BATCH_ROWS", 3), ("PAGE", 4), ("TILE", 2), ("SLICE", 2)):
        monkeypatch.setattr(H, name, value)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, rng.randrange(3), [c + rng.gauss(0, 0.3) for c in centres[i % 4]]) for i in range(150)]
    rows += [(200 + i, i % 2, [0.5, 0.25, 0.0, -0.5, 1.0, 0.125]) for i in range(40)]  # one vector, many ids
    rows += [(3, 1, [9.0] * 6), (3, 0, [0.1] * 6), (None, 1, [1.0] * 6), (300, None, [1.0] * 6), (303, 1, None), (306, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(309, 1, [math.nan] * 6), (312, 1, [math.inf] * 6), (315, 1, []), (316, 1, []), (318, 2, [1.0, 2.0]), (319, 2, [1.0, 1.5]), (320, 0, [1.0, 0.5]), (321, 0, [0.0] * 6), (324, 7, [1.0] * 6)]
    want = plain(rows, lambda i: i % 3 == 0)
    assert len(want) > 300 and mined(spark, rows) == want
    assert mined(spark, []) == set() and mined(spark, rows[:1]) == set()


def test_blocks_that_cannot_hold_a_wanted_score_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 4)) * 5
    rows = [(i, i // 12 % 2, [float(x) for x in centres[i % 12] + rng.normal(size=4) * 0.05]) for i in range(600)]
    df = H.whole_vectors(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), "vec_id", "embedding", "label")
    blocks = H.blocks_of(df, F.col("_id") % 10 == 0)
    search = H.Positives(5)
    batches = H._batches(blocks, search)
    needed = H.needed_blocks(blocks, batches, search, blocks.count(), batches.count())
    read = needed.select(F.sum(F.size("who"))).first()[0]
    assert read < 0.5 * 60 * blocks.count()


def test_query_matches_sql(spark, sf_dir, duck):
    assert_same(queries.op12_hard_negatives(spark, sf_dir), duck.execute(queries.ORACLE_SQL["op12_hard_negatives"]))


@pytest.mark.parametrize("positive", [0, 1, 7, -8, 100, 12345, -99, 10**15 + 7])
def test_windows_are_those_of_the_contract(positive):
    low, high = H.Negatives(3, 50, 95).window(positive)
    for n in (low - 1, low, high, high + 1):
        assert (low <= n <= high) == (50 * positive <= 100 * n <= 95 * positive)
