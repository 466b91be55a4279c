from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from small import ODD, documents

from tessera.llm import quality as Q


def test_shapes():
    assert [Q.shape(w) for w in ("word", "Word", "WORD!!", "a.b", "x1&&&", "42%", "iPad", "|", "")] == ["x", "Xx", "X!", "x.x", "x&", "0%", "m", "|", ""]


def test_indicators_are_the_distinct_n_grams_of_each_text():
    """Whole texts taken together give what each gives alone, and one slot for each distinct n-gram of a kind."""
    texts = ["a b a b c", "", "one", "A b!! b!!  \n x", "one two"]
    words = Q._Words()
    row, slot = Q.indicators(texts, words)
    for i, t in enumerate(texts):
        alone = Q.indicators([t], Q._Words())[1] if t else np.zeros(0)
        assert slot[row == i].tolist() == alone.tolist()
    first = slot[row == 0]
    assert (first < Q.WIDTHS[0]).sum() == 3  # a, b, c
    assert ((first >= Q.WIDTHS[0]) & (first < sum(Q.WIDTHS[:2]))).sum() == 3  # ab, ba, bc
    assert (first >= sum(Q.WIDTHS[:2])).sum() == 3  # x, xx, xxx
    assert len(slot[row == 1]) == 0 and (slot[row == 2] < Q.SIZE).all()


def test_ascent_reaches_the_hinge_optimum():
    """One block against a plain subgradient descent on the primal; several blocks at once against the same."""
    rng = np.random.default_rng(3)
    n, d = 60, 12
    ratios = np.zeros(Q.SIZE)
    ratios[:d] = rng.normal(size=d)
    slots = [np.flatnonzero(rng.random(d) < 0.4) for _ in range(n)]
    signs = np.where([0 in s or 3 in s for s in slots], 1.0, -1.0) * np.where(rng.random(n) < 0.1, -1, 1)
    scale = np.array([Q.row_scale(s, ratios) for s in slots])
    x = np.zeros((n, d + 1))
    for i, s in enumerate(slots):
        x[i, s], x[i, d] = ratios[s] * scale[i], scale[i]

    def primal(w):
        return w @ w / 2 + Q.COST * np.maximum(0, 1 - signs * (x @ w)).sum()

    for blocks in (1, 3):
        weights, alphas = np.zeros(Q.SIZE + 1), [np.zeros(len(range(b, n, blocks))) for b in range(blocks)]
        for turn in range(150):
            changes = []
            for b in range(blocks):
                own = list(range(b, n, blocks))
                alphas[b], change = Q.climb(signs[own], [slots[i] for i in own], scale[own], ratios, weights, alphas[b], blocks, turn * blocks + b)
                changes.append(change)
            weights = weights + sum(changes)
        w = np.append(weights[:d], weights[-1])
        dual = sum(a.sum() for a in alphas) - w @ w / 2
        assert primal(w) - dual < 1e-3 * primal(w)
        every = np.concatenate([alphas[b] for b in range(blocks)])
        order = [i for b in range(blocks) for i in range(b, n, blocks)]
        assert w == pytest.approx((every * signs[order]) @ x[order], abs=1e-9)


def corpus(spark, n=500, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        good = int(rng.random() < 0.8)
        if not good:
            kind = i % 4
            t = [w.upper() + "!!" for w in t] if kind == 0 else [w + "%%%" for w in t] if kind == 1 else [t[0]] * len(t) if kind == 2 else " | ".join(t).split(" ")
        texts.append(" ".join(t))
        labels.append((i, good, 0))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [g for _, g, _ in labels]


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels, good = corpus(spark)
    return docs, labels, good, Q.fit_quality(docs, labels)


def test_held_out_rows_are_told_apart(learned):
    docs, _, good, model = learned
    rows = Q.score_quality(docs, model).collect()
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {i for i in range(len(good)) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == good[r.doc_id] for r in out]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_held_out_labels_teach_nothing_and_reruns_agree(spark):
    docs, labels, _ = corpus(spark, 200)
    other = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in Q.score_quality(docs, Q.fit_quality(docs, x)).collect()) for x in (labels, other))
    assert a == b


def test_odd_texts_and_missing_labels(spark, learned):
    docs, labels, _, model = learned
    odd = documents(spark, [*ODD, "퟿ x", "y" * 200_000], ids=[None, 1, *range(1, len(ODD) + 1)])
    rows = Q.score_quality(odd.withColumn("score", F.lit(9)).withColumn("held_out", F.lit("x")), model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (None, 1)}) == 1  # null, empty and blank texts
    assert Q.score_quality(docs.limit(0), model).count() == 0
    nothing = Q.fit_quality(docs, labels.limit(0))
    assert not nothing.known and len({r.score for r in Q.score_quality(docs, nothing).collect()}) == 1
    repeated = Q.fit_quality(docs.unionAll(docs), labels.unionAll(labels).unionAll(spark.createDataFrame([(None, 1, 0), (1, None, 0)], labels.schema)))
    assert np.array_equal(repeated.weights, model.weights)
