from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from small import ODD, documents

from tessera.llm.mixing import mix_sources, mixed_rows


def targets(sizes: dict, share=1.5, weights=(5, 2, 1)):
    """Water filling by rounds, as a plain loop."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = (budget - sum(out.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return out


def check(rows, texts, sources):
    sizes = [len((t or "").replace(" ", "x").split()) if t else 0 for t in texts]
    per = defaultdict(int)
    for n, s in zip(sizes, sources, strict=True):
        per[s] += n
    want, taken = targets(per), Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.source_size == per[s] and r.target == pytest.approx(want[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in per:
        most = max(n for n, x in zip(sizes, sources, strict=True) if x == s)
        assert abs(taken[s] - want[s]) <= most + 1e-6
    return sum(taken.values()), sum(sizes)


def test_sources_reach_their_targets(spark):
    rng = random.Random(3)
    sources = [rng.choice(["a", "a", "a", "B", "ü", None, "c"]) for _ in range(600)]
    texts = ["w " * rng.randint(0, 40) for _ in sources]
    rows = mix_sources(documents(spark, texts, sources), rows_per_cell=16).collect()
    total, size = check(rows, texts, sources)
    assert total <= 1.5 * size < total + 40


def test_odd_texts_and_reruns(spark):
    sources = ["a", None, "b"] * 4
    docs = documents(spark, ODD, sources)
    first = mix_sources(docs).collect()
    check(first, ODD, sources)
    assert sorted(first) == sorted(mix_sources(docs.repartition(5)).collect())


def test_rows_are_taken_as_often_as_planned(spark):
    docs = documents(spark, [f"w{i} x" for i in range(30)], ["a", "b", None] * 10)
    plan = {r.doc_id: r.passes for r in mix_sources(docs).collect()}
    got = Counter(r.doc_id for r in mixed_rows(docs).collect())
    assert got == Counter({k: v for k, v in plan.items() if v})
    assert mixed_rows(docs).columns == docs.columns


def test_repeated_and_empty_tables(spark):
    docs = documents(spark, ["a b"] * 6 + [""], ["s"] * 7, ids=[1] * 3 + [None] * 4)
    assert sum(r.taken for r in mix_sources(docs).collect()) == 18
    assert mixed_rows(docs).count() == 9
    assert mix_sources(docs.limit(0)).count() == 0
    assert {(r.taken, r.target) for r in mix_sources(documents(spark, ["", None], ["a", "b"])).collect()} == {(0, 0.0)}
