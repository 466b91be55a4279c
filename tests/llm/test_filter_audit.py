from __future__ import annotations

import itertools
import re
from collections import Counter

from compare import assert_same
from small import ODD, documents

from tessera.llm import queries
from tessera.llm.filter_audit import failures, filter_audit, games, mask_counts, with_potential


def plain(rows, labels):
    """Every order applied to every row, one filter after the other."""
    labels = [x for x in labels if x[0] is not None]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        docs.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                hit = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                every = [d for d in own if f in d[1]]
                out[part, "".join(order), k] = (f, len(left), len(hit), len(every) - len(hit), sum(d[1] == {f} for d in own), sum(d[2] for d in hit), sum(d[3] for d in hit))
                shapley[part, f] += len(hit)
    return {key: (*v, shapley[key[0], v[0]]) for key, v in out.items()}


def as_dict(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_odd_rows_match_the_orders_played_out(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [*ODD, long, long, long + " $", "same " * 300, "A " + long.upper(), long, None]
    ids = [5, 3, None, 7, 7, 1, 2, None, 9, 4, 11, 12, 30, 20, 21, 22, 23, 30, None]
    sources = [None, "", "a", "b", "b", "a", None, "b", "a", "", "c", "c", "a", "b", "a", "b", "a", "a", "a"]
    labels = [(30, 1, 0), (30, 0, 1), (20, 1, 0), (7, 0, 1), (99, 1, 1), (None, 1, 1), (21, None, None)]
    docs = documents(spark, texts, sources, ids)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain(list(zip(ids, texts, sources, strict=True)), labels)
    assert as_dict(filter_audit(docs, marks)) == want
    clash = docs.selectExpr("*", "1 AS mask", "2 AS part", "3 AS n", "'x' AS v", "4 AS id")
    assert as_dict(filter_audit(clash, marks.selectExpr("*", "5 AS n"))) == want
    assert filter_audit(docs.limit(0), marks).count() == 0
    none = as_dict(filter_audit(docs, marks.limit(0)))
    assert all(v[5] == v[6] == 0 for v in none.values()) and len(none) == len(want)


def test_potential_is_whole_and_efficient(spark):
    """The potentials' differences are Shapley values times 120: they add up to all that is removed, and P(S) times |S| is exact."""
    docs = documents(spark, [("a $ B " * (i % 90 + 1)) + str(i % 7) for i in range(200)], [f"s{i % 3}" for i in range(200)])
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in with_potential(games(mask_counts(failures(docs), marks))).collect():
        assert sum(r.p[31] - r.p[31 ^ 1 << i] for i in range(5)) == 120 * r.v[31]
        for s in range(1, 32):
            inside = [i for i in range(5) if s >> i & 1]
            assert r.p[s] * len(inside) == 120 * r.v[s] + sum(r.p[s ^ 1 << i] for i in inside)


def test_query_matches_sql(spark, sf_dir, duck):
    assert_same(queries.op13_filter_audit(spark, sf_dir), duck.execute(queries.ORACLE_SQL["op13_filter_audit"]))
