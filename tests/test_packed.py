from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import affinity, counts, markov, packed
from tessera.operators.affinity import Mode
from tessera.plans import catalog


def words(text: str, k: int) -> list[str]:
    return [text[i : i + k] for i in range(len(text) - k + 1)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    made = ["".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 2, 3, 7, 40, 300]))) for _ in range(60)]
    return [*made, "ACGNACGT", "acgtACGT", "ACG TÄ", "N", None, made[7], made[7]]


@pytest.mark.parametrize("k", [1, 3, 8, 11, 31, 33])
def test_counts_are_those_of_all_windows(spark, texts, k, monkeypatch):
    monkeypatch.setattr(packed, "STRETCH", 50)
    rows = [(i % 3, t, i % 4) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g int, seq string, n int")
    want = Counter(w for _, t, _ in rows for w in words(t or "", k))
    assert {r.kmer: r.n for r in counts.count_kmers(df, k).collect()} == want
    weighed: Counter = Counter()
    for g, t, n in rows:
        for w in words(t or "", k):
            weighed[g, w] += n
    found = {(r.g, r.kmer): r.n for r in counts.count_kmers(df, k, weight="n", by=("g",)).collect()}
    assert {key: n for key, n in found.items() if n} == {key: n for key, n in weighed.items() if n}


def test_both_strands_filters_and_null_groups(spark, texts):
    df = spark.createDataFrame([(None if i % 2 else "x", t) for i, t in enumerate(texts) if t and not t.strip("ACGT")], "g string, seq string")
    turn = str.maketrans("ACGT", "TGCA")
    want: Counter = Counter()
    for r in df.collect():
        for w in words(r.seq, 4):
            if "AA" not in w:
                want.update([(r.g, w), (r.g, w.translate(turn)[::-1])])
    found = counts.count_kmers(df, 4, both_strands=True, by=("g",), exclude="AA").collect()
    assert {(r.g, r.kmer): r.n for r in found} == want
    assert counts.count_kmers(df.limit(0), 4).count() == 0


def test_rolled_codes():
    codes = np.array([0, 1, 2, 3, -1, 3, 3])
    assert packed.rolled(codes, 2).tolist() == [1, 6, 11, -1, -1, 15] and packed.rolled(codes, 9).tolist() == []


@pytest.mark.parametrize(("threshold", "longest"), [(1, 6), (3, 4), (0, 5), (1000, 3), (5, 1)])
def test_kmax_from_the_longest_words(spark, texts, threshold, longest):
    clean = [t for t in texts if t and not t.strip("ACGT")]
    df = spark.createDataFrame([(t, i % 3 + 1) for i, t in enumerate(clean)], "seq string, n int")
    want = longest - 1
    for k in range(longest, 0, -1):
        own: Counter = Counter()
        for i, t in enumerate(clean):
            for w in words(t, k):
                own[w] += i % 3 + 1
        if own and min(own.values()) <= threshold:
            want = k - 1
    assert markov.kmax(df, threshold, longest, weight="n").first().kmax == want


def test_scans_in_parts_match_each_window(spark, monkeypatch):
    """Both strands with pair weights, lower case, N and other letters, cut in parts of a few windows."""
    monkeypatch.setattr(affinity, "SCAN_WINDOWS", 7)
    rng = random.Random(5)
    k, mono, di = 7, tuple(rng.uniform(-1, 1) for _ in range(28)), tuple(rng.uniform(-1, 1) for _ in range(96))
    text = "".join(rng.choice("ACGTACGTacgtNn-") for _ in range(60)) + "".join(rng.choice("ACGT") for _ in range(80))
    df = spark.createDataFrame([("c", 100, text), ("d", 0, "ACG"), ("e", 0, None)], "chrom string, pos_start long, seq string")
    rows = sorted(affinity.genome_scan(df, Mode(k, mono, di)).collect())
    turn = str.maketrans("ACGT", "TGCA")

    def score(w):
        c = ["ACGT".index(b) for b in w]
        return float(np.exp(sum(mono[4 * p + b] for p, b in enumerate(c)) + sum(di[16 * p + 4 * c[p] + c[p + 1]] for p in range(k - 1))))

    want = []
    for i, w in enumerate(words(text, k)):
        up = w.upper()
        good = not up.strip("ACGT")
        flag = -1 if "N" in up else 1 if any(b.islower() for b in w) else 0
        want.append(("c", 100 + i, score(up) if good else 0.0, score(up.translate(turn)[::-1]) if good else 0.0, flag))
    assert [(r.chrom, r.pos, r.flag) for r in rows] == [(a, b, e) for a, b, *_, e in want]
    assert np.allclose([(r.forward, r.reverse) for r in rows], [w[2:4] for w in want])
    assert affinity.genome_scan(df, Mode(k, mono, di), only=["d"]).agg(F.count("*")).first()[0] == 0


def python_rows(df) -> int:
    """Rows that a collected frame's Python nodes handed to Spark."""

    def of(node) -> int:
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return of(node.executedPlan())
        if "QueryStage" in name:
            return of(node.plan())
        own = node.metrics().get("pythonNumRowsReceived")
        children = node.children()
        return (own.get().value() if own.isDefined() else 0) + sum(of(children.apply(i)) for i in range(children.size()))

    return of(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize(("k", "paired"), [(1, False), (3, True), (5, False), (7, True)])
def test_peaks_are_those_of_the_scan(spark, k, paired, monkeypatch):
    """Chunks shorter than a window, of one window, long ones cut in parts, N and other letters at the borders of texts, null names."""
    monkeypatch.setattr(affinity, "SCAN_WINDOWS", 11)
    rng = random.Random(k)
    texts = ["", "A", "N" * k, "n" + "ACGT" * 3, "acg-TNA", None, *("".join(rng.choice("ACGTACGTACGTacgtN-é") for _ in range(rng.choice([1, 2, 3, 4, 8, 60]))) for _ in range(80))]
    df = spark.createDataFrame([(None if i % 9 == 0 else f"c{i % 9}", i, t) for i, t in enumerate(texts)], "chrom string, pos_start int, seq string").coalesce(2)
    mode = Mode(k, tuple(rng.uniform(-1, 1) for _ in range(4 * k)), tuple(rng.uniform(-1, 1) for _ in range(16 * (k - 1))) if paired else ())
    scan = affinity.genome_scan(df, mode)
    want = {r.chrom: r for r in scan.groupBy("chrom").agg(F.count("*").alias("windows"), F.max("forward").alias("forward"), F.max("reverse").alias("reverse"), F.count_if(F.col("flag") == -1).alias("unknown")).collect()}
    assert {r.chrom: r for r in affinity.scan_peaks(df, mode).collect()} == want and want
    assert scan.count() == sum(max(0, len(t) - k + 1) for t in texts if t is not None)


def test_genome_query_makes_no_row_a_window(spark, sf_dir):
    found = catalog.QUERIES["i6_genome_scan"](spark, sf_dir)
    rows = found.collect()
    windows = sum(r.windows for r in rows)
    assert windows > 100_000 and python_rows(found) < windows / 100
