from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import sequences as S
from tessera.operators import affinity, counts, filters, markov, splits, windowed
from tessera.plans import fixtures as X


@pytest.fixture(scope="module")
def probes(spark, sf_dir):
    return X.probes(spark, sf_dir).cache()


def test_counts_add_up(probes):
    for k in (1, 3, 8):
        total = counts.count_kmers(probes, k, weight="n").agg(F.sum("n")).first()[0]
        assert total == probes.agg(F.sum("n")).first()[0] * (8 - k + 1)


def test_both_strand_counts_are_symmetric(probes):
    made = {r.kmer: r.n for r in counts.count_kmers(probes, 4, both_strands=True).collect()}
    turned = {k[::-1].translate(str.maketrans("ACGT", "TGCA")): n for k, n in made.items()}
    assert made == turned


def test_sibling_chances_add_to_one(probes):
    model = markov.transition_model(counts.count_kmers(probes, 3, weight="n"))
    for r in model.groupBy("context").agg(F.sum("p").alias("p")).collect():
        assert r.p == pytest.approx(1)


def test_chances_over_the_universe_add_to_one(spark, probes):
    model = markov.transition_model(counts.count_kmers(probes, 2, weight="n"))
    words = affinity.universe(spark, 5)
    assert markov.model_probability(words, model, 2).agg(F.sum("p")).first()[0] == pytest.approx(1)


def test_unseen_windows_have_no_chance(spark):
    model = markov.transition_model(spark.createDataFrame([("AA", 3), ("AC", 1)], "kmer string, n long"))
    words = spark.createDataFrame([("AAA",), ("AAG",), ("CAA",)], "seq string")
    got = {r.seq: r.p for r in markov.model_probability(words, model, 2).collect()}
    assert got == pytest.approx({"AAA": 0.75 * 0.75, "AAG": 0.0, "CAA": 0.0})


def test_repeated_words_keep_their_chance_and_rows(spark):
    model = markov.transition_model(spark.createDataFrame([("AC", 3), ("CG", 1), ("GT", 2), ("GA", 2)], "kmer string, n long"))
    words = spark.createDataFrame([("ACGT",), ("ACGT",), ("ACGA",), ("A",), ("ACNT",)], "seq string")
    made = markov.model_probability(words, model, 2)
    assert "hashpartitioning(seq" not in made._jdf.queryExecution().explainString(made._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    want = 3 / 8 * 1.0 * 0.5
    assert sorted((r.seq, -1 if r.p is None else round(r.p, 9)) for r in made.collect()) == [("A", -1), ("ACGA", want), ("ACGT", want), ("ACGT", want), ("ACNT", 0.0)]
    joined = markov._joined_probability(words.where("seq LIKE 'ACG%'"), model, 2, "seq", (), F.col("seq"), True)
    assert sorted(round(r.p, 9) for r in joined.collect()) == [want] * 3


def test_shape_scores_of_repeated_probes(spark, sf_dir):
    probes = spark.createDataFrame([("ACGTACGT",), ("ACGTACGT",), ("AC",)], "seq string")
    rows = affinity.shape_score(probes, X.SHAPED, X.shape(spark, sf_dir), X.LEFT_FLANK, X.RIGHT_FLANK).collect()
    logs = affinity.shape_log_scores(probes.limit(1), X.SHAPED, X.shape(spark, sf_dir), X.LEFT_FLANK, X.RIGHT_FLANK).collect()
    one = sum(np.exp(r.log) for r in logs)
    assert sorted(round(r.score, 9) for r in rows) == [0.0, round(one, 9), round(one, 9)] and len(logs) == 12


def test_score_gradient_is_that_of_the_score(spark):
    word, step = "ACGTTGCA", 1e-6
    df = spark.createDataFrame([(word,), (word,)], "seq string")
    for got in df.select(affinity.score_gradient("seq", X.NARROW).alias("g")).collect():
        for j in range(12):
            up, down = ([b + s * step * (i == j) for i, b in enumerate(X.MONO)] for s in (1, -1))
            a, b = (df.limit(1).select(affinity.probe_score("seq", [affinity.Mode(3, tuple(w))])).first()[0] for w in (up, down)) if j < 2 else (None, None)
            assert a is None or got.g[j] == pytest.approx((a - b) / (2 * step), rel=1e-5)


def test_samples_depend_on_ids_alone(spark):
    df = spark.range(500)
    a, b = (sorted(r.id for r in splits.fixed_sample(df.repartition(n), "id", 50, 3).collect()) for n in (2, 7))
    assert a == b
    a, b = (sorted(splits.stratified_universe(spark, 4, 20, s).collect()) for s in (1, 1))
    assert a == b and all(0 <= r.code - 12 * r.stratum - min(r.stratum, 16) < 12 + (r.stratum < 16) for r in a)  # 256 = 20 * 12 + 16


def test_thinning_deals_every_read(spark):
    df = spark.createDataFrame([(1, 40), (2, 1), (3, 0)], "id long, n long")
    rows = splits.thinned(df, "id", 0.5, 3).collect()
    totals: dict = {}
    for r in rows:
        totals[r.fold, r.id] = totals.get((r.fold, r.id), 0) + r.n
    assert totals == {(f, i): n for f in range(3) for i, n in ((1, 40), (2, 1))} and {r.test for r in rows if r.id == 1} == {True, False}


@pytest.mark.parametrize("per", [3, 7, 1000])
def test_ranges_don_t_change_windows(spark, per):
    import random

    rng = random.Random(per)
    rows = [(rng.choice("ab"), t, rng.random() if rng.random() < 0.3 else None) for t in rng.sample(range(900), 60)]
    df = spark.createDataFrame(rows, "s string, t int, v double")
    filled, average = {}, {}
    for s in "ab":
        own = sorted((t, v) for x, t, v in rows if x == s)
        for i, (t, _) in enumerate(own):
            filled[s, t] = next((v for _, v in own[i:] if v is not None), None)
            frame = [v for _, v in own[i - 2 : i + 3] if v is not None] if 2 <= i < len(own) - 2 else []
            average[s, t] = sum(frame) / len(frame) if frame else None
    assert {(r.s, r.t): r.filled for r in windowed.back_fill(df, ["s"], "t", "v", per).collect()} == filled
    got = {(r.s, r.t): r.average for r in windowed.moving_average(df, ["s"], "t", "v", 5, per).collect()}
    assert got.keys() == average.keys() and all(got[k] == pytest.approx(average[k]) for k in got if average[k] is not None)
    assert windowed.back_fill(df.limit(0), ["s"], "t", "v").count() == 0


def test_ranges_hold_a_share_of_the_rows_whatever_the_outliers(spark):
    """One far outlier, a dense cluster, many nulls: no range but that of nulls holds more than about its share."""
    places = F.when(F.col("id") == 0, -1e12).when(F.col("id") < 5000, F.col("id") / 1e6).when(F.col("id") < 5100, None).otherwise(F.col("id").cast("double"))
    rows = spark.range(20_000).withColumn("at", places)
    sizes = {r["_range"]: r["count"] for r in windowed._ranges(rows, "at", 500).groupBy("_range").count().collect()}
    assert sizes.pop(-1) == 100 and len(sizes) > 30 and max(sizes.values()) < 1000
    spread = windowed._ranges(rows, "at", 500).where("_range >= 0").groupBy("_range").agg(F.min("at").alias("low"), F.max("at").alias("high")).orderBy("_range").collect()
    assert all(a.high <= b.low for a, b in zip(spread, spread[1:], strict=False))
    found = windowed.moving_average(rows.withColumn("s", F.lit("x")).withColumn("v", F.col("id").cast("double")), ["s"], "at", "v", 3, 500).where("id = 10000").first()
    assert found.average == 10_000


def test_zero_weights_give_closed_form_partition(spark):
    flat = affinity.Mode(3, (0.0,) * 12)
    z = affinity.partition_function(affinity.universe(spark, 5), F.lit(1.0), affinity.probe_score("seq", [flat])).first()[0]
    assert z == pytest.approx(4**5 * 2 * 3)


def test_turned_weights_score_the_reverse_strand(spark):
    mode = X.PAIRED
    df = spark.createDataFrame([("ACGTTGCA",), ("GGGTACCA",)], "seq string")
    scored = df.select(affinity.probe_score("seq", [mode]).alias("a"), affinity.probe_score(S.reverse_complement("seq"), [mode]).alias("b"))
    for r in scored.collect():
        assert r.a == pytest.approx(r.b)


def test_short_words_have_no_windows(spark):
    df = spark.createDataFrame([("AC",), ("",), (None,)], "seq string")
    got = df.select(S.windows("seq", 3).alias("w"), affinity.probe_score("seq", [X.NARROW]).alias("s")).collect()
    assert all(r.w == [] for r in got[:2]) and all(r.s == 0.0 for r in got[:2])


def test_last_given_regex_decides(spark):
    df = spark.createDataFrame([("AAC",), ("CCC",), ("GGG",)], "kmer string")
    kept = lambda **k: [r.kmer for r in df.where(filters.kmer_verdict("kmer", **k)).collect()]
    assert kept(include="A") == ["AAC"]
    assert kept(include="A", exclude="C") == ["GGG"]
    assert kept(include="A", exclude="C", only=["CCC"]) == ["CCC"]


def test_splits_are_exact_and_disjoint(probes):
    rows = probes.count()
    parts = {r.part: r["count"] for r in splits.proportional_split(probes, "code", (0.5, 0.5)).groupBy("part").count().collect()}
    assert parts == {0: -(-rows // 2), 1: rows // 2}
    ranks = splits.ranked(probes, "code")
    assert ranks.select("rank").distinct().count() == rows and ranks.agg(F.max("rank")).first()[0] == rows - 1


def test_samples_include_rows_evenly(spark):
    df = spark.range(40)
    seen = np.zeros(40)
    for step in range(300):
        for r in splits.minibatch(df, "id", 8, step).collect() if step % 10 == 0 else []:
            seen[r.id] += 1
    assert seen.sum() == 30 * 8 and seen.max() < 20


def test_latest_row_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, at int, v string")
    assert sorted((r.k, r.v) for r in windowed.latest(df, ["k"], "at").collect()) == [("a", "y"), ("b", "z")]


def test_back_fill_takes_the_next_value(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, 5.0), ("s", 3, None)], "s string, t int, v double")
    assert [r.filled for r in windowed.back_fill(df, ["s"], "t", "v").orderBy("t").collect()] == [5.0, 5.0, None]


def test_top_words_break_ties_by_word(spark):
    df = spark.createDataFrame([("C", 2), ("A", 2), ("G", 1), ("T", 3)], "kmer string, n long")
    assert [r.kmer for r in windowed.top_words(df, 2).collect()] == ["A", "T"]


def test_kmax_is_below_the_first_failing_length(spark):
    df = spark.createDataFrame([("ACAC", 10)], "seq string, n long")
    assert markov.kmax(df, 15, 4, weight="n").first()[0] == 1
    assert markov.kmax(df, 1, 4, weight="n").first()[0] == 3


def test_shape_profile_matches_a_plain_loop(spark, probes, sf_dir):
    few = probes.limit(40)
    shape = {(r.pentamer, r.feature): r.value for r in X.shape(spark, sf_dir).collect()}
    want: dict = {}
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    score = lambda w: float(np.exp(sum(X.MONO[4 * p + "ACGT".index(b)] for p, b in enumerate(w))))
    for r in few.collect():
        arrays = [x for i in range(6) for x in (score(r.seq[i : i + 3]), score(turn(r.seq[i : i + 3])))]
        best = next(i for i, x in enumerate(arrays) if x == pytest.approx(max(arrays), rel=1e-12))
        part = ("GC" + r.seq + "GA")[best // 2 : best // 2 + 7]
        part = turn(part) if best % 2 else part
        for o in range(3):
            for f in ("f0", "f1"):
                want.setdefault((o, f), []).append(shape[part[o : o + 5], f])
    got = affinity.shape_profile(few, X.NARROW, X.shape(spark, sf_dir), X.LEFT_FLANK, X.RIGHT_FLANK, -9.0, 100.0, 1)
    for r in got.collect():
        assert r.value == pytest.approx(np.mean(want[r.offset, r.feature]), abs=0.05)


def test_back_fill_reads_each_value_once(spark):
    """A long range takes time in proportion to its rows: 60,000 rows a range; made anew from each row on, it would be some 1.8 billion steps."""
    import time

    df = spark.range(0, 60_000, 1, 1).select(F.lit("s").alias("s"), F.col("id").alias("t"), F.when(F.col("id") == 59_998, 1.5).alias("v"))
    start = time.time()
    found = windowed.back_fill(df, ["s"], "t", "v").agg(F.count("filled").alias("n"), F.max("filled").alias("v"), F.count(F.lit(1)).alias("rows")).first()
    assert (found.n, found.v, found.rows) == (59_999, 1.5, 60_000) and time.time() - start < 20


def test_reads_of_a_run_are_not_brought_to_one_task(spark):
    """However large the planner takes the samples for, they come to the reads."""
    from tessera.operators import joins

    reads = spark.createDataFrame([(i, "run1", "TGGACGTACGTCCAGCTG") for i in range(4)], "read_id long, run string, seq string")
    samples = spark.createDataFrame([("run1", "s", 8, "TGG", "CCAGCTG")], "run string, sample string, var_len int, left_barcode string, right_barcode string").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = joins.demultiplex(reads, samples)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(tuple(r) for r in found.collect()) == [("s", i, "ACGTACGT") for i in range(4)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranks_make_their_rows_once(spark):
    """What makes the table runs once, whatever it costs."""
    ran = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(i):
        ran.add(1)
        return i

    df = spark.range(0, 500, 1, 2).select(seen.asNondeterministic()("id").alias("id"))
    assert sorted(r["rank"] for r in splits.ranked(df, "id", rows_per_range=100).collect()) == list(range(500)) and ran.value == 500
