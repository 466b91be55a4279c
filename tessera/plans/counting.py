"""Queries of counts, Markov models, background likelihoods, window functions and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import affinity, counts, markov, windowed
from tessera.plans import fixtures as X
from tessera.plans.fixtures import sql_probe_score, sql_windows, with_tables
from tessera.plans.fixtures import sql_reverse_complement as rc
from tessera.plans.joining import MATCHED, MODEL3, model3, sql_chance, sql_counts
from tessera.plans.registry import query

CONTIGS = "contigs"


@query("d1_kmer_count", with_tables(CONTIGS, f"{sql_counts('k', 'contigs', 6)} SELECT * FROM k"))
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_kmers(X.contigs(spark, sf_dir), 6)


@query("d2_both_strands", with_tables(CONTIGS, f"w AS (SELECT unnest({sql_windows('seq', 5)}) AS w FROM contigs), b AS (SELECT w AS kmer FROM w UNION ALL SELECT {rc('w')} FROM w) SELECT kmer, count(*) AS n FROM b GROUP BY kmer"))
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_kmers(X.contigs(spark, sf_dir), 5, both_strands=True)


@query("d3_anchored_count", with_tables(CONTIGS, "SELECT substr(seq, 8, 4) AS kmer, count(*) AS n FROM contigs WHERE length(seq) >= 11 GROUP BY 1"))
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_anchored(X.contigs(spark, sf_dir), 4, 7)


@query("d4_contig_count", f"WITH g AS (SELECT regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents), w AS (SELECT unnest({sql_windows('seq', 5)}) AS w FROM g), f AS (SELECT w FROM w WHERE NOT regexp_matches(w, 'AAA')), b AS (SELECT w AS kmer FROM f UNION ALL SELECT {rc('w')} FROM f) SELECT kmer, count(*) AS n FROM b GROUP BY kmer")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").select(F.col("text").alias("seq"))
    return counts.count_contigs(docs, 5, both_strands=True, exclude="AAA")


@query("d5_summary", with_tables(CONTIGS, f"{sql_counts('k', 'contigs', 6)} SELECT CAST(sum(n) AS BIGINT) AS total, min(n) AS lowest, max(n) AS highest, count(*) AS words FROM k"))
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.summary(d1(spark, sf_dir))


@query(
    "d6_read_funnel",
    with_tables(
        "reads samples",
        """j AS (SELECT s.sample, starts_with(seq, left_barcode) AS l, starts_with(seq, left_barcode) AND substr(seq, length(left_barcode) + var_len + 1, length(right_barcode)) = right_barcode AS b,
           substr(seq, length(left_barcode) + 1, var_len) AS region FROM reads JOIN samples s USING (run))
        SELECT sample, count(*) AS reads, count(*) FILTER (l) AS left_matched, count(*) FILTER (b) AS matched, count(*) FILTER (b AND regexp_full_match(region, '[ACGTacgt]+')) AS valid,
               count(*) FILTER (b AND regexp_full_match(region, '[ACGTacgt]+') AND regexp_matches(region, 'GC')) AS kept FROM j GROUP BY sample""",
    ),
)
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.read_funnel(X.reads(spark, sf_dir), X.samples(spark, sf_dir), include="GC")


FREQUENCY = "SELECT {by}pos, base, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY {by}pos), 9) AS freq FROM letters GROUP BY {by}pos, base"
LETTERS = "letters AS (SELECT {by}CAST(i - 1 AS INTEGER) AS pos, substr(upper({seq}), i, 1) AS base FROM (SELECT {by}{seq}, unnest(range(1, length({seq}) + 1)) AS i FROM {source} WHERE regexp_full_match({seq}, '[ACGTacgt]+')))"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("freq", F.round("freq", 9))


@query("d7_base_frequency", with_tables("reads", LETTERS.format(by="", seq="seq", source="reads") + FREQUENCY.format(by="")))
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(counts.base_frequency(X.reads(spark, sf_dir), width=18))


@query("d8_sample_frequency", with_tables("reads samples", MATCHED + ", " + LETTERS.format(by="sample, ", seq="region", source="matched") + FREQUENCY.format(by="sample, ")))
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.joins import demultiplex

    return rounded(counts.base_frequency(demultiplex(X.reads(spark, sf_dir), X.samples(spark, sf_dir)), "region", by=("sample",)))


@query("d9_weighted_frequency", with_tables("probes", "letters AS (SELECT CAST(i - 1 AS INTEGER) AS pos, substr(seq, i, 1) AS base, n FROM (SELECT seq, n, unnest(range(1, 9)) AS i FROM probes)) SELECT pos, base, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / sum(sum(n)) OVER (PARTITION BY pos), 9) AS freq FROM letters GROUP BY pos, base"))
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(counts.base_frequency(X.probes(spark, sf_dir), weight="n"))


KMAX = "rows AS (SELECT seq, n, unnest(range(1, 7)) AS k FROM probes), w AS (SELECT k, n, unnest(list_transform(range(1, length(seq) - k + 2), lambda i: substr(seq, i, k))) AS kmer FROM rows), c AS (SELECT k, kmer, sum(n) AS n FROM w GROUP BY k, kmer), l AS (SELECT k, min(n) AS lowest FROM c GROUP BY k)"


@query("d10_kmax", with_tables("probes", f"{KMAX} SELECT CAST(coalesce(min(k) FILTER (lowest <= 100), 6) - 1 AS INTEGER) AS kmax FROM l"))
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.kmax(X.probes(spark, sf_dir), 100, 6, weight="n")


@query("d11_transition_model", with_tables("probes", f"{MODEL3} SELECT kmer, n, substr(kmer, 1, 2) AS context, substr(kmer, 3, 1) AS base, round(p, 9) AS p, round(share, 9) AS share FROM model"))
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model3(X.probes(spark, sf_dir)).withColumns({"p": F.round("p", 9), "share": F.round("share", 9)})


@query("d12_division_model", with_tables("probes", f"{sql_counts('a', 'probes', 3, 'n')}, {sql_counts('b', 'probes', 2, 'n')} SELECT a.kmer, a.n, round((a.n / (SELECT sum(n) FROM a)) / (b.n / (SELECT sum(n) FROM b)), 9) AS p FROM a LEFT JOIN b ON substr(a.kmer, 1, 2) = b.kmer"))
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = X.probes(spark, sf_dir)
    return markov.division_model(counts.count_kmers(probes, 3, weight="n"), counts.count_kmers(probes, 2, weight="n")).withColumn("p", F.round("p", 9))


@query("d13_expected_counts", with_tables("probes", f"{MODEL3}, chances AS ({sql_chance('probes', 'seq')}) SELECT seq, round(p * (SELECT sum(n) FROM probes), 6) AS expected FROM chances"))
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = X.probes(spark, sf_dir)
    made = markov.model_probability(probes, model3(probes), 3).crossJoin(F.broadcast(probes.agg(F.sum("n").alias("_total"))))
    return made.select("seq", F.round(F.col("p") * F.col("_total"), 6).alias("expected"))


@query("d13_left_flank", with_tables("probes", f"{MODEL3} SELECT seq, round(exp(sum(ln(p))), 12) AS p FROM (SELECT seq, unnest({sql_windows(chr(39) + 'GC' + chr(39) + ' || seq', 3)}) AS kmer FROM probes) JOIN model USING (kmer) GROUP BY seq"))
def d13_flank(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = X.probes(spark, sf_dir)
    return markov.model_probability(probes, model3(probes), 3, left_flank=X.LEFT_FLANK).select("seq", F.round("p", 12).alias("p"))


SPLIT = "halves AS (SELECT *, code % 2 AS half FROM probes), train AS (SELECT * FROM halves WHERE half = 0), test AS (SELECT * FROM halves WHERE half = 1)"


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    probes = X.probes(spark, sf_dir)
    return probes.where("code % 2 = 0"), probes.where("code % 2 = 1")


def sql_order(m: int) -> str:
    """Clauses t{m}, m{m} and r{m}: counts, model and fit of one model length on test 4-mers."""
    model = f"m{m} AS (SELECT kmer, n / sum(n) OVER (PARTITION BY substr(kmer, 1, {m - 1})) AS p, n / sum(n) OVER () AS share FROM t{m})"
    return f"{sql_counts(f't{m}', 'train', m, 'n')}, {model}, c{m} AS ({sql_chance('observed', 'kmer', f'm{m}', m, 'n')}), r{m} AS (SELECT {m} AS m, corr(floor(p * (SELECT sum(n) FROM observed)), n::DOUBLE) AS r FROM c{m})"


ORDERS = f"{SPLIT}, {sql_counts('observed', 'test', 4, 'n')}, " + ", ".join(sql_order(m) for m in (1, 2, 3, 4)) + ", scores AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)"


@query("d14_cross_validation", with_tables("probes", f"{ORDERS} SELECT m, round(r, 6) AS r FROM scores"))
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = halves(spark, sf_dir)
    return markov.order_scores(train, test, (1, 2, 3, 4), 4).withColumn("r", F.round("r", 6))


GAIN = f"""{MODEL3}, {sql_counts('k5', 'probes', 5, 'n')}, c AS ({sql_chance('k5', 'kmer', keep='n')}), q AS (SELECT n, p, n / (SELECT sum(n) FROM c) AS q FROM c),
    s AS (SELECT sum(q * log2(q / p)) FILTER (n >= 200 AND p > 0) AS head, least(sum(q) FILTER (n >= 200), 1) AS sq, least(sum(p) FILTER (n >= 200), 1) AS sp, count(*) FILTER (n < 200) AS small FROM q)
    SELECT round(coalesce(head, 0) + CASE WHEN small > 0 AND coalesce(sq, 0) < 1 AND coalesce(sp, 0) < 1 THEN (1 - coalesce(sq, 0)) * log2((1 - coalesce(sq, 0)) / (1 - coalesce(sp, 0))) ELSE 0 END, 9) AS gain FROM s"""


@query("d15_information_gain", with_tables("probes", GAIN))
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = X.probes(spark, sf_dir)
    predicted = markov.model_probability(counts.count_kmers(probes, 5, weight="n"), model3(probes), 3, "kmer", ["n"])
    return markov.information_gain(predicted, 200).select(F.round("gain", 9).alias("gain"))


@query("d16_order_selection", with_tables("probes", f"{ORDERS} SELECT m, round(r, 6) AS r FROM scores ORDER BY coalesce(r, -2) DESC, m LIMIT 1"))
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = halves(spark, sf_dir)
    return markov.best_order(markov.order_scores(train, test, (1, 2, 3, 4), 4)).select("m", F.round("r", 6).alias("r"))


def sql_enrichment(longest: int, lengths: int, low: int, high: int) -> str:
    """kmax, best order and gains by SQL: all lengths and orders are worked out, then the chosen ones picked."""
    tops, orders = range(1, longest), range(1, longest)
    parts = [SPLIT, *(sql_counts(f"b{k}", "test", k, "n") for k in range(1, longest + 1)), *(sql_counts(f"t{m}", "train", m, "n") for m in orders)]
    parts += [f"m{m} AS (SELECT kmer, n / sum(n) OVER (PARTITION BY substr(kmer, 1, {m - 1})) AS p, n / sum(n) OVER () AS share FROM t{m})" for m in orders]
    parts.append("least AS (" + " UNION ALL ".join(f"SELECT {k} AS k, min(n) AS lowest FROM b{k}" for k in range(1, longest + 1)) + ")")
    parts.append(f"top AS (SELECT coalesce(min(k) FILTER (lowest <= {low}), {longest}) - 1 AS top FROM least)")
    for t in tops:
        parts += [f"c{t}_{m} AS ({sql_chance(f'b{t}', 'kmer', f'm{m}', m, 'n')})" for m in orders if m <= t]
    fits = [f"SELECT {t} AS t, {m} AS m, corr(floor(p * (SELECT sum(n) FROM b{t})), n::DOUBLE) AS r FROM c{t}_{m}" for t in tops for m in orders if m <= t]
    parts.append("fits AS (" + " UNION ALL ".join(fits) + ")")
    parts.append("best AS (SELECT m FROM fits, top WHERE t = top ORDER BY coalesce(r, -2) DESC, m LIMIT 1)")
    longer = range(1, longest + lengths)
    parts += [sql_counts(f"g{k}", "probes", k, "n") for k in longer if k <= X.PROBE_LENGTH]
    gains = []
    for k in longer:
        for m in orders:
            if m <= k <= X.PROBE_LENGTH:
                parts.append(f"h{k}_{m} AS ({sql_chance(f'g{k}', 'kmer', f'm{m}', m, 'n')})")
                gains.append(
                    f"""SELECT {k} AS k, {m} AS m, coalesce(sum(q * log2(q / p)) FILTER (n >= {high} AND p > 0), 0) AS head, coalesce(least(sum(q) FILTER (n >= {high}), 1), 0) AS sq,
                    coalesce(least(sum(p) FILTER (n >= {high}), 1), 0) AS sp, count(*) FILTER (n < {high}) AS small FROM (SELECT n, p, n / (SELECT sum(n) FROM h{k}_{m}) AS q FROM h{k}_{m})"""
                )
    parts.append("gains AS (" + " UNION ALL ".join(gains) + ")")
    return (
        ", ".join(parts)
        + f""" SELECT CAST(k AS INTEGER) AS k, CAST(m AS INTEGER) AS m, round(head + CASE WHEN small > 0 AND sq < 1 AND sp < 1 THEN (1 - sq) * log2((1 - sq) / (1 - sp)) ELSE 0 END, 6) AS gain
        FROM gains JOIN best USING (m), top WHERE k >= top AND k < top + {lengths}"""
    )


@query("d17_enrichment", with_tables("probes", sql_enrichment(6, 3, 20, 20)))
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kmax of the test half, the best model length, then gain over the following lengths."""
    train, test = halves(spark, sf_dir)
    return markov.enrichment(train, test, X.probes(spark, sf_dir), 20, 6, 3, 20).withColumn("gain", F.round("gain", 6))


@query("d18_feature_sums", with_tables("probes", f"f AS (SELECT 'GC' || seq || 'GA' AS seq, n FROM probes), {sql_counts('k', 'f', 3, 'n')} SELECT * FROM k"))
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.feature_sums(X.probes(spark, sf_dir), 3, X.LEFT_FLANK, X.RIGHT_FLANK, 2)


def sql_background(seq: str) -> str:
    return "(" + " + ".join(f"(length({seq}) - length(replace({seq}, '{b}', ''))) * ({w!r}::DOUBLE)" for b, w in zip("ACGT", X.BACKGROUND, strict=True)) + ")"


Z0 = f"z AS (SELECT sum(exp({sql_background('seq')})) AS z FROM universe)"


@query("d19_background_likelihood", with_tables("probes universe", f"{Z0}, s AS (SELECT sum(n) AS n, sum(n * {sql_background('seq')}) AS x FROM probes) SELECT round(n * ln(z) - x, 4) AS nll FROM s, z"))
def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, every = X.probes(spark, sf_dir), affinity.universe(spark, X.PROBE_LENGTH)
    z = every.agg(F.sum(F.exp(affinity.background("seq", X.BACKGROUND))).alias("z"))
    own = probes.agg(F.sum("n").alias("n"), F.sum(F.col("n") * affinity.background("seq", X.BACKGROUND)).alias("x"))
    return own.crossJoin(F.broadcast(z)).select(F.round(F.col("n") * F.ln("z") - F.col("x"), 4).alias("nll"))


PAIR_WEIGHTS = tuple((j * 7 % 5 - 2) / 10.0 for j in range(16))
FRAMED = "'GC' || seq || 'GA'"


def sql_pairs(seq: str) -> str:
    code = "4 * (strpos('ACGT', substr({w}, 1, 1))::INT - 1) + strpos('ACGT', substr({w}, 2, 1))::INT".replace("{w}", "w")
    return f"list_sum(list_transform({sql_windows(seq, 2)}, lambda w: list_extract({X.sql_list(PAIR_WEIGHTS)}, {code})))"


@query(
    "d19_word_gradient",
    with_tables(
        "probes universe",
        f"""u AS (SELECT {FRAMED} AS s, exp({sql_pairs(FRAMED)}) AS w FROM universe), e AS (SELECT kmer, sum(w) AS e FROM (SELECT w, unnest({sql_windows('s', 2)}) AS kmer FROM u) GROUP BY kmer),
        o AS (SELECT kmer, sum(n) AS observed FROM (SELECT n, unnest({sql_windows(FRAMED, 2)}) AS kmer FROM probes) GROUP BY kmer)
        SELECT kmer, CAST(coalesce(observed, 0) AS BIGINT) AS observed, round((SELECT sum(n) FROM probes) * e / (SELECT sum(w) FROM u) - coalesce(observed, 0), 4) AS gradient FROM e LEFT JOIN o USING (kmer)""",
    ),
)
def d19_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the background likelihood over pairs of neighbouring bases, flanks included."""
    found = affinity.background_gradient(X.probes(spark, sf_dir), affinity.universe(spark, X.PROBE_LENGTH), PAIR_WEIGHTS, 2, "GC", "GA")
    return found.select("kmer", "observed", F.round("gradient", 4).alias("gradient"))


@query("d20_saturated_likelihood", with_tables("probes", "SELECT CAST(sum(n) AS BIGINT) AS n_reads, round(sum(-n * ln(n)) + sum(n) * ln(sum(n)), 4) AS saturated FROM probes"))
def d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.saturated_likelihood(X.probes(spark, sf_dir)).select("n_reads", F.round("saturated", 4).alias("saturated"))


@query("d21_markov_likelihood", with_tables("probes universe", f"{MODEL3}, own AS ({sql_chance('probes', 'seq', keep='n')}), every AS ({sql_chance('universe', 'seq')}) SELECT round((SELECT sum(-n * ln(p)) FROM own) + (SELECT sum(n) FROM own) * ln((SELECT sum(p) FROM every)), 3) AS nll"))
def d21(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = X.probes(spark, sf_dir)
    return markov.table_likelihood(probes, affinity.universe(spark, X.PROBE_LENGTH), model3(probes), 3).select(F.round("nll", 3).alias("nll"))


GRAMS = "grid AS (SELECT a AS gram FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS a) UNION ALL SELECT a || b FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS a), (SELECT unnest(['A', 'C', 'G', 'T']) AS b))"


@query("d22_ngram_features", with_tables("probes", f"{GRAMS} SELECT code, gram, CAST(len(list_filter(range(1, 9), lambda i: substr(seq, i, length(gram)) = gram)) AS BIGINT) AS n FROM probes, grid"))
def d22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.ngram_features(X.probes(spark, sf_dir), 1, "code")


@query("d23_merge_counts", with_tables("probes", f"{sql_counts('k', 'probes', 4, 'n')} SELECT * FROM k"))
def d23(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = halves(spark, sf_dir)
    return counts.merge_counts(counts.count_kmers(train, 4, weight="n"), counts.count_kmers(test, 4, weight="n"))


@query("e1_share_in_group", with_tables("probes", "SELECT substr(seq, 1, 2) AS prefix, seq, round(n / sum(n) OVER (PARTITION BY substr(seq, 1, 2)), 9) AS freq FROM probes"))
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.with_share(X.probes(spark, sf_dir).withColumn("prefix", F.substring("seq", 1, 2)), ["prefix"]).select("prefix", "seq", F.round("freq", 9).alias("freq"))


@query("e2_latest_wins", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return windowed.latest(rows, ["user_id", "event_type"], "ts", ["event_id"]).drop("ts")


@query("e3_best_window", with_tables("probes", f"w AS (SELECT seq, i - 1 AS pos, {X.sql_window_score('substr(seq, i, 3)', X.NARROW)} AS score FROM (SELECT seq, unnest(range(1, 7)) AS i FROM probes)) SELECT seq, CAST(pos AS INTEGER) AS pos, round(score, 6) AS score FROM w QUALIFY row_number() OVER (PARTITION BY seq ORDER BY round(score, 9) DESC, pos) = 1"))
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = affinity.scored_windows(X.probes(spark, sf_dir), [X.NARROW]).groupBy("seq", "pos").agg(F.round(F.sum("score"), 9).alias("score"))
    return windowed.best_window(rows).withColumn("score", F.round("score", 6))


@query("e4_moving_average", "SELECT event_id, round(CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END, 6) AS average FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed.moving_average(X.table(spark, sf_dir, "events"), ["event_type"], "event_id", "value", 5).select("event_id", F.round("average", 6).alias("average"))


@query("e5_back_fill", "SELECT event_id, first_value(CASE WHEN event_id % 50 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM events")
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "events").withColumn("sparse", F.when(F.col("event_id") % 50 == 0, F.col("value")))
    return windowed.back_fill(rows, ["event_type"], "event_id", "sparse").select("event_id", "filled")


@query("f1_top_kmers", with_tables(CONTIGS, f"{sql_counts('k', 'contigs', 6)} SELECT * FROM k ORDER BY n DESC, kmer LIMIT 20"))
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed.top_words(d1(spark, sf_dir), 20)


@query("f2_key_order", with_tables("probes", "SELECT code, seq AS kmer, n FROM probes ORDER BY code"))
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed.in_key_order(X.probes(spark, sf_dir).select(F.col("seq").alias("kmer"), "n")).select("code", "kmer", "n")


@query("f3_best_words", with_tables("probes", f"SELECT seq, round({sql_probe_score('seq', X.NARROW)}, 6) AS score FROM probes ORDER BY round({sql_probe_score('seq', X.NARROW)}, 6) DESC, seq LIMIT 25"))
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = X.probes(spark, sf_dir).select("seq", F.round(affinity.probe_score("seq", [X.NARROW]), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "seq").limit(25)


@query("f4_score_cutoff", with_tables("probes", f"SELECT seq, n, round({sql_probe_score('seq', X.NARROW)}, 6) AS score FROM probes WHERE {sql_probe_score('seq', X.NARROW)} > 14"))
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = X.probes(spark, sf_dir).select("seq", "n", affinity.probe_score("seq", [X.NARROW]).alias("score"))
    return scored.where("score > 14").withColumn("score", F.round("score", 6))
