"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import affinity, counts, joins, markov
from tessera.plans import fixtures as X
from tessera.plans.fixtures import sql_window_score, sql_windows, with_tables
from tessera.plans.registry import query

MATCHED = "matched AS (SELECT s.sample, r.read_id, substr(r.seq, length(left_barcode) + 1, var_len) AS region FROM reads r JOIN samples s ON r.run = s.run AND starts_with(r.seq, left_barcode) AND substr(r.seq, length(left_barcode) + var_len + 1, length(right_barcode)) = right_barcode)"


@query("c1_demultiplex", with_tables("reads samples", f"{MATCHED} SELECT * FROM matched"))
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.demultiplex(X.reads(spark, sf_dir), X.samples(spark, sf_dir))


def sql_counts(name: str, source: str, k: int, weight: str | None = None) -> str:
    """A clause of weighted k-mer counts."""
    return f"{name} AS (SELECT w AS kmer, CAST({f'sum({weight})' if weight else 'count(*)'} AS BIGINT) AS n FROM (SELECT unnest({sql_windows('seq', k)}) AS w{', ' + weight if weight else ''} FROM {source}) GROUP BY w)"


@query("c2_prefix_join", with_tables("contigs", f"{sql_counts('a', 'contigs', 4)}, {sql_counts('b', 'contigs', 3)} SELECT a.kmer, a.n, substr(a.kmer, 1, 3) AS prefix, b.n AS n_prefix FROM a LEFT JOIN b ON substr(a.kmer, 1, 3) = b.kmer"))
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = X.contigs(spark, sf_dir)
    return joins.with_prefix_counts(counts.count_kmers(contigs, 4), counts.count_kmers(contigs, 3))


#: Transition model of 3-mers of the probes, and each probe's chance under it.
MODEL3 = f"{sql_counts('k3', 'probes', 3, 'n')}, model AS (SELECT kmer, n, n / sum(n) OVER (PARTITION BY substr(kmer, 1, 2)) AS p, n / sum(n) OVER () AS share FROM k3)"


def sql_chance(source: str, key: str, model: str = "model", m: int = 3, keep: str = "") -> str:
    kept = f", {keep}" if keep else ""
    chance = "CASE WHEN i = 1 THEN share ELSE p END" if m > 1 else "share"
    return f"""SELECT {key}{kept}, CASE WHEN count(*) FILTER (coalesce({chance}, 0) <= 0) > 0 THEN 0 ELSE exp(sum(ln({chance}))) END AS p
        FROM (SELECT {key}{kept}, i, substr({key}, i, {m}) AS part FROM (SELECT {key}{kept}, unnest(range(1, length({key}) - {m} + 2)) AS i FROM {source})) LEFT JOIN (SELECT kmer AS w, p, share FROM {model}) ON w = part GROUP BY {key}{kept}"""


def model3(probes: DataFrame) -> DataFrame:
    return markov.transition_model(counts.count_kmers(probes, 3, weight="n"))


@query("c3_window_transitions", with_tables("probes", f"{MODEL3} SELECT seq, round(ln(p), 6) AS log_p FROM ({sql_chance('probes', 'seq')})"))
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = X.probes(spark, sf_dir)
    return markov.model_probability(probes, model3(probes), 3).select("seq", F.round(F.ln("p"), 6).alias("log_p"))


@query("c4_full_outer_counts", with_tables("rounds", "SELECT seq, c0 AS first, c1 AS second, CAST(c0 + c1 AS BIGINT) AS both FROM rounds"))
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = X.rounds(spark, sf_dir)
    first, second = rounds.where("c0 > 0").select("seq", F.col("c0").alias("n")), rounds.where("c1 > 0").select("seq", F.col("c1").alias("n"))
    return joins.combine_counts({"first": first, "second": second, "both": first.union(second)})


@query("c5_observed_predicted", with_tables("probes", f"{MODEL3}, {sql_counts('k5', 'probes', 5, 'n')}, chances AS ({sql_chance('k5', 'kmer', keep='n')}) SELECT kmer, n, round(p * (SELECT sum(n) FROM k5), 4) AS expected FROM chances"))
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = X.probes(spark, sf_dir)
    observed = counts.count_kmers(probes, 5, weight="n")
    total = observed.agg(F.sum("n").alias("_total"))
    chance = markov.model_probability(observed, model3(probes), 3, "kmer").crossJoin(F.broadcast(total)).select("kmer", (F.col("p") * F.col("_total")).alias("expected"))
    return joins.observed_and_predicted(observed, chance).select("kmer", "n", F.round("expected", 4).alias("expected"))


@query("c6_round_zero", with_tables("samples", "SELECT s.run, s.sample, s.round, z.left_barcode AS round0_left, z.var_len AS round0_len FROM samples s LEFT JOIN samples z ON s.round0_run = z.run AND s.round0_sample = z.sample"))
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_round_zero(X.samples(spark, sf_dir)).select("run", "sample", "round", "round0_left", "round0_len")


@query("c7_compatible_barcodes", with_tables("samples", "SELECT sample, left_barcode IN ('TGG', 'GAT') AS compatible FROM samples WHERE run = 'runO'"))
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = X.samples(spark, sf_dir)
    gain, model = samples.where("run = 'runO'"), samples.where("run = 'runF' AND left_barcode <> 'CCA'")
    model = model.union(samples.where("run = 'runO' AND left_barcode IN ('TGG', 'GAT')"))
    semi = joins.compatible_samples(gain, model).select("sample", F.lit(True).alias("compatible"))
    return semi.union(joins.compatible_samples(gain, model, False).select("sample", F.lit(False)))


@query("c8_windows_by_mode", with_tables("probes", f"SELECT seq, 0 AS mode, round(list_sum(list_transform({sql_windows('seq', 3)}, lambda w: {sql_window_score('w', X.NARROW)})), 6) AS score FROM probes UNION ALL SELECT seq, 1, round(list_sum(list_transform({sql_windows('seq', 5)}, lambda w: {sql_window_score('w', X.WIDE)})), 6) FROM probes"))
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = affinity.scored_windows(X.probes(spark, sf_dir), [X.NARROW, X.WIDE])
    return rows.groupBy("seq", "mode").agg(F.round(F.sum("score"), 6).alias("score"))


@query("c9_shape_lookup", with_tables("probes shape", f"w AS (SELECT seq, unnest({sql_windows('seq', 5)}) AS pentamer FROM probes) SELECT seq, feature, round(sum(value), 6) AS value FROM w JOIN shape USING (pentamer) GROUP BY seq, feature"))
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.sequences import windows

    rows = X.probes(spark, sf_dir).select("seq", F.explode(windows("seq", 5)).alias("pentamer"))
    joined = rows.join(F.broadcast(X.shape(spark, sf_dir)), "pentamer")  # 1024 rows a feature
    return joined.groupBy("seq", "feature").agg(F.round(F.sum("value"), 6).alias("value"))


@query("c10_snapshot_binding", with_tables("examples", "SELECT id, id % 3 AS snap, round(list_sum(list_transform(features, lambda x: x * ((id % 3) + 1) / 10.0::DOUBLE)), 6) AS dot FROM examples"))
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.sequences import dot

    bound = X.examples(spark, sf_dir).withColumn("snap", F.col("id") % 3)
    snapshots = bound.select("snap").distinct().select("snap", F.array_repeat((F.col("snap") + 1) / 10.0, 64).alias("theta"))
    return joins.with_snapshots(bound, snapshots).select("id", "snap", F.round(dot("features", "theta"), 6).alias("dot"))


FILLED = """filled AS (SELECT kmer, o AS "offset", substr(fill, 1, o) || kmer || substr(fill, o + 1) AS seq
    FROM k, (SELECT unnest(range(0, 3)) AS o), (SELECT a || b AS fill FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS a), (SELECT unnest(['A', 'C', 'G', 'T']) AS b)))"""


@query("c11_fill_ins", with_tables("probes", f"k AS (SELECT DISTINCT unnest({sql_windows('seq', 5)}) AS kmer FROM probes), {FILLED} SELECT kmer, \"offset\", count(*) AS words, min(seq) AS least, max(seq) AS greatest FROM filled GROUP BY kmer, \"offset\""))
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kmers = counts.count_kmers(X.probes(spark, sf_dir), 5).select("kmer")
    made = joins.fill_ins(kmers, 7, k=5).withColumn("offset", F.col("offset").cast("bigint"))
    return made.groupBy("kmer", "offset").agg(F.count(F.lit(1)).alias("words"), F.min("seq").alias("least"), F.max("seq").alias("greatest"))
