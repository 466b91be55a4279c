"""Queries of unions, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.draws import KEYS, binomial_sql
from tessera.functions.draws import keyed_sql as sql_keyed
from tessera.operators import splits
from tessera.plans import fixtures as X
from tessera.plans.fixtures import with_tables
from tessera.plans.registry import query
from tessera.sources.shared import written

RANKED = f"r AS (SELECT *, row_number() OVER (ORDER BY {sql_keyed('code')}, code) - 1 AS rank, count(*) OVER () AS total FROM probes)"


@query("g1_union_all", with_tables("rounds", "u AS (SELECT seq, c0 AS n FROM rounds WHERE c0 > 0 UNION ALL SELECT seq, c1 FROM rounds WHERE c1 > 0) SELECT seq, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM u"))
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = X.rounds(spark, sf_dir)
    both = splits.union_probes(*[rounds.where(f"c{i} > 0").select("seq", F.col(f"c{i}").alias("n")) for i in (0, 1)])
    return both.crossJoin(F.broadcast(both.agg(F.sum("n").cast("bigint").alias("total"))))


@query("g2_proportional_split", with_tables("probes", f"{RANKED} SELECT code, CASE WHEN rank < ceil(total * 0.5) THEN 0 WHEN rank < ceil(total * 0.5) + ceil(total * 0.3) THEN 1 ELSE 2 END AS part FROM r"))
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.proportional_split(X.probes(spark, sf_dir), "code", (0.5, 0.3, 0.2)).select("code", "part")


@query(
    "g3_thinning",
    with_tables(
        "probes",
        f"""c AS (SELECT code, n, unnest([{", ".join(f"{{'fold': {f}, 'key': {sql_keyed('code', f)}}}" for f in range(3))}]) AS f FROM probes),
        d AS (SELECT f.fold AS fold, code, n, {binomial_sql("n", 0.3, "f.key")} AS t FROM c), e AS (SELECT fold, code, true AS test, t AS n FROM d UNION ALL SELECT fold, code, false, n - t FROM d)
        SELECT CAST(fold AS INTEGER) AS fold, code, test, CAST(n AS BIGINT) AS n FROM e WHERE n > 0""",
    ),
)
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.thinned(X.probes(spark, sf_dir), "code", 0.3, 3)


@query("g4_coin_split", with_tables("probes", f"SELECT code, {sql_keyed('code')} % 2 = 1 AS test FROM probes"))
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.coin_split(X.probes(spark, sf_dir), "code").select("code", "test")


@query("g5_equal_split", with_tables("probes", f"{RANKED} SELECT code, CAST(floor(rank / ceil(total / 7)) AS INTEGER) AS part FROM r"))
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.equal_split(X.probes(spark, sf_dir), "code", 7).select("code", "part")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probes written once, as a sample scans their codes a few times."""
    return written(X.probes(spark, sf_dir), "probes")


@query("g6_minibatch", with_tables("probes", f"SELECT code, n FROM probes ORDER BY {sql_keyed('code', 3)}, code LIMIT 500"))
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.minibatch(_probes(spark, sf_dir), "code", 500, 3).select("code", "n")


@query("g7_nested_minibatch", with_tables("probes", f"pool AS (SELECT * FROM probes ORDER BY {sql_keyed('code', 1)}, code LIMIT 2000) SELECT code, n FROM pool ORDER BY {sql_keyed('code', 9)}, code LIMIT 100"))
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.nested_minibatch(_probes(spark, sf_dir), "code", 2000, 100, 1, 9).select("code", "n")


@query("g8_sub_epochs", with_tables("probes", f"{RANKED} SELECT code, CAST(floor(rank / (floor(total / 80) * 20)) AS INTEGER) AS block FROM r WHERE floor(rank / (floor(total / 80) * 20)) < 4"))
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sub_epochs(X.probes(spark, sf_dir), "code", 4, 20).select("code", "block")


@query("g9_reservoir", with_tables("probes", f"SELECT code, n FROM probes ORDER BY {sql_keyed('code', 7)}, code LIMIT 300"))
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of fixed size."""
    return splits.fixed_sample(_probes(spark, sf_dir), "code", 300, 7).select("code", "n")


@query("g10_unroll", with_tables("probes", "SELECT seq, unnest(range(1, n + 1)) AS copy FROM probes"))
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.unrolled(X.probes(spark, sf_dir)).select("seq", "copy")


@query(
    "g11_stratified_universe",
    with_tables(
        "probes",
        f"s AS (SELECT range AS stratum, 65 + (range < 536)::INT AS size, range * 65 + least(range, 536) AS low FROM range(1000)), d AS (SELECT stratum, CAST(low + CAST({sql_keyed('stratum', 5)} AS HUGEINT) * size // {KEYS} AS BIGINT) AS code FROM s) SELECT stratum, code, coalesce(n, 0) AS n FROM d LEFT JOIN probes USING (code)",
    ),
)
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word from each slice of the universe with the reads that the probes have of it."""
    strata = splits.stratified_universe(spark, X.PROBE_LENGTH, 1000, 5)
    return strata.join(X.probes(spark, sf_dir), "code", "left").select("stratum", "code", F.coalesce("n", F.lit(0)).alias("n"))
