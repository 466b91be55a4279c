"""Window functions over counts, statistics and trajectories; top-k and order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequences import pack


def latest(rows: DataFrame, keys: list[str], at: str, ties: list[str] | None = None) -> DataFrame:
    """The newest row of each key: an aggregate with partial maxima, so a hot key costs one row per task."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(at, *(ties or []))).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*rows.columns)


def best_window(scores: DataFrame, probe: str = "seq", pos: str = "pos", score: str = "score") -> DataFrame:
    """Position and value of each probe's best window, the first of equal ones."""
    return scores.groupBy(probe).agg(F.max_by(pos, F.struct(score, -F.col(pos))).alias(pos), F.max(score).alias(score))


#: Rows that one task sorts together.
ROWS_PER_RANGE = 65_536


def _ranges(rows: DataFrame, at: str, per: int) -> DataFrame:
    """Adds ``_range``: slices of about ``per`` rows in the order of ``at``, cut at its quantiles, so outliers and gaps don't matter; null places are -1."""
    place = F.col(at).cast("double")
    parts = -(-rows.count() // per)
    bounds = None if parts < 2 else rows.agg(F.percentile_approx(place, [i / parts for i in range(1, parts)], max(10_000, 10 * parts)).alias("b")).first()["b"]
    if not bounds:
        return rows.withColumn("_range", F.lit(0).cast("long"))
    cuts = np.unique(np.array(bounds, dtype=np.float64))

    @F.pandas_udf("long")
    def of(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, places.to_numpy(dtype=np.float64), side="right"))

    return rows.withColumn("_range", F.when(place.isNull(), F.lit(-1).cast("long")).otherwise(of(place)))


def moving_average(rows: DataFrame, series: list[str], at: str, value: str, points: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``average`` over ``points`` rows centred on each, by a numeric ``at``; null where the frame is short.

    Rows are numbered within their series by ranges of ``at``, cut into blocks of exactly
    ``rows_per_range`` numbers, and each block gets copies of the rows at its borders, so a long
    series is many tasks. Null places come first.
    """
    half = points // 2
    per = max(rows_per_range, half + 1)
    ranged = _ranges(rows, at, per)
    sizes = ranged.groupBy(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(series)], F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[f"_s{i}" for i in range(len(series))]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = F.col("_range") == F.col("_r")
    for i, s in enumerate(series):
        same = same & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    inside = F.row_number().over(Window.partitionBy(*series, "_range").orderBy(at)) - 1
    numbered = ranged.withColumn("_in", inside).join(offsets, same).withColumn("_nth", F.col("_before") + F.col("_in"))
    block, place = F.floor(F.col("_nth") / per), F.col("_nth") % per
    no = F.lit(None).cast("long")
    to = F.array_compact(F.array(block, F.when(place < half, block - 1).otherwise(no), F.when(place >= per - half, block + 1).otherwise(no)))
    copied = numbered.withColumn("_own", block).withColumn("_block", F.explode(to))
    frame = Window.partitionBy(*series, "_block").orderBy("_nth").rowsBetween(-half, half)
    made = copied.withColumn("average", F.when(F.count(F.lit(1)).over(frame) == 2 * half + 1, F.avg(value).over(frame)))
    return made.where("_own = _block").select(*rows.columns, "average")


def back_fill(rows: DataFrame, series: list[str], at: str, value: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``filled``: the next value that is not null, from the row itself on, by a numeric ``at``.

    Series are cut into ranges of ``at``; a range that ends without a value takes the first one of
    the ranges after it, from an aggregate of one row a range. Ranges are read backwards, as a
    frame that ends at the current row is carried on, where one that starts there is made anew a row.
    """
    ranged = _ranges(rows, at, rows_per_range)
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(F.col(at)))).alias("_first")
    heads = ranged.groupBy(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(series)], F.col("_range").alias("_r")).agg(first)
    later = Window.partitionBy(*[f"_s{i}" for i in range(len(series))]).orderBy("_r").rowsBetween(1, Window.unboundedFollowing)
    heads = heads.withColumn("_later", F.first("_first", ignorenulls=True).over(later))
    same = F.col("_range") == F.col("_r")
    for i, s in enumerate(series):
        same = same & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    frame = Window.partitionBy(*series, "_range").orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("_here", F.last(value, ignorenulls=True).over(frame))
    return own.join(heads, same).select(*rows.columns, F.coalesce("_here", "_later").alias("filled"))


def top_words(counts: DataFrame, k: int, kmer: str = "kmer", n: str = "n") -> DataFrame:
    """The ``k`` highest counts, smaller words first among equal ones, in ascending order of count."""
    return counts.orderBy(F.desc(n), kmer).limit(k).orderBy(n, F.desc(kmer))


def in_key_order(counts: DataFrame, kmer: str = "kmer") -> DataFrame:
    """Rows by packed value with their ``code``; for words of one length that is the order of letters."""
    return counts.withColumn("code", pack(kmer)).orderBy("code")
