"""Unions, splits and samples whose outcome depends on row ids alone."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.draws import HALF, KEYS, binomial, keyed
from tessera.sources.shared import written


def union_probes(*tables: DataFrame) -> DataFrame:
    """All probes, duplicates kept."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


#: Rows that one task sorts together.
ROWS_PER_RANGE = 65_536


def ranked(df: DataFrame, id_col: str, step: int = 0, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``rank`` (from 0) in keyed order and the table's ``rows``.

    The order is cut into ranges of the key, as many as the table's size asks for; one aggregate
    gives each range's offset and only rows of one range are sorted together. Rows are written
    with their keys once, so what makes them runs once.
    """
    made = written(df.withColumn("_key", keyed(id_col, step)), "keyed")
    bits = math.ceil(math.log2(1 + made.count() // rows_per_range))
    rows = made.withColumn("_bucket", F.shiftright("_key", 2 * HALF - bits))
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # 2**bits rows
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("rows"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", id_col)) - 1
    return rows.join(offsets, "_bucket").withColumn("rank", F.col("_before") + inside).drop("_key", "_bucket", "_before")


def proportional_split(df: DataFrame, id_col: str, shares: Sequence[float], step: int = 0) -> DataFrame:
    """Adds ``part``: parts of exactly ceil(rows * share) rows each until the rows run out."""
    part, until = F.lit(len(shares) - 1), F.lit(0)
    bounds = []
    for s in shares:
        until = until + F.ceil(F.col("rows") * s)
        bounds.append(until)
    for i in reversed(range(len(shares))):
        part = F.when(F.col("rank") < bounds[i], i).otherwise(part)
    return ranked(df, id_col, step).withColumn("part", part).drop("rank", "rows")


def equal_split(df: DataFrame, id_col: str, parts: int, step: int = 0) -> DataFrame:
    """Adds ``part``: ``parts`` pieces of ceil(rows / parts) rows in keyed order."""
    return ranked(df, id_col, step).withColumn("part", F.floor(F.col("rank") / F.ceil(F.col("rows") / parts)).cast("int")).drop("rank", "rows")


def unrolled(probes: DataFrame, n: str = "n") -> DataFrame:
    """One row per read, with its number ``copy`` from 1; made in pieces, so no array is longer than 65,536 or a 65,536th of ``n``."""
    zero, most = F.lit(0).cast("long"), 1 << 16
    pieces = probes.where(F.col(n) > 0).withColumn("_piece", F.explode(F.sequence(zero, F.shiftright(F.col(n).cast("long") - 1, 16))))
    first = F.col("_piece") * most
    return pieces.withColumn("copy", F.explode(F.sequence(first + 1, F.least(first + most, F.col(n).cast("long"))))).drop("_piece")


def thinned(probes: DataFrame, id_col: str, share: float, folds: int, n: str = "n") -> DataFrame:
    """``fold, id_col, test, n``: each read goes to the test side with chance ``share``, anew in each fold.

    A probe can be on both sides. How many of its reads go is one binomial draw from its id and
    the fold, whatever its count: a row comes back for each fold and side that has any.
    """
    rows = probes.where(F.col(n) > 0).select(id_col, F.col(n).cast("long").alias("_n"), F.posexplode(F.array(*[keyed(id_col, f) for f in range(folds)])).alias("fold", "_key"))
    rows = rows.withColumn("_test", binomial(F.col("_n"), share, F.col("_key")))
    sides = F.array(F.struct(F.lit(True).alias("test"), F.col("_test").alias("n")), F.struct(F.lit(False).alias("test"), (F.col("_n") - F.col("_test")).alias("n")))
    return rows.select("fold", id_col, F.explode(sides).alias("_s")).select("fold", id_col, "_s.test", "_s.n").where("n > 0")


def coin_split(df: DataFrame, id_col: str, step: int = 0) -> DataFrame:
    """Adds ``test``: whole rows go to one side by the parity of their key."""
    return df.withColumn("test", keyed(id_col, step) % 2 == 1)


#: Bits of a key that one count of keys tells apart.
_BITS = 12


def least_keys(df: DataFrame, id_col: str, size: int, step: int = 0) -> DataFrame:
    """The ``size`` rows with the smallest keys, found without a sort.

    Keys are counted by their top bits, then those of the slice where the size is reached by
    their next bits, until a slice goes in whole; counts are at most 4,096 numbers. What
    remains is a filter, so a sample of any size stays where its rows are. ``df`` is scanned
    a few times for its ids and should be a written table. Rows of one id have one key; if not
    all of them fit, some do.
    """
    key = keyed(id_col, step)
    low, width, left = 0, 2 * HALF, size  # keys from ``low`` on, ``left`` of which are still wanted
    while left > 0 and width > 0:
        narrow = max(0, width - _BITS)
        inside = df if width == 2 * HALF else df.where((key >= low) & (key < low + (1 << width)))
        found = {r["s"]: r["n"] for r in inside.select(F.shiftright(key - low, narrow).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect() if r["s"] is not None}
        at = 0
        for at in sorted(found):
            if found[at] > left:
                break
            left -= found[at]
        else:
            return df.where(key < low + (1 << width))
        low, width = low + (at << narrow), narrow
    return df.where(key < low) if left <= 0 else df.where(key < low).unionByName(df.where(key == low).limit(left))


def minibatch(df: DataFrame, id_col: str, size: int, step: int = 0) -> DataFrame:
    """``size`` distinct rows, drawn without replacement; batches of different steps are independent."""
    return least_keys(df, id_col, size, step)


def nested_minibatch(df: DataFrame, id_col: str, pool: int, size: int, pool_step: int, step: int) -> DataFrame:
    """A batch drawn only from a pool that stays for many steps; the pool itself if it is not larger."""
    own = minibatch(df, id_col, pool, pool_step)
    return own if size >= pool else minibatch(own, id_col, size, step)


def sub_epochs(df: DataFrame, id_col: str, k: int, batch: int, step: int = 0) -> DataFrame:
    """Adds ``block``: a permutation cut into ``k`` blocks of floor(rows / k / batch) batches; the tail is unused and left out."""
    block = F.floor(F.col("rows") / (k * batch)) * batch
    return ranked(df, id_col, step).withColumn("block", F.floor(F.try_divide(F.col("rank"), block)).cast("int")).where(F.col("block") < k).drop("rank", "rows")


def fixed_sample(df: DataFrame, id_col: str, size: int, seed: int) -> DataFrame:
    """A sample of fixed size in which every row is as likely as any other, whatever the table's size."""
    return least_keys(df, id_col, size, seed)


def stratified_universe(spark, length: int, samples: int, seed: int) -> DataFrame:
    """``stratum, code``: one keyed draw from each of ``samples`` slices of [0, 4**length), the first ones longer by one.

    Codes are 64-bit numbers, so words have at most 31 bases; places inside a slice come from
    products of up to 38 digits.
    """
    if length > 31:
        raise ValueError("codes of words longer than 31 bases pass 64 bits")
    width, over = divmod(4**length, samples)
    low = F.col("id") * F.lit(width) + F.least(F.col("id"), F.lit(over))
    size = F.lit(width) + F.when(F.col("id") < over, 1).otherwise(0)
    wide = lambda c: c.cast("decimal(19,0)")
    inside = F.floor(wide(keyed("id", seed)) * wide(size) / F.lit(KEYS).cast("decimal(19,0)"))
    return spark.range(samples).select(F.col("id").alias("stratum"), (low + inside.cast("long")).alias("code"))
