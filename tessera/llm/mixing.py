"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ROWS_PER_CELL, cell_bits, n_spaced_words, plain_text, running_total, written

#: Times a document may be taken at most.
MOST_PASSES = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """``_source, _named, source_size, target`` for each source of ``sizes(_source, _named, size)``.

    Sources in code-point order, the null one last, weigh 5, 2, 1, repeating. They share
    ``share`` times all sizes; a target stops at twice its source's size and what is beyond
    goes to the rest by weight until none is above. Ordered by 2 * size / weight, the saturated
    sources come first, so the common level follows from two running sums. One row per source
    is sorted in one place.
    """
    totals = sizes.groupBy("_source", "_named").agg(F.sum("size").alias("source_size"))
    listed = Window.orderBy(F.desc("_named"), "_source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(listed) - 1, F.lit(len(weights))).cast("int") + 1)
    weighed = totals.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * MOST_PASSES)
    by_level = Window.orderBy(F.col("_limit") / F.col("_weight"), F.desc("_named"), "_source")
    everywhere = Window.partitionBy(F.lit(0))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everywhere) * F.lit(share) - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("_weight").over(after)
    levels = weighed.withColumn("_level", level)
    fits = F.min(F.when(F.col("_level") <= F.col("_limit") / F.col("_weight"), F.struct(F.col("_limit") / F.col("_weight"), "_level"))).over(everywhere)
    final = F.coalesce(fits["_level"] * F.col("_weight"), F.col("_limit").cast("double"))
    return levels.select("_source", "_named", "source_size", F.least(F.col("_limit").cast("double"), final).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    seed: int = 42,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, taken, passes, finish, source``.

    Each source is a queue of its documents in a keyed random order, gone through twice at
    most. A document's virtual finish time is the source's words up to and with it, divided by
    the source's target. All queues are then range-sorted by finish time and cut at the total
    budget: only the range in which the budget runs out is sorted row by row. Documents are
    taken whole, so a source ends within one document of its target. ``taken`` counts the words
    taken, repeats included, ``passes`` how often, and ``finish`` is the first pass's time.

    A null text is empty; empty documents have size 0 and are taken in no pass. Null sources
    are one source, the last. Null or repeated ids are ordered by source and size; rows alike in
    all these may trade places. Sources without words get target 0. Seeded by ids alone, so
    reruns agree.
    """
    measured = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        F.col(source_col).isNotNull().alias("_named"),
        n_spaced_words(plain_text(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("_key"),
    )
    measured = written(measured, "measured")
    rows = measured.count()
    bits = cell_bits(rows, rows_per_cell)
    targets = written(source_targets(measured, weights, share), "targets")
    queued = running_total(measured, ["_source", "_named"], "_key", ["_id", "size"], F.col("size"), "_until", bits).join(targets, ["_source", "_named"])
    queued = written(queued.withColumn("finish", F.when(F.col("target") > 0, F.col("_until") / F.col("target")).otherwise(F.lit(0.0))), "queued")

    per_time = 1 << bits
    again = (F.col("source_size") + F.col("_until")) / F.col("target")
    served = (
        queued.where("size > 0")
        .withColumn("_pass", F.explode(F.array(F.lit(1), F.lit(MOST_PASSES))))
        .withColumn("_time", F.when(F.col("_pass") == 1, F.col("finish")).otherwise(again))
        .withColumn("_range", F.least(F.floor(F.col("_time") * per_time), F.lit(4 * per_time)).cast("long"))
    )
    total = targets.groupBy().agg(F.floor(F.sum("target") + 1e-6).cast("long").alias("_budget"))
    ranges = served.groupBy("_range").agg(F.sum("size").alias("_in_range"))
    up_to = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        ranges.withColumn("_before", F.coalesce(F.sum("_in_range").over(up_to), F.lit(0)))
        .crossJoin(F.broadcast(total))
        .where("_before <= _budget")
        .groupBy()
        .agg(F.max_by(F.struct("_range", "_before", "_budget"), "_range").alias("_cut"))
        .select("_cut.*")
    )
    order = ["_time", "_named", "_source", "_key", "_id", "_pass"]
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = (
        served.join(F.broadcast(cut), "_range")
        .withColumn("_sum", F.col("_before") + F.sum("size").over(inside))
        .where("_sum <= _budget")
        .groupBy()
        .agg(F.max(F.struct(*order)).alias("_last"))
    )
    edge = cut.crossJoin(last).select("_range", "_last")

    def within(n: int):
        time = F.col("finish") if n == 1 else again
        at = F.struct(time.alias("_time"), "_named", "_source", "_key", F.col("_id"), F.lit(n).alias("_pass"))
        place = F.floor(time * per_time)
        return F.when(F.col("size") == 0, 0).when(place < F.col("_range"), 1).when((place == F.col("_range")) & (at <= F.col("_last")), 1).otherwise(0)

    return (
        queued.crossJoin(F.broadcast(edge))  # one row
        .withColumn("passes", within(1) + within(2))
        .select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "passes", "finish", F.when(F.col("_named"), F.col("_source")).alias("source"))
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all their columns, as often as the mix takes them; rows that share an id are taken in the mix's order."""
    plan = mix_sources(docs, id_col, text_col, source_col, **options)
    key = F.struct(F.col(id_col).alias("id")).alias("_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_source", "_size"))
    # Whole rows move once, by id; the number within an id tells repeated rows apart.
    taken = plan.select(key, "passes", F.col("source").alias("_source"), F.col("size").alias("_size")).withColumn("_nth", nth).select("_key", "_nth", "passes")
    row = F.struct(*docs.columns).alias("_row")  # nested, so no name can clash
    numbered = docs.select(row, key, F.col(source_col).cast("string").alias("_source"), n_spaced_words(plain_text(text_col)).alias("_size")).withColumn("_nth", nth)
    joined = numbered.join(taken.where("passes > 0"), ["_key", "_nth"])
    return joined.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("_row.*")
