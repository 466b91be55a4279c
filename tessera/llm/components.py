"""Connected components by repeated star contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``edges(a, b)``; the component is its smallest node.

    Each round points all larger neighbours of a node at its smallest neighbour (large star),
    then all smaller ones (small star); components are unchanged and end as stars, after about
    log**2 rounds at most. A node with many neighbours is one row of an aggregate with partial
    sums and the many rows of a join whose partitions can be split. Loops and repeated edges
    are allowed, null ends are not. Every round is written to the shared folder.
    """
    ordered = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    now = written(ordered, "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = written(large, "edges")
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(below, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = written(small.select("e.*").where("hi <> lo").distinct(), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
