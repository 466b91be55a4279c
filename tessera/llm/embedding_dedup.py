"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one representative per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.components import connected_components

#: Most vectors that the cells are fitted on; the index still covers every vector.
FIT_ROWS = 16_384
#: Rows whose products with all centroids are held at once.
SLICE = 256
ROWS_PER_CELL = 2_048
ROWS_PER_BLOCK = 256


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Unit centroids of spherical k-means on unit rows; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, and is not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = x / largest  # squares of very small or large components stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _placed(classes: DataFrame, centroids: np.ndarray, threshold: float, reach: float) -> DataFrame:
    """``_id, _label, _vec, _n, _cell, _home``: each class in its own cell and as a guest in later cells near its border.

    Two unit vectors a chord r apart whose nearest centroids are p and q satisfy
    x.p - x.q <= r |p - q|. ``reach`` 1 takes this bound whole, so no pair is lost; lower values
    keep that part of it.
    """
    chord = math.sqrt(max(0.0, 2 - 2 * threshold)) * reach
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * centroids @ centroids.T)) * chord

    def run(batches):
        for b in batches:
            for at in range(0, len(b), SLICE):
                yield placed(b.iloc[at : at + SLICE])

    def placed(b: pd.DataFrame) -> pd.DataFrame:
        near = _unit(b["_vec"]) @ centroids.T
        home = near.argmax(axis=1)
        gap = near[np.arange(len(b)), home][:, None] - near
        mine = (gap <= apart[home]) & (np.arange(len(centroids))[None, :] > home[:, None])
        mine[np.arange(len(b)), home] = True
        row, cell = np.nonzero(mine)
        out = b.iloc[row].copy()
        out["_cell"], out["_home"] = cell.astype(np.int32), home[row] == cell
        return out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInPandas(run, f"{fields}, _cell int, _home boolean")


def _compare(threshold: float):
    """Links inside one pair of blocks: for each linked vector the copies it meets and its least local neighbour."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, n, home = _unit(pdf["_vec"]), pdf["_id"].to_numpy(), pdf["_n"].to_numpy(), pdf["_home"].to_numpy()
        block, one = pdf["_block"].to_numpy(), pdf["_low"].iloc[0] == pdf["_high"].iloc[0]
        hit = (x @ x.T >= threshold) & (home[:, None] | home[None, :]) & (ids[:, None] != ids[None, :])
        if not one:
            hit &= block[:, None] != block[None, :]
        links = hit @ n
        label = ids.copy()
        while True:  # least id over local links; rounds follow the local diameter
            near = np.where(hit, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            better = np.minimum(label, near)
            if (better == label).all():
                break
            label = better
        on = hit.any(axis=1)
        return pd.DataFrame({"a": ids[on], "b": label[on], "links": links[on]})

    return run


def embedding_near_dedup(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    reach: float = 0.5,
    rows_per_cell: int = ROWS_PER_CELL,
    seed: int = 42,
) -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``.

    Vectors of equal, non-null label link at a cosine of ``threshold`` or more, in double
    precision. Equal vectors are one class from the start. Classes are assigned to cells of
    spherical k-means, fitted on at most FIT_ROWS of them and one cell for ``rows_per_cell``
    classes, and as guests to the cells whose border is within ``reach`` times the threshold's
    chord (1: no pair can be lost; 0.5: a pair is lost only if its difference points at the
    centroids four deviations more than chance has it). Cells of one label are cut in blocks;
    pairs of blocks are compared by matrix products and give one row per linked vector, not one
    per pair. ``component_id`` is the smallest id reachable over links, ``kept`` whether it is
    the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a
    null label, link with nothing and are kept. Vectors of different lengths never link. A null
    id never is the smallest unless all are null. Repeated rows each come back and count as
    links of one another. Ids may be of any type and repeat: vectors are told apart by a hash of
    label and vector. Further columns are ignored and may have any name. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("_own"), F.col(vector_col).alias("_vec"), F.col(label_col).alias("_label"))
    rows = rows.withColumn("_ok", F.col("_label").isNotNull() & usable(F.col("_vec")))
    classes = rows.where("_ok").groupBy("_label", "_vec").agg(F.count(F.lit(1)).alias("_n"), F.min("_own").alias("_least"))
    classes = written(classes.withColumn("_id", F.xxhash64("_label", "_vec")), "vectors")
    parts = []
    for (width,) in classes.select(F.size("_vec")).distinct().collect():
        part = classes.where(F.size("_vec") == width)
        count = part.count()
        sample = part.select("_vec", "_id").orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(FIT_ROWS).toPandas()
        cells = min(max(1, math.ceil(count / rows_per_cell)), max(1, len(sample) // 8))
        parts.append(_placed(part.drop("_least"), fit_cells(_unit(sample["_vec"]), cells, seed=seed), threshold, reach).withColumn("_width", F.lit(width)))
    own = rows.join(classes, ["_label", "_vec"], "left")
    if not parts:
        return own.select(F.col("_own").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_own").alias("component_id"), F.lit(True).alias("kept"))
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    placed = written(placed, "placed")
    place = ["_width", "_label", "_cell"]
    blocks = placed.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_BLOCK).cast("int").alias("_blocks"))
    blocked = placed.join(blocks, place).withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_id"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    paired = blocked.withColumn("_other", other).withColumn("_low", F.least("_block", "_other")).withColumn("_high", F.greatest("_block", "_other"))
    met = paired.groupBy(*place, "_low", "_high").applyInPandas(_compare(threshold), "a long, b long, links long")
    met = written(met, "met")
    found = connected_components(met.select("a", "b")).withColumnRenamed("node", "_id")
    links = met.groupBy(F.col("a").alias("_id")).agg(F.sum("links").alias("_links"))
    smallest = found.join(classes.select("_id", "_least"), "_id").groupBy("component").agg(F.min("_least").alias("_in_all"))
    named = found.join(smallest, "component").select("_id", "_in_all", F.lit(True).alias("_linked"))
    result = classes.join(links, "_id", "left").join(named, "_id", "left")
    group = F.when(F.col("_linked"), F.col("_in_all")).otherwise(F.col("_least"))
    result = result.select("_label", "_vec", (F.col("_n") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"), group.alias("_group"), F.lit(True).alias("_known"))
    least = F.when(F.col("_known"), F.col("_group")).otherwise(F.col("_own"))
    return (
        rows.join(result, ["_label", "_vec"], "left")
        .withColumn("_least", least)
        .select(F.col("_own").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.col("_least").alias("component_id"), F.col("_own").eqNullSafe(F.col("_least")).alias("kept"))
    )
