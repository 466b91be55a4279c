"""Uniform sharding with exact shard sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ROWS_PER_CELL, cell_bits, plain_text, repeated, running_total, written

#: The driver draws the matrix for two to this power groups of buckets.
TOP = 7


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken from ``good + bad`` are good, at any size of the numbers.

    Inverts the distribution over its mode plus and minus forty deviations, outside of which
    lies less than a double can tell.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mean = draws * (good / total)
    spread = 40 * math.sqrt(max(1.0, mean * (bad / total) * ((total - draws) / max(1, total - 1)))) + 20
    low, high = max(low, int(mean - spread)), min(high, int(mean + spread) + 1)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((draws - k) / (bad - draws + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right").clip(0, high - low))


def communication_matrix(counts: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """Rows that each bucket sends to each shard; its row sums are ``counts``, its column sums ``capacities``.

    Drawn row by row from the multivariate hypergeometric law, which is the law of these counts
    under a uniform permutation of all rows.
    """
    rng, left = np.random.default_rng(seed), list(map(int, capacities))
    out = np.zeros((len(counts), len(left)), dtype=np.int64)
    for i, n in enumerate(counts):
        rest = sum(left)
        for j, room in enumerate(left):
            took = hypergeometric(rng, room, rest - room, n)
            out[i, j] = took
            rest, n = rest - room, n - took
            left[j] = room - took
            if n == 0:
                break
    return out


def _subtrees(counts: DataFrame, top: int, capacities: list[int], seed: int) -> DataFrame:
    """``_bucket, _until``: each bucket's running sum of rows it sends to the shards.

    The matrix is drawn in two levels: the driver deals the shards' rows out to at most 2**TOP
    groups of buckets, whose sums are all it sees, then each group's buckets draw theirs on an
    executor. Both are hypergeometric, so the law is that of one permutation of all rows.
    """
    grouped = counts.withColumn("_top", F.shiftright("_bucket", top))
    sums = sorted((r["_top"], r["n"]) for r in grouped.groupBy("_top").agg(F.sum("n").alias("n")).collect())
    rooms = {t: row.tolist() for (t, _), row in zip(sums, communication_matrix([n for _, n in sums], capacities, seed), strict=True)}

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_bucket")
        own = int(pdf["_top"].iloc[0])
        matrix = communication_matrix(pdf["n"].tolist(), rooms[own], (seed << 32) + own)
        return pd.DataFrame({"_bucket": pdf["_bucket"], "_until": list(np.cumsum(matrix, axis=1))})

    return grouped.groupBy("_top").applyInPandas(draw, "_bucket int, _until array<long>")


def shard_rows(df: DataFrame, key_cols: list[str], n_shards: int, seed: int = 42, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Adds ``shard`` and ``slot``: a uniform permutation of the rows, cut into shards whose counts differ by one at most.

    Rows lie in buckets by a hash of ``key_cols``. The matrix fixes how many rows go from each bucket to each
    shard, a keyed order permutes each bucket and deals its rows out, and a second keyed order
    permutes each shard; ``slot`` is the gapless position there, from 0. The result depends on
    ``key_cols`` and seed, not on files or partitions. ``df`` is read twice and its rows are
    written once to the shared folder.
    """
    rows = df.count()
    bits = min(30, cell_bits(rows, rows_per_cell))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *key_cols), F.lit(1 << bits)).cast("int")
    counts = written(df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n")), "counts")
    until = _subtrees(counts, max(0, bits - TOP), [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)], seed)
    local = Window.partitionBy("_bucket").orderBy(F.xxhash64(F.lit(seed + 1), *key_cols), *key_cols)
    dealt = (
        df.withColumn("_bucket", bucket)
        .withColumn("_rank", F.row_number().over(local))
        .join(until, "_bucket")
        .withColumn("shard", F.size(F.filter("_until", lambda c: c < F.col("_rank"))))
        .withColumn("_key", F.xxhash64(F.lit(seed + 2), *key_cols))
        .drop("_bucket", "_rank", "_until")
    )
    placed = running_total(written(dealt, "dealt"), ["shard"], "_key", key_cols, F.lit(1), "_place", cell_bits(rows // n_shards, rows_per_cell))
    return placed.withColumn("slot", (F.col("_place") - 1).cast("long")).drop("_key", "_place")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24, seed: int = 42) -> DataFrame:
    """One row per document: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``rows``: shard counts differ by one at most, whatever the texts are; equal texts
    spread like any others. ``size`` is the text's UTF-8 bytes plus 8 and a null text has none.
    ``grown_shard`` is null under this law. Null and repeated ids are told apart by checksum and
    size, and rows alike in these too, folded to a number first, by that number, so no value fills
    a bucket. Fewer documents than shards leave shards empty; no documents give no rows. Further
    columns are ignored and may have any name.
    """
    base = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(plain_text(text_col).cast("binary")).alias("text_crc32"),
    )
    own = ["_id", "text_crc32", "size"]
    base = repeated(base.groupBy(*own).agg(F.count(F.lit(1)).alias("_rows")), "_rows", "_nth")
    out = shard_rows(base, [*own, "_nth"], n_shards, seed)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24, seed: int = 42) -> None:
    """Writes whole documents by shard, each shard in slot order, as ``path/shard=.../`` with a column ``row`` that holds the document.

    Documents are nested, so their columns may have any name. Those that share id and text may trade places.
    """
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.struct(F.col(id_col).alias("id")).alias("_id"),
        F.xxhash64(plain_text(text_col)).alias("_text"),
    )
    placed = shard_rows(rows, ["_id", "_text"], n_shards, seed)
    placed.select("shard", "slot", "row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
