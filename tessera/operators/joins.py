"""Joins of reads, samples, counts, windows and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.filters import barcode_match, variable_region


def demultiplex(reads: DataFrame, samples: DataFrame) -> DataFrame:
    """``sample, read_id, region``: every read under each sample of its run whose barcodes it has.

    ``samples(run, sample, var_len, left_barcode, right_barcode, ...)`` is configuration, a few
    rows, so one pass over the reads serves all samples: a hash join on run with the barcodes
    as residual condition. The samples are broadcast whatever the planner takes their size for,
    as a run's reads would meet in one task otherwise.
    """
    s = samples.select("run", "sample", "var_len", "left_barcode", "right_barcode")
    joined = reads.join(F.broadcast(s), "run").where(barcode_match("seq", F.col("left_barcode"), F.col("right_barcode"), F.col("var_len")))
    return joined.select("sample", "read_id", variable_region("seq", F.col("left_barcode"), F.col("var_len")).alias("region"))


def with_prefix_counts(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """``kmer, n, prefix, n_prefix``: counts of k-mers with the counts of their first k - 1 letters, null if unseen."""
    own = longer.select("kmer", "n", F.expr("substring(kmer, 1, length(kmer) - 1)").alias("prefix"))
    return own.join(shorter.select(F.col("kmer").alias("prefix"), F.col("n").alias("n_prefix")), "prefix", "left").select("kmer", "n", "prefix", "n_prefix")


def combine_counts(tables: dict[str, DataFrame], key: str = "seq", n: str = "n") -> DataFrame:
    """One row per word with a count column per table, 0 where the table lacks it."""
    stacked = None
    for name, df in tables.items():
        part = df.select(key, F.lit(name).alias("_set"), n)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(key).pivot("_set", list(tables)).sum(n).fillna(0, list(tables))


def observed_and_predicted(observed: DataFrame, predicted: DataFrame, key: str = "kmer") -> DataFrame:
    """Observed counts with the model's ``expected``; words without prediction keep null."""
    return observed.join(predicted.select(key, "expected"), key, "left")


def with_round_zero(samples: DataFrame) -> DataFrame:
    """Samples with their round-zero sample's barcodes and length, null if it is missing."""
    zero = samples.select(F.col("run").alias("round0_run"), F.col("sample").alias("round0_sample"), F.col("left_barcode").alias("round0_left"), F.col("var_len").alias("round0_len"))
    return samples.join(zero, ["round0_run", "round0_sample"], "left")


def compatible_samples(gain: DataFrame, model: DataFrame, compatible: bool = True) -> DataFrame:
    """Rows of ``gain`` whose both barcodes occur in ``model`` (or do not)."""
    return gain.join(model.select("left_barcode", "right_barcode"), ["left_barcode", "right_barcode"], "left_semi" if compatible else "left_anti")


def with_snapshots(examples: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Examples with the parameter vector of the snapshot that they are bound to."""
    return examples.join(snapshots, "snap")


def fill_ins(kmers: DataFrame, length: int, kmer: str = "kmer", k: int = 0) -> DataFrame:
    """All words of ``length`` that hold a k-mer, at each offset, duplicates kept: ``kmer, offset, seq``.

    Each k-mer makes (length - k + 1) * 4**(length - k) rows in its own task; nothing is shuffled.
    """
    rest = length - k
    both = kmers.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(rest)))).withColumn("_fill", F.explode(F.sequence(F.lit(0), F.lit(4**rest - 1))))
    letters = F.translate(F.lpad(F.conv(F.col("_fill").cast("string"), 10, 4), rest, "0"), "0123", "ACGT") if rest else F.lit("")
    seq = F.concat(F.substr(letters, F.lit(1), F.col("offset")), F.col(kmer), F.substr(letters, F.col("offset") + 1))
    return both.select(F.col(kmer).alias("kmer"), "offset", seq.alias("seq"))
