"""Sinks: count tables, delimited results, score tracks, sequence files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_counts(counts: DataFrame, path: str) -> None:
    """A count table ``sample, k, kmer, code, n``, partitioned by sample and k, sorted by code in each file."""
    counts.repartition("sample", "k").sortWithinPartitions("code").write.partitionBy("sample", "k").parquet(path)


def write_delimited(rows: DataFrame, path: str) -> None:
    """Tab-separated rows under a header."""
    rows.write.csv(path, sep="\t", header=True)


def dealt_by_place(pieces: DataFrame, *ties: str, chrom: str = "chrom", start: str = "pos_start") -> DataFrame:
    """Pieces of contigs in ranges of chromosome and start, so that the scores made from them lie in ranges already and aren't shuffled.

    Pieces of one place are told apart by ``ties``: they may be more than one task should have.
    There are as many ranges as shuffles have partitions, as a piece's size says little of its scores'.
    """
    return pieces.repartitionByRange(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), chrom, start, *ties)


def write_track(scores: DataFrame, path: str, dealt: bool = False) -> None:
    """Scores per position, partitioned by chromosome and sorted by position; ``dealt`` if they come from pieces that are dealt by place."""
    rows = scores if dealt else scores.repartitionByRange("chrom", "pos")
    rows.sortWithinPartitions("chrom", "pos").write.partitionBy("chrom").parquet(path)


def write_fasta(contigs: DataFrame, path: str, name: str = "chrom", seq: str = "seq", width: int = 50) -> None:
    """One record per row: header, then lines of ``width`` letters."""
    lines = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?!$)", "$1\n")
    contigs.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), lines)).write.text(path)
