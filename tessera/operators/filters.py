"""Projections and predicates over reads, words and regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.sequences import BASES, count_of


def valid_bases(seq: str) -> Column:
    """Every letter is one of ACGTacgt, and there is one."""
    return F.col(seq).rlike("^[ACGTacgt]+$")


def barcode_match(seq: str, left: Column, right: Column, var_len: Column, anchored: bool = True) -> Column:
    """Left barcode at the start (or anywhere), right barcode ``var_len`` letters behind it; short reads fail."""
    start = F.lit(1) if anchored else F.instr(F.col(seq), left)
    found = F.startswith(F.col(seq), left) if anchored else start > 0
    return found & (F.substr(F.col(seq), start + F.length(left) + var_len, F.length(right)) == right)


def variable_region(seq: str, left: Column, var_len: Column, anchored: bool = True) -> Column:
    """The ``var_len`` letters behind the left barcode."""
    start = F.lit(1) if anchored else F.instr(F.col(seq), left)
    return F.substr(F.col(seq), start + F.length(left), var_len)


def region_filter(df: DataFrame, seq: str, group: str | None = None, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Keeps regions by one regex: ``group`` before ``include`` before ``exclude``.

    ``group`` needs a find and replaces the region by the first group; ``exclude`` is looked at
    only if neither of the others is given.
    """
    if group is not None:
        return df.where(F.col(seq).rlike(group)).withColumn(seq, F.regexp_extract(seq, group, 1))
    if include is not None:
        return df.where(F.col(seq).rlike(include))
    return df if exclude is None else df.where(~F.col(seq).rlike(exclude))


def kmer_verdict(kmer: str, include: str | None = None, exclude: str | None = None, only: Sequence[str] | None = None) -> Column:
    """Whether a k-mer stays: of include, exclude and include-only the last one given decides."""
    if only is not None:
        return F.col(kmer).isin(list(only)) if len({len(x) for x in only}) == 1 else F.col(kmer).rlike("|".join(only))
    if exclude is not None:
        return ~F.col(kmer).rlike(exclude)
    return F.col(kmer).rlike(include) if include is not None else F.lit(True)


def view(counts: DataFrame, kmer: str = "kmer", n: str = "n", min_count: int = 0, include: str | None = None, exclude: str | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """Rows of a count table that pass every given condition."""
    out = counts.where(F.col(n) >= min_count)
    for one in ({"include": include}, {"exclude": exclude}, {"only": only}):
        out = out.where(kmer_verdict(kmer, **one))
    return out


def homopolymer(seq: str, most: int, run: int) -> Column:
    """Whether some base occurs ``most`` times or more and has a run of ``run`` or more."""
    tests = [(count_of(seq, b) >= most) & F.contains(F.col(seq), F.lit(b * run)) for b in BASES]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def split_homopolymers(probes: DataFrame, seq: str = "seq", n: str = "n", most: int = 5, run: int = 3) -> tuple[DataFrame, DataFrame]:
    """The probes that stay, and one row with the number of reads removed."""
    bad = homopolymer(seq, most, run)
    return probes.where(~bad), probes.agg(F.coalesce(F.sum(F.when(bad, F.col(n))), F.lit(0)).alias("removed"))


def without_motifs(df: DataFrame, seq: str, motifs: Sequence[str]) -> DataFrame:
    """Rows in which none of the motifs is found."""
    return df.where(~F.col(seq).rlike("|".join(motifs))) if motifs else df


def region_quality(seq: str) -> Column:
    """-1 if the region holds N, else 1 if it holds lower case, else 0."""
    s = F.col(seq)
    return F.when(F.contains(F.upper(s), F.lit("N")), -1).when(s != F.upper(s), 1).otherwise(0)
