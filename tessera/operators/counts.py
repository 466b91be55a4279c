"""Word counts, their summaries and position-base frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequences import flanked, pack, reverse_complement, unpack, windows
from tessera.operators.filters import barcode_match, kmer_verdict, valid_bases, variable_region
from tessera.operators.packed import packed_counts
from tessera.sources.readers import skip_invalid


def count_kmers(df: DataFrame, k: int, seq: str = "seq", weight: str | None = None, both_strands: bool = False, by: tuple[str, ...] = (), **filters) -> DataFrame:
    """``*by, kmer, n``: how often each word of length ``k`` occurs in all windows; unseen words are absent.

    ``weight`` counts each window so many times, ``both_strands`` adds every window's reverse
    complement, and ``filters`` are those of :func:`kmer_verdict`. Words of up to 31 bases roll
    as packed codes and are added up in each task before distinct ones are shuffled; filters and
    the other strand see distinct words only.
    """
    if k <= 31:
        found = packed_counts(df, k, seq, weight, by)
        counted = found.select(*by, F.coalesce("word", unpack("code", k)).alias("kmer"), "n")
    else:
        made = df.select(*by, F.explode(windows(seq, k)).alias("kmer"), *([weight] if weight else []))
        counted = made.groupBy(*by, "kmer").agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("bigint").alias("n"))
    if filters:
        counted = counted.where(kmer_verdict("kmer", **filters))
    if not both_strands:
        return counted
    turned = counted.select(*by, F.explode(F.array("kmer", reverse_complement("kmer"))).alias("kmer"), "n")  # the distinct words only
    return turned.groupBy(*by, "kmer").agg(F.sum("n").cast("bigint").alias("n"))


def count_anchored(df: DataFrame, k: int, offset: int, seq: str = "seq", weight: str | None = None) -> DataFrame:
    """``kmer, n``: the one window of each row that starts at ``offset``; rows too short have none."""
    rows = df.where(F.length(seq) >= offset + k).select(F.substring(seq, offset + 1, k).alias("kmer"), *([weight] if weight else []))
    return rows.groupBy("kmer").agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("bigint").alias("n"))


def count_contigs(contigs: DataFrame, k: int, seq: str = "seq", both_strands: bool = False, **filters) -> DataFrame:
    """k-mers over contigs of which letters other than ACGT were skipped."""
    return count_kmers(contigs.select(skip_invalid(F.col(seq)).alias("seq")), k, both_strands=both_strands, **filters)


def count_table(counts: DataFrame, sample: str, k: int) -> DataFrame:
    """Counts as a stored table: ``sample, k, kmer, code, n``."""
    return counts.select(F.lit(sample).alias("sample"), F.lit(k).alias("k"), "kmer", pack("kmer").alias("code"), "n")


def summary(counts: DataFrame, *by: str) -> DataFrame:
    """Total, lowest and highest observed count and number of words, in one aggregate."""
    return counts.groupBy(*by).agg(F.sum("n").cast("bigint").alias("total"), F.min("n").alias("lowest"), F.max("n").alias("highest"), F.count(F.lit(1)).alias("words"))


def read_funnel(reads: DataFrame, samples: DataFrame, include: str | None = None) -> DataFrame:
    """Per sample: reads of its run, with its left barcode, with both, valid, and kept by ``include``."""
    s = samples.select("run", "sample", "var_len", "left_barcode", "right_barcode")
    joined = reads.join(s, "run")
    both = barcode_match("seq", F.col("left_barcode"), F.col("right_barcode"), F.col("var_len"))
    region = joined.withColumn("_region", variable_region("seq", F.col("left_barcode"), F.col("var_len"))).withColumn("_both", both)
    valid = F.col("_both") & valid_bases("_region")
    kept = valid & F.col("_region").rlike(include) if include else valid
    return region.groupBy("sample").agg(
        F.count(F.lit(1)).alias("reads"), F.count_if(F.startswith("seq", "left_barcode")).alias("left_matched"), F.count_if("_both").alias("matched"), F.count_if(valid).alias("valid"), F.count_if(kept).alias("kept")
    )


def base_frequency(df: DataFrame, seq: str = "seq", weight: str | None = None, width: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``*by, pos, base, n, freq`` over rows of valid bases; ``width`` bounds the positions, ``freq`` is the share within a position."""
    valid = df.where(valid_bases(seq))
    letters = F.split(F.upper(seq), "") if width is None else F.slice(F.split(F.upper(seq), ""), 1, width)
    rows = valid.select(*by, *([weight] if weight else []), F.posexplode(letters).alias("pos", "base")).where("base <> ''")
    counted = rows.groupBy(*by, "pos", "base").agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("bigint").alias("n"))
    return with_share(counted, [*by, "pos"])


def with_share(counts: DataFrame, groups: list[str], n: str = "n") -> DataFrame:
    """Adds ``freq``: the row's part of its group's total."""
    return counts.withColumn("freq", F.col(n) / F.sum(n).over(Window.partitionBy(*groups)))


def merge_counts(*tables: DataFrame) -> DataFrame:
    """One count table from partial ones: counts of equal words add up."""
    stacked = tables[0].select("kmer", "n")
    for t in tables[1:]:
        stacked = stacked.unionByName(t.select("kmer", "n"))
    return stacked.groupBy("kmer").agg(F.sum("n").cast("bigint").alias("n"))


def _unpacker(k: int):
    return lambda code: unpack(code, k)


def ngram_features(df: DataFrame, order: int, id_col: str, seq: str = "seq") -> DataFrame:
    """``id_col, gram, n``: counts of all words of 1 to ``order + 1`` letters in each row, zeros included.

    Every row's grid is filled inside the row, by counting matches in its own window array.
    """
    sizes = range(1, order + 2)
    grid = F.concat(*[F.transform(F.sequence(F.lit(0), F.lit(4**k - 1)), _unpacker(k)) for k in sizes])
    seen = F.concat(*[windows(seq, k) for k in sizes])
    filled = df.select(id_col, seen.alias("_seen"), F.explode(grid).alias("gram"))
    return filled.select(id_col, "gram", F.size(F.filter("_seen", lambda g: g == F.col("gram"))).cast("bigint").alias("n"))


def feature_sums(probes: DataFrame, k: int, left: str, right: str, width: int, seq: str = "seq", n: str = "n") -> DataFrame:
    """``kmer, n``: count-weighted words over flank, probe and flank."""
    return count_kmers(probes.select(flanked(seq, left, right, width).alias("seq"), n), k, weight=n)
