"""Affinity scores of words under position-weight modes, and profiles made from them.

A window's score is exp(sum of weights) on each strand; a probe's score is the sum over its
windows, both strands and modes, plus exp of the non-specific weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.sequences import BASES, array_sum, flanked, floats, log10_bin, reverse_complement, reversed_di, reversed_mono, unpack, windows, word_code
from tessera.operators.joins import fill_ins


@dataclass(frozen=True)
class Mode:
    """Weights of one binding mode: 4 per position, optionally 16 per pair of neighbours and per position for shape features."""

    k: int
    mono: tuple[float, ...]
    di: tuple[float, ...] = ()
    shape: dict[str, tuple[float, ...]] = field(default_factory=dict)


def _base(seq: Column, at: Column) -> Column:
    return F.instr(F.lit(BASES), F.substr(seq, at, F.lit(1)))


def _window_log(seq: Column, i: Column, k: int, mono: Sequence[float], di: Sequence[float]) -> Column:
    """Sum of weights of the window that starts at ``i`` (from 1)."""
    one, two = floats(mono), floats(di) if di else None
    total = F.lit(0.0)
    for p in range(k):
        total = total + F.element_at(one, _base(seq, i + p) + 4 * p)
    for p in range(k - 1 if di else 0):
        total = total + F.element_at(two, (_base(seq, i + p) - 1) * 4 + _base(seq, i + p + 1) + 16 * p)
    return total


def strand_logs(seq: Column, i: Column, mode: Mode) -> tuple[Column, Column]:
    """Log scores of a window on the forward and the reverse strand; the reverse one uses turned weights, not a turned word."""
    forward = _window_log(seq, i, mode.k, mode.mono, mode.di)
    return forward, _window_log(seq, i, mode.k, reversed_mono(mode.mono), reversed_di(mode.di) if mode.di else ())


#: Modes up to this length score windows by a table of all their words.
TABLE_LENGTH = 6


def word_tables(mode: Mode) -> tuple[list[float], list[float]]:
    """Forward and reverse scores of all 4**k words of a mode, by code."""
    k, forward = mode.k, []
    for code in range(4**k):
        digits = [code >> 2 * (k - 1 - p) & 3 for p in range(k)]
        total = sum(mode.mono[4 * p + d] for p, d in enumerate(digits))
        total += sum(mode.di[16 * p + 4 * digits[p] + digits[p + 1]] for p in range(k - 1)) if mode.di else 0.0
        forward.append(math.exp(total))
    turned = [sum((3 - (code >> 2 * p & 3)) << 2 * (k - 1 - p) for p in range(k)) for code in range(4**k)]
    return forward, [forward[t] for t in turned]


def _codes(seq: str | Column, k: int) -> Column:
    return F.transform(windows(seq, k), lambda w: word_code(w, k))


def window_scores(seq: str | Column, mode: Mode) -> Column:
    """Scores of all windows, forward and reverse in turn, as one array."""
    s = F.col(seq) if isinstance(seq, str) else seq
    if mode.k <= TABLE_LENGTH:
        forward, reverse = (floats(t) for t in word_tables(mode))
        return F.flatten(F.transform(_codes(s, mode.k), lambda c: F.array(F.get(forward, c), F.get(reverse, c))))
    return F.flatten(F.transform(windows(s, mode.k), lambda w: F.array(*[F.exp(x) for x in strand_logs(w, F.lit(1), mode)])))


def probe_score(seq: str | Column, modes: Sequence[Mode], nonspecific: float | None = None) -> Column:
    """Score of a probe, without a shuffle."""
    total = F.lit(0.0) if nonspecific is None else F.exp(F.lit(float(nonspecific)))
    for m in modes:
        if m.k <= TABLE_LENGTH:
            both = floats([a + b for a, b in zip(*word_tables(m), strict=True)])
            total = total + _table_sum(seq, m.k, both)
        else:
            total = total + array_sum(window_scores(seq, m))
    return total


def _table_sum(seq: str | Column, k: int, table: Column) -> Column:
    return F.aggregate(windows(seq, k), F.lit(0.0), lambda t, w: t + F.get(table, word_code(w, k)))


def scored_windows(probes: DataFrame, modes: Sequence[Mode], key: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """``key, *keep, mode, pos, strand, score``: every window of every probe under every mode; ``mode`` counts from 0."""
    arrays = F.array(*[window_scores(key, m) for m in modes])
    rows = probes.select(key, *keep, F.posexplode(arrays).alias("mode", "_scores"))
    rows = rows.select(key, *keep, "mode", F.posexplode("_scores").alias("_i", "score"))
    return rows.select(key, *keep, "mode", F.floor(F.col("_i") / 2).cast("int").alias("pos"), F.when(F.col("_i") % 2 == 0, "+").otherwise("-").alias("strand"), "score")


def _shape_rows(shape: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: per feature the values of all 1024 pentamers by code, and those of their reverse complements."""
    listed = []
    for word, name in ((F.col("pentamer"), "f"), (reverse_complement("pentamer"), "r")):
        for i, feature in enumerate(features):
            own = F.sort_array(F.collect_list(F.when(F.col("feature") == feature, F.struct(word_code(word, 5).alias("code"), F.col("value").alias("value")))))
            listed.append(F.transform(own, lambda x: x["value"]).alias(f"_{name}{i}"))
    return shape.groupBy().agg(*listed)


def shape_window_logs(probes: DataFrame, mode: Mode, shape: DataFrame, left: str, right: str, key: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """``key, *keep, logs``: per window the log scores ``forward, reverse`` with shape weights, made inside the row.

    Two bases of flank on each side complete the pentamers; ``shape(pentamer, feature, value)``
    has a value for each of the 1024 pentamers and features and is one row of arrays to each task.
    """
    rows = probes.select(key, *keep, flanked(key, left, right, 2).alias("_full")).crossJoin(F.broadcast(_shape_rows(shape, list(mode.shape))))
    codes = F.transform(windows("_full", 5), lambda w: word_code(w, 5))
    rows = rows.withColumn("_codes", codes)

    def of(i: Column, reverse: bool) -> Column:
        logs = _window_log(F.col(key), i + 1, mode.k, *((reversed_mono(mode.mono), reversed_di(mode.di) if mode.di else ()) if reverse else (mode.mono, mode.di)))
        for f, weights in enumerate(mode.shape.values()):
            values = F.col(f"_{'r' if reverse else 'f'}{f}")
            for p, w in enumerate(weights):
                logs = logs + F.lit(float(w)) * F.get(values, F.get("_codes", i + (mode.k - 1 - p if reverse else p)))
        return logs

    n = F.length(key) - mode.k + 1
    starts = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return rows.select(key, *keep, F.transform(starts, lambda i: F.struct(of(i, False).alias("forward"), of(i, True).alias("reverse"))).alias("logs"))


def shape_log_scores(probes: DataFrame, mode: Mode, shape: DataFrame, left: str, right: str, key: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """``key, *keep, pos, strand, log``: the log scores of :func:`shape_window_logs`, a row for each window and strand."""
    rows = shape_window_logs(probes, mode, shape, left, right, key, keep).select(key, *keep, F.posexplode("logs").alias("pos", "_l"))
    both = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("_l.forward").alias("log")), F.struct(F.lit("-").alias("strand"), F.col("_l.reverse").alias("log"))))
    return rows.select(key, *keep, "pos", both.alias("_b")).select(key, *keep, "pos", "_b.*")


def shape_score(probes: DataFrame, mode: Mode, shape: DataFrame, left: str, right: str, key: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """``key, *keep, score``: sum of both strands' window scores with shape weights; repeated probes come back each."""
    total = F.aggregate("logs", F.lit(0.0), lambda t, x: t + F.exp(x["forward"]) + F.exp(x["reverse"]))
    return shape_window_logs(probes, mode, shape, left, right, key, keep).select(key, *keep, total.alias("score"))


#: Kinds of letters beside the base in the two low bits: not a base, lower case, N.
OTHER, LOWER, UNKNOWN = 4, 8, 16


def _letter_kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, dtype=np.uint8)
    kinds[np.frombuffer(b"ACGTacgt", dtype=np.uint8)] = np.tile(np.arange(4), 2)
    kinds[ord("a") : ord("z") + 1] |= LOWER
    kinds[[ord("N"), ord("n")]] |= UNKNOWN
    return kinds


def _scorer(mode: Mode):
    """A function from texts, each with room for a window, to ``(windows of each, forward, reverse, kinds held)`` of all their windows in turn.

    Letters become numbers once for all the texts together; scores are looked up by a window's code, or are sums of shifted look-ups where words are too many for a table.
    """
    k, kinds = mode.k, _letter_kinds()
    strands = [(np.array(m, dtype=np.float64), np.array(d, dtype=np.float64) if d else None) for m, d in ((mode.mono, mode.di), (reversed_mono(mode.mono), reversed_di(mode.di) if mode.di else ()))]

    def scores(digits: list[np.ndarray]) -> list[np.ndarray]:
        made = []
        for mono, di in strands:
            logs = sum(mono[4 * p + digits[p]] for p in range(k))
            if di is not None:
                logs = logs + sum(di[16 * p + 4 * digits[p] + digits[p + 1]] for p in range(k - 1))
            made.append(np.exp(logs))
        return made

    every = np.arange(4**k if k <= TABLE_LENGTH else 0)
    tables = [np.append(s, 0.0) for s in scores([every >> 2 * (k - 1 - p) & 3 for p in range(k)])]

    def scored(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found = kinds[np.frombuffer("".join(texts).encode("latin-1", "replace"), dtype=np.uint8)]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        counts = sizes - k + 1
        n, own = len(found) - k + 1, np.repeat((k - 1) * np.arange(len(texts)), counts)
        own += np.arange(len(own))  # where each text's own windows start; others cross to the next text
        held, width = found, 1
        while 2 * width <= k:
            held, width = held[:-width] | held[width:], 2 * width
        held = (held[:n] | held[k - width : k - width + n])[own]
        base, bad = found & 3, held & OTHER > 0
        if len(every):
            codes = np.zeros(n, dtype=np.uint16)
            for p in range(k):
                codes = codes << 2 | base[p : p + n]
            codes = codes[own]
            codes[bad] = len(every)
            return counts, tables[0][codes], tables[1][codes], held
        forward, reverse = (np.where(bad, 0.0, s[own]) for s in scores([base[p : p + n].astype(np.int64) for p in range(k)]))
        return counts, forward, reverse, held

    return scored


def _groups(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[int], list[str]]]:
    """``(batch, row of each, first window of each, texts)`` of a batch's last column in groups of about SCAN_WINDOWS windows; a long text is cut in parts."""
    for batch in batches:
        rows, starts, texts, size = [], [], [], 0
        for i, text in enumerate(batch.column(width - 1).to_pylist()):
            for at in range(0, len(text) - k + 1, SCAN_WINDOWS):
                part = text[at : at + SCAN_WINDOWS + k - 1]
                rows.append(i)
                starts.append(at)
                texts.append(part)
                size += len(part) - k + 1
                if size >= SCAN_WINDOWS:
                    yield batch, rows, starts, texts
                    rows, starts, texts, size = [], [], [], 0
        if rows:
            yield batch, rows, starts, texts


def genome_scan(contigs: DataFrame, mode: Mode, chrom: str = "chrom", start: str = "pos_start", seq: str = "seq", only: Sequence[str] | None = None) -> DataFrame:
    """``chrom, pos, forward, reverse, flag`` for every window start of chunked contigs; scores are 0 where the window holds a letter other than ACGT.

    Chunks are scored many at a time, and their windows come out in the order of the chunks.
    """
    rows = contigs if only is None else contigs.where(F.col(chrom).isin(list(only)))
    scored, k = _scorer(mode), mode.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, of, starts, texts in _groups(batches, k, 3):
            counts, forward, reverse, held = scored(texts)
            firsts = batch.column(1).take(pa.array(of)).to_numpy(zero_copy_only=False) + np.array(starts)
            pos = np.repeat(firsts - np.cumsum(counts) + counts, counts) + np.arange(len(held))
            flag = np.where(held & UNKNOWN > 0, -1, held & LOWER > 0).astype(np.int32)
            name = batch.column(0).take(pa.array(np.repeat(of, counts)))
            yield pa.RecordBatch.from_arrays([name, pa.array(pos, batch.schema.field(1).type), pa.array(forward), pa.array(reverse), pa.array(flag)], names=[chrom, "pos", "forward", "reverse", "flag"])

    own = rows.where(F.col(seq).isNotNull()).select(chrom, start, seq)
    kinds = [f.dataType.simpleString() for f in own.schema]
    return own.mapInArrow(run, f"`{chrom}` {kinds[0]}, pos {kinds[1]}, forward double, reverse double, flag int").withColumnRenamed(chrom, "chrom")


def scan_peaks(contigs: DataFrame, mode: Mode, chrom: str = "chrom", seq: str = "seq") -> DataFrame:
    """``chrom, windows, forward, reverse, unknown``: a contig's number of windows, its largest scores by strand, and its windows with N.

    The same as sums over :func:`genome_scan`, but a chunk is one row from its windows' scores on. Contigs without a window have no row.
    """
    scored, k = _scorer(mode), mode.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, of, _, texts in _groups(batches, k, 2):
            counts, forward, reverse, held = scored(texts)
            first = np.cumsum(counts) - counts
            tops = [np.maximum.reduceat(s, first) for s in (forward, reverse)]
            unknown = np.add.reduceat((held & UNKNOWN > 0).astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(counts), *map(pa.array, tops), pa.array(unknown)], names=["chrom", "windows", "forward", "reverse", "unknown"])

    own = contigs.where(F.col(seq).isNotNull()).select(F.col(chrom).alias("chrom"), seq)
    parts = own.mapInArrow(run, f"chrom {own.schema[0].dataType.simpleString()}, windows long, forward double, reverse double, unknown long")
    return parts.groupBy("chrom").agg(F.sum("windows").alias("windows"), F.max("forward").alias("forward"), F.max("reverse").alias("reverse"), F.sum("unknown").alias("unknown"))


#: Windows that a scan scores and hands on together.
SCAN_WINDOWS = 200_000


def long_probe_score(seq: str | Column, mode: Mode, nonspecific: float) -> Column:
    """ln of all window scores plus the non-specific score of each window."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.ln(probe_score(s, [mode]) + F.greatest(F.length(s) - mode.k + 1, F.lit(0)) * F.exp(F.lit(float(nonspecific))))


def score_gradient(seq: str | Column, mode: Mode) -> Column:
    """Derivatives of a probe's score by each position-base weight, as an array (number 4 * position + base)."""
    words = windows(seq, mode.k)
    scored = F.transform(F.concat(words, F.transform(words, reverse_complement)), lambda w: F.struct(w.alias("w"), F.exp(_window_log(w, F.lit(1), mode.k, mode.mono, mode.di)).alias("s")))
    zero = F.array_repeat(F.lit(0.0), 4 * mode.k)

    def add(total: Column, x: Column) -> Column:
        hits = F.array(*[_base(x["w"], F.lit(p + 1)) - 1 for p in range(mode.k)])
        return F.transform(total, lambda t, i: t + F.when(F.get(hits, F.floor(i / 4).cast("int")) == i % 4, x["s"]).otherwise(0.0))

    return F.aggregate(scored, zero, add)


def library_scan(words: DataFrame, mode: Mode, left: str, right: str, errors: Sequence[float], key: str = "kmer") -> DataFrame:
    """``key, score, error``: each word between fixed flanks; the error is the root of the sum of (gradient * weight error) squared."""
    full = F.concat(F.lit(left), F.col(key), F.lit(right))
    terms = F.zip_with(score_gradient(full, mode), floats(errors), lambda g, e: (g * e) * (g * e))
    return words.select(key, probe_score(full, [mode]).alias("score"), F.sqrt(F.aggregate(terms, F.lit(0.0), lambda t, x: t + x)).alias("error"))


def universe(spark, length: int) -> DataFrame:
    """All words of a length (up to 12) by code, made in parallel."""
    return spark.range(4**length).select(F.col("id").alias("code"), unpack("id", length).alias("seq"))


def background(seq: str | Column, weights: Sequence[float]) -> Column:
    """Log weight of a word under independent bases."""
    s = F.col(seq) if isinstance(seq, str) else seq
    total = F.lit(0.0)
    for base, w in zip(BASES, weights, strict=True):
        total = total + (F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))) * F.lit(float(w))
    return total


def word_background(seq: str | Column, weights: Sequence[float], k: int, left: str = "", right: str = "") -> Column:
    """Log weight of a word under weights of all words of length ``k``, by code, over flank, word and flank."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return _table_sum(F.concat(F.lit(left), s, F.lit(right)), k, floats(weights))


def background_gradient(probes: DataFrame, universe: DataFrame, weights: Sequence[float], k: int, left: str = "", right: str = "", seq: str = "seq", n: str = "n") -> DataFrame:
    """``kmer, observed, gradient``: reads times the words' mean number under the background, less what the probes hold."""
    full = F.concat(F.lit(left), F.col(seq), F.lit(right))
    observed = probes.select(F.explode(windows(full, k)).alias("kmer"), n).groupBy("kmer").agg(F.sum(n).cast("bigint").alias("observed"))
    weighed = universe.select(F.exp(word_background(seq, weights, k, left, right)).alias("_w"), full.alias("_full"))
    expected = weighed.select("_w", F.explode(windows("_full", k)).alias("kmer")).groupBy("kmer").agg(F.sum("_w").alias("_e"))
    z, reads = weighed.agg(F.sum("_w").alias("_z")), probes.agg(F.sum(n).alias("_n"))
    both = expected.join(observed, "kmer", "left").crossJoin(F.broadcast(z)).crossJoin(F.broadcast(reads))  # one row each
    return both.select("kmer", F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("_n") * F.col("_e") / F.col("_z") - F.coalesce("observed", F.lit(0))).alias("gradient"))


def partition_function(words: DataFrame, p0: Column, score: Column) -> DataFrame:
    """``z``: sum of background probability times score."""
    return words.agg(F.sum(p0 * score).alias("z"))


def sampled_partition(words: DataFrame, score: Column) -> DataFrame:
    """``z, error``: importance estimate of Z from words drawn from the background, with its standard error."""
    return words.select(score.alias("_s")).agg(F.avg("_s").alias("z"), (F.stddev_samp("_s") / F.sqrt(F.count(F.lit(1)))).alias("error"))


def weight_histogram(everything: DataFrame, observed: DataFrame, weight: Column, low: float, width: float, key: str = "seq", n: str = "n") -> DataFrame:
    """``bin, n, words``: words by bin of log10 weight and observed count; count 0 are the words of the universe not observed."""
    binned = everything.join(observed.select(key, n), key, "left").select(log10_bin(weight, low, width).alias("bin"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))
    return binned.groupBy("bin", "n").agg(F.count(F.lit(1)).alias("words"))


def mode_attribution(probes: DataFrame, modes: Sequence[Mode], low: float, width: float, key: str = "seq", n: str = "n") -> DataFrame:
    """``bin, mode, reads``: reads of each bin of log10 score, shared out to modes by their part of the score."""
    scores = F.array(*[array_sum(window_scores(key, m)) for m in modes])
    rows = probes.select(n, scores.alias("_s")).withColumn("_total", array_sum("_s"))
    rows = rows.select(n, "_total", log10_bin("_total", low, width).alias("bin"), F.posexplode("_s").alias("mode", "_own"))
    return rows.groupBy("bin", "mode").agg(F.sum(F.col(n) * F.col("_own") / F.col("_total")).alias("reads"))


def position_bias(probes: DataFrame, mode: Mode, low: float, width: float, step: float = 0.01, key: str = "seq", n: str = "n") -> DataFrame:
    """``bin, share, reads``: reads by bin of log10 score and by the best window's part of the score in steps."""
    rows = probes.select(n, window_scores(key, mode).alias("_s")).withColumn("_total", array_sum("_s"))
    share = F.floor(F.array_max("_s") / F.col("_total") / step + F.lit(1e-9)).cast("int")
    return rows.groupBy(log10_bin("_total", low, width).alias("bin"), share.alias("share")).agg(F.sum(n).cast("bigint").alias("reads"))


def divergence(everything: DataFrame, observed: DataFrame, score: Column, low: float, width: float, n: str = "n") -> DataFrame:
    """``bin, mass, reads``: each bin's part of the universe's score mass beside its part of the observed reads."""
    mass = everything.groupBy(log10_bin(score, low, width).alias("bin")).agg(F.sum(score).alias("_m"))
    total = everything.agg(F.sum(score).alias("_all"))
    seen = observed.groupBy(log10_bin(score, low, width).alias("bin")).agg(F.sum(n).alias("_r"))
    reads = observed.agg(F.sum(n).alias("_reads"))
    joined = mass.join(seen, "bin", "full_outer").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(reads))
    return joined.select("bin", (F.coalesce("_m", F.lit(0.0)) / F.col("_all")).alias("mass"), (F.coalesce("_r", F.lit(0)) / F.col("_reads")).alias("reads"))


def expected_kmers(kmers: DataFrame, k: int, length: int, weight, total: float = 1.0, key: str = "kmer") -> DataFrame:
    """``kmer, expected``: sum of weights of all words of ``length`` that hold the k-mer, at each offset; ``weight`` maps a column to a column."""
    return fill_ins(kmers, length, key, k).groupBy("kmer").agg((F.sum(weight(F.col("seq"))) * total).alias("expected"))


def simplex_bins(scores: DataFrame, a: str, b: str, c: str, steps: int) -> DataFrame:
    """``xbin, ybin, words, top``: three scores normalised to a triangle, counted on a grid with the mean of the largest score.

    Three zeros have null bins.
    """
    total = F.col(a) + F.col(b) + F.col(c)
    x = F.floor((F.try_divide(F.col(b), total) + F.try_divide(F.col(c), total) / 2) * steps + F.lit(1e-9)).cast("int")
    y = F.floor(F.try_divide(F.col(c), total) * steps + F.lit(1e-9)).cast("int")
    return scores.groupBy(x.alias("xbin"), y.alias("ybin")).agg(F.count(F.lit(1)).alias("words"), F.avg(F.greatest(a, b, c)).alias("top"))


def shape_profile(probes: DataFrame, mode: Mode, shape: DataFrame, left: str, right: str, low: float, width: float, last_bin: int, key: str = "seq") -> DataFrame:
    """``bin, offset, feature, value``: mean shape along the best window (the first of those equal to nine places), by bin of log10 score; bins past ``last_bin`` join it."""
    full = F.concat(F.lit(left[len(left) - 2 :]), F.col(key), F.lit(right[:2]))
    scores = probes.select(key, full.alias("_full"), F.transform(window_scores(key, mode), lambda x: F.round(x, 9)).alias("_s")).withColumn("_best", F.array_position("_s", F.array_max("_s")) - 1)
    pos, reverse = F.floor(F.col("_best") / 2).cast("int"), F.col("_best") % 2 == 1
    part = F.substr(F.col("_full"), pos + 1, F.lit(mode.k + 4))
    rows = scores.select(F.least(log10_bin(array_sum("_s"), low, width), F.lit(last_bin)).alias("bin"), F.when(reverse, reverse_complement(part)).otherwise(part).alias("_part"))
    rows = rows.select("bin", F.posexplode(windows("_part", 5)).alias("offset", "pentamer"))
    return rows.join(shape, "pentamer").groupBy("bin", "offset", "feature").agg(F.avg("value").alias("value"))


def reads_by_density(probes: DataFrame, energy: Column, top: float, width: float, n: str = "n") -> DataFrame:
    """``bin, reads``: reads by bin of log weight, counted from ``-top`` up."""
    return probes.groupBy(F.ceil((energy + top) / width).cast("bigint").alias("bin")).agg(F.sum(n).cast("bigint").alias("reads"))
