"""Markov background models over words, their scores, and information gain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequences import pack, windows, word_code
from tessera.operators.counts import count_kmers
from tessera.operators.joins import with_prefix_counts


def kmax(df: DataFrame, threshold: int = 100, longest: int = 15, seq: str = "seq", weight: str | None = None) -> DataFrame:
    """``kmax``: the largest k below the first whose lowest observed count is not above ``threshold``.

    Each text is its words of length ``longest`` and the shorter ones that its end cuts off; only
    these are counted, and every shorter length's counts are those of their beginnings. With none
    failing it is ``longest - 1``, as k = longest is only ever a failing length.
    """
    n = F.col(weight) if weight else F.lit(1)
    whole = count_kmers(df, longest, seq, weight)
    ends = F.transform(F.sequence(F.lit(1), F.lit(max(1, longest - 1))), lambda i: F.when(i <= F.length(seq), F.substr(F.col(seq), F.length(seq) - i + 1)))
    tails = df.where(F.length(seq) >= 1).select(F.explode(F.array_compact(ends)).alias("kmer"), n.alias("n")).groupBy("kmer").agg(F.sum("n").cast("bigint").alias("n"))
    listed = whole.unionByName(tails) if longest > 1 else whole
    beginnings = listed.select(F.explode(F.sequence(F.lit(1), F.length("kmer"))).alias("k"), "kmer", "n")
    counted = beginnings.groupBy("k", F.substr("kmer", F.lit(1), F.col("k")).alias("kmer")).agg(F.sum("n").alias("n"))
    lowest = counted.groupBy("k").agg(F.min("n").alias("lowest"))
    return lowest.agg((F.coalesce(F.min(F.when(F.col("lowest") <= threshold, F.col("k"))), F.lit(longest)) - 1).cast("int").alias("kmax"))


def transition_model(counts: DataFrame) -> DataFrame:
    """``kmer, n, context, base, p, share``: chance of the last base after the others, and the word's share of all."""
    context = F.expr("substring(kmer, 1, length(kmer) - 1)")
    own = counts.select("kmer", "n", context.alias("context"), F.right("kmer", F.lit(1)).alias("base"))
    everywhere = counts.agg(F.sum("n").alias("_total"))  # one row
    p = F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("context")))
    return own.withColumn("p", p).crossJoin(F.broadcast(everywhere)).select("kmer", "n", "context", "base", "p", F.try_divide("n", "_total").alias("share"))


def division_model(longer: DataFrame, shorter: DataFrame | None) -> DataFrame:
    """``kmer, n, p``: (n / total) / (n of the prefix / total of prefixes); n / total for single bases. Null where the prefix is unseen."""
    total = longer.agg(F.sum("n").alias("_total"))
    if shorter is None:
        return longer.crossJoin(F.broadcast(total)).select("kmer", "n", F.try_divide("n", "_total").alias("p"))
    rest = shorter.agg(F.sum("n").alias("_rest"))
    joined = with_prefix_counts(longer, shorter).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(rest))
    return joined.select("kmer", "n", F.try_divide(F.col("n") / F.col("_total"), F.col("n_prefix") / F.col("_rest")).alias("p"))


#: Models up to this length are one row of 4**m chances that every task holds (1 MB at most); longer ones are joined.
TABLE_LENGTH = 8


def _as_row(model: DataFrame, m: int) -> DataFrame:
    """``_p, _share``: a model's chances as arrays by word code, 0 where it has none."""
    filled = model.sparkSession.range(4**m).join(model.select(pack("kmer").alias("id"), "p", "share"), "id", "left")
    zero = F.lit(0.0)
    listed = filled.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("p", zero).alias("p"), F.coalesce("share", zero).alias("share")))).alias("_m"))  # 4**m rows
    return listed.select(F.transform("_m", lambda x: x["p"]).alias("_p"), F.transform("_m", lambda x: x["share"]).alias("_share"))


def model_probability(words: DataFrame, model: DataFrame, m: int, key: str = "seq", keep: Sequence[str] = (), left_flank: str | None = None) -> DataFrame:
    """``key, *keep, p``: chance of each word under a model of words of length ``m``; repeated words come back each.

    ``model(kmer, p, share)``: the share of the word's first m letters times the conditional
    chance of each further window. With ``left_flank`` its last m - 1 bases come before the word
    and every window is conditional. For m = 1 it is the product of the bases' shares. A window that the model has not
    seen makes the chance 0; a word without a window has none (null). Models up to TABLE_LENGTH
    are looked up inside the row, so nothing is shuffled.
    """
    text = F.col(key) if left_flank is None else F.concat(F.lit(left_flank[len(left_flank) - (m - 1) :] if m > 1 else ""), F.col(key))
    if m > TABLE_LENGTH:
        return _joined_probability(words, model, m, key, keep, text, left_flank is None)
    codes = F.transform(windows(text, m), lambda w: word_code(w, m))
    p, share = F.col("_p"), F.col("_share")
    rows = words.select(key, *keep, text.alias("_text"), codes.alias("_codes")).crossJoin(F.broadcast(_as_row(model, m)))
    later = F.col("_codes") if m == 1 or left_flank is not None else F.slice("_codes", 2, F.greatest(F.size("_codes") - 1, F.lit(0)))
    own = share if m == 1 and left_flank is None else p
    log = F.aggregate(later, F.lit(0.0), lambda t, c: t + F.ln(F.get(own, c)))
    log = log if m == 1 or left_flank is not None else log + F.ln(F.get(share, F.get("_codes", F.lit(0))))
    known = F.col("_text").rlike("^[ACGT]+$")
    return rows.select(key, *keep, F.when(F.size("_codes") > 0, F.when(known, F.coalesce(F.exp(log), F.lit(0.0))).otherwise(0.0)).alias("p"))


def _joined_probability(words: DataFrame, model: DataFrame, m: int, key: str, keep: Sequence[str], text: Column, first_is_share: bool) -> DataFrame:
    """Long models: windows of the distinct words meet the model's rows, then words meet their chance."""
    rows = words.select(key, text.alias("_text")).distinct().select(key, F.posexplode(windows("_text", m)).alias("_at", "_window"))
    chance = F.coalesce(F.when((F.col("_at") == 0) & F.lit(first_is_share), F.col("share")).otherwise(F.col("p")), F.lit(0.0))
    joined = rows.join(model.select(F.col("kmer").alias("_window"), "p", "share"), "_window", "left")
    chances = joined.groupBy(F.col(key).alias("_own")).agg(F.when(F.count_if(chance <= 0) > 0, F.lit(0.0)).otherwise(F.exp(F.sum(F.ln(chance)))).alias("p"))
    return words.join(chances, F.col(key) == F.col("_own"), "left").select(key, *keep, "p")


def expected_counts(words: DataFrame, model: DataFrame, m: int, total: float | Column, key: str = "seq", keep: Sequence[str] = (), left_flank: str | None = None) -> DataFrame:
    """Chance and expected count of each word."""
    total = F.lit(total) if not isinstance(total, Column) else total
    return model_probability(words, model, m, key, keep, left_flank).withColumn("expected", F.col("p") * total)


def fit_correlation(predicted: DataFrame, total: Column, by: Sequence[str] = ()) -> DataFrame:
    """``*by, r``: Pearson's R of observed counts ``n`` and whole expected counts."""
    return predicted.groupBy(*by).agg(F.corr(F.floor(F.col("p") * total).cast("double"), F.col("n").cast("double")).alias("r"))


def information_gain(predicted: DataFrame, threshold: int = 100) -> DataFrame:
    """``gain``: sum of q log2(q / p) over words seen ``threshold`` times or more, plus one term for all others.

    ``predicted(n, p)``. Both sums of chances are capped at 1; the lump term is there only if
    some word was seen less often.
    """
    total = predicted.agg(F.sum("n").alias("_total"))
    q = F.col("n") / F.col("_total")
    large = F.col("n") >= threshold
    parts = predicted.crossJoin(F.broadcast(total)).agg(
        F.sum(F.when(large & (F.col("p") > 0), q * F.log2(q / F.col("p")))).alias("_head"),
        F.coalesce(F.least(F.sum(F.when(large, q)), F.lit(1.0)), F.lit(0.0)).alias("_q"),
        F.coalesce(F.least(F.sum(F.when(large, F.col("p"))), F.lit(1.0)), F.lit(0.0)).alias("_p"),
        F.count_if(~large).alias("_small"),
    )
    rest = F.when((F.col("_small") > 0) & (F.col("_q") < 1) & (F.col("_p") < 1), (1 - F.col("_q")) * F.log2((1 - F.col("_q")) / (1 - F.col("_p")))).otherwise(0.0)
    return parts.select((F.coalesce("_head", F.lit(0.0)) + rest).alias("gain"))


def order_scores(train: DataFrame, test: DataFrame, orders: Sequence[int], k: int, seq: str = "seq", n: str = "n") -> DataFrame:
    """``m, r``: for each word length of the model, how its expected counts fit the test words of length ``k``."""
    observed = count_kmers(test, k, seq, weight=n)
    total = observed.agg(F.sum("n").alias("_total"))
    scored = None
    for m in orders:
        model = transition_model(count_kmers(train, m, seq, weight=n)).withColumn("p", F.when(F.lit(m == 1), F.col("share")).otherwise(F.col("p")))
        one = model_probability(observed, model, m, "kmer", ["n"]).crossJoin(F.broadcast(total))
        one = fit_correlation(one, F.col("_total")).select(F.lit(m).alias("m"), "r")
        scored = one if scored is None else scored.union(one)
    return scored


def best_order(scores: DataFrame) -> DataFrame:
    """The first length with the strictly best R."""
    return scores.agg(F.max_by("m", F.struct(F.coalesce("r", F.lit(-2.0)), -F.col("m"))).alias("m"), F.max("r").alias("r"))


def enrichment(train: DataFrame, test: DataFrame, gain: DataFrame, min_count: int, longest: int, lengths: int, gain_threshold: int, seq: str = "seq", n: str = "n") -> DataFrame:
    """``k, m, gain``: from the test sample's kmax to the best order to the gain at each following length.

    Two numbers, kmax and the order, come to the driver.
    """
    top = kmax(test, min_count, longest, seq, n).first()["kmax"]
    chosen = best_order(order_scores(train, test, range(1, top + 1), top, seq, n)).first()["m"]
    model = transition_model(count_kmers(train, chosen, seq, weight=n)).withColumn("p", F.when(F.lit(chosen == 1), F.col("share")).otherwise(F.col("p")))
    out = None
    for k in range(top, top + lengths):
        predicted = model_probability(count_kmers(gain, k, seq, weight=n), model, chosen, "kmer", ["n"])
        one = information_gain(predicted, gain_threshold).select(F.lit(k).alias("k"), F.lit(chosen).alias("m"), "gain")
        out = one if out is None else out.union(one)
    return out


def table_likelihood(probes: DataFrame, universe: DataFrame, model: DataFrame, m: int, seq: str = "seq", n: str = "n") -> DataFrame:
    """``nll``: -sum n ln P + N ln(sum of P over the whole universe)."""
    own = model_probability(probes, model, m, seq, [n]).agg(F.sum(-F.col(n) * F.ln("p")).alias("_own"), F.sum(n).alias("_n"))
    every = model_probability(universe, model, m, seq).agg(F.sum("p").alias("_z"))
    return own.crossJoin(every).select((F.col("_own") + F.col("_n") * F.ln("_z")).alias("nll"))


def saturated_likelihood(probes: DataFrame, n: str = "n") -> DataFrame:
    """``n_reads, saturated``: likelihood of the table under its own shares."""
    return probes.agg(F.sum(n).alias("n_reads"), (F.sum(-F.col(n) * F.ln(n)) + F.sum(n) * F.ln(F.sum(n))).alias("saturated"))
