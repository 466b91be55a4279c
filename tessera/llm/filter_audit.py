"""Filter interaction audit: what each of five filters removes in every order, with Shapley values from the game's potential.

A document fails some of the filters, whatever their order; a set S of filters removes the documents
that fail any of them, v(S). So one count per part and set of failed filters tells everything: steps
of an order are differences of v between coalitions, and the Hart-Mas-Colell potential, made from
smaller coalitions to larger ones, gives the Shapley values as the grand potential less that without
the filter.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACED_WORD, plain_text

#: Fixed values of the operator's contract: the filters and their thresholds.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"

#: Places that the rows of one text are dealt to when they look up its smallest id.
SALTS = 16
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text without nulls fails."""
    words = F.regexp_extract_all(text, F.lit(f"({SPACED_WORD})"), F.lit(1))
    return F.transform(F.array(words), lambda w: _bits(F.size(w), F.size(F.array_distinct(w)), text))[0]


def _bits(n: Column, distinct: Column, text: Column) -> Column:
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = (n < LEAST_WORDS, distinct * 100 < n * LEAST_DISTINCT, capitals * 100 > F.length(text) * MOST_CAPITALS, text.rlike(SIGNS))
    return reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, id, mask, n``: rows by part, id and the filters they fail (bit i for filter i), as often as they occur.

    Texts are told apart by SHA-256. Rows fold by text, id and part on the map side, so copies
    travel once per task and only hashes move.
    """
    text = plain_text(text_col)
    facts = docs.select(F.col(id_col).alias("id"), plain_text(F.col(part_col).cast("string")).alias("part"), F.unhex(F.sha2(text, 256)).alias("_sha"), own_failures(text).alias("_own"))
    facts = facts.groupBy("_sha", "_own", "part", "id").agg(F.count(F.lit(1)).alias("n"))
    least = facts.groupBy("_sha").agg(F.min("id").alias("_least"), F.max("id").alias("_most")).where("_least < _most").select("_sha", "_least")
    repeated = F.when(F.coalesce(F.col("id") > F.col("_least"), F.lit(False)), 1 << FILTERS.index("E")).otherwise(0)
    salt = F.lit(SALTS)  # rows of one text go to SALTS places, its least id to each
    facts = facts.withColumn("_salt", F.pmod(F.xxhash64("id", "part"), salt))
    least = least.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salt.cast("long") - 1)))
    masked = facts.join(least, ["_sha", "_salt"], "left").select("part", "id", (F.col("_own") + repeated).alias("mask"), "n")
    return masked.groupBy("part", "id", "mask").agg(F.sum("n").alias("n"))


def mask_counts(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``part, mask, n, good, toxic``: documents, those of good quality and toxic ones; ids without a label are neither."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(F.max((F.col(good_col) == 1).cast("int")).alias("_g"), F.max((F.col(toxic_col) == 1).cast("int")).alias("_t"))
    marked = failed.join(marks, "id", "left")
    sums = [F.sum(F.col("n") * x).alias(name) for x, name in ((F.lit(1), "n"), (F.coalesce("_g", F.lit(0)), "good"), (F.coalesce("_t", F.lit(0)), "toxic"))]
    return marked.groupBy("part", "mask").agg(*sums)


def games(counts: DataFrame) -> DataFrame:
    """``part, total, v, g, t``: a row per part with arrays by coalition: documents, good ones and toxic ones that it removes."""
    listed = counts.groupBy("part").agg(F.sum("n").cast("bigint").alias("total"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_m"))  # at most 32 a part

    def removed(value: str) -> Column:
        hit = lambda s: F.filter("_m", lambda m: m["mask"].bitwiseAND(s) != 0)
        return F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda s: F.aggregate(hit(s), F.lit(0).cast("bigint"), lambda a, m: a + m[value].cast("bigint")))

    return listed.select("part", "total", removed("n").alias("v"), removed("good").alias("g"), removed("toxic").alias("t"))


def with_potential(played: DataFrame) -> DataFrame:
    """Adds ``p``: 120 times the potential of each coalition, P(S) = (v(S) + sum of P(S without i)) / |S|.

    120 P is a whole number, as P's denominators divide |S|!, and is made so without rounding:
    one turn per size of coalition, each from the potentials of the size before.
    """
    without = " + ".join(f"if((s & {1 << i}) != 0, p[s ^ {1 << i}], 0)" for i in range(len(FILTERS)))
    turn = f"transform(sequence(0, {SETS - 1}), s -> if(bit_count(s) = k, (v[s] * {len(ORDERS)} + {without}) div k, p[s]))"
    return played.withColumn("p", F.expr(f"aggregate(sequence(1, {len(FILTERS)}), array_repeat(0L, {SETS}), (p, k) -> {turn})"))


def audit(played: DataFrame) -> DataFrame:
    """A row for each part, order and step from :func:`with_potential`'s games; see :func:`filter_audit`."""
    everything, steps = SETS - 1, []
    for order in ORDERS:
        before = 0
        for k, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            steps.append((order, k, letter, before, before | own, own))
            before |= own
    listed = played.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, _before int, _after int, _own int")
    rows = played.crossJoin(F.broadcast(listed))  # 600 rows, fixed
    at = lambda game, i: F.get(F.col(game), i)
    before, after, own = F.col("_before"), F.col("_after"), F.col("_own")
    removed = at("v", after) - at("v", before)
    return rows.select(
        "part", "filter_order", "step", "filter",
        (F.col("total") - at("v", after)).alias("kept"),
        removed.alias("removed"),
        (at("v", own) - removed).alias("redundant"),
        (F.col("v")[everything] - at("v", F.lit(everything) - own)).alias("unique_fails"),
        (at("g", after) - at("g", before)).alias("good_lost"),
        (at("t", after) - at("t", before)).alias("toxic_lost"),
        (F.col("p")[everything] - at("p", F.lit(everything) - own)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    Columns: ``part, filter_order, step, filter, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``; ``shapley`` is summed over all 120 orders. Filters: A under
    200 words; B fewer than half of the words distinct; C over 2 % capital letters A-Z; D any of
    ``#$%&*|``; E the same text as a smaller id's, anywhere in the table.

    A null text is empty (fails A; empty texts are copies of one another), a null or empty part
    is "". A null id is smaller or larger than none: it neither fails E nor makes another row fail
    it, and has no label. Rows that repeat id and text count each and don't make one another fail.
    Labels that repeat an id count once, as good or toxic if any of them says so. Whole texts are
    read; further columns are ignored and may have any name. An empty table gives no rows.
    """
    return audit(with_potential(games(mask_counts(failures(docs, id_col, text_col, part_col), labels, id_col))))
