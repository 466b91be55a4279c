"""Shared helpers: distributed running totals, sizing rules, whole-text expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import fresh_path, shared_folder, written

__all__ = ["cell_bits", "first_of_groups", "fresh_path", "n_spaced_words", "orderable", "plain_text", "repeated", "running_total", "shared_folder", "top_bits", "written"]

#: Rows that one cell of a range-cut order holds on average; a cell is the unit that one task sorts.
ROWS_PER_CELL = 1024

#: Fixed values of the operators' contracts: A-Z, and the word classes as Java and Python regexes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def cell_bits(rows: int, per_cell: int = ROWS_PER_CELL) -> int:
    """Bits of a power-of-two number of cells that hold ``per_cell`` rows each on average."""
    return max(0, math.ceil(math.log2(max(1, rows / per_cell))))


def top_bits(key: Column, bits: int) -> Column:
    """The cell of a uniform 64-bit key; cells are ordered as their keys are."""
    return F.shiftright(key, 64 - bits).cast("int") if bits else F.lit(0)


def running_total(df: DataFrame, groups: list[str], key: str, ties: list[str], value: Column, out: str, bits: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group up to this one, by (key, ties).

    ``key`` is a uniform 64-bit hash and ``groups`` hold no nulls. The order is cut into 2**bits
    cells by key; one small aggregate gives each cell's offset and only rows of one cell are
    sorted together, so a group of any size spreads over many tasks. ``df`` is scanned twice
    and should be a written table.
    """
    celled = df.withColumn("_cell", top_bits(F.col(key), bits)).withColumn("_value", value)
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        celled.groupBy(*groups, "_cell")
        .agg(F.sum("_value").alias("_in_cell"))
        .select(*groups, "_cell", F.coalesce(F.sum("_in_cell").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*groups, "_cell").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        celled.join(offsets, [*groups, "_cell"])
        .withColumn(out, F.col("_before") + F.sum("_value").over(inside))
        .drop("_cell", "_value", "_before")
    )


def plain_text(column: str | Column) -> Column:
    """The text, null counting as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def repeated(df: DataFrame, times: str, number: str | None = None) -> DataFrame:
    """Each row as often as its column ``times`` says, without that column; ``number`` names a column that counts the copies from 0.

    No array is longer than 65,536 or the ``times``-th part of that.
    """
    most = 1 << 16
    pieces = df.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col(times) - 1, 16)))).where(F.col(times) > 0)
    left = F.least(F.col(times) - F.col("_piece") * most, F.lit(most))
    copies = pieces.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), left - 1)))
    if number:
        copies = copies.withColumn(number, F.col("_piece") * most + F.col("_copy"))
    return copies.drop("_piece", "_copy", times)


def orderable(row: str, docs: DataFrame, text_col: str) -> list[Column]:
    """The fields of a nested row that can be ordered, without the text."""
    return [F.col(row)[c] for c, kind in docs.dtypes if c != text_col and "map<" not in kind and "variant" not in kind] or [F.lit(0)]


def n_spaced_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text without nulls.

    Every other character is dropped first, so the count is that of the starts of words.
    """
    return F.regexp_count(text, F.lit(SPACED_WORD)).cast("long")


def first_of_groups(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of ``docs`` with the smallest id of each ``_group``; ``grouped`` has ``_id, _key, _group`` for each, ``_key`` being the xxhash64 of its text."""
    mine = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"))
    stays = grouped.groupBy("_group").agg(F.min(mine).alias("_mine")).select("_mine")
    mine = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(plain_text(text_col)).alias("key"))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), mine.alias("_mine"))  # nested, so no name can clash
    first = F.row_number().over(Window.partitionBy("_mine").orderBy(*orderable("_row", docs, text_col)))
    return keyed.join(stays, "_mine", "left_semi").withColumn("_nth", first).where("_nth = 1").select("_row.*")
