"""Exact dedup: group by a 128-bit content hash, compare bytes in the group, keep one id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import orderable, plain_text, repeated


def text_classes(docs: DataFrame, id_col: str, text_col: str, content_hash: Callable[[Column], Column] = F.md5) -> tuple[DataFrame, DataFrame]:
    """``(rows, classes)``: rows ``(_id, _hash, _sha, _rows)`` and classes ``(_hash, _sha, keep_id, group_size)``.

    A class is formed by hash *and* text, so bytes are compared inside each hash group; copies
    fold on the map side and a text crosses the network once per map task, however often it
    occurs. Rows themselves travel without their text.
    """
    text = plain_text(text_col)
    source = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_hash", content_hash(F.col("_text")))
    classes = (
        source.groupBy("_hash", "_text")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size")
    )
    rows = source.select("_id", "_hash", F.sha2("_text", 256).alias("_sha")).groupBy("_id", "_hash", "_sha").agg(F.count(F.lit(1)).alias("_rows"))
    return rows, classes


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when all their bytes are; of equal texts the row with the largest id stays.
    A null text counts as empty, so null and empty texts are one group. Null ids are smaller
    than any other; a group of null ids only keeps one of them. Rows that repeat both id and
    text count in ``group_size`` and come back as often as they occur, one of them kept. An
    empty table gives no rows; further columns are ignored.

    ``content_hash`` may be weak: texts that collide form classes of their own, told apart by
    the bytes in the grouping and by SHA-256 where rows look up their class.
    """
    rows, classes = text_classes(docs, id_col, text_col, content_hash)
    found = repeated(rows.join(classes, ["_hash", "_sha"]), "_rows", "_nth")
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 0)).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that exact dedup keeps; the cases are those of :func:`exact_dedup`.

    Keepers are found without moving texts twice; whole rows then move once, by id. Of rows
    that repeat id and text, the one first by their other columns stays.
    """
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.struct(F.col(id_col).alias("id")).alias("_key"), F.col("text_sha256").alias("_sha"))
    row = F.struct(*docs.columns).alias("_row")  # nested, so no name can clash
    rows = docs.select(row, F.struct(F.col(id_col).alias("id")).alias("_key"), F.sha2(plain_text(text_col), 256).alias("_sha"))
    first = Window.partitionBy("_key", "_sha").orderBy(*orderable("_row", docs, text_col))
    return rows.join(kept, ["_key", "_sha"], "left_semi").withColumn("_first", F.row_number().over(first)).where("_first = 1").select("_row.*")
