"""Line dedup by a deletion neighbourhood over words: shared variants, verified edit distance, earliest line stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import orderable, plain_text, repeated, written

#: Lines are near copies at one word inserted, deleted or replaced, whatever their length, if the longer has this many words.
LEAST_WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def lines_of(text: str) -> Iterator[tuple[int, list[bytes]]]:
    """Number (from 0) and words of each line that has any: A-Z lower-cased, words split at ASCII white space."""
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").lower().split(b"\n")):
        if words := line.split():
            yield i, words


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of which two lines within one word edit share one: halves of the line as the longer and as the shorter of a pair.

    Cut the longer line, of n words, at n // 2: the edit lies on one side and the other side is
    alike. Even places hold first halves, odd ones second halves.
    """
    n, keys = len(words), []
    for longer, cut in ((n, 0), (n + 1, 1)):
        if longer >= LEAST_WORDS:
            m = longer // 2
            for side, part in ((0, words[:m]), (1, words[m - cut :])):
                keys.append(xxhash.xxh64_intdigest(b"%d %d " % (longer, side) + b" ".join(part)) - (1 << 63))
        else:
            keys += [None, None]
    return keys


def deletion_keys(words: list[bytes]) -> tuple[int, np.ndarray]:
    """Hash of the line and of each variant that lacks one word, in time linear in the line."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(words), _BASE, dtype=np.uint64))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)))
        without = sums[:-1] + (sums[-1] - sums[1:]) * _INVERSE
    return int(sums[-1:].view(np.int64)[0]), without.view(np.int64)


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether two word lists differ by one word inserted, deleted or replaced at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, line, digest, keys = [], [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            for number, words in lines_of(text):
                row.append(i)
                line.append(number)
                digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                keys.append(half_keys(words) if len(words) + 1 >= LEAST_WORDS else None)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(row, type=pa.int32())), pa.array(line, type=pa.int32()), pa.array(digest, type=pa.binary()), pa.array(keys, type=pa.list_(pa.int64()))],
            names=["doc", "line", "digest", "keys"],
        )


#: Rows after which a batch of variants is handed on.
_BATCH = 200_000


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, place, doc, line, text``: place -1 with the line's text, then one per deleted word on a side where the edit may be."""

    def batch(own: pa.Array, keys: list, places: list, rows: list, lines: list, texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), pa.array(np.concatenate(places)), own.take(pa.array(rows, type=pa.int32())), pa.array(lines, type=pa.int32()), pa.array(texts, type=pa.string())],
            names=["key", "place", "doc", "line", "text"],
        )

    for b in batches:
        own = b.column(0)
        keys, places, rows, lines, texts = [], [], [], [], []
        for i, (text, marks) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            sides: dict[int, set[int]] = {}
            for m in marks:
                sides.setdefault(m["line"], set()).add(m["half"])
            for number, words in lines_of(text):
                if number not in sides:
                    continue
                whole, without = deletion_keys(words)
                low = high = 0
                if len(words) >= LEAST_WORDS:
                    middle = len(words) // 2
                    low = 0 if 1 in sides[number] else middle  # the second half is shared: the edit is in the first
                    high = len(words) if 0 in sides[number] else middle
                keys += [np.array([whole], dtype=np.int64), without[low:high]]
                places += [np.array([-1], dtype=np.int32), np.arange(low, high, dtype=np.int32)]
                rows += [i] * (1 + high - low)
                lines += [number] * (1 + high - low)
                texts.append(b" ".join(words).decode("utf-8", "replace"))
                texts += [None] * (high - low)
                if len(rows) >= _BATCH:
                    yield batch(own, keys, places, rows, lines, texts)
                    keys, places, rows, lines, texts = [], [], [], [], []
        if rows:
            yield batch(own, keys, places, rows, lines, texts)


def _earlier_near_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``at``, a struct of doc and line: first occurrences of lines that have an earlier line within one word edit."""
    kind = docs.schema["doc"].dataType.simpleString()
    keyed = classes.where("keys IS NOT NULL").select("doc", "line", F.posexplode("keys").alias("half", "key")).where("key IS NOT NULL").withColumn("half", F.pmod("half", F.lit(2)))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    marks = keyed.join(shared, "key").groupBy(F.col("doc").alias("of")).agg(F.collect_set(F.struct("line", "half")).alias("marks"))
    texts = docs.join(marks, F.col("doc") == F.col("of")).dropDuplicates(["doc"])  # rows that repeat are one
    made = written(texts.select("doc", "text", "marks").mapInArrow(_variant_rows, f"key long, place int, doc {kind}, line int, text string"), "variants")
    at = F.struct("doc", "line")
    # Lines alike without the word at one place differ there alone, so the earliest stands for all.
    groups = made.groupBy("key", "place").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    replaced = made.where("place >= 0").join(groups.where("n > 1 AND place >= 0").drop("n"), ["key", "place"]).select(at.alias("at"), "first")
    # A whole line equal to another's variant: either may be the earlier.
    shorter = groups.where("place = -1").select("key", F.col("first").alias("whole"))
    longer = made.where("place >= 0").select("key", at.alias("at"))
    matched = longer.join(shorter, "key")
    inserted = matched.select("at", F.col("whole").alias("first")).union(matched.groupBy(F.col("whole").alias("at")).agg(F.min("at").alias("first")))
    pairs = replaced.union(inserted).where("first < at").groupBy("at").agg(F.min("first").alias("first"))
    texts = made.where("place = -1").select(at.alias("at"), "text")
    both = pairs.join(texts, "at").join(texts.select(F.col("at").alias("first"), F.col("text").alias("other")), "first")

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one_edit(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype=bool)

    return both.where(verified("text", "other")).select("at").distinct()


def _identity(id_col: str, text_col: str) -> Column:
    """What tells documents apart: the id and a 64-bit hash of the text, which only matters among rows that share the id; a struct, so null ids are equal."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(plain_text(text_col)).alias("text"))


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, line, fate`` for every line with a word: ``kept``, ``exact`` or ``near``; ``doc`` is a struct of id and text hash.

    Lines are compared by their words: A-Z lower-cased, split at ASCII white space. Of equal
    lines, also in one document, the earliest by (id, text hash, line number) stays. It goes too if an
    earlier line is within one word inserted, deleted or replaced and the longer of both has
    LEAST_WORDS words; that line may itself have gone for a still earlier one.
    The bound doesn't grow with the line: two words changed in twenty are not near.

    Variants are hashes of a line without one word, emitted only for lines that share a half
    with another and only for words of the other half, which loses no pair. Partners come from
    aggregates by variant, never as all pairs of a group; their words are then compared. Lines
    are numbered from 0 at each line feed. Blank lines are not rows here and always stay. A null
    text is empty; null ids are earliest. Rows that share an id are documents of their own; rows
    that repeat id and text both have the fates of the first, and :func:`line_counts` and
    :func:`drop_repeated_lines` take the lines of the others as exact copies. An empty table
    gives no rows; texts of any length are read whole; further columns are ignored.
    """
    rows = docs.select(_identity(id_col, text_col).alias("doc"), plain_text(text_col).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    lines = written(rows.mapInArrow(_line_rows, f"doc {kind}, line int, digest binary, keys array<bigint>"), "lines")
    classes = lines.groupBy("digest").agg(F.min(F.struct("doc", "line")).alias("first"), F.first("keys").alias("keys"))
    near = _earlier_near_lines(rows, classes.select("first.doc", "first.line", "keys")).withColumn("near", F.lit(True))
    judged = classes.select("digest", "first").join(near, F.col("first") == F.col("at"), "left").select("digest", "first", F.coalesce("near", F.lit(False)).alias("near"))
    fate = F.when(F.struct("doc", "line") != F.col("first"), "exact").when(F.col("near"), "near").otherwise("kept")
    return lines.select("doc", "line", "digest").join(judged, "digest").select("doc", "line", fate.alias("fate"))


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_lines, n_exact, n_near, n_kept, kept_lines``; blank lines don't count.

    The cases are those of :func:`mark_lines`. Of rows that repeat id and text one has the fates
    of its lines and the others, folded to a number before anything moves, have exact copies only.
    """
    of = mark_lines(docs, id_col, text_col).groupBy(F.col("doc").alias("_of")).agg(
        F.count(F.lit(1)).alias("_lines"),
        F.count_if(F.col("fate") == "exact").alias("_exact"),
        F.count_if(F.col("fate") == "near").alias("_near"),
        F.count_if(F.col("fate") == "kept").alias("_kept"),
        F.sort_array(F.collect_set(F.when(F.col("fate") == "kept", F.col("line")))).alias("_places"),
    )
    rows = docs.groupBy(_identity(id_col, text_col).alias("_doc")).agg(F.count(F.lit(1)).alias("_rows"))
    each = rows.join(of, F.col("_doc") == F.col("_of"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("_rows", F.lit(2)))))
    first, zero = F.col("_copy") == 1, F.lit(0).cast("long")
    per = {c: F.coalesce((F.col(f"_{c}") / F.col("_rows")).cast("long"), zero) for c in ("lines", "exact", "near", "kept")}
    counted = each.select(
        F.col("_doc.id").alias(id_col),
        F.when(first, F.lit(1)).otherwise(F.col("_rows") - 1).alias("_rows"),
        per["lines"].alias("n_lines"),
        F.when(first, per["exact"]).otherwise(per["lines"]).alias("n_exact"),
        F.when(first, per["near"]).otherwise(zero).alias("n_near"),
        F.when(first, per["kept"]).otherwise(zero).alias("n_kept"),
        F.when(first, F.coalesce("_places", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")).alias("kept_lines"),
    )
    return repeated(counted, "_rows")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and its text without the lines that :func:`mark_lines` drops; blank lines stay.

    Of rows that repeat id and text, the first by their other columns keeps its lines and the
    others lose all that have words. Columns of any name may be there.
    """
    gone = mark_lines(docs, id_col, text_col).groupBy(F.col("doc").alias("_of")).agg(
        F.collect_set(F.when(F.col("fate") != "kept", F.col("line"))).alias("_gone"), F.collect_set("line").alias("_all")
    )
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _identity(id_col, text_col).alias("_doc"))  # nested, so no name can clash
    nth = F.row_number().over(Window.partitionBy("_doc").orderBy(*orderable("_row", docs, text_col)))
    joined = rows.withColumn("_nth", nth).join(gone, F.col("_doc") == F.col("_of"), "left")
    text = F.col("_row")[text_col]
    out = F.when(F.col("_nth") == 1, F.col("_gone")).otherwise(F.col("_all"))
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(out, i))
    clean = F.when(F.size(F.coalesce(out, F.array().cast("array<int>"))) == 0, text).otherwise(F.array_join(kept, "\n"))
    return joined.select(F.col("_row").withField(text_col, clean).alias("_row")).select("_row.*")
