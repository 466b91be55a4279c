"""SimHash near-dedup with deletion-variant signatures: one-wildcard segment variants, equality join, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ROWS_PER_CELL, first_of_groups, plain_text, written
from tessera.llm.components import connected_components

BITS = 64
#: Fingerprints that hold more than this part of all rows are fewer than it, so they may be broadcast.
MOST_HOT = 1024
#: Bits of each byte value, lowest first, and the place of each byte of a hash in the counts.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_PLACE = (np.arange(8, dtype=np.uint16) * 256)[None, :]


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles joined by one blank; fewer
    words are one shingle and no words give 0. A bit is set if it is in over half the hashes.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.array([xxhash.xxh64_intdigest(p, seed) for p in parts], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of unsigned hashes: a bit is set if it is in over half of them."""
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256)
    over_half = (seen @ _BYTE_BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(over_half, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``_id, _key, _print`` for each document, ``_key`` being a hash of the text; a null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "_key": b["_key"], "_print": np.fromiter((fingerprint(t, shingle, seed) for t in b["_text"]), dtype=np.int64, count=len(b))})

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(plain_text(text_col)).alias("_key"), plain_text(text_col).alias("_text"))
    return rows.mapInPandas(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _key long, _print long")


def one_wildcard_variants(value: Column, segments: int = 2) -> list[Column]:
    """Keys of a 64-bit value: each segment with each of its bits blanked in turn, below the variant's number."""
    width = BITS // segments
    keys = []
    for s in range(segments):
        part = F.shiftrightunsigned(value, s * width).bitwiseAND(F.lit((1 << width) - 1))
        keys += [part.bitwiseAND(F.lit(~(1 << b))).bitwiseOR(F.lit((s * width + b) << width)) for b in range(width)]
    return keys


def linked_prints(prints: DataFrame, most_bits: int = 3) -> DataFrame:
    """Pairs ``a < b`` of different fingerprints (column ``_print``, distinct) that differ in ``most_bits`` bits at most.

    With at most three differing bits and two segments, one segment differs in at most one
    bit; two values of a segment do exactly if they share a variant with one bit blanked.
    So 64 keys per fingerprint find every link; each candidate pair is verified in the join.
    """
    segments = (most_bits + 2) // 2  # floor(most_bits / segments) <= 1
    if BITS % segments or segments > 2:
        raise ValueError("two segments serve up to 3 differing bits")
    keyed = prints.select("_print", F.explode(F.array(*one_wildcard_variants(F.col("_print"), 2))).alias("_key"))
    left, right = keyed.withColumnRenamed("_print", "a"), keyed.withColumnRenamed("_print", "b")  # one exchange serves both
    apart = F.col("a").bitwiseXOR(F.col("b"))
    # 64 times the rows of ``prints``, which the planner's estimate leaves out: never a broadcast
    return left.join(right.hint("merge"), "_key").where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= most_bits) & (F.shiftrightunsigned("_key", BITS // 2) == _first_shared(apart))).select("a", "b")


def _first_shared(apart: Column) -> Column:
    """Number of the first variant that two values share, from the bits in which they differ, so that each pair is taken once."""
    half = BITS // 2
    low, high = apart.bitwiseAND(F.lit((1 << half) - 1)), F.shiftrightunsigned(apart, half)

    def of(part: Column) -> Column:  # no bit: the first variant; one bit: the variant without it
        return F.when(part == 0, F.lit(0)).otherwise(F.bit_count(part - 1))

    return F.when(F.bit_count(low) <= 1, of(low)).otherwise(half + of(high))


def _grouped(docs: DataFrame, id_col: str, text_col: str, most_bits: int, shingle: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents' fingerprints, and per fingerprint ``component_id``, ``_group``, a fingerprint that names its component, and ``_rows``."""
    prints = written(fingerprints(docs, id_col, text_col, shingle, seed), "prints")
    classes = written(prints.groupBy("_print").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")), "classes")
    found = connected_components(linked_prints(classes, most_bits))
    linked = classes.join(found, F.col("_print") == F.col("node")).select("_print", "component", "_first")
    named = linked.join(linked.groupBy("component").agg(F.min("_first").alias("_least")), "component").select("_print", "component", "_least")
    classed = classes.join(named, "_print", "left").select("_print", F.coalesce("_least", "_first").alias("component_id"), F.coalesce("component", "_print").alias("_group"), "_rows")
    return prints, written(classed, "classed")


def _with_classes(prints: DataFrame, classed: DataFrame) -> DataFrame:
    """Every row of ``prints`` with the columns of its fingerprint's class.

    A fingerprint of more than 1/MOST_HOT of all rows is looked up in a broadcast, of which there
    are fewer than MOST_HOT; so the rows of one that a join brings to one task are a small share
    of all, or few.
    """
    least = max(ROWS_PER_CELL, prints.count() // MOST_HOT)
    hot = F.broadcast(classed.where(F.col("_rows") > least))
    seen = prints.join(hot, "_print", "left")
    rest = seen.where(F.col("_rows").isNull()).select(*prints.columns).join(classed.where(F.col("_rows") <= least), "_print")
    return seen.where(F.col("_rows").isNotNull()).unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: ``id_col, fingerprint, component_id``.

    Fingerprints link at ``most_bits`` differing bits or fewer; ``component_id`` is the smallest
    id reachable over links, the document's own included. Equal fingerprints are one class from
    the start, so copies are never paired with each other. Texts without words have fingerprint
    zero and are linked like any others. Null ids don't count as smallest; a component of null
    ids alone has a null id. Repeated rows are returned each; an empty table gives no rows.
    """
    prints, classed = _grouped(docs, id_col, text_col, most_bits, shingle, seed)
    return _with_classes(prints, classed).select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 3, shingle: int = 3, seed: int = 42, similarity: float | None = None
) -> DataFrame:
    """The rows of ``docs``, all their columns, that stand for their component: one each, that of the smallest id.

    With a ``similarity``, texts link if the Jaccard similarity of their shingles reaches it:
    fingerprints at three bits name candidates, the minima of :mod:`tessera.llm.shingle_dedup`
    those that bits leave out; else at ``most_bits`` bits of their fingerprints. Null ids come after all others; of rows that share the smallest id, or repeat,
    the first by a hash of the text and then by their other columns stays.
    """
    if similarity is not None:
        from tessera.llm import shingle_dedup  # it builds on this module

        return shingle_dedup.drop_similar(docs, id_col, text_col, similarity, shingle, seed)
    prints, classed = _grouped(docs, id_col, text_col, most_bits, shingle, seed)
    return first_of_groups(docs, _with_classes(prints, classed), id_col, text_col)
