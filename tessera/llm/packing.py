"""Conflict-constrained best-fit packing of documents into sequences of fixed length."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import n_spaced_words, plain_text, repeated

#: Documents that one task packs together.
ROWS_PER_BLOCK = 2_048


def best_fit(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` for each ``(size, source, cluster)``, taken in the given order.

    Open bins are ordered by what room they have left. The search starts at the tightest bin
    that holds the item and goes on to the next until the bin's bitmaps allow it: its cluster
    is not in the bin and its source is there fewer than ``per_source`` times. Else a new bin
    is opened.
    """
    room: list[tuple[int, int]] = []
    clusters: list[int] = []
    sources: list[list[int]] = []  # one bitmap for each time a source may occur
    cluster_bits: dict[int, int] = {}
    source_bits: dict[int, int] = {}
    placed = []
    for size, source, cluster in items:
        c = cluster_bits.setdefault(cluster, 1 << len(cluster_bits))
        s = source_bits.setdefault(source, 1 << len(source_bits))
        at = bisect_left(room, (size, -1))
        while at < len(room) and (clusters[room[at][1]] & c or sources[room[at][1]][-1] & s):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * per_source)
        placed.append((b, capacity - left))
        insort(room, (left - size, b))
        clusters[b] |= c
        level = next(i for i, bits in enumerate(sources[b]) if not bits & s)
        sources[b][level] |= s
    return placed


def best_fit_as_spread_as_full(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """:func:`best_fit` with the smallest limit per source, of the even share of its largest source and its doubles, that needs at most a tenth more bins than the words do, or as few as no limit."""
    needed = max(1, math.ceil(sum(i[0] for i in items) / capacity))
    most = max(Counter(i[1] for i in items).values(), default=1)
    limit = max(1, math.ceil(max(Counter(i[1] for i in items if i[0]).values(), default=1) / needed))
    while True:
        placed = best_fit(items, capacity, min(limit, most))
        if limit >= most or 1 + max((b for b, _ in placed), default=0) <= 1.1 * needed:
            return placed
        limit *= 2


def _pack_block(capacity: int, per_source: int | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_rest", "_key", "_cluster"], ascending=[False, True, True], kind="stable")
        rest = pdf["_rest"].tolist()
        items = list(zip(rest, pdf["_source"].tolist(), pdf["_cluster"].tolist(), strict=True))
        placed = best_fit_as_spread_as_full(items, capacity) if per_source is None else best_fit(items, capacity, per_source)
        block, used = int(pdf["_block"].iloc[0]) << 32, 1 + max((b for b, _ in placed), default=-1)
        out = []
        for own, size, r, (b, offset) in zip(pdf["_id"], pdf["_size"].tolist(), rest, placed, strict=True):
            whole = (size - r) // capacity
            for piece in range(whole):
                out.append((own, piece, piece * capacity, capacity, block + used, 0))
                used += 1
            if r or not size:
                out.append((own, whole, whole * capacity, r, block + b, offset))
        return pd.DataFrame(out, columns=["_id", "piece", "first_word", "size", "bin", "offset"])

    return run


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    capacity: int = 2048,
    per_source: int | None = 1,
    seed: int = 42,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """One row per piece: ``id_col, piece, first_word, size, bin, offset``.

    Documents are counted in words ``[^\\x20\\x09-\\x0D]+`` and cut into pieces of ``capacity``
    words, each a bin of its own, and a rest. Rests are packed best-fit in decreasing size: a
    bin holds each duplicate cluster once and each source ``per_source`` times at most; with None,
    by the smallest limit that lets a block do with a tenth more bins than its words need, so a
    table of one source fills its bins too. A search that finds its
    source in every bin walks all of a block's open bins, at most ``rows_per_block`` of them.
    ``first_word`` is where the piece starts in its document, ``offset`` where it lies in its
    bin. Clusters are ``cluster_col``'s values or, without one, equal texts.

    Blocks of about ``rows_per_block`` documents, dealt by a hash of id, source, text and number of the copy, are packed
    independently, so the work spreads evenly whatever sources and clusters are; only the last
    bins of a block lose room by that. Null texts are empty; an empty document is one piece of
    size 0. Null sources are one source, null clusters one cluster. Rows that repeat id and text
    are one cluster, so they lie in different bins; they are told apart by a number, so no id or
    text fills a block. Further columns are ignored. An empty table gives no rows.
    """
    size = n_spaced_words(plain_text(text_col))
    cluster = F.xxhash64(plain_text(text_col)) if cluster_col is None else F.xxhash64(F.struct(cluster_col))
    blocks = max(1, math.ceil(docs.count() / rows_per_block))
    rows = docs.select(F.col(id_col).alias("_id"), size.alias("_size"), F.xxhash64(F.struct(source_col)).alias("_source"), cluster.alias("_cluster"))
    own = ["_id", "_size", "_source", "_cluster"]
    rows = repeated(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_rows")), "_rows", "_nth")
    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), *own, "_nth")).withColumn("_rest", F.col("_size") % capacity)
    blocked = rows.withColumn("_block", F.pmod("_key", F.lit(blocks)).cast("int"))
    kind = docs.schema[id_col].dataType.simpleString()
    packed = blocked.groupBy("_block").applyInPandas(_pack_block(capacity, per_source), f"_id {kind}, piece int, first_word long, size long, bin long, offset long")
    return packed.withColumnRenamed("_id", id_col)


def packed_texts(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bin, doc_ids, text``: each bin's words in order, joined by blanks. Ids must be unique."""
    words = F.regexp_extract_all(plain_text(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    pieces = plan.join(docs.select(F.col(id_col), words.alias("_words")), id_col)
    cut = F.array_join(F.slice("_words", F.col("first_word").cast("int") + 1, F.col("size").cast("int")), " ")
    filled = pieces.select("bin", F.struct("offset", F.col(id_col).alias("own"), cut.alias("text")).alias("p")).groupBy("bin").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return filled.select("bin", F.transform("p", lambda p: p["own"]).alias("doc_ids"), F.array_join(F.filter(F.transform("p", lambda p: p["text"]), lambda t: t != ""), " ").alias("text"))
