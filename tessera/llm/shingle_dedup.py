"""Near-dedup at a similarity of word shingles: deletion-variant signatures of SimHash fingerprints and of minima name the candidates, the texts decide.

SimHash comes first: fingerprints of the shingles that differ in three bits at most share a
one-wildcard variant of a segment, meet in an equality join on it and are verified bit by bit,
then by their texts. That finds the nearest copies only. A bit of a SimHash differs in some 15 %
of the places for two texts at a Jaccard similarity of 0.8, 10 of 64 on average and up to 20, and
segments of which one is sure to differ by one bit at most would hold six bits, which tells nothing
apart. So what bits leave apart goes through the same method over a signature whose cells are
minima of the shingles' hashes: cut into segments, one of which differs in at most one cell,
indexed by its variants without one cell, joined where they are equal, and verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import first_of_groups, plain_text, written
from tessera.llm.components import connected_components
from tessera.llm.simhash import linked_prints, majority

#: Segments of a signature and minima in each: two texts at similarity s agree in 7 or 8 of a segment's minima with
#: chance s**8 + 8 * s**7 * (1 - s), so at 0.8 no segment serves with odds 6e-5, at 0.85 with 8e-8.
SEGMENTS, MINIMA = 14, 8
#: Rounds in which a key's members are compared with one of them, before those that are still apart are compared.
ROUNDS = 2
#: Differing bits up to which two fingerprints are candidates.
MOST_BITS = 3
#: 64-bit words of the bitmap that bounds two sets' difference from below.
BITMAP_WORDS = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 2048


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """The distinct runs of ``width`` words; fewer words are one run."""
    return set(zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else {tuple(words)}


def similarity_of(a: set, b: set) -> float:
    """Jaccard similarity of two sets that aren't empty."""
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def signature(words: list[bytes], width: int, seed: int) -> tuple[np.ndarray, int, np.ndarray]:
    """``(keys, size, bitmap)`` of a text's shingles, as :func:`sketched` has them."""
    return sketched(words, width, seed)[:3]


def sketched(words: list[bytes], width: int, seed: int) -> tuple[np.ndarray, int, np.ndarray, int]:
    """``(keys, size, bitmap, fingerprint)`` of a text's shingles.

    ``keys`` are SEGMENTS * MINIMA hashes, each of a segment's minima without one; texts of fewer
    words have one key, of all words. ``size`` is the number of distinct shingles and ``bitmap``
    has a bit flipped for each of them, so two bitmaps differ in no more bits than the sets do in
    shingles. ``fingerprint`` is the SimHash of the distinct shingles.
    """
    bits = BITMAP_WORDS * 64
    if len(words) < width:
        key = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
        return key.view(np.int64), 1, _bitmap(key, bits), majority(key)
    hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)
    rng = np.random.default_rng(seed)
    flips, factors = rng.integers(0, 1 << 64, (2, SEGMENTS * MINIMA, 1), dtype=np.uint64)
    factors |= np.uint64(1)
    n = len(words) - width + 1
    runs = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        runs = _mixed(runs + hashes[i : i + n])
    runs = np.unique(runs)
    least = np.full(SEGMENTS * MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(runs), _PIECE):
        np.minimum(least, ((runs[at : at + _PIECE] ^ flips) * factors).min(axis=1), out=least)
    cells = _mixed(least * _ODD + np.arange(SEGMENTS * MINIMA, dtype=np.uint64)).reshape(SEGMENTS, MINIMA)
    without = cells.sum(axis=1, dtype=np.uint64)[:, None] - cells
    keys = _mixed(without.ravel() * _ODD + np.arange(SEGMENTS * MINIMA, dtype=np.uint64))
    return keys.view(np.int64), len(runs), _bitmap(runs, bits), majority(runs)


def _bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_reach(a: str, b: str, similarity: float) -> Column:
    """Whether sets of these sizes, whose bitmaps differ in so many bits, can reach the Jaccard similarity; only ever errs with yes."""
    apart = F.lit(0)
    for i in range(BITMAP_WORDS):
        apart = apart + F.bit_count(F.col(f"{a}_bits")[i].bitwiseXOR(F.col(f"{b}_bits")[i]))
    most = (F.col(f"{a}_size") + F.col(f"{b}_size")) * ((1 - similarity) / (1 + similarity))
    return apart <= most + 1e-6


def _alike(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose texts reach the similarity."""

    @F.pandas_udf("boolean")
    def reached(a: pd.Series, b: pd.Series) -> pd.Series:
        last, known = None, None  # pairs of one leader often come in a row
        out = []
        for x, y in zip(a, b, strict=True):
            if x != last:
                last, known = x, shingles(words_of(x), shingle)
            out.append(similarity_of(known, shingles(words_of(y), shingle)) >= similarity)
        return pd.Series(out, dtype=bool)

    left, right = texts.select(F.col("_node").alias("a"), F.col("_text").alias("_x")), texts.select(F.col("_node").alias("b"), F.col("_text").alias("_y"))
    return pairs.join(right, "b").join(left, "a").where(reached("_x", "_y")).select("a", "b")


def _apart(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """``_key, _node, _part`` of the keys whose members are in different components."""
    now = keys.join(parts, F.col("_node") == F.col("node"), "left").select("_key", "_node", F.coalesce("component", "_node").alias("_part"))
    apart = now.groupBy("_key").agg(F.min("_part").alias("_low"), F.max("_part").alias("_high")).where("_low < _high").select("_key")
    return written(now.join(apart, "_key"), "keys")


def _nearest_prints(sketches: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of texts that SimHash names: each text with one of its fingerprint, and each fingerprint with the least that it links to.

    So a dense group gives a pair or two a text, however many links it has.
    """
    prints = sketches.select("_node", "_print").distinct()
    leads = written(prints.groupBy("_print").agg(F.min("_node").alias("_lead")), "prints")
    same = prints.join(leads, "_print").where("_node <> _lead").select(F.col("_lead").alias("a"), F.col("_node").alias("b"))
    least = linked_prints(leads.select("_print"), MOST_BITS).groupBy("b").agg(F.min("a").alias("a"))
    one, other = leads.select(F.col("_print").alias("a"), F.col("_lead").alias("_a")), leads.select(F.col("_print").alias("b"), F.col("_lead").alias("_b"))
    near = least.join(one, "a").join(other, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return written(same.unionByName(near), "nearest")


def similar_components(docs: DataFrame, text_col: str = "text", similarity: float = 0.8, shingle: int = 5, seed: int = 42) -> DataFrame:
    """``node, component`` of the texts, as their xxhash64, that have another at the similarity or over.

    Texts whose fingerprints link are compared first. Then texts that share a key are candidates, where the
    components so far don't hold them together. Pairs within a component add nothing to it, so each
    round compares the members of a key with one of them and drops keys that have become one
    component; a large group of near copies is never all pairs. Members of a key that are in
    different components after the rounds meet in a join that lets a pair through only if the
    sets' sizes and bitmaps allow the similarity, an exact bound, so few pairs that fall short
    become rows; those are then compared each, so every candidate is decided.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sketched(words_of(t), shingle, seed) for t in b["_text"]]
            yield pd.DataFrame({"_node": b["_node"], "_keys": [f[0] for f in found], "_size": [f[1] for f in found], "_bits": [f[2] for f in found], "_print": [f[3] for f in found]})

    rows = docs.select(F.xxhash64(plain_text(text_col)).alias("_node"), plain_text(text_col).alias("_text"))
    sketches = written(rows.mapInPandas(sketch, "_node long, _keys array<long>, _size int, _bits array<long>, _print long"), "sketches")
    keyed = sketches.select("_node", F.explode("_keys").alias("_key"))
    shared = keyed.groupBy("_key").agg(F.min("_node").alias("_low"), F.max("_node").alias("_high")).where("_low < _high").select("_key")
    still = written(keyed.join(shared, "_key").distinct(), "keys")
    nearest = _nearest_prints(sketches)
    known = still.select("_node").distinct()
    compared = known.unionByName(nearest.select(F.explode(F.array("a", "b")).alias("_node"))).distinct()
    texts = written(rows.join(compared, "_node", "left_semi").groupBy("_node").agg(F.first("_text").alias("_text")), "texts")
    bounds = sketches.join(known, "_node", "left_semi").groupBy("_node").agg(F.first("_size").alias("_size"), F.first("_bits").alias("_bits"))
    links = written(_alike(nearest, texts, similarity, shingle), "links")
    parts = written(connected_components(links), "parts")
    still = _apart(still, parts)
    for i in range(ROUNDS + 1):
        if i < ROUNDS:
            leads = still.groupBy("_key").agg(F.min_by(F.struct(F.col("_node").alias("lead"), F.col("_part").alias("of")), F.xxhash64(F.lit(i), "_node")).alias("_l"))
            met = still.join(leads.select("_key", "_l.*"), "_key").where("_part <> of").select(F.least("_node", "lead").alias("a"), F.greatest("_node", "lead").alias("b"))
        else:
            members = written(still.join(bounds, "_node"), "members")
            left, right = (members.select("_key", F.col("_node").alias(n), F.col("_part").alias(f"{n}_part"), F.col("_size").alias(f"{n}_size"), F.col("_bits").alias(f"{n}_bits")) for n in ("a", "b"))
            met = left.join(right, "_key").where((F.col("a") < F.col("b")) & (F.col("a_part") != F.col("b_part")) & _may_reach("a", "b", similarity)).select("a", "b")
        found = written(_alike(met.distinct(), texts, similarity, shingle), "links")
        links = links.union(found)
        parts = written(connected_components(links), "parts")
        if i == ROUNDS:
            break
        still = _apart(still.drop("_part"), parts)
        if still.isEmpty():
            break
    return parts


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, all their columns, that stand for their component of similar texts: one each, that of the smallest id.

    Texts link if the Jaccard similarity of their distinct ``shingle``-word runs is ``similarity``
    or more; A-Z are lower-cased, fewer words are one run, and all texts without words are alike. A
    null text is empty. Null ids come after all others; of rows that share the smallest id, or
    repeat, the first by a hash of the text and then by their other columns stays. An empty table gives no rows.
    """
    parts = similar_components(docs, text_col, similarity, shingle, seed)
    keys = written(docs.select(F.col(id_col).alias("_id"), F.xxhash64(plain_text(text_col)).alias("_key")), "keys")
    grouped = keys.join(parts, F.col("_key") == F.col("node"), "left").select("_id", "_key", F.coalesce("component", "_key").alias("_group"))
    return first_of_groups(docs, grouped, id_col, text_col)
