"""Hard negatives: candidates in Hilbert order lie in blocks with zone maps, and interval arithmetic tells which blocks an anchor must read.

Vectors are whole numbers. A Hilbert curve over the most varied dimensions orders them; each block
holds neighbours on it, with the least and largest value of every dimension. For an anchor the
products of its components with those bounds give an interval that holds its score with every row
of the block, so a block is read only if the interval meets the scores that are still wanted: the
best positives first, then the windows that the positives open for negatives.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Rows of a block, of a range that one task orders, anchors of a batch.
BLOCK_ROWS, RANGE_ROWS, BATCH_ROWS = 1024, 16_384, 256
#: Zone maps of a page, blocks of a tile, batches of a slice: what one task compares at once.
PAGE, TILE, SLICE = 256, 16, 64
#: Dimensions of the curve and bits of each; a key has 60 bits.
AXES, BITS = 15, 4
#: Deviations from the mean that the curve's grid spans on each side.
SPREAD = 2.5
LEAST = np.iinfo(np.int64).min

_BLOCK = "block long, width int, ids array<long>, labels array<long>, data binary, size int, anchors array<boolean>, lo array<long>, hi array<long>"
_BATCH = "batch long, width int, ids array<long>, labels array<long>, homes array<long>, data binary, size int"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float = 256.0) -> DataFrame:
    """``_id, _label, _vec``: rows that take part, each component floor(scale * x), x as double; an id counts once, with its least label and vector."""
    finite = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    rows = rows.select(F.col(id_col).cast("bigint").alias("_id"), F.struct(F.col(label_col).cast("bigint").alias("label"), whole.alias("vec")).alias("_row"))
    return rows.groupBy("_id").agg(F.min("_row").alias("_row")).select("_id", F.col("_row.label").alias("_label"), F.col("_row.vec").alias("_vec"))


def hilbert_keys(axes: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of whole numbers below ``2**bits``; dimensions times bits are at most 63."""
    x, d = axes.T.astype(np.int64).copy(), axes.shape[1]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[d - 1] & q, q - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | x[i] >> b & 1
    return key


def curve(rows: DataFrame) -> Callable[[Column], Column]:
    """The Hilbert key of a vector over the AXES most varied dimensions; a vector without one of them counts as at its mean."""
    stats = rows.select(F.posexplode("_vec").alias("d", "x")).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    chosen = stats.orderBy(F.desc(F.col("n") * F.col("s") * F.col("s")), "d").limit(AXES).collect()
    at = [(r["d"], r["m"], max(r["s"], 1e-9)) for r in sorted(chosen, key=lambda r: r["d"])]
    levels = 1 << BITS

    @F.pandas_udf("long")
    def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            grid = np.full((len(vectors), max(1, len(at))), levels // 2)
            for a, (d, mean, deviation) in enumerate(at):
                x = np.array([v[d] if len(v) > d else mean for v in vectors], dtype=np.float64)
                grid[:, a] = np.clip(np.floor((x - mean) / deviation * (levels / 2 / SPREAD)) + levels / 2, 0, levels - 1)
            yield pd.Series(hilbert_keys(grid, BITS))

    return key


def _packed(x: np.ndarray) -> tuple[bytes, int]:
    """A whole-number matrix in the smallest of 2, 4 or 8 bytes a number, and that size."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    size = 2 if largest < 1 << 15 else 4 if largest < 1 << 31 else 8
    return x.astype(f"<i{size}").tobytes(), size


def _matrix(row) -> np.ndarray:
    return np.frombuffer(row.data, dtype=f"<i{row.size}").reshape(len(row.ids), row.width).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; those beyond 64 bits stop at the ends of their range."""
    most = int(max(np.abs(a).max(initial=0), 0)) * int(max(np.abs(b).max(initial=0), 0)) * max(1, a.shape[1])
    if 0 <= most < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if 0 <= most < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST, np.iinfo(np.int64).max).astype(np.int64)


def blocks_of(rows: DataFrame, anchor: Column) -> DataFrame:
    """Candidates in Hilbert order as written blocks of up to BLOCK_ROWS rows with their zone maps."""
    keyed = rows.select("_id", "_label", "_vec", F.size("_vec").alias("_width"), F.coalesce(anchor, F.lit(False)).alias("_anchor"), curve(rows)(F.col("_vec")).alias("_key"))
    ranges = max(1, math.ceil(rows.count() / RANGE_ROWS))
    ordered = keyed.repartitionByRange(ranges, "_width", "_key", "_id").sortWithinPartitions("_width", "_key", "_id")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, n, held = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            held = b if held is None else pd.concat((held, b))
            while len(held) > BLOCK_ROWS or len(held) and held["_width"].iloc[0] != held["_width"].iloc[-1]:
                full = min(BLOCK_ROWS, int((held["_width"] == held["_width"].iloc[0]).sum()))
                yield block(first + n, held.iloc[:full])
                held, n = held.iloc[full:], n + 1
        if held is not None and len(held):
            yield block(first + n, held)

    def block(number: int, b: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(b["_vec"].to_numpy()).astype(np.int64)
        data, size = _packed(x)
        width = x.shape[1]
        row = (number, width, b["_id"].tolist(), b["_label"].tolist(), data, size, b["_anchor"].tolist(), x.min(axis=0).tolist(), x.max(axis=0).tolist())
        return pd.DataFrame([row], columns=[f.split()[0] for f in _BLOCK.split(", ")])

    return written(ordered.select("_id", "_label", "_vec", "_width", "_anchor").mapInPandas(pack, _BLOCK), "blocks")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Positives:
    """What a search for the best rows of an anchor's own label wants: scores from the k-th best in the anchor's home block on."""

    goals = "least array<long>"

    def __init__(self, k: int):
        self.k = k

    def probe(self, labels, own, ids, owner, scores, asked) -> dict:
        """Goals of one anchor from the scores of its home block."""
        mine = np.flatnonzero((labels == own) & (ids != owner))
        return {"least": [int(np.sort(scores[mine])[-self.k]) if len(mine) >= self.k else LEAST]}

    def wanted(self, goal: dict, own: int, zone_labels: np.ndarray, low: int, high: int) -> bool:
        return high >= goal["least"][0] and own in zone_labels

    def take(self, goal: dict, own: int, owner: int, labels: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, np.flatnonzero((labels == own) & (scores >= goal["least"][0]) & (ids != owner))


class Negatives:
    """What the windows of an anchor's positives want: scores of other labels between the k-th best that the home block has in the window and its upper end."""

    goals = "asked array<long>, least array<long>, most array<long>"

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high

    def window(self, positive: int) -> tuple[int, int]:
        """Least and largest score n with low * positive <= 100 * n <= high * positive."""
        return -(-self.low * positive // 100), self.high * positive // 100

    def probe(self, labels, own, ids, owner, scores, asked) -> dict:
        other = np.sort(scores[labels != own])
        least, most = [], []
        for positive in asked:
            low, high = self.window(int(positive))
            until = int(np.searchsorted(other, high, side="right"))
            least.append(max(low, int(other[until - self.k])) if until >= self.k else low)
            most.append(high)
        return {"asked": [int(p) for p in asked], "least": least, "most": most}

    def wanted(self, goal: dict, own: int, zone_labels: np.ndarray, low: int, high: int) -> bool:
        return any(high >= a and low <= b and a <= b for a, b in zip(goal["least"], goal["most"], strict=True)) and bool((zone_labels != own).any())

    def take(self, goal: dict, own: int, owner: int, labels: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        other = labels != own
        for w, (a, b) in enumerate(zip(goal["least"], goal["most"], strict=True)):
            if a <= b:
                yield w, np.flatnonzero(other & (scores >= a) & (scores <= b))


def _batches(blocks: DataFrame, search, asked: DataFrame | None = None) -> DataFrame:
    """Anchors with their goals in batches of up to BATCH_ROWS, probed in their home blocks. ``asked`` has each block's ``anchors`` and the positives' scores of each."""
    names = [f.split()[0] for f in search.goals.split(", ")]
    listed = asked is not None
    source = blocks.join(asked.hint("merge"), "block") if listed else blocks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, n, held = TaskContext.get().partitionId() << 32, 0, []
        for frame in frames:
            for row in frame.itertuples():
                x, ids, labels = _matrix(row), np.array(row.ids, dtype=np.int64), np.array(row.labels, dtype=np.int64)
                where = {int(i): p for p, i in enumerate(ids)} if listed else {}
                own = np.array([where[r["anchor"]] for r in row.asked]) if listed else np.flatnonzero(row.anchors)
                scores = products(x[own], x)
                for k, i in enumerate(own):
                    goal = search.probe(labels, labels[i], ids, ids[i], scores[k], row.asked[k]["scores"] if listed else None)
                    held.append((row.width, int(ids[i]), int(labels[i]), row.block, x[i], goal))
                    if len(held) == BATCH_ROWS or held[0][0] != row.width:
                        cut = len(held) if held[0][0] == row.width else len(held) - 1
                        yield batch(first + n, held[:cut])
                        held, n = held[cut:], n + 1
        if held:
            yield batch(first + n, held)

    def batch(number: int, held: list) -> pd.DataFrame:
        data, size = _packed(np.stack([h[4] for h in held]))
        row = {"batch": number, "width": held[0][0], "ids": [h[1] for h in held], "labels": [h[2] for h in held], "homes": [h[3] for h in held], "data": data, "size": size}
        return pd.DataFrame([row | {f: [h[5][f] for h in held] for f in names}])

    goals = ", ".join(f"{f} array<array<long>>" for f in names)
    return written(source.mapInPandas(run, f"{_BATCH}, {goals}"), "batches")


def _each(row, names: list[str]) -> list[dict]:
    return [dict(zip(names, values, strict=True)) for values in zip(*(getattr(row, f) for f in names), strict=True)]


def needed_blocks(blocks: DataFrame, batches: DataFrame, search, n_blocks: int, n_batches: int) -> DataFrame:
    """``batch, slice, block, who``: the anchors of a batch, by place, whose bounds say that they must read a block.

    Batches are a stated query set against all zone maps, a slice of them and a page of maps at a time.
    """
    pages, slices = math.ceil(n_blocks / PAGE), math.ceil(n_batches / SLICE)
    names = [f.split()[0] for f in search.goals.split(", ")]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    left = batches.withColumn("slice", F.pmod(F.xxhash64("batch"), F.lit(max(1, slices))).cast("int")).withColumn("page", every(pages)).drop("homes")
    zones = blocks.select("block", "width", "lo", "hi", F.array_distinct("labels").alias("kinds"), F.pmod(F.xxhash64("block"), F.lit(max(1, pages))).cast("int").alias("page"), every(slices).alias("slice"))

    def run(own: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, zone in maps.groupby("width"):
            lo, hi = (np.stack(zone[c].to_numpy()).astype(np.int64).reshape(len(zone), width) for c in ("lo", "hi"))
            kinds, numbers = [np.asarray(k) for k in zone["kinds"]], zone["block"].tolist()
            for row in own[own["width"] == width].itertuples():
                x = _matrix(row)
                up, down = np.maximum(x, 0), np.minimum(x, 0)
                least, most = products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)
                goals = _each(row, names)
                for z, number in enumerate(numbers):
                    who = [i for i, goal in enumerate(goals) if search.wanted(goal, row.labels[i], kinds[z], least[i, z], most[i, z])]
                    if who:
                        out.append((row.batch, row.slice, number, who))
        return pd.DataFrame(out, columns=["batch", "slice", "block", "who"])

    return left.groupBy("page", "slice").cogroup(zones.groupBy("page", "slice")).applyInPandas(run, "batch long, slice int, block long, who array<int>")


def best_rows(blocks: DataFrame, batches: DataFrame, search) -> DataFrame:
    """``anchor, home, goal, id, score, rank``: the search's k best rows of each anchor and goal, from the blocks that must be read."""
    n_blocks, n_batches = blocks.count(), batches.count()
    needed = written(needed_blocks(blocks, batches, search, n_blocks, n_batches), "needed")
    tile = F.pmod(F.xxhash64("block"), F.lit(max(1, math.ceil(n_blocks / TILE)))).cast("int").alias("tile")
    names = [f.split()[0] for f in search.goals.split(", ")]
    asked = needed.groupBy(tile, "slice", "batch").agg(F.collect_list(F.struct("block", "who")).alias("needs")).join(batches.hint("merge"), "batch")  # no broadcast: its size is not that of the packed rows
    given = needed.select(F.col("block").alias("_own"), F.col("slice").alias("part"), tile.alias("place")).distinct()
    read = given.join(blocks.drop("lo", "hi", "anchors").hint("merge"), F.col("_own") == F.col("block")).drop("_own")

    def run(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out, known = [], {row.block: row for row in given.itertuples()}
        held = {b: (_matrix(row), np.array(row.ids, dtype=np.int64), np.array(row.labels, dtype=np.int64)) for b, row in known.items()}
        for row in own.itertuples():
            x, goals, found = _matrix(row), _each(row, names), {}
            for need in row.needs:
                y, ids, labels = held[need["block"]]
                who = np.asarray(need["who"])
                scores = products(x[who], y)
                for k, i in enumerate(who):
                    for w, hit in search.take(goals[i], row.labels[i], row.ids[i], labels, ids, scores[k]):
                        if len(hit):
                            best = hit[_best(scores[k][hit], ids[hit], search.k)]
                            found.setdefault((i, w), []).append((scores[k][best], ids[best]))
            for (i, w), parts in found.items():
                s, n = (np.concatenate(c) for c in zip(*parts, strict=True))
                best = _best(s, n, search.k)
                out += [(row.ids[i], row.homes[i], w, int(n[b]), int(s[b])) for b in best]
        return pd.DataFrame(out, columns=["anchor", "home", "goal", "id", "score"])

    part = asked.groupBy("tile", "slice").cogroup(read.groupBy("place", "part")).applyInPandas(run, "anchor long, home long, goal int, id long, score long")
    order = F.row_number().over(Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), "id"))
    return part.withColumn("rank", order).where(F.col("rank") <= search.k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and positive.

    ``anchor`` is a condition on ``_id``. An anchor's positives are its ``positives`` best other
    rows of its label; for each, the ``negatives`` best rows of other labels whose score lies
    between ``low`` and ``high`` per cent of the positive's come back, fewer if there are fewer.
    Scores are exact inner products of floor(256 * component); ties go to the smaller id. Every
    candidate is reached unless its block's bounds rule it out, so nothing is missed.

    Rows with a null id or label, or a vector that is null or holds null or non-finite components
    take no part. An id that repeats counts once, with its least label and vector. Vectors of
    different lengths never meet; empty ones score 0. Ids and labels are whole numbers. Further
    columns are ignored and may have any name. An empty table gives no rows.
    """
    rows = written(whole_vectors(vectors, id_col, vector_col, label_col), "whole")
    blocks = blocks_of(rows, anchor)
    search = Positives(positives)
    found = written(best_rows(blocks, _batches(blocks, search), search), "positives")
    asked = found.groupBy("home", "anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("scores"))  # at most ``positives``
    asked = asked.groupBy(F.col("home").alias("block")).agg(F.collect_list(F.struct("anchor", "scores")).alias("asked"))  # at most BLOCK_ROWS
    windows = Negatives(negatives, low, high)
    batches = _batches(blocks, windows, asked)
    mined = best_rows(blocks, batches, windows)
    goals = batches.select(F.explode(F.arrays_zip("ids", "asked")).alias("_a")).select(F.col("_a.ids").alias("anchor"), F.posexplode("_a.asked").alias("goal", "score"))
    mined = mined.select("anchor", "goal", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank").join(goals, ["anchor", "goal"])
    return (
        found.select("anchor", F.col("id").alias("positive_id"), "score").join(mined, ["anchor", "score"])
        .select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
    )
