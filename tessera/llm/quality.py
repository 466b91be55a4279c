"""Quality: a support vector machine over n-gram indicators scaled by the classes' log-count ratios.

A document is the set of its n-grams: words and pairs of words, and runs of up to three word shapes
(case, digits, signs, whether a word repeats the one before). Each indicator counts as the
logarithm of the ratio of its shares in the two classes; rows have length one. The hinge loss is
minimised by dual coordinate descent: a round's blocks climb their own dual coordinates at once,
each as if all blocks would move alike, and the changes of the weights add up (CoCoA+).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import plain_text, written

#: Most labelled documents of each class that the model is fitted on, whole.
FIT_EACH = 6_000
FOLDS, HELD = 4, 2
#: Share 1 / CALIBRATION of the fitted rows that the support vectors don't see; the score's logistic is fitted on their margins.
CALIBRATION = 5
#: Numbers of hashed indicators: words, pairs of words, runs of shapes. With the constant, both vectors of 32-bit floats stay below a megabyte.
WIDTHS = (1 << 15, 1 << 15, 1 << 14)
SIZE = sum(WIDTHS)
#: Blocks of the bounded sample, rounds, passes of a block's rows in a round, bound of a dual coordinate, count that every indicator starts with.
BLOCKS, ROUNDS, PASSES, COST, PRIOR = 8, 10, 2, 1.0, 1.0
_PIECES = re.compile(r"(\w+)|(\W+)")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; such rows teach nothing. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def shape(word: str) -> str:
    """Case of each run of letters and digits, and the signs between them without repeats."""
    out = []
    for own, signs in _PIECES.findall(word):
        if signs:
            out.append("".join(dict.fromkeys(signs)))
        elif own.isdigit():
            out.append("0")
        else:
            out.append("x" if own.islower() else "X" if own.isupper() and len(own) > 1 else "Xx" if own[:1].isupper() else "m")
    return "".join(out)


class _Words(dict):
    """Word -> hash of it in lower case (upper 32 bits) and of its shape."""

    def __missing__(self, word: str) -> int:
        low, form = (xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in (word.lower(), shape(word)))
        self[word] = out = low << 32 | form
        return out


def _slots(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes + np.uint64(kind)) * _MIX
    return (sum(WIDTHS[:kind]) + (mixed >> np.uint64(40)) % np.uint64(WIDTHS[kind])).astype(np.int64)


def indicators(texts: list[str], words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """``(row, slot)`` of every distinct hashed n-gram of every text, sorted."""
    found = [t.split() for t in texts]
    counts = np.array([len(f) for f in found], dtype=np.int64)
    both = np.fromiter((h for f in found for h in map(words.__getitem__, f)), dtype=np.uint64, count=int(counts.sum()))
    of = np.repeat(np.arange(len(texts)), counts)
    low, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    next_to = of[1:] == of[:-1]
    same = np.concatenate(([False], next_to & (low[1:] == low[:-1]))) if len(of) else np.zeros(0, dtype=bool)
    form = form * np.uint64(2) + same
    pairs = low[:-1] * np.uint64(31) * _MIX + low[1:]
    two = form[:-1] * np.uint64(37) * _MIX + form[1:]
    kinds = [(of, low, 0), (of[1:][next_to], pairs[next_to], 1), (of, form, 2), (of[1:][next_to], two[next_to], 2)]
    if len(of) > 2:
        near = next_to[1:] & next_to[:-1]
        kinds.append((of[2:][near], (two[:-1] * np.uint64(41) * _MIX + form[2:])[near], 2))
    keys = np.unique(np.concatenate([row * SIZE + _slots(h, kind) for row, h, kind in kinds]))
    return keys // SIZE, keys % SIZE


@dataclass(frozen=True)
class Model:
    """Ratios and weights by slot (the constant's weight is ``bias``) and the score's logistic; ``known`` is False without labels of both classes."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    logistic: tuple[float, float]
    known: bool = True


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """``(_text, _good)``, at most FIT_EACH labelled documents of each class that aren't held out, distinct texts; and how many ids of each class there are."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_good"))
    totals = {r["_good"]: r["n"] for r in known.groupBy("_good").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.lit(seed), "_id"), "_id"]
    picked = known.where("_good = 1").orderBy(*order).limit(FIT_EACH).union(known.where("_good = 0").orderBy(*order).limit(FIT_EACH))
    texts = docs.select(F.col(id_col).alias("_id"), plain_text(text_col).alias("_text")).join(F.broadcast(picked), "_id")  # at most 2 * FIT_EACH ids
    return texts.groupBy("_text").agg(F.max("_good").alias("_good")), totals


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for b in batches:
        texts = b.column("_text").to_pylist()
        if len(words) > 500_000:
            words.clear()
        row, slot = indicators(texts, words)
        offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        slots = pa.ListArray.from_arrays(pa.array(offsets), pa.array(slot.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_block"), b.column("_good"), slots], names=["key", "block", "good", "slots"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """``(block, keys, signs, slots)`` of the blocks a task reads, in order of keys; a block is one file and so is never cut."""
    rows: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for b in batches:
        slots = b.column("slots")
        at = slots.offsets.to_numpy()
        flat = slots.values.to_numpy()
        for i, (key, block, good) in enumerate(zip(b.column("key").to_pylist(), b.column("block").to_pylist(), b.column("good").to_pylist(), strict=True)):
            rows.setdefault(block, []).append((key, good, flat[at[i] : at[i + 1]]))
    for block, own in sorted(rows.items()):
        own.sort(key=lambda r: r[0])
        yield block, np.array([r[0] for r in own]), np.array([1.0 if r[1] else -1.0 for r in own]), [r[2] for r in own]


def count_ratios(featured: DataFrame) -> np.ndarray:
    """Per slot the logarithm of its share among good documents' indicators over that among the others'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE), dtype=np.float32)
        for _, _, signs, slots in _blocks(batches):
            for y, s in zip(signs, slots, strict=True):
                counts[int(y > 0), s] += 1
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()])], names=["counts"])

    parts = featured.mapInArrow(run, "counts binary").collect()  # a vector for each of at most BLOCKS tasks
    q, p = PRIOR + np.sum([np.frombuffer(r["counts"], dtype=np.float32).reshape(2, SIZE) for r in parts], axis=0, dtype=np.float64)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def climb(signs: np.ndarray, slots: list[np.ndarray], scale: np.ndarray, ratios: np.ndarray, weights: np.ndarray, alpha: np.ndarray, copies: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Passes of dual coordinate descent over a block: its new ``alpha`` and the change of the weights, of which the last is the constant's.

    Coordinates are taken in a shuffled order. The block's own change counts ``copies`` times
    while it climbs, as all blocks change the weights at once.
    """
    rng, alpha, change = np.random.default_rng(seed), alpha.copy(), np.zeros(SIZE + 1)
    for _ in range(PASSES):
        for i in rng.permutation(len(signs)):
            s = slots[i]
            x = ratios[s] * scale[i]
            margin = float((weights[s] + copies * change[s]) @ x) + (weights[-1] + copies * change[-1]) * scale[i]
            new = min(COST, max(0.0, alpha[i] - (signs[i] * margin - 1) / copies))
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                change[s] += step * x
                change[-1] += step * scale[i]
                alpha[i] = new
    return alpha, change


def row_scale(slots: np.ndarray, ratios: np.ndarray) -> float:
    """One over the length of a row of ratios and the constant 1."""
    return 1.0 / float(np.sqrt(1.0 + ratios[slots] @ ratios[slots]))


def fit_weights(featured: DataFrame, ratios: np.ndarray) -> np.ndarray:
    """Weights of the hinge loss by ROUNDS jobs of dual coordinate descent over the written blocks.

    The driver holds the weights and a dual coordinate for each of at most 2 * FIT_EACH rows.
    """
    weights, alphas = np.zeros(SIZE + 1), {}
    shared = ratios.astype(np.float32)
    for r in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], sent: np.ndarray = weights.astype(np.float32), known: dict = alphas, turn: int = r) -> Iterator[pa.RecordBatch]:
            ratios, weights = shared.astype(np.float64), sent.astype(np.float64)
            for block, keys, signs, slots in _blocks(batches):
                scale = np.array([row_scale(s, ratios) for s in slots])
                alpha, change = climb(signs, slots, scale, ratios, weights, known.get(block, np.zeros(len(keys))), BLOCKS, turn * BLOCKS + block)
                yield pa.RecordBatch.from_arrays([pa.array([block], type=pa.int32()), pa.array([alpha.tobytes()]), pa.array([change.astype(np.float32).tobytes()])], names=["block", "alpha", "change"])

        for x in sorted(featured.mapInArrow(run, "block int, alpha binary, change binary").collect(), key=lambda x: x["block"]):
            alphas = alphas | {x["block"]: np.frombuffer(x["alpha"])}
            weights = weights + np.frombuffer(x["change"], dtype=np.float32)
    return weights


def fit_logistic(margins: np.ndarray, good: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Constant and slope of the weighted logistic likelihood less a small ridge on the slope, by Newton steps."""
    x, theta, held = np.stack((np.ones_like(margins), margins), axis=1), np.zeros(2), np.diag([1e-6, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + held, x.T @ (weight * (good - p)) - held @ theta)
        theta = theta + step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
    return float(theta[0]), float(theta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 42) -> Model:
    """Learns the model from labelled rows that aren't held out, at most FIT_EACH of each class.

    The score's logistic weighs the classes as all labels that aren't held out have them. Texts
    and indicators stay on executors. Without labels of both classes every text scores alike.
    """
    picked, totals = fit_sample(docs, labels, id_col, text_col, label_col, seed)
    key = F.xxhash64(F.lit(seed), "_text")
    picked = picked.select("_text", "_good", key.alias("_key"), F.pmod(F.shiftright(key, 8), F.lit(BLOCKS)).cast("int").alias("_block"))
    sample = written(picked.repartition(BLOCKS, "_block"), "sample")
    found = {r["_good"]: r["n"] for r in sample.groupBy("_good").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = np.zeros(SIZE, dtype=np.float32)
    if not found.get(1) or not found.get(0):
        good, bad = totals.get(1, 0), totals.get(0, 0)
        return Model(none, none, 0.0, (float(np.log((good + 0.5) / (bad + 0.5))), 0.0), known=False)
    featured = written(sample.mapInArrow(_featured, "key long, block int, good int, slots array<int>"), "featured")
    apart = F.pmod("key", F.lit(CALIBRATION)) == 0
    taught = written(featured.where(~apart), "taught")
    if taught.agg(F.count_distinct("good")).first()[0] < 2:
        taught = featured
    ratios = count_ratios(taught)
    weights = fit_weights(taught, ratios)
    model = Model(ratios.astype(np.float32), (ratios * weights[:-1]).astype(np.float32), float(weights[-1]), (0.0, 1.0))
    rows = sample.where(F.pmod("_key", F.lit(CALIBRATION)) == 0).select("_good", margin_of(model, F.col("_text")).alias("m")).collect()  # 2 * FIT_EACH rows at most
    if len({r["_good"] for r in rows}) < 2:
        rows = sample.select("_good", margin_of(model, F.col("_text")).alias("m")).collect()
    order = sorted((r["m"], r["_good"]) for r in rows)
    margins, good = (np.array(c, dtype=np.float64) for c in zip(*order, strict=True))
    weight = np.where(good == 1, totals[1] / good.sum(), totals[0] / (len(good) - good.sum()))
    return Model(model.ratios, model.weights, model.bias, fit_logistic(margins, good, weight * len(good) / weight.sum()))


#: Words of texts that are taken together.
_TOGETHER = 500_000


def margins(texts: list[str], model: Model, words: _Words) -> np.ndarray:
    """The side of the plane, and how far from it, of each text."""
    row, slot = indicators(texts, words)
    squares = np.bincount(row, weights=model.ratios[slot].astype(np.float64) ** 2, minlength=len(texts))
    sums = np.bincount(row, weights=model.weights[slot].astype(np.float64), minlength=len(texts))
    return (sums + model.bias) / np.sqrt(1.0 + squares)


def margin_of(model: Model, text: Column) -> Column:
    """The margin of each text; only the text goes to Python."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _Words()
        for texts in batches:
            out, held, size = [], [], 0
            for t in texts:
                held.append(t)
                size += len(t) >> 2
                if size >= _TOGETHER:
                    out.append(margins(held, model, words))
                    held, size = [], 0
                    if len(words) > 500_000:
                        words.clear()
            if held:
                out.append(margins(held, model, words))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return run(text)


def quality_score(model: Model, text: Column) -> Column:
    constant, slope = model.logistic
    z = F.lit(constant) + (F.lit(slope) * margin_of(model, text) if model.known else F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted``.

    ``score`` (0 to 1, higher: good quality likelier) comes from the whole text and ``predicted``
    is 1 from ``threshold`` on. A null text is empty; empty texts lie where the constant alone
    puts them. Repeated rows are scored each; an empty table gives no rows; further columns are
    ignored and may have any name. Only text enters a score. Nothing is shuffled.
    """
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), quality_score(model, plain_text(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
