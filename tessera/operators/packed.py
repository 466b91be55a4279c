"""Word counts over packed codes: bases roll into whole numbers along a batch, which are counted before anything is shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that are turned into codes at once; words that cross from one stretch to the next are made in the second.
STRETCH = 1 << 21
#: Words up to this length are counted in an array of all their codes (8 MB), longer ones by sorting a stretch's.
DENSE = 10
_LETTERS = np.full(256, -1, dtype=np.int64)
_LETTERS[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.arange(4)
_TO_DIGITS = str.maketrans("ACGT", "0123")


def rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of the words of length ``k`` at each place of a run of base numbers; negative where a word holds another letter."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out, bad = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for p in range(k):
        own = codes[p : p + n]
        out = out << 2 | own & 3
        bad |= own < 0
    out[bad] = -1
    return out


def _sums(codes: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their weights, or how often they are there."""
    found, place = np.unique(codes, return_inverse=True)
    sums = np.zeros(len(found), dtype=np.int64)
    np.add.at(sums, place, 1 if weights is None else weights)
    return found, sums


def _stretches(texts: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(base numbers, row of each)`` of texts of ACGT, with a gap after each, in stretches that overlap by ``k - 1`` letters."""
    held, size, first = [], 0, 0
    for i, t in enumerate([*texts, None]):
        if held and (t is None or size + len(t) > STRETCH):
            raw = _LETTERS[np.frombuffer(("\n".join(held) + "\n").encode(), dtype=np.uint8)]
            of = np.repeat(np.arange(first, first + len(held)), [len(h) + 1 for h in held])
            for at in range(0, max(1, len(raw) - k + 1), STRETCH):
                yield raw[at : at + STRETCH + k - 1], of[at : at + STRETCH + k - 1]
            held, size, first = [], 0, i
        if t is not None:
            held.append(t)
            size += len(t) + 1


def packed_counts(df: DataFrame, k: int, seq: str = "seq", weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``*by, code, word, n``: how often each word of length ``k``, at most 31, stands in the texts; ``code`` packs words of ACGT, others stand in ``word``.

    A task adds up its own words, so what it shuffles are distinct ones. Texts with other letters
    are read letter by letter. Null texts have no words.
    """
    names = [*by, "_text", *(["_weight"] if weight else [])]
    rows = df.where(F.col(seq).isNotNull()).select(*by, F.col(seq).alias("_text"), *([F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("_weight")] if weight else []))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by)
    dense = not by and k <= DENSE

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = np.zeros(4**k if dense else 0, dtype=np.int64)
        for frame in frames:
            frame.columns = names
            for _, own in frame.groupby(list(by), dropna=False, sort=False) if by else [((), frame)]:
                yield from counted(own, every)
        if dense:
            found = np.flatnonzero(every)
            yield made(None, found, every[found], Counter())

    def counted(own: pd.DataFrame, every: np.ndarray) -> Iterator[pd.DataFrame]:
        plain = np.array([not t.strip("ACGT") for t in own["_text"]], dtype=bool)
        weights = own["_weight"].to_numpy(dtype=np.int64) if weight else None
        held = None if weights is None else weights[plain]
        for base, of in _stretches([t for t, p in zip(own["_text"], plain, strict=True) if p], k):
            codes = rolled(base, k)
            on = codes >= 0
            each = None if held is None else held[of[: len(codes)][on]]
            if not dense:
                yield made(own, *_sums(codes[on], each), Counter())
            elif each is None:
                every += np.bincount(codes[on], minlength=len(every))
            else:
                np.add.at(every, codes[on], each)
        words: Counter = Counter()
        for i in np.flatnonzero(~plain):
            t = own["_text"].iloc[i]
            for at in range(len(t) - k + 1):
                words[t[at : at + k]] += 1 if weights is None else int(weights[i])
        if words:
            yield made(own, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), words)

    def made(own: pd.DataFrame | None, codes: np.ndarray, sums: np.ndarray, words: Counter) -> pd.DataFrame:
        mixed = [(None, w, n) if w.strip("ACGT") else (int(w.translate(_TO_DIGITS), 4), None, n) for w, n in words.items()]
        out = pd.DataFrame({"code": pd.Series([*codes.tolist(), *(m[0] for m in mixed)], dtype="Int64"), "word": pd.Series([*[None] * len(codes), *(m[1] for m in mixed)], dtype=object), "n": [*sums.tolist(), *(m[2] for m in mixed)]})
        for c in reversed(by):
            out.insert(0, c, pd.Series([own[c].iloc[0]] * len(out), dtype=own[c].dtype))
        return out

    parts = rows.mapInPandas(run, f"{kinds}{', ' if kinds else ''}code long, word string, n long")
    return parts.groupBy(*by, "code", "word").agg(F.sum("n").cast("bigint").alias("n"))

