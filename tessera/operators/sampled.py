"""Affinity fits of long probes: Z and its gradient from words drawn from the background, batches of reads and of draws in one job."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.draws import KEYS, binomial, keyed, keyed_numbers
from tessera.operators.objectives import UNIVERSE, AffinityModel, Job, ProbeLoss, UniverseSum, evaluate_jobs, likelihood_rows

#: Numbers that a draw has for its bases.
PLACES = 32


@dataclass(frozen=True, eq=False)
class BackgroundDraws:
    """Words of one length drawn from a log-linear background over words of length ``k``, flanks included.

    Such a background is a Markov chain, so its sum over all words, 4**length of them, and each
    base's chance after the bases before it follow from 4**(k - 1) states a place. A word's
    bases come from numbers keyed by its id, so any task draws the same word.
    """

    length: int
    weights: Sequence[float]
    k: int = 1
    left: str = ""
    right: str = ""
    log_z: float = field(init=False)
    cut: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        k, states = self.k, 4 ** (self.k - 1)
        w, bases = np.asarray(self.weights, dtype=np.float64).reshape(states, 4), {b: i for i, b in enumerate("ACGT")}
        if len(self.weights) != 4**k or self.length > PLACES:
            raise ValueError(f"{4**k} weights and at most {PLACES} bases are asked for")
        nexts = (np.arange(states)[:, None] * 4 + np.arange(4)) % states
        rest, cut = np.zeros(states), np.zeros((self.length, states, 3))
        for t in range(self.length + len(self.right) - 1, -1, -1):
            own = np.where(len(self.left) + t >= k - 1, w, 0.0) + rest[nexts]
            if t >= self.length:
                rest = own[:, bases[self.right[t - self.length]]]
            else:
                top = own.max(axis=1, keepdims=True)
                rest = (top + np.log(np.exp(own - top).sum(axis=1, keepdims=True)))[:, 0]
                cut[t] = np.exp(own - rest[:, None]).cumsum(axis=1)[:, :3]
        state, inside = 0, 0.0
        for i, b in enumerate(self.left):
            inside += w[state, bases[b]] if i >= k - 1 else 0.0
            state = (state * 4 + bases[b]) % states
        object.__setattr__(self, "log_z", float(rest[state] + inside))
        object.__setattr__(self, "cut", cut)
        object.__setattr__(self, "_start", state)

    def words(self, ids: np.ndarray, step: int) -> np.ndarray:
        """Base numbers of the draws of some ids, one row each."""
        out, state = np.empty((len(ids), self.length), dtype=np.int64), np.full(len(ids), self._start)
        for t in range(self.length):
            u = (keyed_numbers(np.asarray(ids) * PLACES + t, step).astype(np.float64) + 0.5) / KEYS
            out[:, t] = (u[:, None] > self.cut[t][state]).sum(axis=1)
            state = (state * 4 + out[:, t]) % len(self.cut[t])
        return out

    def drawn(self, spark: SparkSession, samples: int, step: int) -> DataFrame:
        """``seq, p0``: draws that stand for the universe; ``p0`` is the background's sum over all words, dealt out evenly."""

        @F.pandas_udf("string")
        def word(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            letters = np.frombuffer(b"ACGT", dtype=np.uint8)
            for ids in batches:
                raw = letters[self.words(ids.to_numpy(), step)].tobytes().decode()
                yield pd.Series([raw[i : i + self.length] for i in range(0, len(raw), self.length)])

        return spark.range(samples).select(word("id").alias("seq"), F.lit(float(np.exp(self.log_z) / samples)).alias("p0"))


def sampled_z(universe: DataFrame, model: AffinityModel, theta: np.ndarray, samples: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Z, its standard error, its gradient and the standard error of each entry, from draws that stand for the universe."""
    b = evaluate_jobs(universe.withColumn("part", F.lit(UNIVERSE)), {0: Job(UniverseSum(model, True), [theta])})[0][0]
    scale = samples / (samples - 1)
    return b.loss, float(np.sqrt(max(0.0, scale * (b.loss_sq - b.loss**2 / samples)))), b.grad, np.sqrt(np.maximum(0.0, scale * (b.grad_sq - b.grad**2 / samples)))


@dataclass
class SampledLikelihood:
    """The affinity loss of probes of any length, for the stochastic fits.

    ``probes(id, seq, n, p0)`` with p0 as the background has it. ``full`` takes all reads and
    ``full_draws`` draws that are always the same; ``batch`` takes each read with chance ``share``,
    anew in each step, and ``batch_draws`` fresh draws. Either is one job, however many vectors.
    """

    probes: DataFrame
    background: BackgroundDraws
    model: AffinityModel
    ridge: float = 1e-3
    full_draws: int = 65_536
    batch_draws: int = 8_192
    id_col: str = "id"

    def _evaluated(self, probes: DataFrame, draws: DataFrame, thetas: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        jobs = {"own": Job(ProbeLoss(self.model), thetas, frozenset((0,))), "every": Job(UniverseSum(self.model), thetas, frozenset((UNIVERSE,)))}
        found = evaluate_jobs(likelihood_rows(probes, draws), jobs)
        out = []
        for i, (z, t) in enumerate(zip(found["every"], thetas, strict=True)):
            loss, grad = float(np.log(z.loss) + self.ridge * (t @ t)), z.grad / z.loss + 2 * self.ridge * t
            if found["own"]:  # a batch may hold no read
                own = found["own"][i]
                loss, grad = loss + own.loss / own.n, grad + own.grad / own.n
            out.append((loss, grad))
        return out

    def full(self, thetas: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        return self._evaluated(self.probes, self.background.drawn(self.probes.sparkSession, self.full_draws, 0), thetas)

    def batch_reads(self, step: int, share: float) -> DataFrame:
        """Probes with the reads of them that a step takes."""
        taken: Column = binomial(F.col("n").cast("long"), share, keyed(self.id_col, step + 1))
        return self.probes.withColumn("n", taken).where("n > 0")

    def batch(self, step: int, share: float, thetas: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        return self._evaluated(self.batch_reads(step, share), self.background.drawn(self.probes.sparkSession, self.batch_draws, step + 1), thetas)
