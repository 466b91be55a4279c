"""Finite-sum objectives: one Spark aggregate per evaluation, any number of parameter vectors in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Sums = tuple[float, float, float, np.ndarray, np.ndarray]


class Objective:
    """A loss that is a sum over rows. Subclass it to bring your own.

    ``partial`` gets a batch of rows and a parameter vector and returns the number (or weight)
    of rows, the sum of losses, of squared losses, of gradients and of squared gradients.
    """

    columns: tuple[str, ...] = ()

    def partial(self, rows: pd.DataFrame, theta: np.ndarray) -> Sums:
        raise NotImplementedError


@dataclass(frozen=True)
class Bundle:
    """Sums of one evaluation, with means and the variances of the means."""

    n: float
    loss: float
    loss_sq: float
    grad: np.ndarray
    grad_sq: np.ndarray

    def mean(self, theta: np.ndarray, ridge: float = 0.0) -> tuple[float, np.ndarray]:
        return float(self.loss / self.n + ridge * float(theta @ theta) / 2), self.grad / self.n + ridge * theta

    def variances(self) -> tuple[float, np.ndarray]:
        """Variance of the mean loss and of each entry of the mean gradient."""
        n = self.n
        return (self.loss_sq / n - (self.loss / n) ** 2) / (n - 1), (self.grad_sq / n - (self.grad / n) ** 2) / (n - 1)


def evaluate(df: DataFrame, objective: Objective, thetas: Sequence[np.ndarray] | Mapping[int, Sequence[np.ndarray]], by: str | Column | None = None) -> dict:
    """``{candidate: Bundle}``, or ``{(group, candidate): Bundle}`` with a grouping column.

    ``thetas`` may give each group candidates of its own, by the group's number.
    Each task adds up its rows and hands on one row of sums per candidate and group; these are
    summed on executors, so the driver gets 3 + 2 d numbers per candidate, whatever the data.
    """
    each, grouped = isinstance(thetas, Mapping), by is not None
    vectors = {g: [np.asarray(t, dtype=np.float64) for t in own] for g, own in (thetas if each else {0: thetas}).items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for g, rows in b.groupby("_by") if grouped else [(0, b)]:
                for c, theta in enumerate(vectors[int(g) if each else 0]):
                    n, loss, squares, grad, grad_sq = objective.partial(rows, theta)
                    row = np.concatenate(([n, loss, squares], grad, grad_sq))
                    sums[g, c] = sums[g, c] + row if (g, c) in sums else row
        yield pd.DataFrame([(int(g), c, v.tolist()) for (g, c), v in sums.items()], columns=["g", "c", "v"])

    rows = df.select(*objective.columns, *([(F.col(by) if isinstance(by, str) else by).cast("long").alias("_by")] if grouped else []))
    parts = rows.mapInPandas(run, "g long, c int, v array<double>").select("g", "c", F.posexplode("v").alias("i", "x"))
    out: dict = {}
    for r in parts.groupBy("g", "c", "i").agg(F.sum("x").alias("x")).collect():
        out.setdefault((r["g"], r["c"]) if grouped else r["c"], {})[r["i"]] = r["x"]
    made = {}
    for key, values in out.items():
        v = np.array([values[i] for i in range(len(values))])
        d = (len(v) - 3) // 2
        made[key] = Bundle(float(v[0]), float(v[1]), float(v[2]), v[3 : 3 + d], v[3 + d :])
    return made


@dataclass(frozen=True)
class Job:
    """An objective with the vectors it is wanted at, over the rows whose number in a part column is listed; all rows without a list."""

    objective: Objective
    thetas: Sequence[np.ndarray]
    parts: frozenset[int] | None = None


def evaluate_jobs(df: DataFrame, jobs: Mapping[object, Job], part: str = "part") -> dict:
    """``{name: [Bundle of each vector]}`` of any number of objectives, each on its own parts of the rows, in one pass.

    This is what lets fits of many folds and models take their steps together: a job's rows are
    told by a column, so a pass costs one Spark job whatever their number. Sums are added up on
    executors; a name without rows gets an empty list.
    """
    names = list(jobs)
    listed = [(jobs[n].objective, [np.asarray(t, dtype=np.float64) for t in jobs[n].thetas], jobs[n].parts) for n in names]
    columns = sorted({c for o, *_ in listed for c in o.columns})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            own = dict(iter(b.groupby(part)))
            for j, (objective, thetas, parts) in enumerate(listed):
                for rows in own.values() if parts is None else [own[p] for p in parts if p in own]:
                    for c, theta in enumerate(thetas):
                        n, loss, squares, grad, grad_sq = objective.partial(rows, theta)
                        row = np.concatenate(([n, loss, squares], grad, grad_sq))
                        sums[j, c] = sums[j, c] + row if (j, c) in sums else row
        yield pd.DataFrame([(j, c, v.tolist()) for (j, c), v in sums.items()], columns=["j", "c", "v"])

    parts = df.select(*columns, part).mapInPandas(run, "j int, c int, v array<double>").select("j", "c", F.posexplode("v").alias("i", "x"))
    out: dict = {}
    for r in parts.groupBy("j", "c", "i").agg(F.sum("x").alias("x")).collect():
        out.setdefault((r["j"], r["c"]), {})[r["i"]] = r["x"]
    made: dict = {n: [] for n in names}
    for j, c in sorted(out):
        values = out[j, c]
        v = np.array([values[i] for i in range(len(values))])
        d = (len(v) - 3) // 2
        made[names[j]].append(Bundle(float(v[0]), float(v[1]), float(v[2]), v[3 : 3 + d], v[3 + d :]))
    return made


class SquaredHinge(Objective):
    """max(0, 1 - y x.theta)**2 / 2 per row."""

    columns = ("features", "y")

    def partial(self, rows: pd.DataFrame, theta: np.ndarray) -> Sums:
        x, y = np.stack(rows["features"].to_numpy()).astype(np.float64), rows["y"].to_numpy(dtype=np.float64)
        slack = np.maximum(0.0, 1 - y * (x @ theta))
        losses, each = slack**2 / 2, -(slack * y)[:, None] * x
        return float(len(y)), losses.sum(), (losses**2).sum(), each.sum(axis=0), (each**2).sum(axis=0)


_CODES = np.full(256, -1)
for _i, _b in enumerate(b"ACGT"):
    _CODES[_b] = _i


def encoded(seqs: pd.Series) -> np.ndarray:
    """Words of one length as base numbers, one row each."""
    raw = np.frombuffer("".join(seqs).encode(), dtype=np.uint8)
    return _CODES[raw].reshape(len(seqs), -1)


def flanked_codes(codes: np.ndarray, left: str, right: str) -> np.ndarray:
    """Words with the same bases before and after each."""
    ends = [np.tile(_CODES[np.frombuffer(f.encode(), dtype=np.uint8)].astype(codes.dtype), (len(codes), 1)) for f in (left, right)]
    return np.hstack([ends[0], codes, ends[1]])


def pentamers(codes: np.ndarray) -> np.ndarray:
    """Codes of all words of five bases of each row."""
    n = codes.shape[1] - 4
    return sum(codes[:, p : p + n].astype(np.int64) << 2 * (4 - p) for p in range(5))


@dataclass(frozen=True)
class Windows:
    """One window and strand of every probe: places of its weights of value 1, real features with the place of their first weight, score."""

    ones: np.ndarray
    at: int
    real: np.ndarray | None
    kappa: np.ndarray

    def dense(self, size: int) -> np.ndarray:
        """All features as a matrix."""
        x = np.zeros((len(self.kappa), size))
        np.put_along_axis(x, self.ones, 1.0, axis=1)
        if self.real is not None:
            x[:, self.at : self.at + self.real.shape[1]] = self.real
        return x


@dataclass(frozen=True, eq=False)
class AffinityModel:
    """Lengths of the modes. Parameters are, per mode, 4 k weights, with ``di`` 16 (k - 1) of neighbouring pairs, with ``shape`` k for each of its features, then the non-specific one.

    ``left`` and ``right`` are bases of the flanks that windows may reach into. ``shape`` has a
    row of 1,024 values, by pentamer code, for each feature; the pentamer around each base
    counts, so ``ends`` are two more bases on each side. On the reverse strand it is the
    pentamer's reverse complement.
    """

    lengths: tuple[int, ...]
    di: bool = False
    left: str = ""
    right: str = ""
    shape: np.ndarray | None = None
    ends: tuple[str, str] = ("", "")

    def _own(self, k: int) -> int:
        return 4 * k + (16 * (k - 1) if self.di else 0) + (0 if self.shape is None else len(self.shape) * k)

    def size(self) -> int:
        return sum(map(self._own, self.lengths)) + 1

    def scores(self, codes: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, list[Windows]]:
        """Probe scores, and per window and strand its features and scores."""
        codes = flanked_codes(codes, self.left, self.right) if self.left or self.right else codes
        values = [None, None]
        if self.shape is not None:
            around = flanked_codes(codes, *self.ends)
            values = [np.asarray(self.shape)[:, pentamers(strand)] for strand in (around, 3 - around[:, ::-1])]
        total, parts, start = np.full(len(codes), np.exp(theta[-1])), [], 0
        for k in self.lengths:
            at = start + 4 * k + (16 * (k - 1) if self.di else 0)
            for strand, value in zip((codes, 3 - codes[:, ::-1]), values, strict=True):
                for i in range(codes.shape[1] - k + 1):
                    word = strand[:, i : i + k]
                    f = start + 4 * np.arange(k)[None, :] + word
                    if self.di and k > 1:
                        f = np.hstack((f, start + 4 * k + 16 * np.arange(k - 1)[None, :] + 4 * word[:, :-1] + word[:, 1:]))
                    logs, real = theta[f].sum(axis=1), None
                    if value is not None:
                        real = value[:, :, i : i + k].transpose(1, 0, 2).reshape(len(codes), -1)
                        logs = logs + real @ theta[at : at + real.shape[1]]
                    kappa = np.exp(logs)
                    total = total + kappa
                    parts.append(Windows(f, at, real, kappa))
            start += self._own(k)
        return total, parts

    def gradient(self, parts: list[Windows], weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Sum over probes of weight times the score's derivative."""
        g = np.zeros(self.size())
        for w in parts:
            own = weight * w.kappa
            g += np.bincount(w.ones.ravel(), weights=np.repeat(own, w.ones.shape[1]), minlength=len(g))
            if w.real is not None:
                g[w.at : w.at + w.real.shape[1]] += own @ w.real
        g[-1] += weight.sum() * np.exp(theta[-1])
        return g

    def derivatives(self, parts: list[Windows], weight: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each probe's derivatives of the score, and the sum over probes of weight times the second ones."""
        d = self.size()
        first, second = np.zeros((len(weight), d)), np.zeros((d, d))
        for w in parts:
            x = w.dense(d)
            own = x * w.kappa[:, None]
            first += own
            second += x.T @ (own * weight[:, None])
        rest = np.exp(theta[-1])
        first[:, -1] += rest
        second[-1, -1] += weight.sum() * rest
        return first, second


@dataclass(frozen=True)
class ProbeLoss(Objective):
    """-n ln(p0 score) per probe; n counts as n rows."""

    model: AffinityModel
    columns = ("seq", "n", "p0")

    def partial(self, rows: pd.DataFrame, theta: np.ndarray) -> Sums:
        n, p0 = rows["n"].to_numpy(dtype=np.float64), rows["p0"].to_numpy(dtype=np.float64)
        score, parts = self.model.scores(encoded(rows["seq"]), theta)
        losses = -np.log(p0 * score)
        grad = self.model.gradient(parts, -n / score, theta)
        return n.sum(), (n * losses).sum(), (n * losses**2).sum(), grad, np.zeros_like(grad)


@dataclass(frozen=True)
class UniverseSum(Objective):
    """p0 score per word of the universe, or of a sample that stands for it: Z and its gradient; with ``spread`` also the squares of each word's part."""

    model: AffinityModel
    spread: bool = False
    columns = ("seq", "p0")

    def partial(self, rows: pd.DataFrame, theta: np.ndarray) -> Sums:
        p0 = rows["p0"].to_numpy(dtype=np.float64)
        score, parts = self.model.scores(encoded(rows["seq"]), theta)
        squares = ((p0 * score) ** 2).sum()
        if self.spread:
            each = self.model.derivatives(parts, p0, theta)[0] * p0[:, None]
            return float(len(p0)), (p0 * score).sum(), squares, each.sum(axis=0), (each**2).sum(axis=0)
        grad = self.model.gradient(parts, p0, theta)
        return float(len(p0)), (p0 * score).sum(), squares, grad, np.zeros_like(grad)


#: The part of the words that stand for the universe.
UNIVERSE = -1


def likelihood_rows(probes: DataFrame, universe: DataFrame, part: Column | None = None) -> DataFrame:
    """``seq, n, p0, part``: probes, whose part is 0 or as given, and the universe's words or a sample of them, whose part is UNIVERSE."""
    own = probes.select("seq", F.col("n").cast("double").alias("n"), "p0", (F.lit(0) if part is None else part).cast("int").alias("part"))
    return own.unionByName(universe.select("seq", F.lit(0.0).alias("n"), "p0", F.lit(UNIVERSE).alias("part")))


def likelihoods(rows: DataFrame, asked: Mapping[object, tuple[AffinityModel, Sequence[np.ndarray], frozenset[int]]], ridge: float = 0.0) -> dict:
    """``{name: [(loss, gradient) of each vector]}`` over :func:`likelihood_rows`, in one job for all models and parts that are asked for.

    Per read: ln Z - mean of n ln(p0 score) + ridge |theta|**2.
    """
    jobs: dict = {}
    for name, (model, thetas, parts) in asked.items():
        jobs[name, "own"], jobs[name, "every"] = Job(ProbeLoss(model), thetas, parts), Job(UniverseSum(model), thetas, frozenset((UNIVERSE,)))
    found = evaluate_jobs(rows, jobs)
    out = {}
    for name, (_, thetas, _) in asked.items():
        both = zip(found[name, "own"], found[name, "every"], thetas, strict=True)
        out[name] = [(float(np.log(z.loss) + own.loss / own.n + ridge * float(t @ t)), z.grad / z.loss + own.grad / own.n + 2 * ridge * t) for own, z, t in both]
    return out


def affinity_likelihood(probes: DataFrame, universe: DataFrame, model: AffinityModel, thetas: Sequence[np.ndarray], ridge: float = 0.0, active: np.ndarray | None = None) -> list[tuple[float, np.ndarray]]:
    """Loss and gradient of :func:`likelihoods` for each candidate of one model; ``active`` masks the gradient, so frozen weights stay."""
    found = likelihoods(likelihood_rows(probes, universe), {0: (model, thetas, frozenset((0,)))}, ridge)[0]
    return found if active is None else [(loss, grad * active) for loss, grad in found]


def affinity_information(probes: DataFrame, universe: DataFrame, model: AffinityModel, theta: np.ndarray, ridge: float = 0.0, most: int = 500) -> np.ndarray:
    """Second derivatives of the affinity loss, in one job.

    With scores s and their derivatives s' and s'', they are those of ln Z less the mean of
    n (s'' / s - s' s'^T / s**2). Tasks add up blocks of outer products of their windows and
    probes; these are summed on executors, so the driver gets 2 (d * d + d + 1) numbers; d is at most ``most``.
    """
    theta = np.asarray(theta, dtype=np.float64)
    d = model.size()
    if d > most:
        raise ValueError(f"{d} parameters make {d * d} numbers; the limit is {most} parameters")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {p: np.zeros(d * d + d + 1) for p in (0, UNIVERSE)}
        for b in batches:
            for p, rows in b.groupby("part"):
                p0, n = rows["p0"].to_numpy(dtype=np.float64), rows["n"].to_numpy(dtype=np.float64)
                score, parts = model.scores(encoded(rows["seq"]), theta)
                weight = p0 if p == UNIVERSE else n / score
                first, second = model.derivatives(parts, weight, theta)
                if p != UNIVERSE:
                    second -= (first * (n / score**2)[:, None]).T @ first
                sums[p] += np.concatenate((second.ravel(), weight @ first, [(p0 * score).sum() if p == UNIVERSE else n.sum()]))
        yield pd.DataFrame([(p, i, x) for p, v in sums.items() for i, x in enumerate(v)], columns=["p", "i", "x"])

    out = {p: np.zeros(d * d + d + 1) for p in (0, UNIVERSE)}
    for r in likelihood_rows(probes, universe).mapInPandas(run, "p int, i int, x double").groupBy("p", "i").agg(F.sum("x").alias("x")).collect():
        out[r["p"]][r["i"]] = r["x"]
    own, every = out[0], out[UNIVERSE]
    slope = every[d * d : -1] / every[-1]
    return every[: d * d].reshape(d, d) / every[-1] - np.outer(slope, slope) - own[: d * d].reshape(d, d) / own[-1] + 2 * ridge * np.eye(d)


@dataclass(frozen=True)
class LogLinear(Objective):
    """Sum over a universe of exp(theta . counts of words of length k), whose logarithm normalises a background model.

    Words are counted over flank, sequence and flank, in the order of their codes.
    """

    k: int = 1
    left: str = ""
    right: str = ""
    columns = ("seq",)

    def partial(self, rows: pd.DataFrame, theta: np.ndarray) -> Sums:
        codes = encoded(rows["seq"]).astype(np.int64)
        codes = flanked_codes(codes, self.left, self.right) if self.left or self.right else codes
        windows = codes.shape[1] - self.k + 1
        words = sum(codes[:, p : p + windows] << 2 * (self.k - 1 - p) for p in range(self.k))
        places = (np.arange(len(words))[:, None] << 2 * self.k) + words
        counts = np.bincount(places.ravel(), minlength=len(words) << 2 * self.k).reshape(len(words), -1)
        w = np.exp(counts @ theta)
        grad = counts.T @ w
        return float(len(w)), w.sum(), 0.0, grad, np.zeros_like(grad)


@dataclass(frozen=True)
class ModeWeights(Objective):
    """-n ln(sum over modes of exp(theta) kappa) with each mode's kappa already summed per probe; z holds the modes' sums over the universe."""

    columns = ("kappas", "n")

    def partial(self, rows: pd.DataFrame, theta: np.ndarray) -> Sums:
        kappa, n = np.stack(rows["kappas"].to_numpy()).astype(np.float64), rows["n"].to_numpy(dtype=np.float64)
        parts = kappa * np.exp(theta)[None, :]
        score = parts.sum(axis=1)
        losses = -np.log(score)
        grad = -(parts * (n / score)[:, None]).sum(axis=0)
        return n.sum(), (n * losses).sum(), (n * losses**2).sum(), grad, np.zeros_like(grad)


def hinge_curvature(examples: DataFrame, theta: np.ndarray, ridge: float, most: int = 500) -> np.ndarray:
    """Mean second derivative of the squared hinge: d * d sums per task, added up on executors; d is at most ``most``."""
    d = len(theta)
    if d > most:
        raise ValueError(f"{d} parameters make {d * d} numbers; the limit is {most} parameters")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, n = np.zeros((d, d)), 0
        for b in batches:
            x, y = np.stack(b["features"].to_numpy()).astype(np.float64), b["y"].to_numpy(dtype=np.float64)
            on = x[y * (x @ theta) < 1]
            h, n = h + on.T @ on, n + len(y)
        yield pd.DataFrame({"i": np.arange(d * d + 1), "x": np.append(h.ravel(), n)})

    summed = examples.select("features", "y").mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    v = np.zeros(d * d + 1)
    for r in summed:
        v[r["i"]] = r["x"]
    return v[:-1].reshape(d, d) / v[-1] + ridge * np.eye(d)


def information_by_differences(gradients, theta: np.ndarray, step: float = 1e-4) -> np.ndarray:
    """Second derivatives from central differences; ``gradients`` evaluates all 2 d shifted vectors in one pass."""
    d = len(theta)
    shifted = [theta + s * step * np.eye(d)[j] for j in range(d) for s in (1, -1)]
    g = gradients(shifted)
    h = np.array([(g[2 * j] - g[2 * j + 1]) / (2 * step) for j in range(d)])
    return (h + h.T) / 2


def error_bars(information: np.ndarray, n: float, cutoff: float = 1e-12) -> np.ndarray:
    """Standard errors from the eigen pseudo-inverse; the cutoff grows until all are finite."""
    values, vectors = np.linalg.eigh(information)
    while True:
        keep = values > cutoff * max(1e-300, abs(values).max())
        inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
        variance = np.diag(inverse) / n
        if np.isfinite(variance).all() and (variance >= 0).all() or not keep.any():
            return np.sqrt(np.maximum(variance, 0))
        cutoff *= 10
