"""Fits of finite sums: the driver holds parameter vectors, every gradient is a Spark job over the rows."""

from __future__ import annotations

from collections.abc import Callable, Generator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.draws import below, keyed, slot
from tessera.operators.objectives import AffinityModel, Bundle, LogLinear, ModeWeights, Objective, affinity_likelihood, evaluate, likelihood_rows, likelihoods
from tessera.operators.splits import thinned

Many = Callable[[Sequence[np.ndarray]], list[tuple[float, np.ndarray]]]


@dataclass
class Fit:
    """Outcome of a fit: final vector, loss, gradient norm, steps and data passes."""

    theta: np.ndarray
    loss: float = float("nan")
    norm: float = float("nan")
    steps: int = 0
    passes: float = 0.0
    trace: list[float] = field(default_factory=list)


def relative_norm(g: np.ndarray, x: np.ndarray) -> float:
    return float(np.linalg.norm(g) / max(1.0, np.linalg.norm(x)))


def two_loop(g: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The inverse Hessian estimate of (step, gradient change) pairs, oldest first, times ``g``."""
    q, kept = g.copy(), []
    for s, y in reversed(pairs):
        a = float(s @ q) / float(y @ s)
        q = q - a * y
        kept.append(a)
    if pairs:
        s, y = pairs[-1]
        q = q * (float(s @ y) / float(y @ y))
    for (s, y), a in zip(pairs, reversed(kept), strict=True):
        q = q + s * (a - float(y @ q) / float(y @ s))
    return q


Asks = Generator[list[np.ndarray], list[tuple[float, np.ndarray]], Fit]


def lbfgs_asks(start: np.ndarray, memory: int = 8, epsilon: float = 1e-5, steps: int = 50, tries: Sequence[float] = (1.0, 0.3, 0.1, 0.01)) -> Asks:
    """Full-batch L-BFGS as a generator that asks for losses and gradients of vectors and returns its fit.

    Each step asks for a few step lengths at once and takes the lowest loss.
    """
    x = np.asarray(start, dtype=np.float64)
    (loss, g), pairs, passes = (yield [x])[0], [], 1
    for step in range(steps):
        if relative_norm(g, x) <= epsilon:
            return Fit(x, loss, float(np.linalg.norm(g)), step, passes)
        d = -two_loop(g, pairs)
        scale = 1.0 if pairs else 1.0 / max(1.0, float(np.linalg.norm(g)))
        tried = [x + t * scale * d for t in tries]
        found = yield tried
        passes += 1
        best = min(range(len(tried)), key=lambda i: (not np.isfinite(found[i][0]), found[i][0]))
        if not found[best][0] < loss:
            return Fit(x, loss, float(np.linalg.norm(g)), step, passes)
        s, y = tried[best] - x, found[best][1] - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        x, (loss, g) = tried[best], found[best]
    return Fit(x, loss, float(np.linalg.norm(g)), steps, passes)


def in_lockstep(fits: Mapping[object, Asks], many: Callable[[dict[object, list[np.ndarray]]], Mapping[object, list[tuple[float, np.ndarray]]]]) -> dict:
    """``{name: Fit}`` of fits that take their steps together.

    Each keeps its own vector and curvature; ``many`` gets what all unfinished ones ask for and
    answers in one pass, so the number of passes is that of the slowest fit, not their sum.
    """
    done: dict = {}
    asked: dict = {}
    for name, fit in fits.items():
        asked[name] = next(fit)
    while asked:
        answers, asked = many(asked), {}
        for name in answers:
            try:
                asked[name] = fits[name].send(answers[name])
            except StopIteration as end:
                done[name] = end.value
    return {name: done[name] for name in fits}


def lbfgs(many: Many, start: np.ndarray, memory: int = 8, epsilon: float = 1e-5, steps: int = 50, tries: Sequence[float] = (1.0, 0.3, 0.1, 0.01)) -> Fit:
    """One L-BFGS fit; see :func:`lbfgs_asks`."""
    return in_lockstep({0: lbfgs_asks(start, memory, epsilon, steps, tries)}, lambda asked: {0: many(asked[0])})[0]


@dataclass
class FiniteSum:
    """Rows with an objective: full and minibatch means of any number of vectors in one job each."""

    rows: DataFrame
    objective: Objective
    ridge: float
    id_col: str = "id"

    def full(self, thetas: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        b = evaluate(self.rows, self.objective, thetas)
        return [b[i].mean(t, self.ridge) for i, t in enumerate(thetas)]

    def batch_rows(self, step: int, share: float) -> DataFrame:
        """Rows drawn without replacement at a rate, by id and step, so a retried task draws the same."""
        return self.rows.where(keyed(self.id_col, step + 1) < below(share))

    def batch(self, step: int, share: float, thetas: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        b = evaluate(self.batch_rows(step, share), self.objective, thetas)
        return [b[i].mean(t, self.ridge) if i in b else (0.0, self.ridge * t) for i, t in enumerate(thetas)]


def clipped(g: np.ndarray, bound: float = 100.0) -> np.ndarray:
    """The gradient divided by powers of ten until its norm is within the bound."""
    norm = float(np.linalg.norm(g))
    return g if norm <= bound else g / 10 ** np.ceil(np.log10(norm / bound))


def _finished(problem: FiniteSum, x: np.ndarray, steps: int, passes: float, trace: list[float]) -> Fit:
    loss, g = problem.full([x])[0]
    return Fit(x, loss, float(np.linalg.norm(g)), steps, passes + 1, trace)


def sgd(problem: FiniteSum, start: np.ndarray, rate: float = 0.5, share: float = 0.2, epochs: int = 3, epsilon: float = 1e-5, adam: bool = False) -> Fit:
    """Minibatch descent with clipped gradients; an epoch's mean gradient prompts a full check of convergence.

    With ``adam`` moments 0.9 and 0.999, the second summed over coordinates, so one rate scales them all.
    """
    x, step, trace = np.asarray(start, dtype=np.float64), 0, []
    first, second = np.zeros_like(x), 0.0
    per_epoch = max(1, round(1 / share))
    for epoch in range(epochs):
        mean = np.zeros_like(x)
        for _ in range(per_epoch):
            loss, g = problem.batch(step, share, [x])[0]
            g, step = clipped(g), step + 1
            mean += g / per_epoch
            trace.append(loss)
            if adam:
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * float(g @ g)
                x = x - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            else:
                x = x - rate / (1 + epoch) * g
        if relative_norm(mean, x) <= epsilon and relative_norm(problem.full([x])[0][1], x) <= epsilon:
            break
    return _finished(problem, x, step, step * share, trace)


def svrg(problem: FiniteSum, start: np.ndarray, rate: float = 0.5, share: float = 0.2, epochs: int = 3, per_epoch: int = 5, epsilon: float = 1e-5, average: bool = False) -> Fit:
    """Variance-reduced descent; both vectors of a step are evaluated in one pass over its batch."""
    w = np.asarray(start, dtype=np.float64)
    step, passes, trace = 0, 0.0, []
    for _ in range(epochs):
        loss, anchor = problem.full([w])[0]
        passes += 1
        trace.append(loss)
        if relative_norm(anchor, w) <= epsilon:
            break
        x, mean = w.copy(), np.zeros_like(w)
        for _ in range(per_epoch):
            (_, gx), (_, gw) = problem.batch(step, share, [x, w])
            x = x - rate * (gx - gw + anchor)
            mean += x / per_epoch
            step, passes = step + 1, passes + share
        w = mean if average else x
    return _finished(problem, w, step, passes, trace)


def _bound_gradients(rows: DataFrame, problem: FiniteSum, snap: Column, snapshots: dict[int, np.ndarray], x: np.ndarray | None = None) -> list[np.ndarray] | None:
    """Mean gradient of the rows, each at its own snapshot, and with ``x`` also at that, in one pass; none without rows."""
    tried = {s: [v] if x is None else [v, x] for s, v in snapshots.items()}
    b = evaluate(rows, problem.objective, tried, by=snap)
    n = sum(v.n for (_, c), v in b.items() if c == 0)
    count = 1 if x is None else 2
    if not n:
        return None
    return [sum(b[g, c].grad + b[g, c].n * problem.ridge * tried[g][c] for g, at in b if at == c) / n for c in range(count)]


def ksvrg(
    problem: FiniteSum, start: np.ndarray, rate: float = 0.5, share: float = 0.2, sub_epochs: int = 3, per_epoch: int = 4, k: int | None = None, direction: Callable[[np.ndarray, np.ndarray, int], np.ndarray] | None = None
) -> Fit:
    """k-SVRG: every row is bound to a snapshot; a sub-epoch's rows are bound to its last vector.

    Which rows a step takes follows from their ids, so a row's snapshot is an expression of its
    id: that of the latest sub-epoch that took it. Nothing is written, and a row is evaluated at
    its own snapshot alone. Snapshots that no row uses are dropped, and the expression with them,
    so it holds about the logarithm of the number of rows. With ``k`` the rows of sub-epoch t are
    block t of a keyed permutation in ``k`` blocks, which is k2-SVRG. ``direction`` may turn the
    gradient estimate into another step.
    """
    share = share if k is None else 1 / (k * per_epoch)
    x = np.asarray(start, dtype=np.float64)
    snapshots, taken, step, passes, trace = {0: x.copy()}, {}, 0, 0.0, []
    for epoch in range(sub_epochs):
        snap = _latest(taken, min(snapshots))
        anchor = (_bound_gradients(problem.rows, problem, snap, snapshots) or [problem.ridge * x])[0]
        passes += 1
        touched = F.lit(False)
        for i in range(per_epoch):
            if k is None:
                mine = keyed(problem.id_col, step + 1) < below(share)
            else:
                block = slot(keyed(problem.id_col, 0), k * per_epoch)
                mine = block == (epoch % k) * per_epoch + i
            found = _bound_gradients(problem.rows.where(mine), problem, snap, snapshots, x)
            g = anchor if found is None else found[1] - found[0] + anchor
            x = x - rate * (g if direction is None else direction(g, x, step))
            touched, step, passes = touched | mine, step + 1, passes + share
        fresh = epoch + 1
        snapshots[fresh], taken[fresh] = x.copy(), touched
        used = {r["snap"] for r in problem.rows.select(_latest(taken, min(snapshots)).alias("snap")).distinct().collect()}
        snapshots = {s: v for s, v in snapshots.items() if s in used}
        taken = {s: c for s, c in taken.items() if s > min(snapshots)}
        trace.append(float(len(snapshots)))
    return _finished(problem, x, step, passes, trace)


def _latest(taken: dict[int, Column], first: int) -> Column:
    """The last snapshot, of those numbered, whose sub-epoch took the row; ``first`` if none did."""
    out = F.lit(first).cast("long")
    for s in sorted(taken):
        out = F.when(taken[s], F.lit(s).cast("long")).otherwise(out)
    return out


class _Curvature:
    """Steps of the mean vector and central differences of batch gradients as L-BFGS pairs, every ``period`` steps."""

    def __init__(self, problem: FiniteSum, share: float, period: int, memory: int):
        self.problem, self.share, self.period, self.memory = problem, share, period, memory
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.seen: list[np.ndarray] = []
        self.last: np.ndarray | None = None
        self.passes = 0.0

    def direction(self, g: np.ndarray, x: np.ndarray, step: int) -> np.ndarray:
        self.seen.append(x)
        if len(self.seen) == self.period:
            mean = np.mean(self.seen, axis=0)
            self.seen = []
            if self.last is not None and np.linalg.norm(s := mean - self.last) > 0:
                h = 1e-2 / max(1e-12, float(np.linalg.norm(s)))
                (_, up), (_, down) = self.problem.batch(10_000 + step, self.share, [mean + h * s, mean - h * s])
                self.passes += self.share
                if s @ (y := (up - down) / (2 * h)) > 1e-12:
                    self.pairs = [*self.pairs, (s, y)][-self.memory :]
            self.last = mean
        return two_loop(g, self.pairs)


def stochastic_lbfgs(problem: FiniteSum, start: np.ndarray, rate: float = 0.3, share: float = 0.2, hessian_share: float = 0.5, epochs: int = 3, per_epoch: int = 6, period: int = 2, memory: int = 5, epsilon: float = 1e-5) -> Fit:
    """Stochastic L-BFGS: variance-reduced gradients times a curvature estimate from batches."""
    w, curvature = np.asarray(start, dtype=np.float64), _Curvature(problem, hessian_share, period, memory)
    step, passes, trace = 0, 0.0, []
    for _ in range(epochs):
        loss, anchor = problem.full([w])[0]
        passes += 1
        trace.append(loss)
        if relative_norm(anchor, w) <= epsilon:
            break
        x = w.copy()
        for _ in range(per_epoch):
            (_, gx), (_, gw) = problem.batch(step, share, [x, w])
            x = x - rate * curvature.direction(gx - gw + anchor, x, step)
            step, passes = step + 1, passes + share
        w = x
    return _finished(problem, w, step, passes + curvature.passes, trace)


def stochastic_lbfgs_blocks(problem: FiniteSum, start: np.ndarray, rate: float = 0.3, k: int = 3, sub_epochs: int = 3, per_epoch: int = 4, period: int = 2, hessian_share: float = 0.5, memory: int = 5) -> Fit:
    """Stochastic L-BFGS steps on k2-SVRG gradients."""
    curvature = _Curvature(problem, hessian_share, period, memory)
    fit = ksvrg(problem, start, rate, 1 / (k * per_epoch), sub_epochs, per_epoch, k, curvature.direction)
    fit.passes += curvature.passes
    return fit


def fit_background(
    universe: DataFrame, sums: Sequence[float], reads: float, start: np.ndarray | None = None, epsilon: float = 1e-5, steps: int = 20, k: int = 1, left: str = "", right: str = ""
) -> Fit:
    """Log-linear background over words of length ``k`` and the flanks: mean of ln Z - theta . X / N.

    ``sums`` X, in the order of the words' codes, come from one pass over the probes.
    """
    x = np.asarray(sums, dtype=np.float64) / reads
    model = LogLinear(k, left, right)

    def many(thetas):
        z = evaluate(universe, model, thetas)
        return [(float(np.log(z[i].loss) - t @ x), z[i].grad / z[i].loss - x) for i, t in enumerate(thetas)]

    return lbfgs(many, np.zeros(4**k) if start is None else start, epsilon=epsilon, steps=steps)


def fit_affinity(probes: DataFrame, universe: DataFrame, model: AffinityModel, start: np.ndarray, ridge: float = 1e-3, active: np.ndarray | None = None, steps: int = 8) -> Fit:
    """Multinomial affinity likelihood by L-BFGS; ``active`` freezes weights."""
    return lbfgs(lambda thetas: affinity_likelihood(probes, universe, model, thetas, ridge, active), start, steps=steps)


def fit_mode_weights(probes: DataFrame, z: np.ndarray, steps: int = 12, epsilon: float = 1e-5) -> Fit:
    """One scale per mode with the weights fixed; ``probes(kappas, n)`` and ``z``, the modes' sums over the universe. The first scale is held at 0."""

    def many(thetas):
        own = evaluate(probes, ModeWeights(), thetas)
        out = []
        for i, t in enumerate(thetas):
            parts = z * np.exp(t)
            g = parts / parts.sum() + own[i].grad / own[i].n
            g[0] = 0.0
            out.append((float(np.log(parts.sum()) + own[i].loss / own[i].n), g))
        return out

    return lbfgs(many, np.zeros(len(z)), epsilon=epsilon, steps=steps)


@dataclass(frozen=True, eq=False)
class Trial:
    """A model of a sweep by name, and one of the places where it may start."""

    name: object
    model: AffinityModel
    start: np.ndarray
    variant: object = None


def fit_trials(rows: DataFrame, trials: Sequence[Trial], train: frozenset[int], test: frozenset[int], ridge: float = 1e-3, steps: int = 20, epsilon: float = 1e-5) -> dict:
    """``{name: (Fit, test loss)}`` of models fitted on the same parts of :func:`likelihood_rows`, in lockstep; the test loss has no ridge."""
    models = {t.name: t.model for t in trials}
    found = in_lockstep({t.name: lbfgs_asks(t.start, steps=steps, epsilon=epsilon) for t in trials}, lambda asked: likelihoods(rows, {n: (models[n], v, train) for n, v in asked.items()}, ridge))
    held = likelihoods(rows, {n: (models[n], [f.theta], test) for n, f in found.items()})
    return {n: (f, held[n][0][0]) for n, f in found.items()}


def best_starts(rows: DataFrame, trials: Sequence[Trial], train: frozenset[int], ridge: float = 1e-3) -> list[Trial]:
    """Of trials of one name, which differ in where they start, the one with the lowest loss; one job for all."""
    asked = {i: (t.model, [t.start], train) for i, t in enumerate(trials)}
    losses = {i: v[0][0] for i, v in likelihoods(rows, asked, ridge).items()}
    best: dict = {}
    for i, t in enumerate(trials):
        if t.name not in best or losses[i] < losses[best[t.name]]:
            best[t.name] = i
    return [trials[i] for i in best.values()]


def fold_rows(probes: DataFrame, universe: DataFrame, share: float, folds: int, id_col: str = "code") -> DataFrame:
    """:func:`likelihood_rows` with every read dealt to the train or test side of each fold: part 2 f is fold f's training side, 2 f + 1 its test side."""
    sides = thinned(probes, id_col, share, folds)
    own = sides.join(probes.select(id_col, "seq", "p0"), id_col)
    return likelihood_rows(own, universe, 2 * F.col("fold") + F.col("test").cast("int"))


def cross_validated_affinity(rows: DataFrame, model: AffinityModel, start: np.ndarray, folds: int, ridge: float = 1e-3, steps: int = 20, epsilon: float = 1e-5) -> list[tuple[int, Fit, float]]:
    """``(fold, Fit, test loss)`` of refits on each fold's training side of :func:`fold_rows`, all from one start, in lockstep.

    Losses are per read; the test loss has no ridge.
    """

    def many(asked: dict) -> dict:
        return likelihoods(rows, {f: (model, v, frozenset((2 * f,))) for f, v in asked.items()}, ridge)

    found = in_lockstep({f: lbfgs_asks(start, steps=steps, epsilon=epsilon) for f in range(folds)}, many)
    held = likelihoods(rows, {f: (model, [fit.theta], frozenset((2 * f + 1,))) for f, fit in found.items()})
    return [(f, found[f], held[f][0][0]) for f in range(folds)]


def cross_validated(folds: int, fit_on: Callable[[int], Fit], test_on: Callable[[int, np.ndarray], float]) -> list[tuple[int, float, float]]:
    """``(fold, train loss, test loss)`` of refits on each fold's training part, one after the other."""
    out = []
    for fold in range(folds):
        fit = fit_on(fold)
        out.append((fold, fit.loss, test_on(fold, fit.theta)))
    return out


def progressive_modes(probes: DataFrame, universe: DataFrame, lengths: Sequence[int], ridge: float = 1e-3, steps: int = 4) -> list[tuple[str, Fit]]:
    """Fits the first mode, then adds one at a time: the new mode alone while the others are frozen, then all together."""
    done: list[tuple[str, Fit]] = []
    own = np.zeros(0)
    rest = -2.0
    for count in range(1, len(lengths) + 1):
        model = AffinityModel(tuple(lengths[:count]))
        seed = 0.01 * np.cos(np.arange(4 * lengths[count - 1]) + count)  # equal weights are a saddle
        start = np.concatenate((own, seed, [rest]))
        if count > 1:
            active = np.concatenate((np.zeros(len(own)), np.ones(4 * lengths[count - 1]), [0.0]))
            done.append((f"mode {count} alone", fit := fit_affinity(probes, universe, model, start, ridge, active, steps)))
            start = fit.theta
        done.append((f"modes 1 to {count}", fit := fit_affinity(probes, universe, model, start, ridge, None, steps)))
        own, rest = fit.theta[:-1], fit.theta[-1]
    return done
