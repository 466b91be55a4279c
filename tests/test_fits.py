from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.draws import HALF, below, keyed_numbers
from tessera.operators import affinity, counts, fit, objectives
from tessera.operators.affinity import background, universe
from tessera.operators.fit import FiniteSum
from tessera.operators.objectives import AffinityModel, LogLinear, ProbeLoss, SquaredHinge, UniverseSum, affinity_likelihood, evaluate
from tessera.operators.sampled import BackgroundDraws, SampledLikelihood, sampled_z
from tessera.plans import fixtures as X


@pytest.fixture(scope="module")
def problem(spark, sf_dir):
    return FiniteSum(X.examples(spark, sf_dir).cache(), SquaredHinge(), 0.001)


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    p0 = F.exp(background("seq", X.BACKGROUND)).alias("p0")
    few = X.probes(spark, sf_dir).where("code % 16 = 1").select(F.substring("seq", 1, 5).alias("seq"), "n").groupBy("seq").agg(F.sum("n").alias("n"))
    return few.select("seq", "n", p0).cache(), universe(spark, 5).select("seq", p0).cache()


def difference(f, x, j, h=1e-5):
    e = np.zeros_like(x)
    e[j] = h
    return (f(x + e) - f(x - e)) / (2 * h)


def test_hinge_gradient_matches_differences(problem):
    x = np.sin(np.arange(64)) / 5
    _, g = problem.full([x])[0]
    for j in (0, 17, 63):
        assert g[j] == pytest.approx(difference(lambda t: problem.full([t])[0][0], x, j), abs=1e-6)


def test_affinity_gradient_matches_differences(tables):
    model, x = AffinityModel((2, 3)), np.sin(np.arange(21)) / 3
    many = lambda ts: objectives.affinity_likelihood(*tables, model, ts, 0.01)
    _, g = many([x])[0]
    for j in (0, 7, 15, 20):
        assert g[j] == pytest.approx(difference(lambda t: many([t])[0][0], x, j), abs=1e-6)


def test_groups_add_up_to_the_whole(problem):
    x = np.ones(64) / 10
    whole = evaluate(problem.rows, SquaredHinge(), [x])[0]
    parts = evaluate(problem.rows.withColumn("g", F.col("id") % 3), SquaredHinge(), [x], by="g")
    assert sum(p.loss for p in parts.values()) == pytest.approx(whole.loss)
    assert np.allclose(sum(p.grad for p in parts.values()), whole.grad)


@pytest.fixture(scope="module")
def optimum(problem):
    return fit.lbfgs(problem.full, np.zeros(64), steps=60, epsilon=1e-5)


def test_lbfgs_converges(optimum):
    assert optimum.norm < 1e-4


def test_stochastic_fits_approach_the_optimum(problem, optimum):
    start = problem.full([np.zeros(64)])[0][0]
    for found in (
        fit.sgd(problem, np.zeros(64), rate=2.0, share=0.34, epochs=4),
        fit.sgd(problem, np.zeros(64), rate=0.2, share=0.34, epochs=4, adam=True),
        fit.svrg(problem, np.zeros(64), rate=3.0, share=0.34, epochs=3, per_epoch=4),
        fit.ksvrg(problem, np.zeros(64), rate=3.0, share=0.34, sub_epochs=3, per_epoch=3),
        fit.ksvrg(problem, np.zeros(64), rate=3.0, sub_epochs=3, per_epoch=3, k=3),
        fit.stochastic_lbfgs(problem, np.zeros(64), share=0.5, epochs=3, per_epoch=4),
        fit.stochastic_lbfgs_blocks(problem, np.zeros(64), k=2, sub_epochs=3, per_epoch=3),
    ):
        assert optimum.loss <= found.loss + 1e-9 < start


class Local(FiniteSum):
    """The problem over arrays, with the batches that ids and steps give on Spark."""

    def __init__(self, problem):
        rows = problem.rows.collect()
        self.x, self.y, self.ids, self.ridge = np.stack([r.features for r in rows]), np.array([r.y for r in rows]), np.array([r.id for r in rows]), problem.ridge

    def _at(self, on, thetas):
        out = []
        for t in thetas:
            slack = np.maximum(0, 1 - self.y[on] * (self.x[on] @ t))
            out.append((float((slack**2).mean() / 2 + self.ridge * t @ t / 2), -(slack * self.y[on]) @ self.x[on] / on.sum() + self.ridge * t) if on.any() else (0.0, self.ridge * t))
        return out

    def full(self, thetas):
        return self._at(np.full(len(self.y), True), thetas)

    def batch(self, step, share, thetas):
        return self._at(keyed_numbers(self.ids, step + 1) < below(share), thetas)


@pytest.fixture(scope="module")
def local(problem):
    return Local(problem)


def test_batches_over_arrays_are_those_on_spark(problem, local):
    x = np.sin(np.arange(64)) / 5
    for step in (0, 7):
        (a, ga), (b, gb) = problem.batch(step, 0.3, [x])[0], local.batch(step, 0.3, [x])[0]
        assert a == pytest.approx(b) and np.allclose(ga, gb)


def test_stochastic_fits_reach_the_optimum(local, optimum):
    """Within a hundredth of L-BFGS's loss; the variance-reduced ones down to its gradient norm, with the passes that 20 and 200 rows a batch take."""
    start = np.zeros(64)
    for found in (fit.sgd(local, start, rate=20.0, share=0.2, epochs=60), fit.sgd(local, start, rate=0.2, share=0.2, epochs=40, adam=True)):
        assert found.loss < 1.01 * optimum.loss
    for found, passes in (
        (fit.svrg(local, start, rate=5.0, share=0.04, epochs=60, per_epoch=50), 60),
        (fit.svrg(local, start, rate=10.0, share=0.4, epochs=60, per_epoch=20), 80),
        (fit.stochastic_lbfgs(local, start, rate=0.1, share=0.04, hessian_share=0.4, epochs=200, per_epoch=50, period=10, memory=10), 80),
        (fit.stochastic_lbfgs(local, start, rate=0.5, share=0.4, hessian_share=0.4, epochs=100, per_epoch=10, period=5, memory=10), 80),
    ):
        assert fit.relative_norm(local.full([found.theta])[0][1], found.theta) <= 1.0001e-5 and found.loss < 1.0001 * optimum.loss and found.passes < passes


@pytest.mark.parametrize("k", [None, 3])
def test_bound_snapshots_reach_the_optimum(local, optimum, k):
    """The loop over arrays that the Spark fits are compared with, run to the end."""
    w = _plain_ksvrg(local.x, local.y, local.ids, local.ridge, 5.0, 0.2, 60, 2 if k else 5, k)
    assert local.full([w])[0][0] < 1.01 * optimum.loss


def _plain_ksvrg(x, y, ids, ridge, rate, share, sub_epochs, per_epoch, k):
    """k-SVRG over arrays, with a snapshot kept for every row."""

    def key(step):
        return keyed_numbers(ids, step)

    def gradient(rows, at):
        slack = np.maximum(0, 1 - y[rows] * (x[rows] * at).sum(axis=1))
        return (-(slack * y[rows])[:, None] * x[rows] + ridge * at).mean(axis=0)

    w, own, every, step = np.zeros(x.shape[1]), np.zeros_like(x), np.full(len(ids), True), 0
    for epoch in range(sub_epochs):
        anchor, touched = gradient(every, own), np.full(len(ids), False)
        for i in range(per_epoch):
            block = (key(0) >> HALF) * ((k or 1) * per_epoch) >> HALF
            mine = key(step + 1) < below(share) if k is None else block == (epoch % k) * per_epoch + i
            w = w - rate * (gradient(mine, np.tile(w, (mine.sum(), 1))) - gradient(mine, own[mine]) + anchor)
            touched, step = touched | mine, step + 1
        own[touched] = w
    return w


@pytest.mark.parametrize("k", [None, 3])
def test_snapshots_follow_from_ids(problem, k):
    rows = problem.rows.collect()
    x, y, ids = np.stack([r.features for r in rows]), np.array([r.y for r in rows]), np.array([r.id for r in rows])
    found = fit.ksvrg(problem, np.zeros(64), rate=1.0, share=0.4, sub_epochs=4, per_epoch=2, k=k)
    assert found.passes == pytest.approx(4 + 8 * (0.4 if k is None else 1 / 6) + 1)
    assert np.allclose(found.theta, _plain_ksvrg(x, y, ids, problem.ridge, 1.0, 0.4, 4, 2, k), atol=1e-9)


def test_batches_without_rows_follow_the_anchor(problem):
    found = fit.ksvrg(problem, np.zeros(64), rate=1.0, share=0.0, sub_epochs=1, per_epoch=2)
    _, g = problem.full([np.zeros(64)])[0]
    assert np.allclose(found.theta, -2 * g)


def test_information_of_a_quadratic():
    h = np.array([[2.0, 0.5], [0.5, 1.0]])
    assert np.allclose(objectives.information_by_differences(lambda ts: [h @ t for t in ts], np.array([0.3, -0.2])), h)


def test_added_modes_lower_the_loss(tables):
    found = fit.progressive_modes(*tables, (2, 2), steps=2)
    assert [name for name, _ in found] == ["modes 1 to 1", "mode 2 alone", "modes 1 to 2"]
    first, alone, both = (f for _, f in found)
    assert np.array_equal(alone.theta[:8], first.theta[:8]) and both.loss <= alone.loss


def test_frozen_weights_stay(tables):
    active = np.concatenate((np.zeros(8), np.ones(13)))
    start = np.sin(np.arange(21)) / 5
    found = fit.fit_affinity(*tables, AffinityModel((2, 3)), start, active=active, steps=2)
    assert np.array_equal(found.theta[:8], start[:8]) and not np.array_equal(found.theta[8:], start[8:])


def test_mode_weights_lower_the_loss(spark):
    rows = [([1.0, 3.0], 5), ([2.0, 1.0], 1)]
    probes = spark.createDataFrame(rows, "kappas array<double>, n long")
    found = fit.fit_mode_weights(probes, np.array([4.0, 4.0]), steps=6)
    assert found.theta[0] == 0 and found.theta[1] > 0


def test_error_bars_of_a_known_matrix():
    assert np.allclose(objectives.error_bars(np.diag([4.0, 1.0]), 100), [0.05, 0.1])
    assert np.isfinite(objectives.error_bars(np.zeros((2, 2)), 10)).all()


def test_curvature_is_the_mean_of_active_rows(problem):
    h = objectives.hinge_curvature(problem.rows, np.zeros(64), 0.0)
    x = np.stack([r.features for r in problem.rows.collect()])
    assert np.allclose(h, x.T @ x / len(x))


def test_two_loop_without_pairs_is_the_gradient():
    assert np.array_equal(fit.two_loop(np.arange(3.0), []), np.arange(3.0))
    assert np.linalg.norm(fit.clipped(np.full(4, 1e5))) <= 100


def _slope(f, theta, j, step=1e-5):
    up, down = (theta + s * step * (np.arange(len(theta)) == j) for s in (1, -1))
    return (f(up) - f(down)) / (2 * step)


@pytest.mark.parametrize("model", [AffinityModel((3,), True, "GC", "GA"), AffinityModel((2, 3), True), AffinityModel((2,), False, "C", "A")])
def test_pair_and_flank_weights_have_true_gradients(model):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"seq": ["ACGTAC", "TTGACA", "GGGCAT"], "n": [3, 1, 2], "p0": [0.1, 0.2, 0.3]})
    theta = rng.normal(scale=0.3, size=model.size())
    for objective in (ProbeLoss(model), UniverseSum(model)):
        _, _, _, grad, _ = objective.partial(rows, theta)
        for j in range(len(theta)):
            assert grad[j] == pytest.approx(_slope(lambda t: objective.partial(rows, t)[1], theta, j), rel=1e-5, abs=1e-7)  # noqa: B023


@pytest.mark.parametrize("model", [LogLinear(2, "C", "A"), LogLinear(3), LogLinear()])
def test_word_background_has_a_true_gradient(model):
    rows = pd.DataFrame({"seq": ["ACGTAC", "TTGACA", "GGGCAT"]})
    theta = np.random.default_rng(4).normal(scale=0.3, size=4**model.k)
    _, _, _, grad, _ = model.partial(rows, theta)
    for j in range(len(theta)):
        assert grad[j] == pytest.approx(_slope(lambda t: model.partial(rows, t)[1], theta, j), rel=1e-5, abs=1e-7)


def test_word_background_fit_meets_the_observed_words(spark, sf_dir):
    """At the optimum the background's mean word counts, flanks included, are those of the probes."""
    probes = X.probes(spark, sf_dir)
    sums = {r.kmer: r.n for r in counts.feature_sums(probes, 2, X.LEFT_FLANK, X.RIGHT_FLANK, 1).collect()}
    words = [a + b for a in "ACGT" for b in "ACGT"]
    reads = probes.agg(F.sum("n")).first()[0]
    every = affinity.universe(spark, X.PROBE_LENGTH).select("seq").cache()
    found = fit.fit_background(every, [sums.get(w, 0) for w in words], reads, steps=15, k=2, left=X.LEFT_FLANK[-1:], right=X.RIGHT_FLANK[:1])
    rest = affinity.background_gradient(probes, every, found.theta, 2, X.LEFT_FLANK[-1:], X.RIGHT_FLANK[:1]).collect()
    assert max(abs(r.gradient) for r in rest) < 2e-3 * reads


SHAPES = np.random.default_rng(9).normal(size=(2, 1024))
SHAPED = (AffinityModel((3,), shape=SHAPES, ends=("GC", "GA")), AffinityModel((2, 3), True, "C", "A", SHAPES, ("GG", "AT")))


@pytest.mark.parametrize("model", SHAPED)
def test_shape_weights_have_true_gradients(model):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"seq": ["ACGTAC", "TTGACA", "GGGCAT"], "n": [3, 1, 2], "p0": [0.1, 0.2, 0.3]})
    theta = rng.normal(scale=0.2, size=model.size())
    for objective in (ProbeLoss(model), UniverseSum(model)):
        _, _, _, grad, _ = objective.partial(rows, theta)
        for j in range(len(theta)):
            assert grad[j] == pytest.approx(_slope(lambda t: objective.partial(rows, t)[1], theta, j), rel=1e-5, abs=1e-7)  # noqa: B023


def test_shape_scores_of_a_strand_are_those_of_the_turned_probe():
    """A probe and its reverse complement, with flanks turned alike, have one score."""
    theta = np.random.default_rng(4).normal(scale=0.2, size=SHAPED[0].size())
    turned = AffinityModel((3,), shape=SHAPES, ends=("TC", "GC"))
    a, b = (m.scores(objectives.encoded(pd.Series([s])), theta)[0] for m, s in ((SHAPED[0], "ACGTACCA"), (turned, "TGGTACGT")))
    assert a == pytest.approx(b)


@pytest.mark.parametrize("model", [AffinityModel((2, 3), True, "GC", "GA"), *SHAPED])
def test_information_matches_differences(tables, model):
    theta = np.random.default_rng(6).normal(scale=0.2, size=model.size())

    def gradients(thetas):
        return [g for _, g in affinity_likelihood(*tables, model, thetas, 0.01)]

    found = objectives.affinity_information(*tables, model, theta, 0.01)
    assert np.allclose(found, found.T) and np.allclose(found, objectives.information_by_differences(gradients, theta), atol=1e-5)


def test_information_has_a_limit(tables):
    with pytest.raises(ValueError):
        objectives.affinity_information(*tables, AffinityModel((3,)), np.zeros(13), most=12)


def _chances(k, weights, left, right, length):
    """Log weight of every word of a length under a background, counted window by window."""
    words = ["".join("ACGT"[c >> 2 * (length - 1 - p) & 3] for p in range(length)) for c in range(4**length)]
    code = {w: i for i, w in enumerate("".join("ACGT"[c >> 2 * (k - 1 - p) & 3] for p in range(k)) for c in range(4**k))}
    return np.array([sum(weights[code[(left + w + right)[i : i + k]]] for i in range(len(left + w + right) - k + 1)) for w in words])


@pytest.mark.parametrize(("k", "left", "right"), [(1, "", ""), (2, "GC", "A"), (3, "A", "TG"), (3, "", "")])
def test_draws_follow_the_background(k, left, right):
    weights = np.random.default_rng(k).normal(scale=0.6, size=4**k)
    logs = _chances(k, weights, left, right, 4)
    source = BackgroundDraws(4, weights, k, left, right)
    assert source.log_z == pytest.approx(np.log(np.exp(logs).sum()))
    drawn = source.words(np.arange(60_000), 3) @ 4 ** np.arange(3, -1, -1)
    e = 60_000 * np.exp(logs - source.log_z)
    assert ((np.bincount(drawn, minlength=256) - e) ** 2 / e).sum() < 255 + 5 * np.sqrt(510)
    assert np.array_equal(source.words(np.array([7]), 3)[0], source.words(np.arange(60_000), 3)[7])


def test_sampled_z_and_gradient_lie_near_the_exact_ones(spark):
    """At length 8: within 3.5 standard errors for 20 numbers, and the errors are of the right size."""
    model = AffinityModel((3,), False, "GC", "GA")
    theta = np.array([*X.MONO, -1.0])
    exact = evaluate(universe(spark, 8).select("seq", F.exp(background("seq", X.BACKGROUND)).alias("p0")), UniverseSum(model), [theta])[0]
    source, z = BackgroundDraws(8, X.BACKGROUND), []
    for step in range(6):
        value, error, grad, errors = sampled_z(source.drawn(spark, 8000, step), model, theta, 8000)
        assert abs(value - exact.loss) < 4 * error and (np.abs(grad - exact.grad) < 4 * errors).all() and error < 0.05 * value
        z.append((value - exact.loss) / error)
    assert 0.2 < np.std(z) < 2.5


@pytest.fixture(scope="module")
def long_probes(spark):
    """Probes of 16 bases drawn from a background and then by their affinity under known weights."""
    rng = np.random.default_rng(8)
    true = np.array([*(1.5 * rng.normal(size=12)), 2.0])
    model, source = AffinityModel((3,)), BackgroundDraws(16, X.BACKGROUND)
    codes = source.words(np.arange(60_000), 77)
    score, _ = model.scores(codes, true)
    kept = codes[rng.choice(len(score), 6000, p=score / score.sum())]
    rows = pd.DataFrame({"seq": ["".join("ACGT"[b] for b in row) for row in kept]})
    rows = rows.groupby("seq", as_index=False).size().rename(columns={"size": "n"})
    rows["id"] = np.arange(len(rows))
    rows["p0"] = [float(np.exp(sum(X.BACKGROUND["ACGT".index(b)] for b in s))) for s in rows["seq"]]
    return SampledLikelihood(spark.createDataFrame(rows).cache(), source, model, 1e-5, 16_384, 4_096), true


def test_stochastic_fits_of_sixteen_bases(long_probes):
    """SGD, SVRG and stochastic L-BFGS go from the start to the loss of the true weights but for a small part of the way."""
    problem, true = long_probes
    start = np.array([*(0.2 * true[:12]), 2.0])
    (first, _), (least, _) = problem.full([start, true])
    assert first > least
    for found, share in (
        (fit.sgd(problem, start, rate=15.0, share=0.34, epochs=2), 0.5),
        (fit.svrg(problem, start, rate=15.0, share=0.34, epochs=2, per_epoch=3), 0.4),
        (fit.stochastic_lbfgs(problem, start, rate=0.6, share=0.34, epochs=1, per_epoch=6), 0.4),
    ):
        assert found.loss - least < share * (first - least), (found.loss, least, first)
    empty = problem.batch(1, 0.0, [start])[0]
    assert np.isfinite(empty[0]) and np.isfinite(empty[1]).all()


def test_lockstep_fits_are_those_made_alone(tables):
    probes, every = tables
    rows = objectives.likelihood_rows(probes, every, F.when(F.col("seq") < "G", 0).otherwise(1)).cache()
    models = {"a": AffinityModel((2,)), "b": AffinityModel((3,), True), "c": SHAPED[0]}
    trials = [fit.Trial(n, m, 0.1 * np.cos(np.arange(m.size()) + s), s) for n, m in models.items() for s in range(2)]
    asked = []
    real = objectives.evaluate_jobs
    try:
        objectives.evaluate_jobs = lambda *a: asked.append(1) or real(*a)
        best = fit.best_starts(rows, trials, frozenset((0,)), 0.01)
        found = fit.fit_trials(rows, best, frozenset((0,)), frozenset((1,)), 0.01, steps=4)
    finally:
        objectives.evaluate_jobs = real
    assert len(asked) == 1 + 1 + 4 + 1  # starts, first gradients, steps, test losses: whatever the number of models
    train, test = (probes.where(f"seq {op} 'G'") for op in ("<", ">="))
    for t in best:
        losses = [affinity_likelihood(train, every, t.model, [x.start], 0.01)[0][0] for x in trials if x.name == t.name]
        assert int(np.argmin(losses)) == t.variant
        alone = fit.fit_affinity(train, every, t.model, t.start, 0.01, steps=4)
        assert np.allclose(alone.theta, found[t.name][0].theta, atol=1e-6) and alone.steps == found[t.name][0].steps
        assert found[t.name][1] == pytest.approx(affinity_likelihood(test, every, t.model, [alone.theta])[0][0], abs=1e-7)


def test_affinity_folds_in_lockstep(spark, tables):
    probes, every = tables
    probes = probes.withColumn("code", F.xxhash64("seq").bitwiseAND((1 << 40) - 1)).cache()
    model = AffinityModel((2,))
    start = 0.1 * np.cos(np.arange(9.0))
    rows = fit.fold_rows(probes, every, 0.4, 2).cache()
    sides = {r.part: r.n for r in rows.where("part >= 0").groupBy("part").agg(F.sum("n").alias("n")).collect()}
    assert sides[0] + sides[1] == sides[2] + sides[3] == probes.agg(F.sum("n")).first()[0]
    for fold, found, held in fit.cross_validated_affinity(rows, model, start, 2, 0.01, 5):
        train, test = (rows.where(F.col("part") == 2 * fold + side) for side in (0, 1))
        alone = fit.fit_affinity(train, every, model, start, 0.01, steps=5)
        assert np.allclose(alone.theta, found.theta, atol=1e-6) and held == pytest.approx(affinity_likelihood(test, every, model, [alone.theta])[0][0], abs=1e-7)


def test_affinity_refits_by_fold(spark, sf_dir):
    probes = X.probes(spark, sf_dir).limit(300).withColumn("p0", F.lit(1.0)).cache()
    every = affinity.universe(spark, X.PROBE_LENGTH).where("code % 64 = 0").select("seq", F.lit(1.0).alias("p0")).cache()
    model = AffinityModel((2,), True)

    def fit_on(f):
        return fit.fit_affinity(probes.where(F.col("code") % 2 != f), every, model, np.zeros(model.size()), steps=1)

    def test_on(f, theta):
        return affinity_likelihood(probes.where(F.col("code") % 2 == f), every, model, [theta])[0][0]

    found = fit.cross_validated(2, fit_on, test_on)
    assert [f for f, *_ in found] == [0, 1] and all(np.isfinite([a, b]).all() for _, a, b in found)
