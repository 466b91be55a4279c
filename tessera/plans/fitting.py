"""Queries of finite-sum objectives and fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.draws import KEYS, below, binomial_sql, keyed, slot, slot_sql
from tessera.functions.draws import keyed_sql as sql_keyed
from tessera.functions.sequences import array_sum, pack
from tessera.operators import affinity, fit, objectives
from tessera.operators.affinity import background, window_scores
from tessera.operators.counts import feature_sums
from tessera.operators.fit import FiniteSum, Fit
from tessera.operators.objectives import AffinityModel, Objective, SquaredHinge, evaluate
from tessera.operators.sampled import PLACES, BackgroundDraws, SampledLikelihood
from tessera.plans import fixtures as X
from tessera.plans.counting import sql_background
from tessera.plans.fixtures import sql_list, sql_probe_score, sql_window_log, sql_windows, with_tables
from tessera.plans.fixtures import sql_reverse_complement as rc
from tessera.plans.registry import query
from tessera.sources.shared import written

RIDGE = 0.001
THETA = np.array([0.1 * (-1) ** j for j in range(64)])
SLACK = "s AS (SELECT id, y, features, greatest(0, 1 - y * list_sum(list_transform(range(1, 65), lambda j: features[j] * (CASE WHEN j % 2 = 1 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END)))) AS m FROM {source})"


def hinge_sql(source: str) -> str:
    return SLACK.replace("{source}", source)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _summary(spark: SparkSession, name: str, found: Fit) -> DataFrame:
    return _rows(spark, [(name, round(found.loss, 5), round(found.norm, 4), found.steps, round(float(found.passes), 3))], "method string, loss double, gradient_norm double, steps int, passes double")


def problem(spark: SparkSession, sf_dir: str) -> FiniteSum:
    """The labelled examples with the squared hinge, written once as every step reads them again."""
    return FiniteSum(written(X.examples(spark, sf_dir), "examples"), SquaredHinge(), RIDGE)


def _loss_and_gradient(spark: SparkSession, rows: DataFrame) -> DataFrame:
    loss, grad = evaluate(rows, SquaredHinge(), [THETA])[0].mean(THETA, RIDGE)
    return _rows(spark, [(j, round(float(v), 7)) for j, v in enumerate([loss, *grad])], "entry int, value double")


def gradient_sql(where: str = "") -> str:
    """Loss as entry 0, then the gradient's entries."""
    theta = sql_list(THETA)
    source = f"part AS (SELECT * FROM examples {where})"
    return f"""{source}, {hinge_sql("part")},
        g AS (SELECT j, sum(-m * y * features[j]) / count(*) + {RIDGE} * {theta}[j] AS v FROM (SELECT *, unnest(range(1, 65)) AS j FROM s) GROUP BY j)
        SELECT 0 AS entry, round(sum(m * m) / 2 / count(*) + {RIDGE} * 64 * 0.01 / 2, 7) AS value FROM s UNION ALL SELECT CAST(j AS INTEGER), round(v, 7) FROM g"""


@query("j1_hinge_gradient", with_tables("examples", gradient_sql()))
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loss_and_gradient(spark, X.examples(spark, sf_dir))


BATCH = f"WHERE {sql_keyed('id', 1)} < {below(0.5)}"


@query(
    "j2_minibatch_variances",
    with_tables(
        "examples",
        f"""part AS (SELECT * FROM examples {BATCH}), {hinge_sql("part")},
        e AS (SELECT -m * y * features[j] AS g, j FROM (SELECT *, unnest(range(1, 65)) AS j FROM s)), v AS (SELECT j, var_samp(g) / count(*) AS v FROM e GROUP BY j)
        SELECT CAST(count(*) AS BIGINT) AS rows, round(avg(m * m / 2), 7) AS loss, round(var_samp(m * m / 2) / count(*), 9) AS loss_variance, (SELECT round(sum(v), 9) FROM v) AS gradient_variance FROM s""",
    ),
)
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.examples(spark, sf_dir).where(keyed("id", 1) < below(0.5))
    found = evaluate(rows, SquaredHinge(), [THETA])[0]
    loss, grads = found.variances()
    return _rows(spark, [(int(found.n), round(found.loss / found.n, 7), round(float(loss), 9), round(float(grads.sum()), 9))], "rows long, loss double, loss_variance double, gradient_variance double")


@query("j3_id_set", with_tables("examples", gradient_sql("WHERE id IN (SELECT doc_id FROM labels)")))
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and gradient on the ids that another table lists."""
    rows = X.examples(spark, sf_dir)
    ids = X.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return _loss_and_gradient(spark, rows.join(ids, "id", "left_semi"))


@query("j4_lbfgs")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, "lbfgs", fit.lbfgs(problem(spark, sf_dir).full, np.zeros(64), steps=12))


#: Accelerated descent from zero, far past what the rounding shows; a step of 10 is below 2 over the largest curvature of unit vectors in 64 dimensions.
DESCENT = f"""e AS (SELECT features, y AS label FROM examples), c AS (SELECT count(*) AS n FROM e),
    it(i, theta, ahead) AS (SELECT 0, list_transform(range(64), lambda x: 0.0::DOUBLE), list_transform(range(64), lambda x: 0.0::DOUBLE) UNION ALL
        SELECT i + 1, list(new ORDER BY j), list(new + {(1 - 0.1) / (1 + 0.1)!r}::DOUBLE * (new - old) ORDER BY j) FROM (
            SELECT i, j, any_value(theta[j]) AS old, any_value(ahead[j]) - 10 * (sum(-slack * features[j]) / any_value(n) + {RIDGE}::DOUBLE * any_value(ahead[j])) AS new
            FROM (SELECT i, theta, ahead, features, n, greatest(0, 1 - label * list_dot_product(features, ahead)) * label AS slack FROM it, e, c WHERE i < 300), (SELECT unnest(range(1, 65)) AS j) GROUP BY i, j) GROUP BY i),
    best AS (SELECT theta FROM it WHERE i = 300)
    SELECT CAST(j AS INTEGER) AS entry, round(theta[j], 3) AS value FROM best, (SELECT unnest(range(1, 65)) AS j)
    UNION ALL SELECT 0, round(avg(pow(greatest(0, 1 - label * list_dot_product(features, theta)), 2)) / 2 + {RIDGE}::DOUBLE * any_value(list_dot_product(theta, theta)) / 2, 7) FROM e, best"""


@query("j4_optimum", with_tables("examples", DESCENT).replace("WITH ", "WITH RECURSIVE ", 1))
def j4_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least loss (entry 0) and the vector that has it, by L-BFGS until no step lowers the loss."""
    found = fit.lbfgs(problem(spark, sf_dir).full, np.zeros(64), epsilon=1e-9, steps=80)
    return _rows(spark, [(i, round(float(v), 3 if i else 7)) for i, v in enumerate([found.loss, *found.theta])], "entry int, value double")


@query("j5_sgd")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, "sgd", fit.sgd(problem(spark, sf_dir), np.zeros(64), share=0.34, epochs=3))


@query("j6_adam")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, "adam", fit.sgd(problem(spark, sf_dir), np.zeros(64), rate=0.1, share=0.34, epochs=3, adam=True))


@query("j7_svrg")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, "svrg", fit.svrg(problem(spark, sf_dir), np.zeros(64), share=0.34, epochs=3, per_epoch=3))


@query("j8_ksvrg")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, "k-svrg", fit.ksvrg(problem(spark, sf_dir), np.zeros(64), share=0.34, sub_epochs=3, per_epoch=2))


@query("j9_k2svrg")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, "k2-svrg", fit.ksvrg(problem(spark, sf_dir), np.zeros(64), sub_epochs=3, per_epoch=2, k=3))


@query("j10_stochastic_lbfgs")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, "stochastic lbfgs", fit.stochastic_lbfgs(problem(spark, sf_dir), np.zeros(64), share=0.34, epochs=2, per_epoch=4))


@query("j11_stochastic_lbfgs_blocks")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, "stochastic lbfgs on k2-svrg", fit.stochastic_lbfgs_blocks(problem(spark, sf_dir), np.zeros(64), k=2, sub_epochs=2, per_epoch=3))


def table_and_universe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Probes and all words of their length with background weights, written once for the fits."""
    p0 = F.exp(background("seq", X.BACKGROUND)).alias("p0")
    probes = written(X.probes(spark, sf_dir).select("code", "seq", "n", p0), "probes")
    return probes, written(affinity.universe(spark, X.PROBE_LENGTH).select("seq", p0), "universe")


#: Bases are independent and all words have one length, so the best weights are the logarithms of the bases' shares.
BASE_SUMS = "x AS (SELECT {group} AS part, b, sum(n * (length(seq) - length(replace(seq, b, '')))) AS x FROM probes, (SELECT unnest(['A', 'C', 'G', 'T']) AS b) GROUP BY 1, 2), r AS (SELECT {group} AS part, sum(n) AS n FROM probes GROUP BY 1)"
HALVES = BASE_SUMS.replace("{group}", "code % 2") + f""", s AS (SELECT part, b, x / n AS x, ln(x / n / {X.PROBE_LENGTH}) AS w FROM x JOIN r USING (part)),
    t AS (SELECT b, sum(x) / (SELECT sum(n) FROM r) AS x FROM x GROUP BY b)
    SELECT 'train' AS part, round(-sum(x * w), 6) AS loss FROM s WHERE part = 0 UNION ALL SELECT 'test', round(-sum(o.x * s.w), 6) FROM s JOIN s o ON s.b = o.b AND s.part = 0 AND o.part = 1
    UNION ALL SELECT 'all', round(-sum(x * ln(x / {X.PROBE_LENGTH})), 6) FROM t"""


@query("j12_background_fit", with_tables("probes", HALVES))
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the even half, likelihood of the odd half, then a fit on all."""
    probes, every = table_and_universe(spark, sf_dir)
    counts = [F.sum(F.col("n") * (F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit(""))))).alias(b) for b in "ACGT"]
    halves = {r["half"]: r for r in probes.groupBy((F.col("code") % 2).alias("half")).agg(F.sum("n").alias("reads"), *counts).collect()}
    sums = {h: np.array([float(r[b]) for b in "ACGT"]) for h, r in halves.items()}
    train = fit.fit_background(every, sums[0], halves[0]["reads"], epsilon=1e-7, steps=25)
    log_z = np.log(evaluate(every, objectives.LogLinear(), [train.theta])[0].loss)
    test = float(log_z - train.theta @ sums[1] / halves[1]["reads"])
    final = fit.fit_background(every, sums[0] + sums[1], halves[0]["reads"] + halves[1]["reads"], train.theta, epsilon=1e-7, steps=25)
    return _rows(spark, [("train", round(train.loss, 6)), ("test", round(test, 6)), ("all", round(final.loss, 6))], "part string, loss double")


#: Added before rounding, as means over round numbers of reads lie on the borders of their digits.
OFF = 1.23e-6
#: At the best weights the background's mean number of each pair of bases, flanks included, is that of the reads.
PAIRS = f"""w AS (SELECT n, unnest({sql_windows("'GC' || seq || 'GA'", 2)}) AS kmer FROM probes), t AS (SELECT sum(n) AS n FROM probes)
    SELECT kmer, round(sum(w.n) / any_value(t.n) + {OFF}::DOUBLE, 4) AS observed, round(sum(w.n) / any_value(t.n) + {OFF}::DOUBLE, 4) AS fitted FROM w, t GROUP BY kmer"""


@query("j12_pair_background", with_tables("probes", PAIRS))
def j12_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A background over pairs of neighbouring bases with flanks, fitted on all reads, and the mean number of each pair under it."""
    probes, every = table_and_universe(spark, sf_dir)
    words = [a + b for a in "ACGT" for b in "ACGT"]
    reads = probes.agg(F.sum("n")).first()[0]
    found = {r["kmer"]: float(r["n"]) for r in feature_sums(probes, 2, "GC", "GA", 2).collect()}
    sums = [found.get(w, 0.0) for w in words]
    best = fit.fit_background(every, sums, reads, epsilon=1e-9, steps=60, k=2, left="GC", right="GA")
    z = evaluate(every, objectives.LogLinear(2, "GC", "GA"), [best.theta])[0]
    return _rows(spark, [(w, round(x / reads + OFF, 4), round(float(m) + OFF, 4)) for w, x, m in zip(words, sums, z.grad / z.loss, strict=True) if x], "kmer string, observed double, fitted double")


NS = -1.0
AFFINITY = f"""score AS (SELECT seq, n, exp({sql_background("seq")}) AS p0, {sql_probe_score("seq", X.NARROW, nonspecific=NS)} AS s FROM probes),
    every AS (SELECT seq, exp({sql_background("seq")}) AS p0, {sql_probe_score("seq", X.NARROW, nonspecific=NS)} AS s FROM universe),
    z AS (SELECT sum(p0 * s) AS z FROM every), t AS (SELECT sum(n) AS n FROM probes),
    rows AS (SELECT seq, -n / s AS w, 'own' AS part FROM score UNION ALL SELECT seq, p0, 'every' FROM every),
    words AS (SELECT w, part, unnest(list_concat({sql_windows("seq", 3)}, list_transform({sql_windows("seq", 3)}, lambda x: {rc("x")}))) AS x FROM rows),
    kappa AS (SELECT part, x, sum(w) AS w, exp({sql_window_log("x", X.NARROW)}) AS k FROM words GROUP BY part, x),
    g AS (SELECT part, p * 4 + strpos('ACGT', substr(x, p + 1, 1)) AS entry, sum(w * k) AS g FROM kappa, (SELECT unnest(range(0, 3)) AS p) GROUP BY 1, 2),
    ns AS (SELECT part, sum(w) * exp({NS}::DOUBLE) AS g FROM rows GROUP BY part)
    SELECT 0 AS entry, round(ln(z) + (SELECT sum(-n * ln(p0 * s)) FROM score) / t.n, 6) AS value FROM z, t
    UNION ALL SELECT CAST(entry AS INTEGER), round(sum(CASE part WHEN 'own' THEN g / t.n ELSE g / z END), 6) FROM g, z, t GROUP BY 1
    UNION ALL SELECT 13, round(sum(CASE part WHEN 'own' THEN g / t.n ELSE g / z END), 6) FROM ns, z, t"""


@query("j13_affinity_likelihood", with_tables("probes universe", AFFINITY))
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, every = table_and_universe(spark, sf_dir)
    loss, grad = objectives.affinity_likelihood(probes, every, AffinityModel((3,)), [np.array([*X.MONO, NS])])[0]
    return _rows(spark, [(i, round(float(v), 6)) for i, v in enumerate([loss, *grad])], "entry int, value double")


#: Loss, then the gradient's entries, of the shaped model; windows' scores follow from seven bases.
SHAPE_THETA = np.array([*X.MONO, *X.SHAPE_WEIGHTS["f0"], *X.SHAPE_WEIGHTS["f1"], NS])
SHAPE_SQL = f"""f AS (SELECT pentamer, max(value) FILTER (feature = 'f0') AS f0, max(value) FILTER (feature = 'f1') AS f1 FROM shape GROUP BY pentamer),
    r AS (SELECT code AS id, 'own' AS part, seq, n, exp({sql_background("seq")}) AS p0 FROM probes UNION ALL SELECT code, 'every', seq, 0, exp({sql_background("seq")}) FROM universe),
    w AS (SELECT id, part, n, p0, unnest(list_concat({sql_windows("'GC' || seq || 'GA'", 7)}, list_transform({sql_windows("'GC' || seq || 'GA'", 7)}, lambda x: {rc("x")}))) AS x FROM r),
    v AS (SELECT DISTINCT x FROM w),
    e AS (SELECT x, p, f0, f1 FROM (SELECT x, unnest(range(1, 4)) AS p FROM v) JOIN f ON pentamer = substr(x, p, 5)),
    k AS (SELECT x, exp({sql_window_log("substr(x, 3, 3)", X.NARROW)} + sum(list_extract({sql_list(X.SHAPE_WEIGHTS["f0"])}, p) * f0 + list_extract({sql_list(X.SHAPE_WEIGHTS["f1"])}, p) * f1)) AS k FROM e GROUP BY x),
    s AS (SELECT id, part, any_value(n) AS n, any_value(p0) AS p0, sum(k) + exp({NS}::DOUBLE) AS s FROM w JOIN k USING (x) GROUP BY id, part),
    a AS (SELECT *, CASE part WHEN 'own' THEN -n / s ELSE p0 END AS weight FROM s),
    t AS (SELECT part, CASE part WHEN 'own' THEN sum(n) ELSE sum(p0 * s) END AS total, sum(weight) AS weight FROM a GROUP BY part),
    c AS (SELECT part, x, sum(weight) * any_value(k) AS c FROM w JOIN a USING (id, part) JOIN k USING (x) GROUP BY part, x),
    g AS (SELECT part, p * 4 + strpos('ACGT', substr(x, p + 3, 1)) AS entry, sum(c) AS g FROM c, (SELECT unnest(range(0, 3)) AS p) GROUP BY 1, 2
          UNION ALL SELECT part, 12 + p, sum(c * f0) FROM c JOIN e USING (x) GROUP BY 1, 2 UNION ALL SELECT part, 15 + p, sum(c * f1) FROM c JOIN e USING (x) GROUP BY 1, 2
          UNION ALL SELECT part, 19, weight * exp({NS}::DOUBLE) FROM t)
    SELECT 0 AS entry, round((SELECT ln(total) FROM t WHERE part = 'every') + (SELECT sum(-n * ln(p0 * s)) / sum(n) FROM s WHERE part = 'own'), 6) AS value
    UNION ALL SELECT CAST(entry AS INTEGER), round(sum(g / total), 6) FROM g JOIN t USING (part) GROUP BY 1"""


def shape_values(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Values of both features for the 1,024 pentamers, by code."""
    rows = X.shape(spark, sf_dir).withColumn("code", pack("pentamer")).collect()
    out = np.zeros((2, 1024))
    for r in rows:
        out[("f0", "f1").index(r["feature"]), r["code"]] = r["value"]
    return out


def shaped_model(spark: SparkSession, sf_dir: str, lengths: tuple[int, ...] = (3,)) -> AffinityModel:
    return AffinityModel(lengths, shape=shape_values(spark, sf_dir), ends=(X.LEFT_FLANK[-2:], X.RIGHT_FLANK[:2]))


@query("j13_shape", with_tables("probes universe shape", SHAPE_SQL))
def j13_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and gradient with shape weights: real features of the pentamer around each base of a window."""
    probes, every = table_and_universe(spark, sf_dir)
    loss, grad = objectives.affinity_likelihood(probes, every, shaped_model(spark, sf_dir), [SHAPE_THETA])[0]
    return _rows(spark, [(i, round(float(v), 6)) for i, v in enumerate([loss, *grad])], "entry int, value double")


#: A minibatch step: the reads that it takes and its draws, whose number per word of the universe is that of a sample.
STEP, SHARE, DRAWS = 2, 0.25, 20_000
DRAWN = BackgroundDraws(X.PROBE_LENGTH, X.BACKGROUND)
_U = f"(CAST({sql_keyed(f'(range * {PLACES} + t)', STEP + 1)} AS DOUBLE) + 0.5) / {KEYS}"
BATCH_TABLES = f"""score AS (SELECT seq, n, exp({sql_background("seq")}) AS p0, {sql_probe_score("seq", X.NARROW, nonspecific=NS)} AS s FROM (SELECT seq, {binomial_sql("n", SHARE, sql_keyed("code", STEP + 1))} AS n FROM probes) WHERE n > 0),
    words AS (SELECT range AS id, array_to_string(list_transform(range(0, {X.PROBE_LENGTH}), lambda t: substr('ACGT', 1 + list_sum(list_transform({sql_list(DRAWN.cut[0][0])}, lambda c: ({_U} > c)::INT))::INT, 1)), '') AS seq FROM range({DRAWS})),
    every AS (SELECT seq, {float(np.exp(DRAWN.log_z) / DRAWS)!r}::DOUBLE AS p0, {sql_probe_score("seq", X.NARROW, nonspecific=NS)} AS s FROM words)"""


def batch_sql() -> str:
    """The loss and gradient of :data:`AFFINITY` over a batch's reads and draws."""
    rest = AFFINITY[AFFINITY.index("z AS (") :].replace("FROM probes", "FROM score").replace("words", "windows")
    return f"{BATCH_TABLES}, {rest}"


@query("j13_minibatch", with_tables("probes", batch_sql()))
def j13_minibatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss per read and gradient of one stochastic step: a quarter of the reads, and Z from words drawn from the background, in one job."""
    p0 = F.exp(background("seq", X.BACKGROUND)).alias("p0")
    problem = SampledLikelihood(written(X.probes(spark, sf_dir).select("code", "seq", "n", p0), "probes"), DRAWN, AffinityModel((3,)), 0.0, batch_draws=DRAWS, id_col="code")
    loss, grad = problem.batch(STEP, SHARE, [np.array([*X.MONO, NS])])[0]
    return _rows(spark, [(i, round(float(v), 6)) for i, v in enumerate([loss, *grad])], "entry int, value double")


DI_NS, DI_LEFT, DI_RIGHT = -0.5, "GC", "GA"
PAIRED_SCORE = sql_probe_score(f"'{DI_LEFT}' || seq || '{DI_RIGHT}'", X.PAIRED, nonspecific=DI_NS)


@query("j13_dinucleotide", with_tables("probes universe", f"z AS (SELECT sum(exp({sql_background('seq')}) * {PAIRED_SCORE}) AS z FROM universe), o AS (SELECT sum(-n * ln(exp({sql_background('seq')}) * {PAIRED_SCORE})) / sum(n) AS l FROM probes) SELECT round(ln(z) + l, 6) AS loss FROM z, o"))
def j13_di(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood with weights of neighbouring pairs, windows reaching two bases into the flanks."""
    probes, every = table_and_universe(spark, sf_dir)
    loss, _ = objectives.affinity_likelihood(probes, every, AffinityModel((3,), True, DI_LEFT, DI_RIGHT), [np.array([*X.MONO, *X.DI, DI_NS])])[0]
    return _rows(spark, [(round(float(loss), 6),)], "loss double")


#: The same likelihood with its gradient: bases of windows, then pairs of neighbours, then the non-specific weight.
PAIR_AFFINITY = f"""score AS (SELECT seq, n, exp({sql_background("seq")}) AS p0, {PAIRED_SCORE} AS s FROM probes), every AS (SELECT seq, exp({sql_background("seq")}) AS p0, {PAIRED_SCORE} AS s FROM universe),
    z AS (SELECT sum(p0 * s) AS z FROM every), t AS (SELECT sum(n) AS n FROM probes),
    rows AS (SELECT '{DI_LEFT}' || seq || '{DI_RIGHT}' AS seq, -n / s AS w, 'own' AS part FROM score UNION ALL SELECT '{DI_LEFT}' || seq || '{DI_RIGHT}', p0, 'every' FROM every),
    words AS (SELECT w, part, unnest(list_concat({sql_windows("seq", 3)}, list_transform({sql_windows("seq", 3)}, lambda x: {rc("x")}))) AS x FROM rows),
    kappa AS (SELECT part, x, sum(w) AS w, exp({sql_window_log("x", X.PAIRED)}) AS k FROM words GROUP BY part, x),
    g AS (SELECT part, p * 4 + strpos('ACGT', substr(x, p + 1, 1)) AS entry, sum(w * k) AS g FROM kappa, (SELECT unnest(range(0, 3)) AS p) GROUP BY 1, 2
          UNION ALL SELECT part, 12 + p * 16 + 4 * (strpos('ACGT', substr(x, p + 1, 1)) - 1) + strpos('ACGT', substr(x, p + 2, 1)), sum(w * k) FROM kappa, (SELECT unnest(range(0, 2)) AS p) GROUP BY 1, 2
          UNION ALL SELECT part, 45, sum(w) * exp({DI_NS}::DOUBLE) FROM rows GROUP BY part)
    SELECT 0 AS entry, round(ln(z) + (SELECT sum(-n * ln(p0 * s)) FROM score) / t.n, 6) AS value FROM z, t
    UNION ALL SELECT CAST(entry AS INTEGER), round(sum(CASE part WHEN 'own' THEN g / t.n ELSE g / z END), 6) FROM g, z, t GROUP BY 1"""


@query("j13_pair_gradient", with_tables("probes universe", PAIR_AFFINITY))
def j13_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and all gradient entries with weights of neighbouring pairs, windows reaching two bases into the flanks."""
    probes, every = table_and_universe(spark, sf_dir)
    loss, grad = objectives.affinity_likelihood(probes, every, AffinityModel((3,), True, DI_LEFT, DI_RIGHT), [np.array([*X.MONO, *X.DI, DI_NS])])[0]
    return _rows(spark, [(i, round(float(v), 6)) for i, v in enumerate([loss, *grad])], "entry int, value double")


@query("j14_candidates", with_tables("examples", "c AS (SELECT unnest(range(0, 5)) AS c), s AS (SELECT c, greatest(0, 1 - y * list_sum(list_transform(range(1, 65), lambda j: features[j] * (CASE WHEN j % 2 = 1 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END) * c))) AS m FROM examples, c) SELECT CAST(c AS INTEGER) AS candidate, round(avg(m * m) / 2 + 0.001 * 64 * 0.01 * c * c / 2, 7) AS loss FROM s GROUP BY c"))
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five multiples of one vector in one pass."""
    tried = [c * THETA for c in range(5)]
    found = evaluate(X.examples(spark, sf_dir), SquaredHinge(), tried)
    return _rows(spark, [(c, round(found[c].mean(t, RIDGE)[0], 7)) for c, t in enumerate(tried)], "candidate int, loss double")


#: Second derivatives at fixed weights: of Z's logarithm, less those of the probes' mean log score.
INFORMATION = AFFINITY[: AFFINITY.index("g AS (")].replace("score AS (SELECT seq,", "score AS (SELECT seq, code,").replace("every AS (SELECT seq,", "every AS (SELECT seq, code,").replace(
    "rows AS (SELECT seq, -n / s AS w, 'own' AS part FROM score UNION ALL SELECT seq, p0, 'every' FROM every)", "rows AS (SELECT seq, code, s, n, n / s AS w, 'own' AS part FROM score UNION ALL SELECT seq, code, s, 0, p0, 'every' FROM every)"
) + f"""h AS (SELECT part, p * 4 + strpos('ACGT', substr(x, p + 1, 1)) AS i, q * 4 + strpos('ACGT', substr(x, q + 1, 1)) AS j, sum(w * k) AS h FROM kappa, (SELECT unnest(range(0, 3)) AS p), (SELECT unnest(range(0, 3)) AS q) GROUP BY 1, 2, 3
          UNION ALL SELECT part, 13, 13, sum(w) * exp({NS}::DOUBLE) FROM rows GROUP BY part),
    o AS (SELECT part, code, p * 4 + strpos('ACGT', substr(x, p + 1, 1)) AS i, sum(exp({sql_window_log("x", X.NARROW)})) AS d
          FROM (SELECT part, code, unnest(list_concat({sql_windows("seq", 3)}, list_transform({sql_windows("seq", 3)}, lambda x: {rc("x")}))) AS x FROM rows), (SELECT unnest(range(0, 3)) AS p) GROUP BY 1, 2, 3
          UNION ALL SELECT part, code, 13, exp({NS}::DOUBLE) FROM rows),
    d AS (SELECT i, sum(w * d) / any_value(z) AS d FROM o JOIN rows USING (part, code), z WHERE part = 'every' GROUP BY i),
    m AS (SELECT a.i AS i, b.i AS j, sum(n / (s * s) * a.d * b.d) AS m FROM o a JOIN o b USING (part, code) JOIN rows USING (part, code) WHERE part = 'own' GROUP BY 1, 2),
    every_pair AS (SELECT a.i AS i, b.i AS j, a.d * b.d AS d FROM d a, d b)
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(coalesce(e.h, 0) / z - d - coalesce(w.h, 0) / t.n + m / t.n + CASE WHEN i = j THEN {2 * RIDGE} ELSE 0 END, 6) AS value
    FROM every_pair JOIN m USING (i, j) LEFT JOIN (SELECT * FROM h WHERE part = 'every') e USING (i, j) LEFT JOIN (SELECT * FROM h WHERE part = 'own') w USING (i, j), z, t"""


@query("j15_information", with_tables("probes universe", INFORMATION))
def j15_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All second derivatives of the affinity loss, summed as outer products in one job."""
    probes, every = table_and_universe(spark, sf_dir)
    found = objectives.affinity_information(probes, every, AffinityModel((3,)), np.array([*X.MONO, NS]), RIDGE)
    return _rows(spark, [(i + 1, j + 1, round(float(v), 6) + 0.0) for i, row in enumerate(found) for j, v in enumerate(row)], "i int, j int, value double")


@query("j15_error_bars")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error bars from the second derivatives of the hinge and of the affinity model, each one job of outer products."""
    rows = written(X.examples(spark, sf_dir), "examples")
    n = rows.count()
    hinge = objectives.error_bars(objectives.hinge_curvature(rows, THETA, RIDGE), n)
    probes, every = table_and_universe(spark, sf_dir)
    reads = probes.agg(F.sum("n")).first()[0]
    bars = objectives.error_bars(objectives.affinity_information(probes, every, AffinityModel((3,)), np.array([*X.MONO, NS]), 1e-3), reads)
    return _rows(spark, [(name, i, round(float(v), 5)) for name, b in (("hinge", hinge), ("affinity", bars)) for i, v in enumerate(b)], "model string, parameter int, error double")


@query("j16_mode_weights")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scale per mode with each mode's probe sums made once."""
    return _summary(spark, "mode weights", fit.fit_mode_weights(*_mode_sums(spark, sf_dir), steps=5))


def _mode_sums(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray]:
    """Each mode's score of every probe, and their sums over the universe."""
    modes = [X.NARROW, X.WIDE]
    kappas = F.array(*[array_sum(window_scores("seq", m)) for m in modes])
    probes = written(X.probes(spark, sf_dir).select("n", kappas.alias("kappas")), "kappas")
    every = affinity.universe(spark, X.PROBE_LENGTH).select(kappas.alias("k"))
    z = every.agg(*[F.sum(F.col("k")[i]).alias(f"z{i}") for i in range(len(modes))]).first()
    return probes, np.array([float(v) for v in z])


#: The second mode's scale by halving an interval: the loss is convex in it.
SCALES = f"""p AS (SELECT n, {sql_probe_score("seq", X.NARROW)} AS a, {sql_probe_score("seq", X.WIDE)} AS b FROM probes),
    z AS (SELECT sum({sql_probe_score("seq", X.NARROW)}) AS a, sum({sql_probe_score("seq", X.WIDE)}) AS b FROM universe),
    c AS (SELECT a, b, sum(n) AS n FROM p GROUP BY a, b), t AS (SELECT sum(n) AS n FROM p),
    s(i, low, high) AS (SELECT 0, -20.0::DOUBLE, 20.0::DOUBLE UNION ALL
        SELECT any_value(s.i) + 1, CASE WHEN any_value(z.b * exp((low + high) / 2) / (z.a + z.b * exp((low + high) / 2))) < sum(c.n * c.b * exp((low + high) / 2) / (c.a + c.b * exp((low + high) / 2))) / any_value(t.n) THEN any_value((low + high) / 2) ELSE any_value(low) END,
               CASE WHEN any_value(z.b * exp((low + high) / 2) / (z.a + z.b * exp((low + high) / 2))) < sum(c.n * c.b * exp((low + high) / 2) / (c.a + c.b * exp((low + high) / 2))) / any_value(t.n) THEN any_value(high) ELSE any_value((low + high) / 2) END
        FROM s, c, z, t WHERE s.i < 60 GROUP BY s.i),
    f AS (SELECT low AS x FROM s WHERE i = 60)
    SELECT round(x, 3) AS scale, round((SELECT ln(a + b * exp(x)) FROM z) - (SELECT sum(n * ln(a + b * exp(x))) FROM c) / (SELECT n FROM t), 6) AS loss FROM f"""


@query("j16_mode_scales", with_tables("probes universe", SCALES).replace("WITH ", "WITH RECURSIVE ", 1))
def j16_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second mode's scale beside the first at the least loss, from each mode's probe sums."""
    probes, z = _mode_sums(spark, sf_dir)
    found = fit.fit_mode_weights(probes, z, steps=60, epsilon=1e-9)
    return _rows(spark, [(round(float(found.theta[1]), 3), round(found.loss, 6))], "scale double, loss double")


FOLDS = BASE_SUMS.replace("{group}", f"CAST({slot_sql(sql_keyed('code'), 3)} AS INTEGER)") + f""", f AS (SELECT DISTINCT part AS fold FROM r),
    s AS (SELECT fold, b, sum(x) AS x, (SELECT sum(n) FROM r WHERE part <> fold) AS n FROM f JOIN x ON part <> fold GROUP BY fold, b)
    SELECT s.fold, round(-sum(s.x / s.n * ln(s.x / s.n / {X.PROBE_LENGTH})), 6) AS train, round(-sum(x.x / r.n * ln(s.x / s.n / {X.PROBE_LENGTH})), 6) AS test
    FROM s JOIN x ON x.part = fold AND x.b = s.b JOIN r ON r.part = fold GROUP BY s.fold"""


@query("j17_cross_validated", with_tables("probes", FOLDS))
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background refits on the training part of three folds; the folds' sums come from one pass."""
    probes, every = table_and_universe(spark, sf_dir)
    fold = slot(keyed("code"), 3).cast("int")
    counts = [F.sum(F.col("n") * (F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit(""))))).alias(b) for b in "ACGT"]
    parts = {r["fold"]: (float(r["reads"]), np.array([float(r[b]) for b in "ACGT"])) for r in probes.groupBy(fold.alias("fold")).agg(F.sum("n").alias("reads"), *counts).collect()}

    def fit_on(f: int) -> Fit:
        rest = [v for k, v in parts.items() if k != f]
        return fit.fit_background(every, sum(x for _, x in rest), sum(n for n, _ in rest), epsilon=1e-7, steps=25)

    def test_on(f: int, theta: np.ndarray) -> float:
        return float(np.log(evaluate(every, objectives.LogLinear(), [theta])[0].loss) - theta @ parts[f][1] / parts[f][0])

    found = fit.cross_validated(3, fit_on, test_on)
    return _rows(spark, [(f, round(a, 6), round(b, 6)) for f, a, b in found], "fold int, train double, test double")


CV_FOLDS, CV_SHARE = 3, 0.3


@query("j17_affinity_folds")
def j17_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affinity model fitted on all reads, then refitted from there on the training reads of each fold, all folds in one job a step.

    ``adjusted`` is the test loss less that of a model that gives each word its own chance.
    """
    probes, every = table_and_universe(spark, sf_dir)
    model, ridge = AffinityModel((3,)), RIDGE
    start = np.array([*(0.1 * np.cos(np.arange(12))), NS])
    whole = fit.fit_affinity(probes, every, model, start, ridge, steps=10)
    rows = written(fit.fold_rows(probes, every, CV_SHARE, CV_FOLDS), "folds")
    found = fit.cross_validated_affinity(rows, model, whole.theta, CV_FOLDS, ridge, steps=10)
    own = rows.where(F.col("part") != objectives.UNIVERSE).groupBy("part").agg(F.sum("n").alias("n"), F.sum(-F.col("n") * F.ln("n")).alias("s")).collect()
    least = {r["part"]: r["s"] / r["n"] + float(np.log(r["n"])) for r in own}
    out = [("fold", f, round(x.loss, 4), round(test, 4), round(test - least[2 * f + 1], 4)) for f, x, test in found]
    mean = [round(float(np.mean([r[i] for r in out])), 4) for i in (2, 3, 4)]
    return _rows(spark, [("all", -1, round(whole.loss, 4), None, None), *out, ("mean", -1, *mean)], "stage string, fold int, train double, test double, adjusted double")


#: The sweep's models: lengths, neighbouring pairs, flank, shape.
SWEEP = tuple((k, di, flank, shaped) for k in (2, 3, 4) for di in (False, True) for flank in (0, 2) for shaped in (False, True))


@query("j18_model_sweep")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits over length, pairs of neighbours, flank, shape and shift; the lowest likelihood of the test half wins.

    One job tells the best of each model's shifted starts, then all models take their steps in
    lockstep: as many jobs as the slowest fit has steps, however many models there are.
    """
    probes, every = table_and_universe(spark, sf_dir)
    rows = written(objectives.likelihood_rows(probes, every, slot(keyed("code"), 2)), "halves")
    values, trials = shape_values(spark, sf_dir), []
    for k, di, flank, shaped in SWEEP:
        left, right = X.LEFT_FLANK[: len(X.LEFT_FLANK) - flank], X.RIGHT_FLANK[flank:]
        model = AffinityModel((k,), di, X.LEFT_FLANK[len(left) :], X.RIGHT_FLANK[:flank], values if shaped else None, (left[-2:], right[:2]) if shaped else ("", ""))
        rest = np.zeros(model.size() - 4 * k - 1)
        trials += [fit.Trial((k, di, flank, shaped), model, np.concatenate((np.roll(0.2 * np.cos(np.arange(4 * k)), 4 * s), rest, [NS])), s) for s in range(k)]
    train, test = frozenset((0,)), frozenset((1,))
    best = fit.best_starts(rows, trials, train, RIDGE)
    found = fit.fit_trials(rows, best, train, test, RIDGE, steps=4)
    chosen = min(found, key=lambda name: (found[name][1], name))
    shifts = {t.name: t.variant for t in best}
    out = [(*name, shifts[name], round(f.loss, 4), round(float(held), 4), f.steps, name == chosen) for name, (f, held) in found.items()]
    return _rows(spark, out, "k int, di boolean, flank int, shape boolean, shift int, loss double, test double, steps int, chosen boolean")


@query("j19_progressive_modes")
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, every = table_and_universe(spark, sf_dir)
    found = fit.progressive_modes(probes, every, (2, 3), steps=2)
    return _rows(spark, [(name, round(f.loss, 6), f.steps) for name, f in found], "stage string, loss double, steps int")


class LeastSquares(Objective):
    """A user's own objective: squared error of a linear fit."""

    columns = ("features", "y")

    def partial(self, rows, theta):
        x, y = np.stack(rows["features"].to_numpy()).astype(float), rows["y"].to_numpy(dtype=float)
        error = x @ theta - y
        each = error[:, None] * x
        return float(len(y)), (error**2 / 2).sum(), (error**4 / 4).sum(), each.sum(axis=0), (each**2).sum(axis=0)


@query("k1_user_objective", with_tables("examples", "s AS (SELECT list_sum(list_transform(range(1, 65), lambda j: features[j] * (CASE WHEN j % 2 = 1 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END))) - y AS e FROM examples) SELECT CAST(count(*) AS BIGINT) AS rows, round(avg(e * e) / 2, 7) AS loss FROM s"))
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate(X.examples(spark, sf_dir), LeastSquares(), [THETA])[0]
    return _rows(spark, [(int(found.n), round(found.loss / found.n, 7))], "rows long, loss double")

