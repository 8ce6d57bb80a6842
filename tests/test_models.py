"""Fits against closed forms, a library fit and simulations; draws, effects and comparison against numpy."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from natal.models import compare, effects, mixed, summaries
from natal.models.draws import DrawMatrix, draw_matrix, draws_table, matrix_from_table
from natal.models.logit import fit_logit
from natal.models.patterns import pattern_counts
from natal.models.priors import FLAT, WEAK, Priors, prior_summary


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(1)
    n = 4000
    a, b = rng.normal(size=n), rng.integers(0, 3, n).astype(float)
    y = rng.random(n) < 1 / (1 + np.exp(-(0.3 - 0.8 * a + 0.5 * b)))
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": y.astype(int)})).persist()


def test_fit_equals_library(simulated):
    fit = fit_logit(simulated, "y", ["a", "b"])
    data = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(simulated)
    lib = LogisticRegression(featuresCol="x", labelCol="y", tol=1e-10, maxIter=200, standardization=False).fit(data)
    assert fit.mode == pytest.approx([lib.intercept, *lib.coefficients], abs=1e-4)
    assert fit.nobs == 4000 and fit.steps < 10


def test_prior_shrinks(simulated):
    flat = fit_logit(simulated, "y", ["a", "b"])
    tight = fit_logit(simulated, "y", ["a", "b"], Priors(slope_sd=0.05))
    assert abs(tight.mode[1]) < abs(flat.mode[1]) and tight.cov[1, 1] < flat.cov[1, 1]
    # gradient of the penalised likelihood vanishes
    pdf = simulated.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.a, pdf.b])
    grad = x.T @ (pdf.y - 1 / (1 + np.exp(-x @ tight.mode))) - np.diag([0, 400, 400]) @ tight.mode
    assert grad == pytest.approx(np.zeros(3), abs=1e-3)


def test_saturated_two_by_two(spark):
    rows = [(1.0, 1)] * 30 + [(1.0, 0)] * 10 + [(0.0, 1)] * 20 + [(0.0, 0)] * 40
    fit = fit_logit(spark.createDataFrame(rows, "x double, y int"), "y", ["x"])
    assert fit.mode == pytest.approx([np.log(0.5), np.log(30 * 40 / (10 * 20))])


def test_separation_is_reported(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1)] * 20, "x double, y int")
    with pytest.raises((RuntimeError, np.linalg.LinAlgError)):
        fit_logit(df, "y", ["x"], FLAT, max_steps=15)
    assert fit_logit(df, "y", ["x"], WEAK).mode[1] > 1


def grouped(spark, seed, groups, per_group, sd, slope=-0.4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=groups)
    b = rng.normal(0, sd, groups)
    g = np.repeat(np.arange(groups), per_group)
    y = rng.random(len(g)) < 1 / (1 + np.exp(-(0.2 + slope * x[g] + b[g])))
    return spark.createDataFrame(pd.DataFrame({"g": g, "x": x[g], "y": y.astype(int)})), b, x


def test_random_intercept_recovers_simulation(spark):
    slopes, sds, cover = [], [], []
    for seed in (1, 2):
        df, b, _ = grouped(spark, seed, 60, 300, 0.5)
        fit = mixed.fit_random_intercept(df, "y", ["x"], "g", WEAK)
        draws = mixed.mixed_draws(fit, 800)
        table = summaries.random_effects(mixed.group_draws(fit, draws), width=0.9).toPandas().set_index("condition").sort_index()
        assert np.corrcoef(table.estimate, b)[0, 1] > 0.9
        cover.append(((table.lower <= b) & (b <= table.upper)).mean())
        slopes.append(fit.mode[1])
        sds.append(fit.sd)
        assert fit.weights.sum() == pytest.approx(1) and fit.n_groups == 60 and fit.nobs == 18000
    assert np.mean(slopes) == pytest.approx(-0.4, abs=0.15)
    assert np.mean(sds) == pytest.approx(0.5, abs=0.12)
    assert 0.75 < np.mean(cover) <= 1.0


def test_random_intercept_with_tiny_sd_is_the_fixed_fit(spark):
    df, _, _ = grouped(spark, 3, 20, 100, 0.0)
    fixed = fit_logit(df, "y", ["x"])
    fit = mixed.fit_random_intercept(df, "y", ["x"], "g", sds=[1e-4])
    assert fit.modes[0] == pytest.approx(fixed.mode, abs=1e-3)
    assert fit.covs[0] == pytest.approx(fixed.cov, abs=1e-4)


def test_group_posterior_equals_quadrature(spark):
    """One SD, few groups: the Laplace marginal of an effect is near the exact one."""
    df, _, _ = grouped(spark, 5, 6, 80, 0.6)
    fit = mixed.fit_random_intercept(df, "y", ["x"], "g", Priors(slope_sd=0.001, intercept_sd=0.001), sds=[0.6])
    draws = mixed.mixed_draws(fit, 3000)
    got = mixed.group_draws(fit, draws).groupBy("condition").agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).toPandas()
    got = got.set_index("condition")
    pdf = df.toPandas()
    grid = np.linspace(-3, 3, 2001)
    for g, part in pdf.groupby("g"):
        k, n = part.y.sum(), len(part)
        logp = k * grid - n * np.log1p(np.exp(grid)) - grid**2 / (2 * 0.36)
        w = np.exp(logp - logp.max())
        mean = (w * grid).sum() / w.sum()
        assert got.m[g] == pytest.approx(mean, abs=0.04)
        assert got.s[g] == pytest.approx(np.sqrt((w * (grid - mean) ** 2).sum() / w.sum()), rel=0.1)


def test_draws_do_not_depend_on_partitions(spark, simulated):
    fit = fit_logit(simulated, "y", ["a", "b"])
    m = draw_matrix(fit, 4000)
    assert m.values.mean(axis=0) == pytest.approx(fit.mode, abs=0.01)
    assert np.cov(m.values.T) == pytest.approx(fit.cov, abs=3e-4)
    assert (draw_matrix(fit, 4000).values == m.values).all()
    table = draws_table(spark, m, "full")
    assert table.count() == 12000
    assert matrix_from_table(table.repartition(5), m.terms).values == pytest.approx(m.values)


def test_any_number_of_draws(spark):
    draws = DrawMatrix(("Intercept", "x"), np.arange(1_500_000.0 * 2).reshape(-1, 2))
    assert len(draws) == 1_500_000


def test_effect_needs_no_compression(spark, simulated):
    """The average over respondents is the same with and without patterns."""
    draws = draw_matrix(fit_logit(simulated, "y", ["a", "b"]), 50)
    pdf = simulated.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.a, pdf.b])
    p = 1 / (1 + np.exp(-x @ draws.values.T))
    want = (draws.values[:, 1] * p * (1 - p)).mean(axis=0)
    ones = simulated.select("a", "b", F.lit(1).alias("n"))
    for data in (ones.repartition(7), pattern_counts(simulated, "y", ["a", "b"])):
        got = effects.average_marginal_effect(data, draws, "a").orderBy("draw").toPandas().ame
        assert got.to_numpy() == pytest.approx(want)
    part = effects.average_marginal_effect(ones, draws, "a", prop=0.3).toPandas().ame
    assert part.mean() == pytest.approx(want.mean(), rel=0.1)


def test_effect_blocks(spark, simulated, monkeypatch):
    from natal.models import scoring

    draws = draw_matrix(fit_logit(simulated, "y", ["a"]), 20)
    ones = simulated.select("a", F.lit(1).alias("n"))
    want = effects.average_marginal_effect(ones, draws, "a").orderBy("draw").toPandas()
    monkeypatch.setattr(scoring, "CELLS_PER_BLOCK", 100)
    got = effects.average_marginal_effect(ones, draws, "a").orderBy("draw").toPandas()
    pd.testing.assert_frame_equal(got, want)


def test_curve(simulated):
    fit = fit_logit(simulated, "y", ["a", "b"])
    patterns = pattern_counts(simulated, "y", ["a", "b"])
    out = effects.effect_curve(patterns, draw_matrix(fit, 500), "a", points=11).orderBy("point").toPandas()
    assert len(out) == 11 and (out.estimate.diff().dropna() < 0).all()
    assert ((out.lower < out.estimate) & (out.estimate < out.upper)).all()
    lo, hi = simulated.agg(F.min("a"), F.max("a")).first()
    assert out.a.iloc[0] == pytest.approx(lo) and out.a.iloc[-1] == pytest.approx(hi)


def test_group_effects_enter_scores(spark):
    df, _, _ = grouped(spark, 7, 12, 60, 0.8)
    patterns = pattern_counts(df, "y", ["x"], "g")
    fit = mixed.fit_random_intercept(df, "y", ["x"], "g", WEAK, sds=[0.8])
    draws = mixed.mixed_draws(fit, 300)
    joined = mixed.attach_groups(patterns, fit)
    with_groups = effects.average_marginal_effect(joined, draws, "x").orderBy("draw").toPandas().ame.to_numpy()
    wide = mixed.group_draws(fit, draws).toPandas().pivot(index="condition", columns="draw", values="value")
    pdf = df.toPandas()
    eta = draws.values[:, 0] + np.outer(pdf.x, draws.values[:, 1]) + wide.to_numpy()[pdf.g]
    p = 1 / (1 + np.exp(-eta))
    assert with_groups == pytest.approx((draws.values[:, 1] * p * (1 - p)).mean(axis=0))


def plain_fit(x):
    """Shape and scale of rising excesses, number by number."""
    n = len(x)
    m = 30 + int(n**0.5)
    theta = [1 / x[-1] + (1 - (m / (j - 0.5)) ** 0.5) / 3 / x[int(n / 4 + 0.5) - 1] for j in range(1, m + 1)]
    k = [sum(math.log1p(-t * e) for e in x) / n for t in theta]
    profile = [n * (math.log(-t / s) - s - 1) for t, s in zip(theta, k)]
    weight = [math.exp(v - max(profile)) for v in profile]
    best = sum(t * w for t, w in zip(theta, weight)) / sum(weight)
    shape = sum(math.log1p(-best * e) for e in x) / n
    return (n * shape + 5) / (n + 10), -shape / best


def plain_loo(ll):
    """Smoothed leave-one-out value and tail shape of one pattern, number by number."""
    top = max(-v for v in ll)
    pairs = sorted((-v - top, v) for v in ll)
    tail = compare.tail_length(len(ll))
    ratio = [r for r, _ in pairs]
    shape = math.inf if not tail else -math.inf
    if tail and ratio[-1] - ratio[-tail] > 1e-12:
        cut = ratio[-tail - 1]
        excess = [math.exp(r) - math.exp(cut) for r in ratio[-tail:]]
        if excess[0] > 0:
            shape, scale = plain_fit(excess)
            for i in range(tail):
                q = scale * math.expm1(-shape * math.log1p(-(i + 0.5) / tail)) / shape
                ratio[len(ll) - tail + i] = min(math.log(math.exp(cut) + q), 0.0)
    joint = sum(math.exp(r + v) for r, (_, v) in zip(ratio, pairs))
    return math.log(joint / sum(map(math.exp, ratio))), shape


def test_smoothing_known_tail(spark):
    rng = np.random.default_rng(2)
    for k in (0.1, 0.4, 0.8):
        x = np.sort((rng.random((30, 400)) ** -k - 1) / k, axis=1)
        fitted = compare.tail_fit(spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>"), "x", 400, "f").select("f.*").toPandas()
        assert fitted["shape"].mean() == pytest.approx(k, abs=0.08) and fitted["scale"].mean() == pytest.approx(1, abs=0.12)
        assert sorted(fitted["shape"]) == pytest.approx(sorted(plain_fit(v)[0] for v in x), abs=1e-10)


@pytest.mark.parametrize("draws", [3, 40, 400])
def test_smoothed_values_equal_plain_arithmetic(spark, draws):
    """Wide, narrow and constant log-likelihoods; too few draws for a tail; ties at the cut."""
    rng = np.random.default_rng(draws)
    ll = np.vstack([rng.normal(size=(4, draws)) * np.array([[0.05], [0.5], [2], [8]]) - 1, np.full((1, draws), -0.7), rng.integers(3, size=(2, draws)) - 3.0])
    tail = compare.tail_length(draws)
    found = compare.tail_of(ll, tail)
    rows = [(i, (v[0].tolist(), *map(float, v[1:]))) for i, v in enumerate(zip(*found.values()))]
    df = spark.createDataFrame(rows, f"i int, _t_m {compare._TAIL}")
    got = compare.with_loo(df, "m", draws, tail).orderBy("i").toPandas()
    want = [plain_loo(v) for v in ll]
    assert got.elpd_m.tolist() == pytest.approx([w[0] for w in want], abs=1e-9)
    assert got.k_m.tolist() == pytest.approx([w[1] for w in want], abs=1e-7)
    assert got.lpd_m.tolist() == pytest.approx(np.log(np.exp(ll).mean(axis=1)), abs=1e-12)


def test_loo_equals_refitting(spark, simulated):
    """Leaving a respondent out by weights agrees with leaving it out by refitting."""
    small = simulated.limit(120).persist()
    pdf = small.toPandas()
    patterns = pattern_counts(small, "y", ["a", "b"])
    fit = fit_logit(small, "y", ["a", "b"], WEAK)
    points = compare.pointwise(patterns, {"m": draw_matrix(fit, 2000)}).toPandas()
    assert points.n.sum() == 120 and (points.k_m < 0.7).all()
    exact = []
    for i in range(0, 120, 30):
        rest = spark.createDataFrame(pdf.drop(index=i))
        refit = draw_matrix(fit_logit(rest, "y", ["a", "b"], WEAK), 2000)
        eta = refit.values @ np.array([1.0, pdf.a[i], pdf.b[i]])
        p = 1 / (1 + np.exp(-eta))
        exact.append((i, np.log((p if pdf.y[i] else 1 - p).mean())))
    for i, value in exact:
        row = points[np.isclose(points.a, pdf.a[i]) & (points.y == pdf.y[i])].iloc[0]
        assert row.elpd_m == pytest.approx(value, abs=0.02)


def points_frame(spark, seed=0, n=300, k=3):
    rng = np.random.default_rng(seed)
    e = np.log(rng.uniform(0.2, 0.9, (n, k)))
    pdf = pd.DataFrame(e, columns=[f"elpd_m{j}" for j in range(k)])
    pdf["n"] = rng.integers(1, 5, n)
    return spark.createDataFrame(pdf), pdf


def test_compare_equals_repeated_rows(spark):
    df, pdf = points_frame(spark)
    long = pdf.loc[pdf.index.repeat(pdf.n)].reset_index(drop=True)
    out = compare.compare(df, ["m0", "m1", "m2"]).toPandas()
    best = out.model[0]
    for _, r in out.iterrows():
        d = long[f"elpd_{r.model}"] - long[f"elpd_{best}"]
        assert r.elpd_diff == pytest.approx(d.sum(), abs=1e-9)
        assert r.se_diff == pytest.approx(np.sqrt(len(d)) * d.std(), abs=1e-6)
    assert (out.elpd_diff <= 0).all() and out.elpd_diff[0] == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_stacking_is_optimal(spark, k):
    df, pdf = points_frame(spark, seed=k, k=k)
    models = [f"m{j}" for j in range(k)]
    w = compare.stacking_weights(df, models).toPandas().set_index("model").weight[models].to_numpy()
    assert w.sum() == pytest.approx(1) and (w >= 0).all()
    e = np.exp(pdf[[f"elpd_{m}" for m in models]].to_numpy())
    grad = (pdf.n.to_numpy()[:, None] * e / (e @ w)[:, None]).sum(axis=0) / pdf.n.sum()
    assert grad.max() == pytest.approx(1, abs=1e-6)


def test_stacking_prefers_a_dominant_model(spark):
    df, _ = points_frame(spark, k=2)
    better = df.withColumn("elpd_m0", F.greatest("elpd_m0", "elpd_m1") + 0.1)
    w = {r["model"]: r["weight"] for r in compare.stacking_weights(better, ["m0", "m1"]).collect()}
    assert w["m0"] == pytest.approx(1) and w["m1"] == pytest.approx(0)


def test_priors_and_table(spark):
    rows = {tuple(r) for r in prior_summary(spark, WEAK, ["x"], "cowcode").collect()}
    assert rows == {("Intercept", "", "normal(0, 2.5)"), ("b", "x", "normal(0, 2.5)"), ("sd", "cowcode", "exponential(1)")}
    text = {r["coef"]: r["prior"] for r in prior_summary(spark, FLAT, ["x"], "g").collect()}
    assert text["x"] == "(flat)" and text["g"] == "student_t(3, 0, 2.5)"
    tidy = spark.createDataFrame(
        [("m1", "Intercept", 0.123, -0.5, 1.0), ("m2", "x", 2.0, 1.0, 3.0), ("m2", "other", 1.0, 1.0, 1.0)],
        "model string, term string, estimate double, conf_low double, conf_high double",
    )
    out = summaries.model_table(tidy, {"Intercept": "Intercept", "x": "Corruption"}, ["m1", "m2"], {"m1": 10, "m2": 20})
    got = [tuple(r) for r in out.orderBy("position", "statistic").collect()]
    assert got == [
        (1, "Intercept", "estimate", "0.12", None), (1, "Intercept", "interval", "[-0.50, 1.00]", None),
        (2, "Corruption", "estimate", None, "2.00"), (2, "Corruption", "interval", None, "[1.00, 3.00]"),
        (3, "Observations", "n", "10", "20"),
    ]


def test_suite(spark, tmp_path):
    from natal.plans.model_suite import fit_suite

    rng = np.random.default_rng(9)
    g = np.repeat(np.arange(25), 120)
    c, r, i = (rng.normal(size=25) for _ in range(3))
    b = rng.normal(0, 0.7, 25)
    y = rng.random(len(g)) < 1 / (1 + np.exp(-(0.2 - 0.4 * c[g] + b[g])))
    df = spark.createDataFrame(pd.DataFrame({"g": g, "c": c[g], "r": r[g], "i": i[g], "y": y.astype(int)}))
    suite = fit_suite(df, "y", ["c", "r", "i"], "g", WEAK, n_draws=400)
    assert suite.models == ["base", "dem", "full", "dem_country", "full_country"]
    points = suite.pointwise()
    assert points.agg(F.sum("n")).first()[0] == len(g)
    ranking = suite.ranking(points).toPandas().set_index("model")
    assert ranking.elpd_diff.idxmax().endswith("_country") and ranking.weight.sum() == pytest.approx(1)
    assert ranking.loc["base", "elpd_diff"] < -20
    ame = suite.marginal_effects("c").toPandas().set_index("model")
    assert (ame.lower < ame.estimate).all() and len(ame) == 5
    wide = {m: ame.upper[m] - ame.lower[m] for m in ame.index}
    assert wide["dem_country"] > wide["dem"]
    assert suite.curves("c", points=5).count() == 25
    countries = suite.country_effects().toPandas()
    one = countries[countries.model == "dem_country"].sort_values("condition")
    assert len(countries) == 50 and np.corrcoef(one.estimate, b)[0, 1] > 0.8
    store = str(tmp_path / "draws")
    first = suite.coefficient_draws(store).count()
    assert first == suite.coefficient_draws(store).count() == 400 * (2 + 3 + 4 + 3 + 4)
    table = suite.table({"Intercept": "Intercept", "c": "Corruption"}).toPandas()
    assert list(table.columns[-5:]) == suite.models and (table[table.statistic == "n"][suite.models] == str(len(g))).all().all()


def test_patterns_are_spread_by_work(spark):
    from natal.models.patterns import spread_patterns

    df = spark.range(2000).coalesce(1).select(F.col("id").alias("x"), F.lit(1).alias("n"), F.lit(0.0).alias("hits"))
    out = spread_patterns(df, 2000)
    assert out.rdd.getNumPartitions() == 8 and out.count() == 2000
    assert spread_patterns(df, 100) is df
    assert spread_patterns(df, 10_000_000).rdd.getNumPartitions() == 20_000
    with pytest.raises(ValueError, match="taken"):
        pattern_counts(df, "hits", ["n"])


def group_sd_posterior(b, var, x):
    """Log posterior of log SDs for normal group effects known up to a variance."""
    v = np.exp(2 * x)[:, None] + var
    return -0.5 * (np.log(v) + b**2 / v).sum(axis=1) + x


@pytest.mark.parametrize("groups", [8, 20, 150, 400, 2000])
@pytest.mark.parametrize("sd", [0.01, 0.335, 6.0])
def test_grid_encloses_the_group_sd(groups, sd):
    rng = np.random.default_rng(groups)
    b, var = rng.normal(0, np.hypot(sd, 0.1), groups), 0.01
    x = np.linspace(*np.log(mixed.COARSE), mixed.POINTS)
    for _ in range(20):
        lp = group_sd_posterior(b, var, x)
        new = mixed.next_grid(x, lp)
        if new is None:
            break
        x = new
    else:
        pytest.fail("not enclosed")
    assert 0 < lp.argmax() < len(x) - 1
    assert lp[0] < lp.max() - mixed.DEPTH and lp[-1] < lp.max() - mixed.DEPTH
    dense = np.linspace(x[0] - 1, x[-1] + 1, 20_001)
    moments = []
    for g, p in ((x, lp), (dense, group_sd_posterior(b, var, dense))):
        w = np.exp(p - p.max())
        w /= w.sum()
        moments.append((w @ np.exp(g), np.sqrt(w @ np.exp(g) ** 2 - (w @ np.exp(g)) ** 2)))
    assert moments[0] == pytest.approx(moments[1], rel=0.03)


def test_group_sd_of_many_groups(spark):
    """150 groups: the mass is narrow and lies off the first grid's points."""
    df, _, _ = grouped(spark, 5, 150, 60, 0.335)
    fit = mixed.fit_random_intercept(df, "y", ["x"], "g")
    top = fit.weights.max()
    assert fit.weights[0] < 0.01 * top and fit.weights[-1] < 0.01 * top
    assert 0.2 < fit.sd < 0.5
    dense = np.exp(np.linspace(np.log(fit.sds[0]), np.log(fit.sds[-1]), 41))
    fine = mixed.fit_random_intercept(df, "y", ["x"], "g", sds=dense)
    spread = lambda f: np.sqrt(f.weights @ f.sds**2 - f.sd**2)
    assert fit.sd == pytest.approx(fine.sd, rel=0.02)
    assert spread(fit) == pytest.approx(spread(fine), rel=0.05)


def test_unknown_predictors_do_not_count(spark):
    rng = np.random.default_rng(2)
    n = 300
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-x))).astype(int)
    rows = [(float(a), float(b), int(c)) for a, b, c in zip(x, z, y)]
    spoiled = rows + [(None, 1.0, 1)] * 80 + [(2.0, float("nan"), 0)] * 70 + [(1.0, 1.0, None)] * 50
    full, bad = (spark.createDataFrame(r, "x double, z double, y int") for r in (rows, spoiled))
    one, two = fit_logit(full, "y", ["x", "z"]), fit_logit(bad, "y", ["x", "z"])
    assert two.nobs == one.nobs == n and two.mode == pytest.approx(one.mode)
    draws = draw_matrix(one, 50)
    loose = bad.filter("y is not null").groupBy("x", "z").agg(F.count("y").alias("n"), F.sum("y").cast("double").alias("hits"))
    want = {r.draw: r.ame for r in effects.average_marginal_effect(pattern_counts(full, "y", ["x", "z"]), draws, "x").collect()}
    for counts in (pattern_counts(bad, "y", ["x", "z"]), loose):
        assert {r.draw: r.ame for r in effects.average_marginal_effect(counts, draws, "x").collect()} == pytest.approx(want)
        assert fit_logit(None, "y", ["x", "z"], patterns=counts).nobs == n
    curves = [effects.effect_curve(c, draws, "x", points=5).toPandas().estimate.tolist() for c in (pattern_counts(full, "y", ["x", "z"]), loose)]
    assert curves[0] == pytest.approx(curves[1])


def test_sampled_effect_does_not_depend_on_partitions(spark, simulated):
    counts = pattern_counts(simulated, "y", ["b"])
    draws = draw_matrix(fit_logit(simulated, "y", ["b"]), 20)
    runs = [effects.average_marginal_effect(counts.repartition(k), draws, "b", prop=0.3).orderBy("draw").toPandas().ame.tolist() for k in (1, 2, 7)]
    assert runs[0] == pytest.approx(runs[1], rel=1e-12) and runs[0] == pytest.approx(runs[2], rel=1e-12)


def test_stacking_reports_what_did_not_converge(spark):
    with pytest.raises(RuntimeError, match="converge"):
        compare.stacking_weights(points_frame(spark)[0], ["m0", "m1", "m2"], max_steps=1)


def test_store_finds_fits_by_data_and_specification(spark, simulated, tmp_path):
    from natal.models.store import fingerprint, stored

    counts = pattern_counts(simulated, "y", ["b"])
    made = []

    def fit(slope_sd, data=counts):
        def compute():
            made.append(slope_sd)
            return spark.createDataFrame([(slope_sd or 0.0,)], "x double")

        return stored(str(tmp_path), data, {"outcome": "y", "priors": Priors(slope_sd=slope_sd)}, compute).first()[0]

    assert [fit(None), fit(None), fit(2.0), fit(2.0)] == [0.0, 0.0, 2.0, 2.0]
    assert made == [None, 2.0]
    fit(None, counts.filter("b > 0"))
    assert len(made) == 3
    assert fingerprint(counts) == fingerprint(counts.repartition(5).select(*reversed(counts.columns)))


def test_stored_fit_is_found_though_sums_differ_in_the_last_bit(spark, monkeypatch):
    from natal.catalog import models

    rows = [(i % 3, (i * 7 % 11 - 5) / 3, (i * 5 % 13 - 6) / 4, 40, float(12 + i % 9)) for i in range(30)]
    exact = spark.createDataFrame(rows, "cowcode int, corrupt_z double, polity2_z double, n bigint, hits double")
    noise = F.udf(lambda x: x + random.random() * 1e-12, "double").asNondeterministic()
    monkeypatch.setattr(models, "counted", lambda *_: exact.withColumn("corrupt_z", noise("corrupt_z")))
    got = models.stored_fit(spark, "").orderBy("term").collect()
    monkeypatch.setattr(models, "counted", lambda *_: exact)
    want = models.logit_fixed_prior(spark, "").orderBy("term").collect()
    assert [r.term for r in got] == ["Intercept", *models.X[:2]] == [r.term for r in want]
    assert [x for r in got for x in r[1:]] == pytest.approx([x for r in want for x in r[1:]], abs=2e-5)


def panel_of(spark, groups=12, rows=900, seed=8):
    """Respondents of some groups, of which the first holds more than a third; x is their own."""
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(rows) < 0.35, 0, rng.integers(groups, size=rows))
    x = rng.normal(size=rows).round(2)
    y = (rng.random(rows) < 1 / (1 + np.exp(-(0.3 + 0.8 * x + rng.normal(size=groups)[g])))).astype(float)
    return spark.createDataFrame(pd.DataFrame({"g": g.astype("int32"), "x": x, "y": y}))


@pytest.mark.parametrize("fewest, direct", [(20, 512), (20, 1), (10**6, 512)])
def test_spread_groups_give_the_same_fit(spark, monkeypatch, fewest, direct):
    """Groups over several tasks, or all in one task, or sums added up by Spark: one and the same fit."""
    df = panel_of(spark)
    want = mixed.fit_random_intercept(df, "y", ["x"], "g", WEAK, sds=[0.5, 1.0, 2.0], tol=1e-12)
    monkeypatch.setattr(mixed, "FEWEST", fewest)
    monkeypatch.setattr(mixed, "DIRECT", direct)
    data, tasks, n, heavy = mixed.dealt(df.select(F.col("g").alias(mixed.GROUP), F.col("x").alias("x1"), F.lit(1.0).alias("n"), F.col("y").alias("hits")), ["x1"])
    assert (0 in heavy) == (fewest == 20) and n == 12 and data.rdd.getNumPartitions() == tasks
    sizes = [r[0] for r in data.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert fewest > 20 or max(sizes) < 0.35 * 900
    got = mixed.fit_random_intercept(df, "y", ["x"], "g", WEAK, sds=[0.5, 1.0, 2.0], tol=1e-12)
    for a, b in ((got.modes, want.modes), (got.covs, want.covs), (got.weights, want.weights)):
        assert np.allclose(a, b, atol=1e-6)
    for a, b in zip(got.groups.orderBy("g").collect(), want.groups.orderBy("g").collect()):
        assert a["g"] == b["g"] and np.allclose(a[mixed.MODES], b[mixed.MODES], atol=1e-5) and np.allclose(a[mixed.CROSS], b[mixed.CROSS], rtol=1e-4)


def test_mode_of_a_mixed_fit_is_the_joint_mode(spark):
    """Gradient of the joint log posterior is zero at coefficients and effects, by plain arithmetic."""
    df = panel_of(spark, seed=9)
    fit = mixed.fit_random_intercept(df, "y", ["x"], "g", sds=[0.7], tol=1e-14)
    b = {r["g"]: r[mixed.MODES][0] for r in fit.groups.collect()}
    d = df.toPandas()
    p = 1 / (1 + np.exp(-(fit.modes[0][0] + fit.modes[0][1] * d.x + d.g.map(b))))
    residual = d.y - p
    assert abs(residual.sum()) < 1e-6 and abs((residual * d.x).sum()) < 1e-6
    for g, value in b.items():
        assert abs(residual[d.g == g].sum() - value / 0.7**2) < 1e-6


def test_a_fit_takes_few_jobs(spark):
    data = pattern_counts(panel_of(spark), "y", ["x"], "g").persist()
    data.count()
    sc = spark.sparkContext
    sc.setJobGroup("mixed-fit", "a fit on the default grid")
    fit = mixed.fit_random_intercept(data, "y", ["x"], "g", WEAK, patterns=data)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(fit.sds) >= mixed.POINTS and len(sc.statusTracker().getJobIdsForGroup("mixed-fit")) < 20
    assert "Generate" not in fit.groups._jdf.queryExecution().toString()


def test_kept_counts_are_binomial_quantiles():
    rng = np.random.default_rng(4)
    n = np.r_[0, 1, 2, rng.integers(1, 400, 40), 100_000].astype(float)
    u = np.r_[0.5, 0.2, 0.999999, rng.random(40), 0.7]
    for prop in (0.01, 0.3, 0.97):
        got = effects.kept(u, n, prop)
        for value, m, at in zip(got, n.astype(int), u):
            total = 0.0
            for k in range(m + 1):
                log = math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(prop) + (m - k) * math.log1p(-prop)
                total += math.exp(log)
                if total >= at * (1 - 1e-12):
                    break
            assert value == k
    many = effects.kept((np.arange(20_000) + 0.5) / 20_000, np.full(20_000, 50.0), 0.3)
    assert many.mean() == pytest.approx(15, abs=0.01) and many.var() == pytest.approx(10.5, abs=0.05)
