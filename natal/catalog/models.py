"""Model queries on the exposure table.

Where the checking SQL needs exact agreement, draws are literal or derived from the data;
fits with a closed or iterable form are checked against SQL as well.
"""

import numpy as np
from pyspark.sql import functions as F

from natal.catalog.base import EXPOSURE_SQL, rounded
from natal.catalog.exposures import exposed
from natal.catalog.registry import query
from natal.models import compare, effects, mixed, summaries
from natal.models.draws import DrawMatrix, draw_matrix, draws_table, matrix_from_table
from natal.models.logit import fit_logit
from natal.models.patterns import pattern_counts
from natal.models.priors import WEAK
from natal.models.store import stored
from natal.operators.frame import standardize
from natal.session import cut_lineage, scratch_path
from natal.sources.tables import load_or_compute, write_stage

RAW = ["fuzzy_corrupt", "fuzzy_polity2", "fuzzy_ln_gdpcap"]
X = ["corrupt_z", "polity2_z", "gdpcap_z"]
LABELS = {"Intercept": "Intercept", "corrupt_z": "Corruption", "polity2_z": "Regime Type", "gdpcap_z": "Per Capita GDP"}


def voters(spark, sf_dir):
    """Exposed respondents with a known vote."""
    return exposed(spark, sf_dir).filter("voted < 3").withColumn("voted_re", F.col("voted") - 1)


def counted(spark, sf_dir):
    """Patterns over all predictors and countries, z-scored over respondents."""
    raw = pattern_counts(voters(spark, sf_dir), "voted_re", RAW, "cowcode")
    scored = standardize(raw, RAW, weight="n")
    return scored.withColumnsRenamed(dict(zip([f"{c}_z" for c in RAW], X))).drop(*RAW)


# The SQL averages every respondent's window anew, so equal predictors may differ in the last
# bit there; nine places bring them together again.
VOTERS_SQL = f"""{EXPOSURE_SQL},
vote AS (SELECT *, voted - 1 AS y FROM expo WHERE voted < 3),
stats AS (SELECT avg(fuzzy_corrupt) AS m1, stddev_samp(fuzzy_corrupt) AS s1, avg(fuzzy_polity2) AS m2,
                 stddev_samp(fuzzy_polity2) AS s2, avg(fuzzy_ln_gdpcap) AS m3, stddev_samp(fuzzy_ln_gdpcap) AS s3 FROM vote),
est AS (SELECT cpsidp, cowcode, y, (fuzzy_corrupt - m1) / s1 AS x1, (fuzzy_polity2 - m2) / s2 AS x2,
               (fuzzy_ln_gdpcap - m3) / s3 AS x3 FROM vote, stats),
pat AS (SELECT cowcode, x1, x2, x3, count(*) AS n, sum(y) AS h
        FROM (SELECT cowcode, y, round(x1, 9) AS x1, round(x2, 9) AS x2, round(x3, 9) AS x3 FROM est) GROUP BY ALL)"""


@query(
    "pattern_counts",
    f"""WITH {VOTERS_SQL}
    SELECT cowcode, round(x1, 6) AS corrupt_z, round(x2, 6) AS polity2_z, CAST(n AS BIGINT) AS n, CAST(h AS DOUBLE) AS hits FROM pat""",
)
def counted_patterns(spark, sf_dir):
    return rounded(counted(spark, sf_dir).drop("gdpcap_z"), ["corrupt_z", "polity2_z"])


def terms_frame(spark, sf_dir, fit):
    """Estimates and standard errors of a fit as rows."""
    return rounded(fit_frame(spark, fit), ["estimate", "se"], 5)


def fit_frame(spark, fit):
    from natal.operators.joins import literal_table

    return literal_table(
        spark,
        {"term": fit.terms, "estimate": fit.mode.tolist(), "se": np.sqrt(np.diag(fit.cov)).tolist()},
        "term string, estimate double, se double",
    )


@query(
    "logit_intercept",
    f"""WITH {VOTERS_SQL}
    SELECT 'Intercept' AS term, round(ln(avg(y) / (1 - avg(y))), 5) AS estimate,
           round(1 / sqrt(count(*) * avg(y) * (1 - avg(y))), 5) AS se FROM vote""",
)
def logit_intercept(spark, sf_dir):
    return terms_frame(spark, sf_dir, fit_logit(voters(spark, sf_dir), "voted_re", []))


@query(
    "logit_binary",
    f"""WITH {VOTERS_SQL},
    c AS (SELECT sum(y) FILTER (WHERE x1 > 0) AS a, sum(1 - y) FILTER (WHERE x1 > 0) AS b,
                 sum(y) FILTER (WHERE x1 <= 0) AS c, sum(1 - y) FILTER (WHERE x1 <= 0) AS d FROM est)
    SELECT 'Intercept' AS term, round(ln(c / d), 5) AS estimate, round(sqrt(1 / c + 1 / d), 5) AS se FROM c
    UNION ALL SELECT 'high', round(ln(a * d / (b * c)), 5), round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 5) FROM c""",
)
def logit_binary(spark, sf_dir):
    data = counted(spark, sf_dir).withColumn("high", (F.col("corrupt_z") > 0).cast("double"))
    return terms_frame(spark, sf_dir, fit_logit(data, "voted_re", ["high"], patterns=data))


def logit_sql(slope_precision=0.0, intercept_precision=0.0):
    """Newton steps as a recursive query for an intercept and two predictors."""
    return f"""{newton_sql(slope_precision, intercept_precision)}
    SELECT term, round(estimate, 5) AS estimate, round(sqrt(v), 5) AS se FROM (
      SELECT unnest(['Intercept', 'corrupt_z', 'polity2_z']) AS term, unnest([b0, b1, b2]) AS estimate,
             unnest([v0, v1, v2]) AS v FROM it WHERE i = 8)"""


def newton_sql(slope_precision=0.0, intercept_precision=0.0):
    """The recursive part: mode and covariance at step 8."""
    a, b = intercept_precision, slope_precision
    return f"""WITH RECURSIVE {VOTERS_SQL},
    it(i, b0, b1, b2, v0, v1, v2, v01, v02, v12) AS (
      SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
      UNION ALL
      SELECT i + 1, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det,
             b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det, c00 / det, c11 / det, c22 / det, c01 / det, c02 / det, c12 / det
      FROM (SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02,
                   h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22,
                   h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h02 * h12) + h02 * (h01 * h12 - h02 * h11) AS det
            FROM (SELECT i, b0, b1, b2, sum(r) - {a} * b0 AS g0, sum(r * x1) - {b} * b1 AS g1, sum(r * x2) - {b} * b2 AS g2,
                         sum(w) + {a} AS h00, sum(w * x1) AS h01, sum(w * x2) AS h02, sum(w * x1 * x1) + {b} AS h11,
                         sum(w * x1 * x2) AS h12, sum(w * x2 * x2) + {b} AS h22
                  FROM (SELECT *, h - n * p AS r, n * p * (1 - p) AS w
                        FROM (SELECT it.*, pat.*, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM it, pat WHERE i < 8))
                  GROUP BY i, b0, b1, b2)))"""


def normal_sql(draw, term, seed=42, stream=0):
    """A standard normal of the stream, as :func:`natal.models.draws.normals` makes it."""
    text = f"md5('{seed}:{stream}:' || {draw} || ':{term}')"
    u = f"(CAST('0x' || substr({text}, 1, 13) AS BIGINT) + 0.5) / pow(2, 52)"
    v = f"CAST('0x' || substr({text}, 14, 13) AS BIGINT) / pow(2, 52)"
    return f"sqrt(-2 * ln({u})) * cos(2 * pi() * {v})"


@query("logit_fixed", logit_sql())
def logit_fixed(spark, sf_dir):
    data = counted(spark, sf_dir)
    return terms_frame(spark, sf_dir, fit_logit(data, "voted_re", X[:2], patterns=data))


@query("logit_fixed_prior", logit_sql(1 / 2.5**2, 1 / 2.5**2))
def logit_fixed_prior(spark, sf_dir):
    data = counted(spark, sf_dir)
    return terms_frame(spark, sf_dir, fit_logit(data, "voted_re", X[:2], WEAK, patterns=data))


@query("stored_fit", logit_sql(1 / 2.5**2, 1 / 2.5**2))
def stored_fit(spark, sf_dir):
    """A fit found again by its data and specification; the second call does not fit."""
    store = scratch_path(spark, "fits")
    # Written once: means added up anew, in another order, may differ in the last bit and would be other data.
    data = write_stage(counted(spark, sf_dir), scratch_path(spark, "patterns"))
    made_from = {"outcome": "voted_re", "predictors": X[:2], "priors": WEAK}
    stored(store, data, made_from, lambda: terms_frame(spark, sf_dir, fit_logit(data, "voted_re", X[:2], WEAK, patterns=data)))
    return stored(store, data, made_from, lambda: (_ for _ in ()).throw(RuntimeError("fitted again")))


def full_logit_sql(precision):
    """Newton steps for an intercept and three predictors; the step solves by elimination."""
    k = 4
    x = ["1", "x1", "x2", "x3"]
    b = [f"b{i}" for i in range(k)]
    sums = [f"sum(r * {x[i]}) - {precision} * b{i} AS g{i}" for i in range(k)]
    sums += [f"sum(w * {x[i]} * {x[j]}) + {precision if i == j else 0} AS h{i}_{j}" for i in range(k) for j in range(k)]
    step = f"""SELECT i, {", ".join(b)}, {", ".join(sums)}
      FROM (SELECT *, h - n * p AS r, n * p * (1 - p) AS w FROM (
        SELECT it.*, pat.*, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2 + b3 * x3))) AS p FROM it, pat WHERE i < 8))
      GROUP BY i, {", ".join(b)}"""
    for p in range(k - 1):
        done = [f"g{i}" for i in range(p + 1)] + [f"h{i}_{j}" for i in range(p + 1) for j in range(i, k)]
        rest = [f"g{i} - h{i}_{p} / h{p}_{p} * g{p} AS g{i}" for i in range(p + 1, k)]
        rest += [f"h{i}_{j} - h{i}_{p} / h{p}_{p} * h{p}_{j} AS h{i}_{j}" for i in range(p + 1, k) for j in range(p + 1, k)]
        step = f"SELECT i, {', '.join(b + done + rest)} FROM ({step})"
    for p in reversed(range(k)):
        known = "".join(f" - h{p}_{j} * d{j}" for j in range(p + 1, k))
        step = f"SELECT *, (g{p}{known}) / h{p}_{p} AS d{p} FROM ({step})"
    return f"""WITH RECURSIVE {VOTERS_SQL},
    it(i, {", ".join(b)}) AS (
      SELECT 0, {", ".join(["0.0::DOUBLE"] * k)}
      UNION ALL SELECT i + 1, {", ".join(f"b{i} + d{i}" for i in range(k))} FROM ({step}))
    SELECT unnest(['Intercept', 'corrupt_z', 'polity2_z', 'gdpcap_z']) AS term,
           unnest([round(b0, 5), round(b1, 5), round(b2, 5), round(b3, 5)]) AS estimate FROM it WHERE i = 8"""


@query("logit_full", full_logit_sql(1 / 2.5**2))
def logit_full(spark, sf_dir):
    data = counted(spark, sf_dir)
    return terms_frame(spark, sf_dir, fit_logit(data, "voted_re", X, WEAK, patterns=data)).drop("se")


SD = 0.5
GROUP_MODES_SQL = f"""WITH RECURSIVE {VOTERS_SQL},
    it(i, cowcode, b, b0, b1) AS (
      SELECT 0, cowcode, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT cowcode FROM pat)
      UNION ALL
      SELECT i + 1, cowcode, b + (r - h0 * d0 - h01 * d1) / d, b0 + d0, b1 + d1
      FROM (SELECT *, (s11 * t0 - s01 * t1) / (s00 * s11 - s01 * s01) AS d0,
                   (s00 * t1 - s01 * t0) / (s00 * s11 - s01 * s01) AS d1
            FROM (SELECT *, sum(h0 - h0 * h0 / d) OVER () AS s00, sum(h01 - h0 * h01 / d) OVER () AS s01,
                         sum(h11 - h01 * h01 / d) OVER () AS s11, sum(g0 - h0 * r / d) OVER () AS t0,
                         sum(g1 - h01 * r / d) OVER () AS t1
                  FROM (SELECT *, g0 - b / {SD**2} AS r, h0 + 1 / {SD**2} AS d
                        FROM (SELECT i, cowcode, b, b0, b1, sum(e) AS g0, sum(e * x1) AS g1, sum(w) AS h0,
                                     sum(w * x1) AS h01, sum(w * x1 * x1) AS h11
                              FROM (SELECT *, h - n * p AS e, n * p * (1 - p) AS w
                                    FROM (SELECT it.*, x1, n, h, 1 / (1 + exp(-(b + b0 + b1 * x1))) AS p
                                          FROM it JOIN pat USING (cowcode) WHERE i < 8))
                              GROUP BY i, cowcode, b, b0, b1)))))
    SELECT cowcode, round(b, 4) AS effect, round(b0, 4) AS intercept, round(b1, 4) AS slope FROM it WHERE i = 8"""


@query("logit_group_modes", GROUP_MODES_SQL)
def logit_group_modes(spark, sf_dir):
    """Joint mode of slope and country effects at a given group SD."""
    data = counted(spark, sf_dir)
    fit = mixed.fit_random_intercept(data, "voted_re", X[:1], "cowcode", sds=[SD], patterns=data, tol=1e-14)
    out = fit.groups.select(
        "cowcode",
        F.get(mixed.MODES, F.lit(0)).alias("effect"),
        F.lit(float(fit.modes[0, 0])).alias("intercept"),
        F.lit(float(fit.modes[0, 1])).alias("slope"),
    )
    return rounded(out, ["effect", "intercept", "slope"], 4)


# Group SDs spread evenly over their logs, as the grid of a fit.
SDS = (0.1, 0.2, 0.4, 0.8)
SD_PRIOR = 1.0  # rate of the exponential prior
SD_SQL = f"""WITH RECURSIVE {VOTERS_SQL},
    grid AS (SELECT CAST(unnest({list(SDS)}) AS DOUBLE) AS sd),
    it(i, sd, cowcode, b, b0, b1) AS (
      SELECT 0, sd, cowcode, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM grid, (SELECT DISTINCT cowcode FROM pat)
      UNION ALL
      SELECT i + 1, sd, cowcode, b + (r - h0 * d0 - h01 * d1) / d, b0 + d0, b1 + d1
      FROM (SELECT *, (s11 * t0 - s01 * t1) / (s00 * s11 - s01 * s01) AS d0,
                   (s00 * t1 - s01 * t0) / (s00 * s11 - s01 * s01) AS d1
            FROM (SELECT *, sum(h0 - h0 * h0 / d) OVER w + 1 / 6.25 AS s00, sum(h01 - h0 * h01 / d) OVER w AS s01,
                         sum(h11 - h01 * h01 / d) OVER w + 1 / 6.25 AS s11, sum(g0 - h0 * r / d) OVER w - b0 / 6.25 AS t0,
                         sum(g1 - h01 * r / d) OVER w - b1 / 6.25 AS t1
                  FROM (SELECT *, g0 - b / (sd * sd) AS r, h0 + 1 / (sd * sd) AS d
                        FROM (SELECT i, sd, cowcode, b, b0, b1, sum(e) AS g0, sum(e * x1) AS g1, sum(w) AS h0,
                                     sum(w * x1) AS h01, sum(w * x1 * x1) AS h11
                              FROM (SELECT *, h - n * p AS e, n * p * (1 - p) AS w
                                    FROM (SELECT it.*, x1, n, h, 1 / (1 + exp(-(b + b0 + b1 * x1))) AS p
                                          FROM it JOIN pat USING (cowcode) WHERE i < 10))
                              GROUP BY i, sd, cowcode, b, b0, b1))
                  WINDOW w AS (PARTITION BY sd)))),
    last AS (
      SELECT sd, cowcode, b, b0, b1, sum(h * eta - n * ln(1 + exp(eta))) AS ll, sum(w) + 1 / (sd * sd) AS d, sum(w) AS h0,
             sum(w * x1) AS h01, sum(w * x1 * x1) AS h11
      FROM (SELECT *, n * p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-eta)) AS p FROM (
        SELECT it.*, x1, n, h, b + b0 + b1 * x1 AS eta FROM it JOIN pat USING (cowcode) WHERE i = 10)))
      GROUP BY sd, cowcode, b, b0, b1),
    post AS (
      SELECT sd, any_value(b0) AS b0, any_value(b1) AS b1,
             sum(ll) - 0.5 * sum(b * b) / (sd * sd) - count(*) * ln(sd) - 0.5 * sum(ln(d))
             - 0.5 * ln((sum(h0 - h0 * h0 / d) + 1 / 6.25) * (sum(h11 - h01 * h01 / d) + 1 / 6.25) - sum(h01 - h0 * h01 / d) ** 2)
             - 0.5 * (any_value(b0) ** 2 + any_value(b1) ** 2) / 6.25 - {SD_PRIOR} * sd + ln(sd) AS lp
      FROM last GROUP BY sd)
    SELECT sd AS group_sd, round(exp(lp - top) / sum(exp(lp - top)) OVER (), 5) AS weight, round(b0, 4) AS intercept, round(b1, 4) AS slope
    FROM (SELECT *, max(lp) OVER () AS top FROM post)"""


@query("group_sd_posterior", SD_SQL)
def group_sd_posterior(spark, sf_dir):
    """Laplace weights of given group SDs under the exponential prior, with the modes at each."""
    from natal.operators.joins import literal_table

    data = counted(spark, sf_dir)
    fit = mixed.fit_random_intercept(data, "voted_re", X[:1], "cowcode", WEAK, sds=SDS, patterns=data, tol=1e-14)
    columns = {"group_sd": list(SDS), "weight": fit.weights.tolist(), "intercept": fit.modes[:, 0].tolist(), "slope": fit.modes[:, 1].tolist()}
    out = literal_table(spark, columns, "group_sd double, weight double, intercept double, slope double")
    return rounded(rounded(out, ["weight"], 5), ["intercept", "slope"], 4)


@query("logit_random_intercept")
def logit_random_intercept(spark, sf_dir):
    """Two predictors and a country effect, group SD integrated out."""
    data = counted(spark, sf_dir)
    fit = mixed.fit_random_intercept(data, "voted_re", X[:2], "cowcode", WEAK, patterns=data)
    draws = mixed.mixed_draws(fit)
    fixed = draws_table(spark, draws, "dem_country")
    coefficients = summaries.tidy(fixed).drop("model")
    effects_ = summaries.random_effects(mixed.group_draws(fit, draws), width=0.9)
    effects_ = effects_.select(
        F.concat(F.lit("r_cowcode_"), F.col("condition")).alias("term"), "estimate", F.col("lower").alias("conf_low"),
        F.col("upper").alias("conf_high"),
    )
    sd = mixed.sd_draws(fit, draws)
    return coefficients.unionByName(effects_).withColumn("group_sd", F.lit(float(np.median(sd))))


@query(
    "posterior_draws",
    f"""{newton_sql()},
    low AS (SELECT *, sqrt(v0) AS l00, v01 / sqrt(v0) AS l10, v02 / sqrt(v0) AS l20, sqrt(v1 - v01 * v01 / v0) AS l11 FROM it WHERE i = 8),
    factor AS (SELECT *, (v12 - l20 * l10) / l11 AS l21 FROM low),
    z AS (SELECT d AS draw, {normal_sql("d", 0)} AS z0, {normal_sql("d", 1)} AS z1, {normal_sql("d", 2)} AS z2
          FROM (SELECT unnest(range(4000)) AS d))
    SELECT 'dem' AS model, CAST(draw AS BIGINT) AS draw, unnest(['Intercept', 'corrupt_z', 'polity2_z']) AS term,
           unnest([round(b0 + l00 * z0, 5), round(b1 + l10 * z0 + l11 * z1, 5),
                   round(b2 + l20 * z0 + l21 * z1 + sqrt(v2 - l20 * l20 - l21 * l21) * z2, 5)]) AS value
    FROM factor, z""",
)
def posterior_draws(spark, sf_dir):
    """Draws of a fit, stored once under its name and read back."""
    path = scratch_path(spark, "fit_dem")

    def compute():
        data = counted(spark, sf_dir)
        return draws_table(spark, draw_matrix(fit_logit(data, "voted_re", X[:2], patterns=data)), "dem")

    stored = load_or_compute(spark, path, compute)
    again = matrix_from_table(stored, ["Intercept", *X[:2]])
    return rounded(draws_table(spark, again, "dem"), ["value"], 5)


# Draws derived from the data: log odds of the two halves of the predictor in each of 20 folds.
FOLDS = 20
FOLD_SQL = f"""{VOTERS_SQL},
fold AS (
  SELECT model, cpsidp % {FOLDS} AS draw,
         count_if(x1 <= 0 AND y = 1) + 0.5 AS c, count_if(x1 <= 0 AND y = 0) + 0.5 AS d,
         count_if(x1 > 0 AND y = 1) + 0.5 AS a, count_if(x1 > 0 AND y = 0) + 0.5 AS b
  FROM (SELECT 'base' AS model, * FROM est UNION ALL SELECT 'dem', * REPLACE (x2 AS x1) FROM est) GROUP BY ALL),
draws AS (SELECT model, draw, 'Intercept' AS term, ln(c / d) AS value FROM fold
          UNION ALL SELECT model, draw, 'corrupt_z', ln(a * d / (b * c)) FROM fold),
tidy AS (SELECT model, term, quantile_cont(value, 0.5) AS estimate, quantile_cont(value, 0.05) AS conf_low,
                quantile_cont(value, 0.95) AS conf_high FROM draws GROUP BY ALL)"""


def fold_draws(spark, sf_dir):
    v = voters(spark, sf_dir).select("cpsidp", "voted_re", *RAW[:2])
    z = standardize(v, RAW[:2])
    y, high = F.col("voted_re"), F.col("m.z") > 0
    # The base model splits by corruption, the other one by regime.
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{c}_z").alias("z")) for m, c in zip(("base", "dem"), RAW)])

    def cell(side, outcome):
        return F.coalesce(F.sum(F.when(side, outcome)), F.lit(0)) + 0.5

    fold = (
        z.withColumn("m", F.explode(models))
        .groupBy(F.col("m.model").alias("model"), (F.col("cpsidp") % FOLDS).alias("draw"))
        .agg(cell(~high, y).alias("c"), cell(~high, 1 - y).alias("d"), cell(high, y).alias("a"), cell(high, 1 - y).alias("b"))
    )
    wide = fold.select(
        "model", "draw", F.log(F.col("c") / F.col("d")).alias("Intercept"),
        F.log(F.col("a") * F.col("d") / (F.col("b") * F.col("c"))).alias("corrupt_z"),
    )
    return wide.unpivot(["model", "draw"], ["Intercept", "corrupt_z"], "term", "value")


@query(
    "coef_table",
    f"""WITH {FOLD_SQL} SELECT model, term, round(estimate, 6) AS estimate, round(conf_low, 6) AS conf_low,
        round(conf_high, 6) AS conf_high FROM tidy""",
)
def coef_table(spark, sf_dir):
    return rounded(summaries.tidy(fold_draws(spark, sf_dir)), ["estimate", "conf_low", "conf_high"])


@query(
    "coef_summary",
    f"""WITH {FOLD_SQL}
    SELECT model, term, round(avg(value), 6) AS estimate, round(stddev_samp(value), 6) AS est_error,
           round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.975), 6) AS upper FROM draws GROUP BY ALL""",
)
def coef_summary(spark, sf_dir):
    return rounded(summaries.posterior_summary(fold_draws(spark, sf_dir)), ["estimate", "est_error", "lower", "upper"])


@query(
    "model_table",
    f"""WITH {FOLD_SQL},
    cells AS (
      SELECT model, CASE term WHEN 'Intercept' THEN 1 ELSE 2 END AS position,
             CASE term WHEN 'Intercept' THEN 'Intercept' ELSE 'Corruption' END AS label,
             unnest(['estimate', 'interval']) AS statistic,
             unnest([printf('%.2f', estimate), printf('[%.2f, %.2f]', conf_low, conf_high)]) AS cell FROM tidy
      UNION ALL SELECT 'base', 5, 'Observations', 'n', CAST(count(*) AS VARCHAR) FROM vote
      UNION ALL SELECT 'dem', 5, 'Observations', 'n', CAST(count(*) AS VARCHAR) FROM vote)
    SELECT CAST(position AS INTEGER) AS position, label, statistic, max(cell) FILTER (WHERE model = 'base') AS base,
           max(cell) FILTER (WHERE model = 'dem') AS dem FROM cells GROUP BY ALL""",
)
def model_table(spark, sf_dir):
    n = voters(spark, sf_dir).count()
    return summaries.model_table(summaries.tidy(fold_draws(spark, sf_dir)), LABELS, ["base", "dem"], {"base": n, "dem": n})


@query("model_table_fitted")
def model_table_fitted(spark, sf_dir):
    """Comparison table of three nested fits on one set of patterns."""
    data = cut_lineage(counted(spark, sf_dir))  # one set of patterns for three fits
    specs = {"base": X[:1], "dem": X[:2], "full": X}
    fits = {m: fit_logit(data, "voted_re", xs, WEAK, patterns=data) for m, xs in specs.items()}
    tables = [draws_table(spark, draw_matrix(f), m) for m, f in fits.items()]
    draws = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return summaries.model_table(summaries.tidy(draws), LABELS, list(specs), {m: f.nobs for m, f in fits.items()})


# Literal coefficient draws, so that SQL can use the same ones.
N_DRAWS = 40


def literal_draws(predictors, slopes, intercept=0.1):
    d = np.arange(N_DRAWS)
    columns = [intercept + 0.01 * d] + [s + 0.004 * (i + 1) * d for i, s in enumerate(slopes)]
    return DrawMatrix(("Intercept", *predictors), np.column_stack(columns))


def literal_eta(slopes, intercept=0.1):
    return f"({intercept} + 0.01 * d) + " + " + ".join(
        f"({s} + {0.004 * (i + 1)} * d) * x{i + 1}" for i, s in enumerate(slopes)
    )


SLOPES = (-0.3, 0.2)
DRAWS_SQL = f"draws AS (SELECT unnest(range({N_DRAWS})) AS d)"


@query(
    "ame",
    f"""WITH {VOTERS_SQL}, {DRAWS_SQL}
    SELECT d AS draw, round(sum((-0.3 + 0.004 * d) * p * (1 - p) * n) / sum(n), 6) AS ame
    FROM (SELECT d, n, 1 / (1 + exp(-({literal_eta(SLOPES)}))) AS p FROM pat, draws) GROUP BY d""",
)
def ame(spark, sf_dir):
    draws = literal_draws(X[:2], SLOPES)
    return rounded(effects.average_marginal_effect(counted(spark, sf_dir), draws, "corrupt_z"), ["ame"])


@query(
    "ame_interval",
    f"""WITH {VOTERS_SQL}, {DRAWS_SQL}, ame AS (
      SELECT d, sum((-0.3 + 0.004 * d) * p * (1 - p) * n) / sum(n) AS v
      FROM (SELECT d, n, 1 / (1 + exp(-({literal_eta(SLOPES)}))) AS p FROM pat, draws) GROUP BY d)
    SELECT round(quantile_cont(v, 0.5), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS lower,
           round(quantile_cont(v, 0.975), 6) AS upper FROM ame""",
)
def ame_interval(spark, sf_dir):
    from natal.operators.frame import interval

    draws = literal_draws(X[:2], SLOPES)
    per_draw = effects.average_marginal_effect(counted(spark, sf_dir), draws, "corrupt_z")
    return rounded(interval(per_draw, [], "ame"), ["estimate", "lower", "upper"])


@query(
    "effect_curve",
    f"""WITH {VOTERS_SQL}, {DRAWS_SQL},
    r AS (SELECT min(x1) AS lo, max(x1) AS hi, sum(x2 * n) / sum(n) AS x2 FROM pat),
    grid AS (SELECT unnest(range(25)) AS i, lo, hi, x2 FROM r),
    g AS (SELECT CAST(i AS INTEGER) AS point, lo + i * ((hi - lo) / 24) AS x1, x2 FROM grid),
    p AS (SELECT point, x1, 1 / (1 + exp(-({literal_eta(SLOPES)}))) AS p FROM g, draws)
    SELECT point, round(x1, 6) AS corrupt_z, round(quantile_cont(p, 0.5), 6) AS estimate,
           round(quantile_cont(p, 0.05), 6) AS lower, round(quantile_cont(p, 0.95), 6) AS upper FROM p GROUP BY point, x1""",
)
def effect_curve(spark, sf_dir):
    out = effects.effect_curve(counted(spark, sf_dir), literal_draws(X[:2], SLOPES), "corrupt_z", 0.9, 25)
    return rounded(out, ["corrupt_z", "estimate", "lower", "upper"])


@query(
    "effect_curves",
    f"""WITH {VOTERS_SQL}, {DRAWS_SQL},
    r AS (SELECT min(x1) AS lo1, max(x1) AS hi1, min(x2) AS lo2, max(x2) AS hi2, sum(x1 * n) / sum(n) AS a1,
                 sum(x2 * n) / sum(n) AS a2 FROM pat),
    grid AS (SELECT unnest(range(10)) AS i, * FROM r),
    g AS (SELECT 'corrupt_z' AS effect, i, lo1 + i * ((hi1 - lo1) / 9) AS v, lo1 + i * ((hi1 - lo1) / 9) AS x1, a2 AS x2 FROM grid
          UNION ALL SELECT 'polity2_z', i, lo2 + i * ((hi2 - lo2) / 9), a1, lo2 + i * ((hi2 - lo2) / 9) FROM grid),
    p AS (SELECT effect, i, v, 1 / (1 + exp(-({literal_eta(SLOPES)}))) AS p FROM g, draws)
    SELECT effect, CAST(i AS INTEGER) AS point, round(v, 6) AS value, round(quantile_cont(p, 0.5), 6) AS estimate,
           round(quantile_cont(p, 0.025), 6) AS lower, round(quantile_cont(p, 0.975), 6) AS upper FROM p GROUP BY effect, i, v""",
)
def effect_curves(spark, sf_dir):
    out = effects.effect_curves(counted(spark, sf_dir), literal_draws(X[:2], SLOPES), points=10)
    return rounded(out, ["value", "estimate", "lower", "upper"])


SAMPLED = 0.1


@query(
    "ame_sampled",
    f"""WITH {VOTERS_SQL}, {DRAWS_SQL},
    kept AS (SELECT * FROM est WHERE CAST('0x' || substr(md5('42:' || cpsidp), 1, 13) AS BIGINT) / pow(2, 52) < {SAMPLED}),
    ame AS (SELECT d, avg((-0.3 + 0.004 * d) * p * (1 - p)) AS v
            FROM (SELECT d, 1 / (1 + exp(-({literal_eta(SLOPES)}))) AS p FROM kept, draws) GROUP BY d)
    SELECT round(quantile_cont(v, 0.5), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS lower,
           round(quantile_cont(v, 0.975), 6) AS upper FROM ame""",
)
def ame_sampled(spark, sf_dir):
    """Marginal effect over a tenth of the respondents, the sampling being what is asked for."""
    from natal.operators.frame import interval

    scored = standardize(voters(spark, sf_dir).select("cpsidp", "voted_re", *RAW), RAW)
    scored = scored.withColumnsRenamed(dict(zip([f"{c}_z" for c in RAW], X)))
    counts = pattern_counts(effects.thin(scored, "cpsidp", SAMPLED), "voted_re", X[:2])
    per_draw = effects.average_marginal_effect(counts, literal_draws(X[:2], SLOPES), "corrupt_z")
    return rounded(interval(per_draw, [], "ame"), ["estimate", "lower", "upper"])


THINNED = 0.3


@query(
    "ame_thinned",
    f"""WITH {VOTERS_SQL}, {DRAWS_SQL},
    folded AS (SELECT cowcode, educ99, count(*) AS n FROM vote WHERE educ99 IS NOT NULL GROUP BY ALL),
    u AS (SELECT *, (CAST('0x' || substr(md5('42:' || cowcode || ':' || educ99), 1, 13) AS BIGINT) + 0.5) / pow(2, 52) AS u FROM folded),
    mass AS (SELECT cowcode, educ99, n, u, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({THINNED}) + (n - k) * ln({1 - THINNED})) AS p
             FROM (SELECT *, unnest(range(n + 1)) AS k FROM u)),
    upto AS (SELECT *, sum(p) OVER (PARTITION BY cowcode, educ99 ORDER BY k) AS c FROM mass),
    kept AS (SELECT cowcode, educ99, min(k) AS w FROM upto WHERE c >= u GROUP BY ALL)
    SELECT d AS draw, round(sum((-0.3 + 0.004 * d) * p * (1 - p) * w) / sum(w), 6) AS ame
    FROM (SELECT d, w, 1 / (1 + exp(-((0.1 + 0.01 * d) + (-0.3 + 0.004 * d) * educ99))) AS p FROM kept, draws) GROUP BY d""",
)
def ame_thinned(spark, sf_dir):
    """Marginal effect over a share of the respondents, thinned within counted patterns."""
    people = voters(spark, sf_dir).withColumn("educ", F.col("educ99").cast("double"))
    counts = pattern_counts(people.select("voted_re", "educ", "educ99", "cowcode"), "voted_re", ["educ", "educ99"], "cowcode")
    per_draw = effects.average_marginal_effect(counts, literal_draws(["educ"], SLOPES[:1]), "educ", THINNED, key=["cowcode", "educ99"])
    return rounded(per_draw, ["ame"])


@query(
    "random_effects",
    f"""WITH {VOTERS_SQL},
    g AS (SELECT cowcode, cpsidp % {FOLDS} AS draw, avg(y) - 0.5 AS value FROM est GROUP BY ALL),
    q AS (SELECT cowcode, avg(value) AS m, quantile_cont(value, 0.3) AS lo, quantile_cont(value, 0.7) AS hi FROM g GROUP BY 1)
    SELECT cowcode AS condition, round(m, 6) AS estimate, round(lo, 6) AS lower, round(hi, 6) AS upper,
           CASE WHEN lo > 0 OR hi < 0 THEN 'sig' ELSE 'insig' END AS sig FROM q""",
)
def random_effects(spark, sf_dir):
    draws = (
        voters(spark, sf_dir)
        .groupBy(F.col("cowcode").alias("condition"), (F.col("cpsidp") % FOLDS).alias("draw"))
        .agg((F.avg("voted_re") - 0.5).alias("value"))
    )
    return rounded(summaries.random_effects(draws, width=0.4), ["estimate", "lower", "upper"])


GROUP_DRAWS_SQL = f"""{GROUP_MODES_SQL[: GROUP_MODES_SQL.rindex("SELECT cowcode")]},
    last AS (
      SELECT cowcode, b, sum(w) + 1 / {SD**2} AS d, sum(w) AS h0, sum(w * x1) AS h01, sum(w * x1 * x1) AS h11
      FROM (SELECT *, n * p * (1 - p) AS w FROM (
        SELECT it.*, x1, n, 1 / (1 + exp(-(b + b0 + b1 * x1))) AS p FROM it JOIN pat USING (cowcode) WHERE i = 8)) GROUP BY cowcode, b),
    s AS (SELECT sum(h0 - h0 * h0 / d) AS s00, sum(h01 - h0 * h01 / d) AS s01, sum(h11 - h01 * h01 / d) AS s11 FROM last),
    cov AS (SELECT s11 / (s00 * s11 - s01 * s01) AS c00, -s01 / (s00 * s11 - s01 * s01) AS c01, s00 / (s00 * s11 - s01 * s01) AS c11 FROM s),
    z AS (SELECT d AS draw, sqrt(c00) * z0 AS e0, c01 / sqrt(c00) * z0 + sqrt(c11 - c01 * c01 / c00) * z1 AS e1
          FROM (SELECT d, {normal_sql("d", 0)} AS z0, {normal_sql("d", 1)} AS z1 FROM (SELECT unnest(range(4000)) AS d)), cov),
    noise AS (SELECT cowcode, draw, sqrt(-2 * ln((CAST('0x' || t[1:13] AS BIGINT) + 0.5) / pow(2, 52))) * cos(2 * pi() * CAST('0x' || t[14:26] AS BIGINT) / pow(2, 52)) AS zg
              FROM (SELECT cowcode, draw, md5('42:group ' || cowcode || ':' || draw) AS t FROM last, z)),
    v AS (SELECT cowcode, b - (h0 * e0 + h01 * e1) / d + zg / sqrt(d) AS value FROM last JOIN noise USING (cowcode) JOIN z USING (draw)),
    q AS (SELECT cowcode, avg(value) AS m, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM v GROUP BY 1)
    SELECT cowcode AS condition, round(m, 4) AS estimate, round(lo, 4) AS lower, round(hi, 4) AS upper,
           CASE WHEN lo > 0 OR hi < 0 THEN 'sig' ELSE 'insig' END AS sig FROM q"""


@query("random_effects_fitted", GROUP_DRAWS_SQL)
def random_effects_fitted(spark, sf_dir):
    """Country effects of a fit at a given group SD, summarised from their posterior draws."""
    data = counted(spark, sf_dir)
    fit = mixed.fit_random_intercept(data, "voted_re", X[:1], "cowcode", sds=[SD], patterns=data, tol=1e-14)
    effects_ = summaries.random_effects(mixed.group_draws(fit, mixed.mixed_draws(fit)), width=0.9)
    return rounded(effects_, ["estimate", "lower", "upper"], 4)


MODEL_SLOPES = {"base": (-0.3,), "dem": (0.25, -0.2)}
MODEL_INTERCEPTS = {"base": -0.35, "dem": -0.1}


def ll_sql(model):
    eta = literal_eta(MODEL_SLOPES[model], MODEL_INTERCEPTS[model])
    return f"""SELECT '{model}' AS model, cowcode, x1, x2, y, c, -ln(avg(1 + exp(CASE y WHEN 1 THEN -1 ELSE 1 END * ({eta})))) AS elpd
    FROM cell, draws GROUP BY ALL"""


LOO_SQL = f"""{VOTERS_SQL}, {DRAWS_SQL},
cell AS (SELECT cowcode, x1, x2, 1 AS y, h AS c FROM pat WHERE h > 0
         UNION ALL SELECT cowcode, x1, x2, 0, n - h FROM pat WHERE n > h),
point AS ({ll_sql("base")} UNION ALL {ll_sql("dem")})"""


def literal_points(spark, sf_dir):
    models = {m: literal_draws(X[: len(s)], s, MODEL_INTERCEPTS[m]) for m, s in MODEL_SLOPES.items()}
    return compare.pointwise(counted(spark, sf_dir).drop("gdpcap_z"), models, smooth=False)


@query(
    "pointwise_elpd",
    f"""WITH {LOO_SQL}
    SELECT cowcode, round(x1, 6) AS corrupt_z, round(x2, 6) AS polity2_z, y, CAST(any_value(c) AS BIGINT) AS n,
           round(max(elpd) FILTER (WHERE model = 'base'), 6) AS elpd_base,
           round(max(elpd) FILTER (WHERE model = 'dem'), 6) AS elpd_dem
    FROM point GROUP BY cowcode, x1, x2, y""",
)
def pointwise_elpd(spark, sf_dir):
    out = literal_points(spark, sf_dir).select("cowcode", "corrupt_z", "polity2_z", "y", "n", "elpd_base", "elpd_dem")
    return rounded(out, ["corrupt_z", "polity2_z", "elpd_base", "elpd_dem"])


@query(
    "elpd_compare",
    f"""WITH {LOO_SQL},
    total AS (SELECT model, sum(c * elpd) AS e FROM point GROUP BY 1),
    best AS (SELECT arg_max(model, e) AS model FROM total),
    diff AS (SELECT a.model, a.c, a.elpd - b.elpd AS d, a.elpd FROM point a JOIN point b USING (cowcode, x1, x2, y)
             WHERE b.model = (SELECT model FROM best))
    SELECT model, round(sum(c * d), 4) AS elpd_diff,
           round(sqrt(sum(c) * greatest(sum(c * d * d) - sum(c * d) * sum(c * d) / sum(c), 0) / (sum(c) - 1)), 4) AS se_diff,
           round(sum(c * elpd), 4) AS elpd_loo FROM diff GROUP BY model""",
)
def elpd_compare(spark, sf_dir):
    out = compare.compare(literal_points(spark, sf_dir), list(MODEL_SLOPES))
    return rounded(out, ["elpd_diff", "se_diff", "elpd_loo"], 4)


@query(
    "stacking_weights",
    f"""WITH RECURSIVE {LOO_SQL},
    e AS (SELECT any_value(c) AS c, exp(max(elpd) FILTER (WHERE model = 'base')) AS e1,
                 exp(max(elpd) FILTER (WHERE model = 'dem')) AS e2 FROM point GROUP BY cowcode, x1, x2, y),
    it(i, w) AS (
      SELECT 0, 0.5::DOUBLE
      UNION ALL
      SELECT i + 1, greatest(0, least(1, w + sum(c * t) / sum(c * t * t)))
      FROM (SELECT i, w, c, (e1 - e2) / (w * e1 + (1 - w) * e2) AS t FROM it, e WHERE i < 40) GROUP BY i, w)
    SELECT unnest(['base', 'dem']) AS model, unnest([round(w, 4), round(1 - w, 4)]) AS weight FROM it WHERE i = 40""",
)
def stacking_weights(spark, sf_dir):
    return rounded(compare.stacking_weights(literal_points(spark, sf_dir), list(MODEL_SLOPES)), ["weight"], 4)


@query("model_ranking")
def model_ranking(spark, sf_dir):
    """All five models: fit, leave-one-out comparison and stacking weights."""
    from natal.plans.model_suite import fit_suite

    return fit_suite(None, "voted_re", X, "cowcode", WEAK, patterns=counted(spark, sf_dir)).ranking()
