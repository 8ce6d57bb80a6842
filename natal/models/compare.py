"""Leave-one-out fit, model ranking and stacking weights.

Pointwise values are computed per covariate pattern and outcome and carry the number of
respondents behind them, so nothing is lost by the compression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.models.draws import DrawMatrix
from natal.models.patterns import HITS, TRIALS
from natal.models.scoring import eta_of, log_lik, map_blocks
from natal.operators.joins import literal_table


def log_mean_exp(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).mean(axis=1, keepdims=True)))[:, 0]


def tail_length(draws: int) -> int:
    """How many of the largest importance ratios are smoothed; none where they are too few for a fit."""
    tail = int(min(np.ceil(0.2 * draws), np.ceil(3 * np.sqrt(draws))))
    return tail if tail >= 5 else 0


def tail_of(ll: np.ndarray, tail: int) -> dict[str, np.ndarray | list]:
    """What leave-one-out needs of the log-likelihoods of all draws, per row.

    ``top`` holds the ``tail`` largest log ratios in rising order, relative to the largest; ``cut`` is
    the next one, ``rest`` the sum of all smaller ratios, ``shift`` the largest log ratio.
    """
    shift = (-ll).max(axis=1)
    ratios = -ll - shift[:, None]
    if tail:
        ratios = np.partition(ratios, [ll.shape[1] - tail - 1], axis=1)
    split = ll.shape[1] - tail
    top = np.sort(ratios[:, split:], axis=1)
    cut = ratios[:, split - 1] if split else np.full(len(ll), -np.inf)
    return {"top": list(top), "cut": cut, "rest": np.exp(ratios[:, :split]).sum(axis=1), "shift": shift, "lpd": log_mean_exp(ll)}


#: How many points the profile of the tail's shape has beyond the root of the tail's
#: length, and the weight and place of the prior on the shape.
PROFILE, PRIOR_WEIGHT, PRIOR_SHAPE = 30, 10.0, 0.5


def tail_fit(df: DataFrame, excess: str, n: int, into: str) -> DataFrame:
    """Add ``into``: shape and scale of a generalised Pareto tail for an array of ``n`` rising excesses.

    Profile posterior mean over a fixed grid (Zhang and Stephens 2009), with the shape
    shrunk towards one half for short tails (Vehtari et al. 2024). All in array expressions; each
    step is a column of its own, so that none is computed twice.
    """
    points = PROFILE + int(np.sqrt(n))
    x = F.col(excess)

    def mean_log(theta):
        return F.aggregate(x, F.lit(0.0), lambda total, e: total + F.log1p(-theta * e)) / n

    offsets = F.array(*[F.lit(float(1 - np.sqrt(points / (j - 0.5))) / 3) for j in range(1, points + 1)])
    first, quarter = 1 / F.get(x, F.lit(n - 1)), F.get(x, F.lit(int(n / 4 + 0.5) - 1))
    theta = F.transform(offsets, lambda o: first + o / quarter)
    grid = F.transform(theta, lambda t: F.struct(t.alias("t"), mean_log(t).alias("k")))
    profile = F.transform("_grid", lambda g: F.struct(g["t"].alias("t"), (n * (F.log(-g["t"] / g["k"]) - g["k"] - 1)).alias("p")))
    weight = F.transform("_profile", lambda g: F.struct(g["t"].alias("t"), F.exp(g["p"] - F.col("_peak")).alias("w")))
    total = F.aggregate("_weight", F.lit(0.0), lambda a, g: a + g["w"])
    best = F.aggregate("_weight", F.lit(0.0), lambda a, g: a + g["t"] * g["w"]) / total
    shape = F.struct(((n * F.col("_k") + PRIOR_WEIGHT * PRIOR_SHAPE) / (n + PRIOR_WEIGHT)).alias("shape"), (-F.col("_k") / F.col("_theta")).alias("scale"))
    return (
        df.withColumn("_grid", grid)
        .withColumn("_profile", profile)
        .withColumn("_peak", F.array_max(F.transform("_profile", lambda g: g["p"])))
        .withColumn("_weight", weight)
        .withColumn("_theta", best)
        .withColumn("_k", mean_log(F.col("_theta")))
        .withColumn(into, shape)
        .drop("_grid", "_profile", "_peak", "_weight", "_theta", "_k")
    )


def with_loo(df: DataFrame, model: str, draws: int, tail: int) -> DataFrame:
    """Turn a model's tail ``_t_<model>`` into ``elpd_``, ``lpd_`` and ``k_``.

    The largest ratios are replaced by expected order statistics of the fitted tail, and none may
    exceed the largest raw ratio. A draw outside the tail adds the same to the sum over draws of ratio
    times density whatever it is, so those outside need no more than their number and their sum.
    """
    t = F.col(f"_t_{model}")
    if not tail:
        shape = F.lit(float("inf") if draws else float("nan"))
        elpd = F.log(draws / t["rest"]) - t["shift"]
        return df.withColumns({f"elpd_{model}": elpd, f"lpd_{model}": t["lpd"], f"k_{model}": shape}).drop(f"_t_{model}")
    low, high = F.get(t["top"], F.lit(0)), F.get(t["top"], F.lit(tail - 1))
    flat = (high - low <= 1e-12) | (F.exp(low) - F.exp(t["cut"]) <= 0)  # no tail to fit
    excess = F.when(~F.col("_flat"), F.transform(t["top"], lambda v: F.exp(v) - F.exp(t["cut"])))
    df = tail_fit(df.withColumn("_flat", flat).withColumn("_excess", excess), "_excess", tail, "_fit")
    k = F.when(F.abs(F.col("_fit.shape")) < 1e-12, 1e-12).otherwise(F.col("_fit.shape"))
    places = F.array(*[F.lit(float(np.log1p(-(i - 0.5) / tail))) for i in range(1, tail + 1)])
    quantiles = F.transform(places, lambda q: F.col("_fit.scale") * F.expm1(-k * q) / k)
    fitted = F.transform(quantiles, lambda q: F.least(F.log(F.exp(t["cut"]) + q), F.lit(0.0)))
    smooth = F.when(F.col("_flat"), t["top"]).otherwise(fitted)
    pairs = F.arrays_zip(t["top"].alias("raw"), F.col("_smooth").alias("new"))
    over = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.exp(p["new"] - p["raw"]))
    under = F.aggregate("_smooth", F.lit(0.0), lambda a, v: a + F.exp(v))
    return (
        df.withColumn("_smooth", smooth)
        .withColumns(
            {
                f"elpd_{model}": F.log((draws - tail + over) / (t["rest"] + under)) - t["shift"],
                f"lpd_{model}": t["lpd"],
                f"k_{model}": F.when(F.col("_flat"), F.lit(float("-inf"))).otherwise(F.col("_fit.shape")),
            }
        )
        .drop("_excess", "_flat", "_fit", "_smooth", f"_t_{model}")
    )


_TAIL = "struct<top: array<double>, cut: double, rest: double, shift: double, lpd: double>"


def pointwise(patterns: DataFrame, models: Mapping[str, DrawMatrix], smooth: bool = True, group_prefix: Mapping[str, str] | None = None) -> DataFrame:
    """Leave-one-out values of all models in one pass.

    ``patterns`` must span the predictors of every model. Result columns: pattern key, ``y``,
    number of respondents, and per model ``elpd_``, ``lpd_`` and ``k_``. A task reduces the draws of a
    pattern to the tail of their importance ratios; the tail is fitted and smoothed by Spark.
    """
    prefixes = dict(group_prefix or {})
    keys = [c for c in patterns.columns if c not in (HITS, TRIALS) and not c.startswith(("_natal", *prefixes.values()))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patterns.select(*keys).schema)
    schema += ", y int, n bigint" + "".join(f", `_t_{m}` {_TAIL}" for m in models)
    tails = {m: tail_length(len(d)) if smooth else 0 for m, d in models.items()}

    def reduce(blocks, ms):
        for block in blocks:
            etas = {m: eta_of(block, d, prefixes.get(m, "")) for m, d in ms.items()}
            for y in (0, 1):
                hits = block[HITS].to_numpy(dtype=float)
                n = (hits if y else block[TRIALS].to_numpy(dtype=float) - hits).round().astype("int64")
                rows = np.flatnonzero(n > 0)
                out = block[keys].iloc[rows].copy()
                out["y"], out["n"] = y, n[rows]
                for m, eta in etas.items():
                    found = tail_of(log_lik(eta[rows], y), tails[m])
                    out[f"_t_{m}"] = [dict(zip(found, v)) for v in zip(*found.values())]
                yield out

    points = map_blocks(patterns, models, reduce, schema)
    for m, d in models.items():
        points = with_loo(points, m, len(d), tails[m])
        if not smooth:
            points = points.withColumn(f"k_{m}", F.lit(float("nan")))
    return points


def loo_summary(points: DataFrame, models: Sequence[str], bad_k: float = 0.7) -> DataFrame:
    """Per model: expected density, effective parameters, their information criterion, SEs, poor tails."""
    n = F.col("n")
    total = F.sum("n")

    def one(m):
        e, p = F.col(f"elpd_{m}"), F.col(f"lpd_{m}") - F.col(f"elpd_{m}")
        return F.struct(
            F.lit(m).alias("model"),
            F.sum(n * e).alias("elpd_loo"),
            _se(e, n, total).alias("se_elpd_loo"),
            F.sum(n * p).alias("p_loo"),
            (-2 * F.sum(n * e)).alias("looic"),
            F.sum(F.when(F.col(f"k_{m}") > bad_k, n).otherwise(0)).alias("n_bad_k"),
        )

    return points.agg(F.array(*[one(m) for m in models]).alias("a")).select(F.inline("a"))


def _se(value, n, total):
    """sqrt(N) times the sample SD of a pointwise value that stands for ``n`` respondents."""
    spread = F.sum(n * value * value) - F.sum(n * value) * F.sum(n * value) / total
    return F.sqrt(total * F.greatest(spread, F.lit(0.0)) / (total - 1))


def compare(points: DataFrame, models: Sequence[str]) -> DataFrame:
    """Difference in expected density to the best model, with its standard error; best first."""
    n, total = F.col("n"), F.sum("n")
    cells = []
    for m in models:
        for b in models:
            d = F.col(f"elpd_{m}") - F.col(f"elpd_{b}")
            cells.append(
                F.struct(
                    F.lit(m).alias("model"),
                    F.lit(b).alias("best"),
                    F.sum(n * d).alias("elpd_diff"),
                    _se(d, n, total).alias("se_diff"),
                    F.sum(n * F.col(f"elpd_{m}")).alias("elpd_loo"),
                )
            )
    # One row per pair of models: the list of models is short and set by the caller.
    pairs = points.agg(F.array(*cells).alias("a")).select(F.inline("a"))
    best = pairs.agg(F.max_by("model", "elpd_loo")).scalar()
    return pairs.filter(F.col("best") == best).drop("best").orderBy(F.desc("elpd_diff"), "model")


def stacking_weights(points: DataFrame, models: Sequence[str], max_steps: int = 50, tol: float = 1e-9) -> DataFrame:
    """Weights that maximise the leave-one-out log score of the mixture.

    Sequential quadratic steps on the simplex (Kim et al. 2020): one aggregate gives the
    gradient and curvature in model space, a second one the line search.
    """
    k = len(models)
    cols = [f"elpd_{m}" for m in models]
    top = F.greatest(*cols) if k > 1 else F.col(cols[0])
    data = points.select("n", *[F.exp(F.col(c) - top).alias(f"e{j}") for j, c in enumerate(cols)]).persist()
    try:
        total = float(data.agg(F.sum("n")).first()[0])
        w = np.full(k, 1.0 / k)
        for _ in range(max_steps):
            mix = _mixture(w)
            u = [F.col(f"e{j}") / mix for j in range(k)]
            row = data.agg(
                *[F.sum(F.col("n") * u[j]).alias(f"g{j}") for j in range(k)],
                *[F.sum(F.col("n") * u[j] * u[l]).alias(f"h{j}_{l}") for j in range(k) for l in range(j, k)],
            ).first()
            grad = np.array([row[f"g{j}"] for j in range(k)]) / total
            gap = grad.max() - 1  # optimality gap of the mean log score
            if gap < tol:
                break
            curve = np.array([[row[f"h{min(j, l)}_{max(j, l)}"] for l in range(k)] for j in range(k)]) / total
            target = _quadratic_step(curve, 1 - grad, w)
            target /= target.sum()
            sizes = [2.0**-i for i in range(12)]
            trial = [w + a * (target - w) for a in sizes]
            scores = data.agg(*[F.sum(F.col("n") * F.log(_mixture(t))) for t in [w, *trial]]).first()
            best = int(np.argmax([s if s is not None else -np.inf for s in scores]))
            if best == 0:
                if gap < 1e-6:  # as good as sums of doubles can tell
                    break
                raise RuntimeError(f"no step improves the stacking weights; the optimality gap is {gap:g}")
            w = trial[best - 1]
        else:
            raise RuntimeError(f"stacking weights did not converge in {max_steps} steps")
        return literal_table(
            points.sparkSession, {"model": list(models), "weight": [float(x) for x in w]}, "model string, weight double"
        )
    finally:
        data.unpersist()


def _mixture(w: np.ndarray):
    return sum((F.col(f"e{j}") * float(v) for j, v in enumerate(w)), F.lit(0.0))


def _quadratic_step(curve: np.ndarray, slope: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Minimise the local quadratic over non-negative weights.

    Active sets as in non-negative least squares (Lawson and Hanson 1974): weights enter one by
    one, and those that a step would make negative leave again.
    """
    k = len(w)
    curve = curve + 1e-10 * np.eye(k)
    target = curve @ w - slope
    x, free = np.zeros(k), np.zeros(k, dtype=bool)
    for _ in range(30 * k):
        pull = target - curve @ x
        pull[free] = -np.inf
        if pull.max() < 1e-12:
            return x
        free[pull.argmax()] = True
        while True:
            s = np.zeros(k)
            s[free] = np.linalg.solve(curve[np.ix_(free, free)], target[free])
            low = free & (s <= 0)
            if not low.any():
                x = s
                break
            x = x + (x[low] / (x[low] - s[low])).min() * (s - x)
            free &= x > 1e-14
            x[~free] = 0.0
    raise RuntimeError("the quadratic step did not settle")
