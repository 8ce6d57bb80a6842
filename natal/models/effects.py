"""Average marginal effects and predicted-probability curves."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.models.draws import DrawMatrix
from natal.models.patterns import TRIALS
from natal.models.scoring import eta_of, logistic, map_blocks

_UNIFORM = "_natal_uniform"
#: Standard deviations around the mean within which the kept share of a pattern lies.
REACH = 40


def average_marginal_effect(
    patterns: DataFrame, draws: DrawMatrix, x: str, prop: float = 1.0, seed: int = 42, weight: str = TRIALS,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Average of ``beta_x * p * (1 - p)`` over respondents, one row per draw.

    ``prop`` below 1 averages over a random share of the respondents, where the caller wants
    that: each one is kept with this probability, also within a counted pattern. How many of a pattern are
    kept is the binomial quantile at a number between 0 and 1 that a digest of the seed and the
    columns ``key`` (all, by default) gives, so it is the same at any partitioning. Patterns with an
    unknown predictor are left out. Each task sends one partial sum per draw.
    """
    at = draws.terms.index(x)
    patterns = patterns.na.drop("any", subset=list(draws.predictors))
    if prop < 1:
        keys = key or sorted(c for c in patterns.columns if not c.startswith("_natal"))
        text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
        digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
        patterns = patterns.withColumn(_UNIFORM, (digits + 0.5) / 2.0**52)

    def score(blocks, d):
        total, n = np.zeros(len(d)), 0.0
        for block in blocks:
            w = block[weight].to_numpy(dtype=float)
            if prop < 1:
                w = kept(block[_UNIFORM].to_numpy(), w, prop)
            p = logistic(eta_of(block, d))
            total += w @ (p * (1 - p))
            n += w.sum()
        if n:
            yield pd.DataFrame({"draw": np.arange(len(d)), "s": total * d.values[:, at], "n": n})

    partial = map_blocks(patterns, draws, score, "draw bigint, s double, n double")
    return partial.groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("ame"))


def thin(respondents: DataFrame, key: str, prop: float, seed: int = 42) -> DataFrame:
    """A share ``prop`` of the respondents, chosen by a digest of seed and id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return respondents.filter(F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / 2.0**52 < prop)


def kept(uniform: np.ndarray, n: np.ndarray, prop: float) -> np.ndarray:
    """Binomial quantiles: how many of ``n`` are kept with probability ``prop``, at a number between 0 and 1.

    Distribution functions of all rows are summed up together, over the same number of places around each
    mean; places further off hold less than rounding does.
    """
    out = np.zeros(len(n))
    if prop <= 0 or not len(n):
        return out
    spread = np.sqrt(n * prop * (1 - prop))
    reach = np.ceil(REACH * spread + REACH).astype(np.int64)
    for rows in np.array_split(np.argsort(reach, kind="stable"), max(1, int(reach.sum() // 1_000_000))):
        low = np.maximum(np.floor(n[rows] * prop) - reach[rows], 0)
        k = low[:, None] + np.arange(2 * reach[rows].max() + 2)[None, :]
        m = n[rows][:, None]
        step = np.log(np.maximum(m - k, 1e-300)) - np.log(k + 1) + math.log(prop) - math.log1p(-prop)
        log = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(step[:, :-1], axis=1)], axis=1)
        log[k > m] = -np.inf
        mass = np.exp(log - log.max(axis=1, keepdims=True))
        total = np.cumsum(mass, axis=1)
        below = (total < uniform[rows][:, None] * total[:, -1:]).sum(axis=1)
        out[rows] = np.minimum(low + below, n[rows])
    return out


def effect_curve(
    patterns: DataFrame, draws: DrawMatrix, x: str, width: float = 0.9, points: int = 100, weight: str = TRIALS
) -> DataFrame:
    """Predicted probability over the range of ``x``, other predictors at their mean.

    Median and equal-tailed band per grid point; group effects are left out.
    """
    others = [p for p in draws.predictors if p != x]
    patterns = patterns.na.drop("any", subset=list(draws.predictors))
    stats = patterns.agg(
        F.min(x).alias("_lo"),
        F.max(x).alias("_hi"),
        *[(F.sum(F.col(o) * F.col(weight)) / F.sum(weight)).alias(o) for o in others],
    )
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    grid = stats.withColumn("_point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        "_point", (F.col("_lo") + F.col("_point") * step).alias(x), *others
    )
    tail = (1 - width) / 2

    def score(blocks, d):
        for block in blocks:
            q = np.quantile(logistic(eta_of(block, d)), [tail, 0.5, 1 - tail], axis=1)
            yield pd.DataFrame({"point": block["_point"], x: block[x], "estimate": q[1], "lower": q[0], "upper": q[2]})

    return map_blocks(grid, draws, score, f"point int, `{x}` double, estimate double, lower double, upper double")


def effect_curves(patterns: DataFrame, draws: DrawMatrix, width: float = 0.95, points: int = 100, weight: str = TRIALS) -> DataFrame:
    """Curves of all predictors in one long table."""
    curves = [
        effect_curve(patterns, draws, x, width, points, weight)
        .withColumnRenamed(x, "value")
        .select(F.lit(x).alias("effect"), "point", "value", "estimate", "lower", "upper")
        for x in draws.predictors
    ]
    return reduce(DataFrame.unionByName, curves)
