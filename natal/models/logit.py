"""Logit with normal priors, fitted by Newton steps.

Each step is one aggregate over the data: log-likelihood, gradient and Hessian are sums, so
they combine on the map side and the driver sees k + k(k+1)/2 + 2 numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from natal.models.patterns import HITS, TRIALS, pattern_counts
from natal.models.priors import FLAT, Priors

INTERCEPT = "Intercept"


@dataclass(frozen=True)
class LogitFit:
    """Posterior mode and covariance of a logit."""

    terms: tuple[str, ...]
    mode: np.ndarray
    cov: np.ndarray
    loglik: float
    nobs: int
    steps: int
    priors: Priors = field(default=FLAT)

    @property
    def predictors(self) -> tuple[str, ...]:
        return self.terms[1:]


def number(value: float) -> str:
    return f"{float(value)!r}D"


def linear(terms: Sequence[str], beta: Sequence[float]) -> str:
    """Linear predictor as SQL text, the intercept first."""
    return " + ".join([number(beta[0]), *[f"{number(b)} * `{t}`" for t, b in zip(terms[1:], beta[1:])]])


def scored(df: DataFrame, terms: Sequence[str], eta: str, keep: Sequence[str] = ()) -> DataFrame:
    """Design columns ``x0..``, linear predictor, residual and weight of every row.

    SQL text keeps the number of driver calls per Newton step small.
    """
    design = ["1D AS x0", *[f"`{t}` AS x{j}" for j, t in enumerate(terms[1:], 1)]]
    base = df.selectExpr(*keep, TRIALS, HITS, *design, f"{eta} AS _eta")
    return base.selectExpr("*", "1 / (1 + exp(-_eta)) AS _p").selectExpr(
        "*", f"{HITS} - {TRIALS} * _p AS _r", f"{TRIALS} * _p * (1 - _p) AS _w"
    )


def score_sums(k: int) -> list[Column]:
    """Sums of the log-likelihood, gradient and upper triangle of the information matrix.

    The log-likelihood is written so that large linear predictors do not overflow.
    """
    ll = f"{HITS} * _eta - {TRIALS} * (greatest(_eta, 0D) + log1p(exp(-abs(_eta))))"
    sums = [f"sum({ll}) AS ll"]
    sums += [f"sum(_r * x{j}) AS g{j}" for j in range(k)]
    sums += [f"sum(_w * x{j} * x{l}) AS h{j}_{l}" for j in range(k) for l in range(j, k)]
    return [F.expr(s) for s in sums]


def unpack(row, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    grad = np.array([row[f"g{j}"] for j in range(k)], dtype=float)
    info = np.zeros((k, k))
    for j in range(k):
        for l in range(j, k):
            info[j, l] = info[l, j] = row[f"h{j}_{l}"]
    return float(row["ll"]), grad, info


def fit_logit(
    df: DataFrame,
    outcome: str,
    predictors: Sequence[str],
    priors: Priors = FLAT,
    max_steps: int = 50,
    tol: float = 1e-10,
    patterns: DataFrame | None = None,
) -> LogitFit:
    """Posterior mode of ``outcome ~ predictors``.

    ``patterns`` may pass counts made earlier by :func:`pattern_counts`, also over more
    predictors than are used here.
    """
    terms = (INTERCEPT, *predictors)
    k = len(terms)
    data = pattern_counts(df, outcome, predictors) if patterns is None else patterns.na.drop("any", subset=list(predictors))
    data = data.persist()
    try:
        penalty = np.diag(priors.precision(k))
        beta, last = np.zeros(k), None
        for step in range(1, max_steps + 1):
            row = scored(data, terms, linear(terms, beta)).agg(F.sum(TRIALS).alias("n"), *score_sums(k)).first()
            if not row["n"]:
                raise ValueError("no complete rows to fit")
            ll, grad, info = unpack(row, k)
            value = ll - 0.5 * beta @ penalty @ beta
            if last is not None and value < last[0] - 1e-9 * abs(last[0]):
                beta = (beta + last[1]) / 2  # overshot: go back half way
                continue
            move = np.linalg.solve(info + penalty, grad - penalty @ beta)
            if move @ (grad - penalty @ beta) < tol:
                return LogitFit(terms, beta, np.linalg.inv(info + penalty), ll, int(row["n"]), step, priors)
            last = (value, beta)
            beta = beta + move
        raise RuntimeError(f"no convergence in {max_steps} steps; a predictor may separate the outcome")
    finally:
        data.unpersist()
