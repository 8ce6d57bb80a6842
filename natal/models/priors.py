"""Prior settings and their summary."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from natal.operators.joins import literal_table


@dataclass(frozen=True)
class Priors:
    """Normal priors by their SD (``None`` is flat) and a prior on the group SD."""

    slope_sd: float | None = None
    intercept_sd: float | None = None
    group_sd: tuple = ("student_t", 3.0, 2.5)

    def precision(self, k: int) -> list[float]:
        """Diagonal of the prior precision, intercept first."""
        def one(sd):
            return 0.0 if sd is None else 1.0 / sd**2

        return [one(self.intercept_sd), *[one(self.slope_sd)] * (k - 1)]

    def log_group_sd(self, sd: float) -> float:
        """Log density of the group SD up to a constant."""
        kind, *args = self.group_sd
        if kind == "exponential":
            return -args[0] * sd
        if kind == "student_t":
            df, scale = args
            return -(df + 1) / 2 * math.log1p((sd / scale) ** 2 / df)
        raise ValueError(f"unknown prior {kind!r}")


FLAT = Priors()
# Weakly informative priors for standardised predictors.
WEAK = Priors(slope_sd=2.5, intercept_sd=2.5, group_sd=("exponential", 1.0))


def prior_summary(spark: SparkSession, priors: Priors, predictors: Sequence[str], group: str | None = None) -> DataFrame:
    """One row per parameter with its prior as text."""
    def normal(sd):
        return "(flat)" if sd is None else f"normal(0, {sd:g})"

    rows = [("Intercept", "", normal(priors.intercept_sd))]
    rows += [("b", p, normal(priors.slope_sd)) for p in predictors]
    if group:
        kind, *args = priors.group_sd
        text = ", ".join(f"{a:g}" for a in ([args[0], 0.0, args[1]] if kind == "student_t" else args))
        rows.append(("sd", group, f"{kind}({text})"))
    cls, coef, text = zip(*rows)
    return literal_table(spark, {"class": cls, "coef": coef, "prior": text}, "class string, coef string, prior string")
