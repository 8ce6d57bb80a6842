"""The five turnout models of one analysis table and everything read off them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.models import compare, effects, mixed, summaries
from natal.models.draws import DRAWS, DrawMatrix, draw_matrix, draws_table
from natal.models.logit import LogitFit, fit_logit
from natal.models.mixed import MixedFit
from natal.models.patterns import pattern_counts, spread_patterns
from natal.models.priors import FLAT, Priors
from natal.models.store import stored
from natal.operators.frame import interval
from natal.session import cut_lineage


@dataclass(frozen=True)
class Suite:
    """Nested fits (corruption; plus regime; plus income) and two of them with country effects."""

    patterns: DataFrame
    fits: Mapping[str, LogitFit | MixedFit]
    draws: Mapping[str, DrawMatrix]
    group: str

    @property
    def models(self) -> list[str]:
        return list(self.fits)

    @property
    def grouped(self) -> list[str]:
        return [m for m, f in self.fits.items() if isinstance(f, MixedFit)]

    def coefficient_draws(self, store: str | None = None) -> DataFrame:
        """Long draws of all models; with ``store`` each model's draws are written once and read back.

        An entry belongs to the data and the fit it came from, so other data or priors find none.
        """
        spark = self.patterns.sparkSession

        def table(m):
            if store is None:
                return draws_table(spark, self.draws[m], m)
            fit, draws = self.fits[m], self.draws[m]
            made_from = {"model": m, "terms": fit.terms, "priors": fit.priors, "draws": len(draws), "seed": draws.seed}
            return stored(store, self.patterns, made_from, lambda: draws_table(spark, draws, m))

        return reduce(DataFrame.unionByName, [table(m) for m in self.models])

    def scored(self, model: str) -> DataFrame:
        """Patterns ready for scoring with a model, country effects attached where it has them."""
        fit = self.fits[model]
        return mixed.attach_groups(self.patterns, fit) if isinstance(fit, MixedFit) else self.patterns

    def marginal_effects(self, x: str, width: float = 0.95, prop: float = 1.0) -> DataFrame:
        """Median average marginal effect of ``x`` with its interval, one row per model."""
        per_draw = [
            effects.average_marginal_effect(self.scored(m), self.draws[m], x, prop).withColumn("model", F.lit(m))
            for m in self.models
        ]
        return interval(reduce(DataFrame.unionByName, per_draw), ["model"], "ame", width)

    def curves(self, x: str, width: float = 0.9, points: int = 100) -> DataFrame:
        """Predicted probability over ``x`` per model."""
        parts = [
            effects.effect_curve(self.patterns, self.draws[m], x, width, points).withColumn("model", F.lit(m)) for m in self.models
        ]
        return reduce(DataFrame.unionByName, parts)

    def country_effects(self, width: float = 0.95) -> DataFrame:
        """Summary of every country effect of the models that have them."""
        parts = [
            summaries.random_effects(mixed.group_draws(self.fits[m], self.draws[m]), width=width).withColumn("model", F.lit(m))
            for m in self.grouped
        ]
        return reduce(DataFrame.unionByName, parts)

    def table(self, labels: Mapping[str, str], width: float = 0.9) -> DataFrame:
        sizes = {m: f.nobs for m, f in self.fits.items()}
        return summaries.model_table(summaries.tidy(self.coefficient_draws(), width), labels, self.models, sizes)

    def pointwise(self) -> DataFrame:
        """Leave-one-out values of all models per pattern, written once for the uses that follow."""
        data, prefixes = self.patterns, {m: f"{m}__" for m in self.grouped}
        for m in self.grouped:
            data = mixed.attach_groups(data, self.fits[m], prefixes[m])
        return cut_lineage(compare.pointwise(data, self.draws, group_prefix=prefixes))

    def ranking(self, points: DataFrame | None = None) -> DataFrame:
        """Difference in expected density, its standard error and the stacking weight per model."""
        points = self.pointwise() if points is None else points
        return compare.compare(points, self.models).join(compare.stacking_weights(points, self.models), "model")


def fit_suite(
    table: DataFrame,
    outcome: str,
    predictors: Sequence[str],
    group: str,
    priors: Priors = FLAT,
    n_draws: int = DRAWS,
    seed: int = 42,
    patterns: DataFrame | None = None,
) -> Suite:
    """Fit the five models on one pass over the respondents.

    ``predictors`` are corruption, regime type and income, in this order.
    """
    corruption, regime, income = predictors
    counts = pattern_counts(table, outcome, predictors, group) if patterns is None else patterns
    kept = cut_lineage(counts.filter(F.col(group).isNotNull()))
    counts = cut_lineage(spread_patterns(kept, kept.count()))
    nested = {"base": [corruption], "dem": [corruption, regime], "full": [corruption, regime, income]}
    fits: dict[str, LogitFit | MixedFit] = {
        m: fit_logit(counts, outcome, xs, priors, patterns=counts) for m, xs in nested.items()
    }
    for m in ("dem", "full"):
        fits[f"{m}_country"] = mixed.fit_random_intercept(counts, outcome, nested[m], group, priors, patterns=counts)
    draws = {
        m: mixed.mixed_draws(f, n_draws, seed) if isinstance(f, MixedFit) else draw_matrix(f, n_draws, seed) for m, f in fits.items()
    }
    return Suite(counts, fits, draws, group)
