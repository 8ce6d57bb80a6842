"""Tables of coefficients and group effects from posterior draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.functions.columns import excludes_zero
from natal.operators.frame import interval
from natal.operators.joins import literal_table, lookup_join


def tidy(draws: DataFrame, width: float = 0.9) -> DataFrame:
    """Median and equal-tailed interval per model and term."""
    return interval(draws, ["model", "term"], "value", width, "median", "conf_low", "conf_high")


def posterior_summary(draws: DataFrame, width: float = 0.95) -> DataFrame:
    """Mean, posterior SD and equal-tailed interval per model and term."""
    keys = ["model", "term"]
    centre = interval(draws, keys, "value", width, "mean", "lower", "upper")
    return centre.join(draws.groupBy(*keys).agg(F.stddev_samp("value").alias("est_error")), keys)


def glance(rows: DataFrame) -> DataFrame:
    """Size of the estimation sample."""
    return rows.agg(F.count("*").alias("n"))


def model_table(
    coefficients: DataFrame,
    labels: Mapping[str, str],
    models: Sequence[str],
    nobs: Mapping[str, int] | None = None,
    digits: int = 2,
) -> DataFrame:
    """Comparison table: one column per model, estimate and interval rows per labelled term.

    Terms without a label are left out; the order of ``labels`` is the row order.
    """
    spark = coefficients.sparkSession
    names = literal_table(
        spark,
        {"term": labels.keys(), "label": labels.values(), "position": range(1, len(labels) + 1)},
        "term string, label string, position int",
    )
    f = f"%.{digits}f"
    cells = lookup_join(coefficients, names, ["term"], "inner", len(labels)).select(
        "model",
        "position",
        "label",
        F.explode(
            F.array(
                F.struct(F.lit("estimate").alias("statistic"), F.format_string(f, "estimate").alias("cell")),
                F.struct(
                    F.lit("interval").alias("statistic"), F.format_string(f"[{f}, {f}]", "conf_low", "conf_high").alias("cell")
                ),
            )
        ).alias("c"),
    )
    cells = cells.select("model", "position", "label", "c.statistic", "c.cell")
    if nobs:
        size = {"model": nobs.keys(), "cell": [str(n) for n in nobs.values()]}
        rows = literal_table(spark, size, "model string, cell string").select(
            "model", F.lit(len(labels) + 1).alias("position"), F.lit("Observations").alias("label"), F.lit("n").alias("statistic"), "cell"
        )
        cells = cells.unionByName(rows)
    return cells.groupBy("position", "label", "statistic").pivot("model", list(models)).agg(F.first("cell"))


def random_effects(group_draws: DataFrame, group: str = "condition", width: float = 0.95) -> DataFrame:
    """Mean, interval and significance flag of every group effect."""
    out = interval(group_draws, [group], "value", width, "mean", "lower", "upper")
    return out.withColumn("sig", excludes_zero("lower", "upper"))
