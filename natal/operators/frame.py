"""Whole-frame operators: complete cases, standardising, tables and interval summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from natal.functions.columns import known, ratio
from natal.session import cut_lineage


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in any (named) column."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def case_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, rows known per column and rows complete in all columns, in one pass."""
    present = {c: F.col(c).isNotNull() & ~F.equal_null(F.isnan(F.col(c).try_cast("double")), F.lit(True)) for c in columns}
    complete = reduce(lambda a, b: a & b, present.values())
    return df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(p).alias(f"n_{c}") for c, p in present.items()],
        F.count_if(complete).alias("nobs"),
    )


def standardize(
    df: DataFrame,
    columns: Sequence[str],
    n_sd: float = 1,
    suffix: str = "_z",
    weight: str | None = None,
    materialise: bool = False,
) -> DataFrame:
    """Add z-scores over all rows; a constant column gives null.

    Mean and SD come from one aggregate that the planner runs as a scalar subquery, so no
    window over the whole table and no join is needed. With ``weight`` every row stands for
    that many rows, which gives respondent z-scores from counted patterns.

    The rows are needed twice, once for the statistics. By default they are computed twice,
    which suits a scan with broadcast joins; ``materialise`` writes them to the shared folder
    in between, which suits rows that come out of a shuffle.
    """
    df = cut_lineage(df) if materialise else df
    if weight is None:
        parts = {c: (F.avg(known(c)), F.stddev_samp(known(c))) for c in columns}
    else:
        # A row counts for a column only where that column is known.
        of = {c: F.when(known(c).isNotNull(), F.col(weight)) for c in columns}
        means = df.agg(F.struct(*[F.try_divide(F.sum(n * known(c)), F.sum(n)).alias(c) for c, n in of.items()])).scalar()
        parts = {
            c: (
                F.first(means.getField(c)),
                F.sqrt(F.try_divide(F.sum(n * F.pow(known(c) - means.getField(c), 2)), F.sum(n) - 1)),
            )
            for c, n in of.items()
        }
    stats = df.agg(
        F.struct(*[p for c, (m, s) in parts.items() for p in (m.alias(f"m_{c}"), s.alias(f"s_{c}"))])
    ).scalar()
    staged = df.withColumn("_stats", stats)
    scores = {
        f"{c}{suffix}": ratio(F.col(c) - F.col(f"_stats.m_{c}"), F.col(f"_stats.s_{c}") * n_sd) for c in columns
    }
    return staged.withColumns(scores).drop("_stats")


def weighted_share(
    df: DataFrame, within: Sequence[str], category: str, weight: str, total: str = "n", share: str = "pct"
) -> DataFrame:
    """Weighted total per category and its share inside ``within``."""
    totals = df.groupBy(*within, category).agg(F.sum(weight).alias(total))
    # The window sees one row per category, not the respondents.
    return totals.withColumn(share, ratio(total, F.sum(total).over(Window.partitionBy(*within))))


def tabulate(df: DataFrame, column: str, count: str = "n", percent: str = "percent") -> DataFrame:
    """One-way table: rows and share per value, a missing value being its own row."""
    counts = df.groupBy(column).agg(F.count("*").alias(count))
    whole = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(percent, ratio(F.col(count), whole))


def interval(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    width: float = 0.95,
    point: str = "median",
    low: str = "lower",
    high: str = "upper",
) -> DataFrame:
    """Central value and equal-tailed interval per group, quantiles interpolated exactly.

    Meant for posterior draws, whose number per group is set by the fit.
    """
    tail = (1 - width) / 2
    q = F.percentile(F.col(value), F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)))
    grouped = df.groupBy(*by) if by else df.groupBy()
    out = grouped.agg(q.alias("_q"), F.avg(value).alias("_mean"))
    centre = F.col("_mean") if point == "mean" else F.get("_q", F.lit(1))
    return out.select(
        *by, centre.alias("estimate"), F.get("_q", F.lit(0)).alias(low), F.get("_q", F.lit(2)).alias(high)
    )


def observed_levels(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Levels that occur, in level order, renumbered from 1 (unused ones are dropped)."""
    from natal.functions.columns import level_rank

    seen = df.select(column).distinct().withColumn("_rank", level_rank(column, levels)).filter("_rank is not null")
    # At most as many rows as the declared level list.
    ranks = seen.agg(F.array_sort(F.collect_set("_rank"))).scalar()
    return seen.withColumn("level", F.array_position(ranks, F.col("_rank")).cast("int")).drop("_rank")
