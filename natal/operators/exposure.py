"""Source-country conditions in the years before a respondent's reference year.

A respondent's exposure depends only on the country and the reference year. So the panel is
expanded to the reference years it can serve and averaged there, and respondents look the
result up: the fact table is neither multiplied nor shuffled by the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.functions.columns import known, ratio
from natal.operators.joins import lookup_join


def exposure_rows(
    respondents: DataFrame,
    panel: DataFrame,
    code: str,
    reference_year: str,
    window: int,
    panel_year: str = "src_year",
    rows: int | None = None,
) -> DataFrame:
    """One row per respondent and panel year in ``reference_year - window .. reference_year``.

    The band is spelled out as years, which makes it an equi-join on country and year.
    Respondents without a panel row in the window drop out.
    """
    ref = F.col(reference_year)
    spelled = respondents.withColumn(panel_year, F.explode(F.sequence(ref - window, ref)))
    return lookup_join(spelled, panel, [code, panel_year], "inner", rows).withColumn("year_diff", F.col(panel_year) - ref)


def exposure_sums(
    panel: DataFrame,
    code: str,
    variables: Sequence[str],
    reference_year: str,
    window: int,
    panel_year: str = "src_year",
) -> DataFrame:
    """Per country and reference year: sum and number of known values of each variable.

    Also the first panel year in the window and the number of panel rows. At most
    ``window + 1`` times as many rows as the panel.
    """
    y = F.col(panel_year)
    served = panel.withColumn(reference_year, F.explode(F.sequence(y, y + window)))
    parts = [
        part
        for v in variables
        for part in (F.sum(known(v)).alias(f"_sum_{v}"), F.count(known(v)).alias(f"_n_{v}"))
    ]
    return (
        served.filter(F.col(code).isNotNull())
        .groupBy(code, reference_year)
        .agg(F.min(panel_year).alias("_first_year"), F.count("*").alias("_rows"), *parts)
    )


def exposure_mean(
    respondents: DataFrame,
    panel: DataFrame,
    respondent: str,
    code: str,
    reference_year: str,
    variables: Sequence[str],
    window: int,
    panel_year: str = "src_year",
    prefix: str = "fuzzy_",
    unique: bool = False,
) -> DataFrame:
    """Mean exposure per respondent, one row each, with the respondent's own columns.

    ``year_diff`` is that of the earliest panel year. ``unique=True`` states that
    ``respondent`` never repeats and saves the only shuffle of the fact table; otherwise
    repeated respondents pool all their years and keep the columns of their earliest one.
    """
    sums = exposure_sums(panel, code, variables, reference_year, window, panel_year)
    diff = (F.col("_first_year") - F.col(reference_year)).cast("int").alias("year_diff")
    carried = [*respondents.columns, "year_diff"]
    if unique:
        means = [ratio(f"_sum_{v}", f"_n_{v}").alias(f"{prefix}{v}") for v in variables]
        ready = sums.select(code, reference_year, diff, *means, F.col("_rows").alias("n_years"))
        joined = lookup_join(respondents, ready, [code, reference_year], "inner", grows=window + 1)
        return joined.select(*carried, *[f"{prefix}{v}" for v in variables], "n_years")
    joined = lookup_join(respondents, sums, [code, reference_year], "inner", grows=window + 1).select("*", diff)
    others = [c for c in carried if c != respondent]
    order = F.struct("_first_year", *[F.col(c) for c in others])
    first = F.min_by(F.struct(*others), order).alias("_first")
    means = [
        ratio(F.sum(f"_sum_{v}"), F.sum(f"_n_{v}")).alias(f"{prefix}{v}") for v in variables
    ]
    grouped = joined.groupBy(respondent).agg(first, *means, F.sum("_rows").alias("n_years"))
    return grouped.select(
        *[F.col(respondent) if c == respondent else F.col(f"_first.{c}").alias(c) for c in carried],
        *[f"{prefix}{v}" for v in variables],
        "n_years",
    )


def exposure_first(
    respondents: DataFrame,
    panel: DataFrame,
    code: str,
    reference_year: str,
    window: int,
    panel_year: str = "src_year",
) -> DataFrame:
    """Each respondent with the earliest panel row of the window.

    The earliest row hangs on country and reference year alone, so it is found on the panel,
    expanded to the years it serves, and looked up: respondents are neither multiplied nor
    shuffled. Of several panel rows of one year the one that sorts first by its other columns
    counts. Respondents without a panel row in the window drop out.
    """
    rest = [c for c in panel.columns if c not in (code, panel_year)]
    served = panel.filter(F.col(code).isNotNull()).withColumn(
        reference_year, F.explode(F.sequence(F.col(panel_year), F.col(panel_year) + window))
    )
    first = F.min(F.struct(panel_year, *rest)).alias("_first")
    found = served.groupBy(code, reference_year).agg(first).select(code, reference_year, "_first.*")
    joined = lookup_join(respondents, found, [code, reference_year], "inner", grows=window + 1)
    return joined.withColumn("year_diff", F.col(panel_year) - F.col(reference_year))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per group in a stated order, by partial aggregation instead of a sort.

    A null order value counts as last; ties fall to the remaining columns.
    """
    rest = [c for c in df.columns if c not in keys]
    ranks = [part for c in order for part in (F.col(c).isNull(), F.col(c))]
    pick = F.min_by(F.struct(*rest), F.struct(*ranks, *[F.col(c) for c in rest if c not in order]))
    return df.groupBy(*keys).agg(pick.alias("_first")).select(*keys, "_first.*")
