"""Lossless compression of respondents to covariate patterns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIALS, HITS = "n", "hits"
ROWS_PER_TASK = 250
#: A job of more tasks costs more to run than it gains.
MOST_TASKS = 20_000


def pattern_counts(df: DataFrame, outcome: str, predictors: Sequence[str], group: str | None = None) -> DataFrame:
    """Respondents and positive outcomes per combination of predictors and group.

    The likelihood of a logit depends on these counts only. With country-level predictors a
    survey of any size folds to some thousand rows; with respondent-level predictors the
    result has about as many rows as the survey and everything downstream still works.

    Only rows with a known outcome and known predictors count (NaN is unknown). Models that share
    one table of counts thus see the rows that are complete over all its predictors.
    """
    if {TRIALS, HITS} & {c.lower() for c in [*predictors, group or ""]}:
        raise ValueError(f"{TRIALS!r} and {HITS!r} are taken by the counts; rename the column")
    keys = ([group] if group else []) + [p for p in predictors if p != group]
    return df.na.drop("any", subset=[outcome, *predictors]).groupBy(*keys).agg(F.count(outcome).alias(TRIALS), F.sum(outcome).cast("double").alias(HITS))


def spread_patterns(patterns: DataFrame, rows: int) -> DataFrame:
    """Spread counted patterns over tasks by work instead of by bytes.

    A pattern is a few bytes, but scoring multiplies it with thousands of draws; adaptive
    execution would put all of them into one task. Tasks have ``ROWS_PER_TASK`` patterns each,
    up to ``MOST_TASKS`` tasks, and more patterns each beyond.
    """
    tasks = min(math.ceil(rows / ROWS_PER_TASK), MOST_TASKS)
    if tasks <= 1:
        return patterns
    keys = [c for c in patterns.columns if c not in (TRIALS, HITS)]
    return patterns.repartition(tasks, *keys)
