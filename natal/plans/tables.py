"""The shared tail of every analysis table: recode, keep complete cases, standardise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from natal import rules
from natal.functions import columns as C
from natal.operators.frame import complete_cases, standardize


def recodes() -> dict[str, Column]:
    """Outcome and banded attributes from the raw survey codes."""
    return {
        "voted_re": C.recode("voted", rules.VOTE_OUTCOME),
        "age_re": C.bands("age", rules.AGE_BANDS),
        "educ99_re": C.sets("educ99", rules.EDUCATION_SETS),
        "faminc_re": C.sets("faminc", rules.INCOME_SETS),
    }


LEVELS: Mapping[str, Sequence[str]] = {
    "age_re": rules.AGE_LEVELS,
    "educ99_re": rules.EDUCATION_LEVELS,
    "faminc_re": rules.INCOME_LEVELS,
}


def analysis_table(
    df: DataFrame, keep: Sequence[str], z_columns: Sequence[str], n_sd: float = 1, materialise: bool = False
) -> DataFrame:
    """Select, recode, drop incomplete rows, then standardise over the rows that are left.

    The order matters: z-scores are over complete respondents, not over countries.
    """
    recoded = df.select(*keep).withColumns(recodes())
    return standardize(complete_cases(recoded), z_columns, n_sd, materialise=materialise)
