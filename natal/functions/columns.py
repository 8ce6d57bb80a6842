"""Column expressions that keep missing-value rules explicit. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_set(c: Column | str, values: Iterable) -> Column:
    """Membership that is false, not null, for a missing value."""
    return F.coalesce(as_column(c).isin(*values), F.lit(False))


def not_in(c: Column | str, values: Iterable) -> Column:
    """Exclusion that keeps rows whose value is missing."""
    return ~in_set(c, values)


def unless(condition: Column) -> Column:
    """Negated conjunction for filters: rows where ``condition`` is unknown are dropped."""
    return ~condition


def null_if(c: Column | str, *sentinels) -> Column:
    """Replace sentinel codes with null."""
    c = as_column(c)
    return F.when(~in_set(c, sentinels), c)


def null_where(c: Column | str, condition: Column) -> Column:
    """Null where ``condition`` holds; an unknown condition also gives null."""
    return F.when(~condition, as_column(c))


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice that stays null where the condition is null."""
    return F.when(condition, yes).when(~condition, no)


def bands(c: Column | str, rules: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """Label closed ranges ``(label, low, high)``; values outside all of them give null."""
    c = as_column(c)

    def test(low, high):
        parts = [c >= low] if low is not None else []
        parts += [c <= high] if high is not None else []
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    return _first_match([(test(low, high), F.lit(label)) for label, low, high in rules])


def sets(c: Column | str, rules: Mapping[str, Iterable]) -> Column:
    """Label explicit code sets; unlisted codes give null."""
    c = as_column(c)
    return _first_match([(c.isin(*codes), F.lit(label)) for label, codes in rules.items()])


def recode(c: Column | str, mapping: Mapping) -> Column:
    """Map single values; unlisted ones give null."""
    c = as_column(c)
    return _first_match([(c == key, F.lit(value)) for key, value in mapping.items()])


def override(c: Column | str, by: Column | str, mapping: Mapping) -> Column:
    """``c``, replaced wherever ``by`` names a key of ``mapping``."""
    return F.coalesce(recode(by, mapping), as_column(c))


def _first_match(cases: list[tuple[Column, Column]]) -> Column:
    (condition, value), *rest = cases
    return reduce(lambda acc, case: acc.when(*case), rest, F.when(condition, value))


def in_levels(c: Column | str, levels: Sequence) -> Column:
    """Keep values of a closed domain, null the others."""
    c = as_column(c)
    return F.when(c.isin(*levels), c)


def level_rank(c: Column | str, levels: Sequence[str]) -> Column:
    """1-based position in the level order; 1 is the reference level, unknown gives null."""
    rank = F.array_position(F.array(*[F.lit(v) for v in levels]), as_column(c))
    return F.when(rank > 0, rank.cast("int"))


def to_number(c: Column | str, dtype: str = "double") -> Column:
    """Text to number; text that is no number gives null."""
    return as_column(c).try_cast(dtype)


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division with null for a zero divisor."""
    return F.try_divide(as_column(num), as_column(den))


def log(c: Column | str) -> Column:
    """Natural log; zero and below give null."""
    return F.log(as_column(c))


def known(c: Column | str) -> Column:
    """NaN to null, so that both count as missing."""
    return F.nanvl(as_column(c).cast("double"), F.lit(None).cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Apply :func:`known` to every floating column, once, at ingest."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({name: known(F.col(f"`{name}`")) for name in floating})


def mean(c: Column | str) -> Column:
    """Mean over known values; null when none is known."""
    return F.avg(known(c))


def excludes_zero(low: Column | str, high: Column | str) -> Column:
    """Flag an interval that lies wholly on one side of zero."""
    return if_else((as_column(low) > 0) | (as_column(high) < 0), F.lit("sig"), F.lit("insig"))
