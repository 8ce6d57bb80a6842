"""Column selection and naming. Works on the schema only, never on rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snake_case(name: str) -> str:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.replace("%", "_percent_").replace("#", "_number_"))
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", spaced)
    cleaned = re.sub(r"[^0-9a-z]+", "_", spaced.lower()).strip("_") or "x"
    return f"x{cleaned}" if cleaned[0].isdigit() else cleaned


def clean_names(names: Sequence[str]) -> list[str]:
    """Snake case; later duplicates get ``_2``, ``_3`` and so on, past names that are taken."""
    cleaned = [snake_case(n) for n in names]
    seen, taken, out = dict.fromkeys(cleaned, 0), set(cleaned), []
    for name in cleaned:
        seen[name] += 1
        new = name
        if seen[name] > 1:
            while (new := f"{name}_{seen[name]}") in taken:
                seen[name] += 1
        taken.add(new)
        out.append(new)
    return out


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def containing(df: DataFrame, text: str) -> list[str]:
    """Columns whose name holds ``text``."""
    return [c for c in df.columns if text in c]


def positions(df: DataFrame, first: int, last: int) -> list[str]:
    """Columns by 1-based position, both ends included."""
    return df.columns[first - 1 : last]


def select_renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select ``{new: old}``."""
    return df.select([F.col(f"`{old}`").alias(new) for new, old in mapping.items()])


def first_then_rest(df: DataFrame, *first: str) -> DataFrame:
    """Move some columns to the front."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def period_name(variable: str, start: int, end: int) -> str:
    """``lagged_<variable>_<yy><yy>``."""
    return f"lagged_{variable}_{start % 100:02d}{end % 100:02d}"
