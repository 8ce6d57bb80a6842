"""Fits kept between runs: found again by what was fitted to which data, not by a name."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.sources.tables import load_or_compute


def fingerprint(df: DataFrame) -> str:
    """Digest of a table's columns and rows, whatever their order and partitioning."""
    columns = sorted(df.columns)
    rows = df.select(F.xxhash64(*columns).alias("h"))
    n, total, mixed = rows.agg(
        F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.sum(F.xxhash64("h").cast("decimal(38,0)"))
    ).first()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return hashlib.sha256(json.dumps([sorted(kinds.items()), n, str(total), str(mixed)]).encode()).hexdigest()


def stored(store: str, patterns: DataFrame, specification: Mapping, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``compute`` makes for this data and specification, from the store if it is there.

    ``specification`` holds all that the result depends on besides the data: outcome, predictors,
    group, priors, draws, seed. One aggregate over the counted patterns finds the entry; on a hit
    nothing is fitted. Half-written entries do not count. Doubles count to the last bit: patterns
    that hold sums of doubles should be a written table, as sums made anew in another order may differ.
    """
    text = json.dumps([fingerprint(patterns), specification], sort_keys=True, default=repr)
    key = hashlib.sha256(text.encode()).hexdigest()[:32]
    return load_or_compute(patterns.sparkSession, f"{store.rstrip('/')}/{key}", compute)
