"""Posterior draws.

A draw is generated from its number and a seed alone, so any task can produce any draw, and
a task that runs again produces the same one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from natal.models.logit import LogitFit

DRAWS = 4000  # fixed value: 4 chains of 1000 kept draws


@dataclass(frozen=True)
class DrawMatrix:
    """Coefficient draws as an array: one row per draw, intercept first.

    Its size is draws times terms, set by the model and not by the data: 4,000 draws of 5,000 terms
    are 160 MB. ``component`` and ``centre`` serve models with group effects.
    """

    terms: tuple[str, ...]
    values: np.ndarray
    component: np.ndarray | None = None
    centre: np.ndarray | None = None
    seed: int = 42

    def __len__(self) -> int:
        return len(self.values)

    @property
    def predictors(self) -> tuple[str, ...]:
        return self.terms[1:]


def normals(seed: int, stream: int | str, shape: tuple[int, ...]) -> np.ndarray:
    """Standard normals of a named stream, by the Box-Muller transform of message digests.

    Number ``i, j`` hangs on seed, stream, ``i`` and ``j`` alone and on published formulas, so any
    engine with md5 makes the same ones.
    """
    head = hashlib.md5(f"{seed}:{stream}".encode())
    out = np.empty((2, math.prod(shape)), dtype=np.int64)
    for k, place in enumerate(np.ndindex(shape)):
        digest = head.copy()
        digest.update("".join(f":{p}" for p in place).encode())
        text = digest.hexdigest()
        out[0, k], out[1, k] = int(text[:13], 16), int(text[13:26], 16)
    u, v = (out + [[0.5], [0.0]]) / 2.0**52
    return (np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)).reshape(shape)


def uniforms(seed: int, stream: int | str, n: int) -> np.ndarray:
    """Numbers between 0 and 1 of a named stream, from message digests as in :func:`normals`."""
    digests = (hashlib.md5(f"{seed}:{stream}:{i}".encode()).hexdigest() for i in range(n))
    return (np.array([int(d[:13], 16) for d in digests], dtype=np.int64) + 0.5) / 2.0**52


def normal_column(seed: int, stream: Column, number: Column) -> Column:
    """:func:`normals` as a column: number ``number`` of the stream that ``stream`` names."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), stream.cast("string"), F.lit(":"), number.cast("string")).cast("binary"))

    def part(start):
        return F.conv(F.substring(digest, start, 13), 16, 10).cast("double")

    u, v = (part(1) + 0.5) / 2.0**52, part(14) / 2.0**52
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def draw_matrix(fit: LogitFit, n: int = DRAWS, seed: int = 42) -> DrawMatrix:
    """Normal approximation around the posterior mode."""
    z = normals(seed, 0, (n, len(fit.terms)))
    return DrawMatrix(fit.terms, fit.mode + z @ np.linalg.cholesky(fit.cov).T, seed=seed)


def draws_table(spark: SparkSession, draws: DrawMatrix, model: str) -> DataFrame:
    """Long table ``(model, draw, term, value)``, produced by the tasks."""
    shared = spark.sparkContext.broadcast(draws.values)  # draws times terms
    terms = draws.terms

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["draw"].to_numpy()
            yield pd.DataFrame(
                {
                    "draw": np.repeat(ids, len(terms)),
                    "term": np.tile(np.array(terms, dtype=object), len(ids)),
                    "value": shared.value[ids].ravel(),
                }
            )

    ids = spark.range(len(draws)).withColumnRenamed("id", "draw")
    long = ids.mapInPandas(emit, "draw bigint, term string, value double")
    return long.select(F.lit(model).alias("model"), "draw", "term", "value")


def matrix_from_table(draws: DataFrame, terms: Sequence[str]) -> DrawMatrix:
    """Stored long draws ``(draw, term, value)`` of one model back to an array.

    Rows come one array per draw, so the driver holds draws times terms numbers and no more.
    """
    pairs = F.map_from_entries(F.collect_list(F.struct("term", "value")))
    values = F.array(*[F.element_at("pairs", F.lit(t)) for t in terms])
    wide = draws.filter(F.col("term").isin(*terms)).groupBy("draw").agg(pairs.alias("pairs")).select("draw", values.alias("v"))
    rows = sorted(wide.collect(), key=lambda r: r["draw"])
    return DrawMatrix(tuple(terms), np.array([r["v"] for r in rows], dtype=float).reshape(len(rows), len(terms)))
