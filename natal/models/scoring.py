"""Rows times draws, batch by batch inside the tasks.

The product of rows and draws is never a table: each task multiplies an Arrow batch with the
draw array and hands on only what the caller reduces it to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.models.draws import DrawMatrix, normals

CELLS_PER_BLOCK = 4_000_000
STREAM = "_natal_stream"
MODES, CURVES, CROSS = "_natal_modes", "_natal_curves", "_natal_cross"


def logistic(eta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))


def log_lik(eta: np.ndarray, y: int) -> np.ndarray:
    signed = eta if y else -eta
    return np.minimum(signed, 0.0) - np.log1p(np.exp(-np.abs(signed)))


def group_offsets(block: pd.DataFrame, draws: DrawMatrix, prefix: str = "") -> np.ndarray:
    """Draws of each row's group effect, given the coefficient draws.

    Every group has its own random stream, so all its rows see the same draws wherever
    they are processed.
    """
    streams = block[STREAM].to_numpy().astype(str)
    kinds, where = np.unique(streams, return_inverse=True)
    first = np.array([np.flatnonzero(where == i)[0] for i in range(len(kinds))])
    s = draws.component
    shift = draws.values - draws.centre[s]
    out = np.empty((len(kinds), len(draws)))
    for i, row in enumerate(first):
        mode = np.asarray(block[prefix + MODES].iloc[row], dtype=float)
        curve = np.asarray(block[prefix + CURVES].iloc[row], dtype=float)
        cross = np.asarray(block[prefix + CROSS].iloc[row], dtype=float).reshape(len(mode), -1)
        noise = normals(draws.seed, kinds[i], (len(draws),))
        out[i] = mode[s] - np.einsum("dk,dk->d", cross[s], shift) / curve[s] + noise / np.sqrt(curve[s])
    return out[where]


def eta_of(block: pd.DataFrame, draws: DrawMatrix, prefix: str = "") -> np.ndarray:
    """Linear predictor, one row per data row and one column per draw."""
    x = np.column_stack([np.ones(len(block)), *[block[p].to_numpy(dtype=float) for p in draws.predictors]])
    eta = x @ draws.values.T
    if draws.component is not None and prefix + MODES in block:
        eta = eta + group_offsets(block, draws, prefix)
    return eta


def blocks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Slices small enough that rows times draws stays within a fixed amount of memory."""
    rows = max(1, CELLS_PER_BLOCK // max(width, 1))
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


def map_blocks(
    df: DataFrame,
    draws: DrawMatrix | Mapping[str, DrawMatrix],
    reduce: Callable[[Iterator[pd.DataFrame], object], Iterator[pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Run ``reduce`` over memory-bounded blocks with the draws shipped once per executor."""
    shared = df.sparkSession.sparkContext.broadcast(draws)  # draws times terms per model
    width = max(len(d) for d in draws.values()) if isinstance(draws, Mapping) else len(draws)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from reduce(blocks(batches, width), shared.value)

    return df.mapInPandas(run, schema)


def with_stream(df: DataFrame, group: str) -> DataFrame:
    return df.withColumn(STREAM, F.concat(F.lit("group "), F.col(group).cast("string")))
