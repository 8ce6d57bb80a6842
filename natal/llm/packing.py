"""Best-fit packing of tokenised documents by minimum bin slack.

Only the lengths of pieces decide a packing, and there are at most ``capacity`` different lengths,
so bins are planned on the histogram of lengths. For each bin the largest remaining length is
taken and a bitset subset-sum over the remaining lengths finds the fullest feasible rest. The
combination is then removed as often as the counts allow, which closes that many bins at once.
After each such step some length is left fewer times than the combination held it, so there are
at most sum(capacity / length) steps (about 7,700 for 1024), whatever the size of the input.

Pieces are numbered per length without a global sort: each task numbers its own, and the counts
of (task, length) give the offsets. A piece's number says which bin it belongs to.

Cases: a null text counts as empty; an empty text is a piece that holds only the end token;
repeated and null ids are rows of their own; an empty table gives no rows; other columns are
ignored. Longer documents are cut so that only the first piece can be shorter than ``capacity``.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from natal.llm.bpe import codec
from natal.llm.common import rows_of, tokenizer_path, written

CAPACITY = 1024
END = 2
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
_PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def cuts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document with ``n`` tokens."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """Token pieces of all documents: place in the document, checksum, number within task and length."""
    path = path or tokenizer_path()
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        coder, part = codec(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), rows_of(batch, "text")):
                ids = memoryview(coder.encode(text) + last)
                n = len(ids) // 4
                starts = cuts(n, capacity)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    seen[b - a] += 1
                    for column, v in zip(out, (doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), seen[b - a] - 1)):
                        column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out[0], pa.int64()),
                        pa.array(out[1], pa.int32()),
                        *[pa.array(c, pa.int64()) for c in out[2:5]],
                        pa.array([part] * len(out[0]), pa.int32()),
                        pa.array(out[5], pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _PIECES)


def fullest(counts: Mapping[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum that is at most ``room``.

    Reachable sums are the set bits of one integer. Each stage adds a power-of-two number of
    copies of a length; the bits before each stage lead back to the chosen copies. Large lengths
    come first, and the search ends as soon as the room is filled exactly.
    """
    mask, reach, stages = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            stages.append((length, copies, reach))
            reach |= reach << (length * copies) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, copies, before in reversed(stages):
        if not before >> at & 1:
            at -= length * copies
            chosen[length] = chosen.get(length, 0) + copies
    return chosen


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how often, combination of lengths), in the order in which they are closed."""
    counts, bins = {n: c for n, c in histogram.items() if c}, []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        chosen = fullest(counts, capacity - seed)
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(counts[n] // m for n, m in chosen.items())
        bins.append((times, chosen))
        for n, m in chosen.items():
            counts[n] -= times * m
            if not counts[n]:
                del counts[n]
    return bins


def segments(bins: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first number, first bin, copies per bin, offset in the bin)."""
    rows, used, bin_id = {}, {}, 0
    for times, chosen in bins:
        offset = 0
        for n in sorted(chosen, reverse=True):
            rows.setdefault(n, []).append((used.get(n, 0), bin_id, chosen[n], offset))
            used[n] = used.get(n, 0) + times * chosen[n]
            offset += n * chosen[n]
        bin_id += times
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    cut = written(pieces(docs, capacity, end, path), "pieces")
    counted = written(cut.groupBy("part", "length").count(), "piece-counts")
    # One row per length: at most ``capacity`` rows reach the driver.
    histogram = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("count")).collect()}
    places = segments(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))

    def place(frames):
        for f in frames:
            number = (f["before"] + f["nth"]).to_numpy()
            lengths = f["length"].to_numpy()
            sequence, offset = np.empty(len(f), np.int64), np.empty(len(f), np.int64)
            order = np.argsort(lengths, kind="stable")
            edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                rows = order[a:b]
                n = lengths[rows[0]]
                s = places[n]
                first, bins, copies, at = s[np.searchsorted(s[:, 0], number[rows], side="right") - 1].T
                t = number[rows] - first
                sequence[rows] = bins + t // copies
                offset[rows] = at + t % copies * n
            out = f[["doc_id", "piece", "start", "length", "ids_crc32"]]
            yield out.assign(sequence_id=pd.Series(sequence, out.index), offset=pd.Series(offset, out.index))

    return cut.join(before, ["part", "length"]).mapInPandas(place, _PACKED)
