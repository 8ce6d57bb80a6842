"""One row of each group of near copies: five-word Jaccard similarity of 0.8 or more, exactly.

A text is the set of its five-word shingles. Candidates are found by their SimHashes as in
:mod:`natal.llm.simhash`: the grid join on segment counts gives every pair within ``NEAR`` bits. A
pair at exactly 0.8 differs in ten of 64 bits on average with a standard deviation of three, too
far for grids; such pairs up to ``DISTANCE`` bits, four deviations above, are looked for among texts
that share a band of min-hashes, which one at 0.8 misses with probability (1 - 0.8^5)^28 = 1.5e-5.
Candidates of both kinds are joined to groups, and inside each group the sets of all members are
compared, so no pair below the threshold is ever linked.

Cases: null text counts as empty; texts without words are one class; a text with fewer than five
words is one shingle; equal sets are one class and compared once. A full group is dealt to tasks
as pairs of blocks, and a block pair yields a spanning forest of its links. A group keeps the row of its
smallest id; a group of null ids only keeps one row; of rows repeated with their id any equal one stays;
texts of any length are compared whole; an empty table gives no rows; all columns stay, also those of
clashing names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from natal.llm import simhash
from natal.llm.common import extended, packed, rows_of, tasks, written
from natal.llm.components import components

SHINGLE = 5
#: Bits that the grid join finds in full, and the runs of segments that its grids are made of.
NEAR, RUNS = 4, 6
DISTANCE = 22
#: Bands of min-hashes, and min-hashes in each.
BANDS, ROWS = 28, 5
#: Members of a group that one task compares with as many others.
BLOCK = 256
#: Lookups up to this many bytes are broadcast.
SMALL = 64 << 20
_XOR, _TIMES = np.array([[xxhash.xxh64_intdigest(f"{k} {i}", simhash.SEED) for i in range(BANDS * ROWS)] for k in "xt"], dtype=np.uint64)
_TIMES |= np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted different hashes of the five-word shingles."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def bands(h: np.ndarray) -> list[int]:
    """A signed number per band of min-hashes; none for an empty set."""
    if not len(h):
        return []
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), 512):
        np.minimum(low, ((h[None, at : at + 512] ^ _XOR[:, None]) * _TIMES[:, None]).min(axis=1), out=low)
    return [_signed(xxhash.xxh64_intdigest(b.tobytes(), simhash.SEED)) for b in low.reshape(BANDS, ROWS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def alike(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that span all pairs of filled sets with a Jaccard similarity of 0.8 or more."""
    none = np.empty(0, int)
    if len(sets) < 2:
        return none, none
    sizes = np.array([len(s) for s in sets])
    start = np.r_[0, np.cumsum(sizes)]
    of = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held, left, right = np.zeros(of.max() + 1, dtype=bool), [none], [none]
    for i in range(len(sets) - 1):
        mine, rest = of[start[i] : start[i + 1]], start[i + 1]
        held[mine] = True
        common = np.add.reduceat(held[of[rest:]], start[i + 1 : -1] - rest, dtype=np.int64)
        held[mine] = False
        hit = np.flatnonzero(9 * common >= 4 * (sizes[i] + sizes[i + 1 :]))  # c / (a + b - c) >= 4 / 5
        left.append(np.full(len(hit), i))
        right.append(hit + i + 1)
    root = simhash._forest(len(sets), np.concatenate(left), np.concatenate(right))
    node = np.flatnonzero(root != np.arange(len(sets)))
    return node, root[node]


def _printed(docs: DataFrame) -> DataFrame:
    """(row, n, key, fp, bands): a number for each row, and what is seen of its shingle set."""
    keep = ("row", "n")

    def run(batches):
        for batch in batches:
            key, fp, cells = [], [], []
            for text in rows_of(batch, "text"):
                h = shingle_set(text)
                key.append(_signed(xxhash.xxh64_intdigest(h.tobytes(), simhash.SEED)))
                fp.append(_signed(simhash.simhash(h)))
                cells.append(bands(h))
            made = [pa.array(key, pa.int64()), pa.array(fp, pa.int64()), pa.array(cells, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], [*keep, "key", "fp", "bands"])

    df = packed(docs).withColumn("n", F.monotonically_increasing_id())
    return df.mapInArrow(run, extended(df, keep, key=LongType(), fp=LongType(), bands=ArrayType(LongType())))


def exact_links(members: DataFrame) -> DataFrame:
    """(a, b) bigint: links between the keys of ``members`` (group, pair, key, text) inside each group and pair."""

    def found(keys, sets):
        a, b = alike(sets)
        if len(a):
            keys = np.array(keys, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[a]), pa.array(keys[b])], ["a", "b"])

    def run(batches):
        at, keys, sets = None, [], []
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("group", "pair", "key")))
            for (group, pair, key), text in zip(places, rows_of(batch, "text")):
                if (group, pair) != at:
                    yield from found(keys, sets)
                    at, keys, sets = (group, pair), [], []
                h = shingle_set(text)
                if len(h):
                    keys.append(key)
                    sets.append(h)
        yield from found(keys, sets)

    return members.mapInArrow(run, "a bigint, b bigint")


def near_classes(printed: DataFrame, doc_id, block: int = BLOCK) -> DataFrame:
    """(key, first_id, component, component_id) for every different shingle set of ``printed``."""
    spark = printed.sparkSession
    least = printed.groupBy("key").agg(F.min(doc_id).alias("first_id"), F.min("n").alias("n"))
    classes = written(printed.select("n", "fp", "bands").join(least, "n"), "near-classes")
    near = simhash.near_links(classes.select("fp").distinct(), RUNS, distance=NEAR)
    cells = classes.select("fp", F.posexplode("bands").alias("grid", "cell"))
    far = simhash.links_in_cells(cells, distance=DISTANCE)
    maybe = components(near.unionByName(far), "near-candidates").withColumnRenamed("node", "fp")
    grouped = classes.select("n", "key", "fp").join(maybe, "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(grouped.select("n", "key", "group").join(sizes, "group"), "near-members")
    small = members.count() * 64 <= SMALL
    texts = printed.select("n", F.col("row.text").alias("text")).join(F.broadcast(members) if small else members, "n")
    texts = texts.withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    texts = texts.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("own")) * F.col("parts") + F.greatest(j, F.col("own")))
    dealt = texts.select("group", F.explode(others).alias("pair"), "key", "text")
    dealt = dealt.repartition(tasks(spark), "group", "pair").sortWithinPartitions("group", "pair")
    of = components(exact_links(dealt), "near-links").withColumnRenamed("node", "key")
    reached = classes.select("key", "first_id").join(of, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = reached.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return reached.join(named, "component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, chosen as ``simhash.one_of_each`` chooses."""
    printed = written(_printed(docs), "near-rows")
    doc_id = F.col("row.doc_id").cast("bigint")
    classes = near_classes(printed, doc_id).withColumnRenamed("key", "fp")
    return simhash.first_rows(printed.select("row", F.col("key").alias("fp")), classes, doc_id)
