"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into segments of two bits and mapped to the bit count of each. Counts
differ in Manhattan distance by at most the number of differing bits, so that distance is a lower
bound. Written in unary inside its segment (0, 1, 2 as 00, 01, 11), a vector of counts is again
64 bits wide and the Manhattan distance of two vectors is the number of differing bits.

The range join works on grids: the count vector is cut into ``BLOCKS`` runs of segments. Vectors
at distance 3 or less agree in all but three runs, so they share the cell of at least one grid
that keeps ``BLOCKS - 3`` runs. Inside a cell the bound is checked first, then the bits exactly.
Only different fingerprints take part. A full cell is dealt to tasks as pairs of blocks, and a
block pair yields a spanning forest of its links, so what is emitted grows with the members.

Cases: null text counts as empty; texts without words have fingerprint zero, linked like any
other; a null doc_id takes its class's component and never names one; repeated rows share a class; texts of any
length are fingerprinted whole; an empty table gives an empty result; extra columns, also of clashing
names, are ignored, or kept where rows are chosen.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from natal.llm.common import extended, packed, rows_of, tasks, written
from natal.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
#: Members of a cell that one task compares with as many others.
BLOCK = 2048
#: Cells up to this size are compared side by side in one go.
FEW = 32
_LOW = 0x5555555555555555


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of lower-cased (A-Z) words split at ASCII white space, with repeats."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")


def simhash(h: np.ndarray) -> int:
    """SimHash of shingle hashes; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of a text."""
    return simhash(shingle_hashes(text, size))


def fingerprints(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = SHINGLE) -> DataFrame:
    """``keep`` and ``fp``: the fingerprint of ``text`` as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, size) for t in rows_of(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(fp)], [*keep, "fp"])

    return df.select(*keep, "text").mapInArrow(run, extended(df, keep, fp=LongType()))


def grids(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of the segments that each grid keeps, as signed numbers."""
    runs = [list(r) for r in np.array_split(np.arange(32), blocks)]
    masks = [sum(3 << 2 * int(s) for r in keep for s in r) for keep in combinations(runs, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def counts_in_unary(fp):
    """The count vector of a fingerprint column: each pair of bits becomes its count in unary."""
    low = F.lit(_LOW)
    either = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(low)
    both = fp.bitwiseAND(F.shiftrightunsigned(fp, 1)).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _unary(fp: np.ndarray) -> np.ndarray:
    low, one = np.uint64(_LOW), np.uint64(1)
    return ((fp | fp >> one) & low) | ((fp & fp >> one & low) << one)


def _near(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Bound on the counts first, then the bits of what is left."""
    near = np.bitwise_count(ua ^ ub) <= distance
    near[near] = np.bitwise_count((a ^ b)[near]) <= distance
    return near


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member that each of ``n`` nodes reaches over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _cell_links(fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is near among the fingerprints of a full cell or block pair."""
    u, left, right = _unary(fp), [], []
    for i in range(len(fp) - 1):
        hit = np.flatnonzero(_near(fp[i], fp[i + 1 :], u[i], u[i + 1 :], distance)) if len(fp) > 1 else []
        left.append(np.full(len(hit), i))
        right.append(hit + i + 1)
    if not left:
        return np.empty(0, int), np.empty(0, int)
    root = _forest(len(fp), np.concatenate(left), np.concatenate(right))
    node = np.flatnonzero(root != np.arange(len(fp)))
    return node, root[node]


def _links(keys: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys."""
    edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
    sizes = np.diff(edges)
    run = np.repeat(np.arange(len(sizes)), sizes)
    few = sizes[run] <= FEW
    u, out = _unary(fp), []
    for s in range(1, min(FEW, int(sizes.max(initial=1)))):
        i = np.flatnonzero(few[:-s] & (run[:-s] == run[s:]))
        if not len(i):
            break
        i = i[_near(fp[i], fp[i + s], u[i], u[i + s], distance)]
        out.append((fp[i], fp[i + s]))
    for k in np.flatnonzero(sizes > FEW):
        members = fp[edges[k] : edges[k + 1]]
        a, b = _cell_links(members, distance)
        out.append((members[a], members[b]))
    none = np.empty(0, np.uint64)
    return (np.concatenate([none, *(a for a, _ in out)]), np.concatenate([none, *(b for _, b in out)]))


def near_links(prints: DataFrame, blocks: int = BLOCKS, block: int = BLOCK, distance: int = DISTANCE) -> DataFrame:
    """(a, b) bigint: links whose components are those of all pairs at ``distance`` or less.

    ``prints`` holds different fingerprints in ``fp``.
    """
    masks = F.array(*[F.lit(m) for m in grids(blocks, distance)])
    cells = prints.select("fp", F.posexplode(F.transform(masks, lambda m: counts_in_unary(F.col("fp")).bitwiseAND(m))).alias("grid", "cell"))
    return links_in_cells(cells, block, distance)


def links_in_cells(cells: DataFrame, block: int = BLOCK, distance: int = DISTANCE) -> DataFrame:
    """(a, b) bigint: links that span the pairs at ``distance`` or less that share a (grid, cell)."""
    spark = cells.sparkSession
    full = cells.groupBy("grid", "cell").count().filter(F.col("count") > block)
    parts = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    dealt = cells.join(full, ["grid", "cell"], "left").withColumn("parts", parts)
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # A member of block k meets blocks 0..k as the later one and k..parts-1 as the earlier one.
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("own")) * F.col("parts") + F.greatest(j, F.col("own")))
    dealt = dealt.withColumn("own", own).select("grid", "cell", F.explode(others).alias("pair"), "fp")
    dealt = dealt.repartition(tasks(spark), "grid", "cell", "pair").sortWithinPartitions("grid", "cell", "pair")

    def run(batches):
        held = None
        for batch in batches:
            part = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("grid", "cell", "pair", "fp")])
            held = part if held is None else np.concatenate([held, part])
            whole = np.flatnonzero((held[:, :3] != held[-1, :3]).any(axis=1))
            cut = whole[-1] + 1 if len(whole) else 0
            if cut:
                yield from found(held[:cut])
                held = held[cut:]
        if held is not None and len(held):
            yield from found(held)

    def found(rows):
        a, b = _links(rows[:, :3], np.ascontiguousarray(rows[:, 3]).view(np.uint64), distance)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _classes(printed: DataFrame, doc_id) -> DataFrame:
    """(fp, first_id, component, component_id) for every different fingerprint of ``printed``."""
    classes = written(printed.groupBy("fp").agg(F.min(doc_id).alias("first_id")), "simhash-classes")
    of = components(near_links(classes.select("fp")), "simhash-links").withColumnRenamed("node", "fp")
    reached = classes.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = reached.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return reached.join(named, "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    printed = written(fingerprints(docs), "simhash")
    classes = _classes(printed, F.col("doc_id")).select("fp", "component_id")
    return printed.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest doc_id.

    A component without any id keeps a row of its smallest fingerprint; of rows that share the
    smallest id, the smallest fingerprint, and of equal ones any, stays.
    """
    printed = written(fingerprints(packed(docs), ("row",)), "simhash-rows")
    doc_id = F.col("row.doc_id").cast("bigint")
    return first_rows(printed, _classes(printed, doc_id), doc_id)


def first_rows(printed: DataFrame, classes: DataFrame, doc_id) -> DataFrame:
    """Of ``printed`` (row, fp) one row of each component of ``classes``, as ``one_of_each`` chooses."""
    classes = classes.filter(F.col("first_id").eqNullSafe(F.col("component_id")))
    winners = classes.groupBy("component").agg(F.min("fp").alias("fp"), F.first("component_id").alias("stays"))
    kept = printed.join(winners.select("fp", "stays"), "fp").filter(doc_id.eqNullSafe(F.col("stays"))).select("fp", "row")
    # Only rows repeated with id and fingerprint are left to choose from: seldom any.
    again = kept.groupBy("fp").count().filter("count > 1").select("fp", F.lit(True).alias("again"))
    marked = kept.join(again, "fp", "left")
    number = F.row_number().over(Window.partitionBy("fp").orderBy(F.xxhash64("row.text")))
    once = marked.filter("again").withColumn("number", number).filter("number = 1").select("row")
    return marked.filter("again is null").select("row").unionByName(once).select("row.*")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """The query's columns: the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
