"""Hard negatives of anchors by segment summaries.

A vector is cut into segments, and of each its mean and its deviation (the length of what is left
when the mean is taken off) are stored with the row. For two vectors a and b and a segment of w
components

    w * mean_a * mean_b - dev_a * dev_b  <=  a . b  <=  w * mean_a * mean_b + dev_a * dev_b

so sums over segments bound the score. Neighbouring segments merge into wider ones, which makes the
bounds a hierarchy: pairs are tested with one segment, the survivors with four, theirs with sixteen,
and only what is left is scored exactly. A pair goes only when its bounds prove that it can be in
no result, so results are exact.

Plan. Anchors and rows form a grid: anchors are dealt to blocks of bounded size, rows to as many
groups as give every task a cell. A cell holds one block of anchors in memory and streams the rows of
its group past it, keeping the best of each anchor so far; what it has kept tightens the bounds for
later rows. A cell returns at most ``k`` rows per anchor (per positive), and a window over those few
gives the result. Two passes: positives first, then the negatives inside each positive's range.

Rows that take no part: null id, null label, null vector, a null or non-finite component (times 256
as well). Vectors of unequal length are scored over the components that both have. Components are
integers of any size; a score beyond 64 bits counts as the nearest that fits. Repeated rows
are rows of their own, except that an anchor repeated as a whole gives its result once; rows with
the anchor's id are neither its positives nor its negatives. An anchor without positives, or a positive
without negatives, gives no row. An empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from natal.llm.common import tasks, written

ANCHORS_OF, SHIFTED_OF, CLASSES, SCALE = 100, 7, 10, 256.0
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of its positive's.
LOW, HIGH = 30, 90
#: Segments at the levels of the hierarchy; each divides the next.
LEVELS = (1, 4, 16)
#: Anchors of a block, and bytes of their components at most; cells of the score matrix at a time.
BLOCK, BLOCK_BYTES, CELLS = 8192, 64 << 20, 1 << 22
#: Rows that a cell takes first, so that its thresholds stand early; then twice as many each time.
FIRST_ROWS = 256
_64 = (1 << 63) - 1


# Summaries


def summaries(q: np.ndarray, segments: int = LEVELS[-1]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment of some vectors, whose length ``segments`` divides."""
    parts = q.reshape(len(q), segments, -1)
    with np.errstate(over="ignore", invalid="ignore"):
        mean = parts.mean(axis=2) if parts.shape[2] else np.zeros(parts.shape[:2])
        return mean, np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))


def merged(mean: np.ndarray, dev: np.ndarray, width: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of fewer, wider segments from those of narrow ones of ``width`` components."""
    m, d = mean.reshape(len(mean), segments, -1), dev.reshape(len(dev), segments, -1)
    wide = m.mean(axis=2)
    return wide, np.sqrt((d**2).sum(axis=2) + width * ((m - wide[:, :, None]) ** 2).sum(axis=2))


class Side:
    """Vectors of one side of a cell with their summaries at each level."""

    def __init__(self, q: np.ndarray, mean: np.ndarray, dev: np.ndarray):
        self.q = q
        width = q.shape[1] // LEVELS[-1]
        self.width = {s: q.shape[1] // s for s in LEVELS}
        self.levels = {s: merged(mean, dev, width, s) for s in LEVELS}
        one = self.levels[LEVELS[0]]
        # Room for rounding: a hair of the product of lengths.
        self.slack = np.sqrt(q.shape[1]) * np.abs(one[0][:, 0]) + one[1][:, 0]
        self.top = float(np.abs(q).max(initial=0))

    def take(self, rows) -> Side:
        out = object.__new__(Side)
        out.q, out.width, out.top = self.q[rows], self.width, self.top
        out.slack = self.slack[rows]
        out.levels = {s: (m[rows], d[rows]) for s, (m, d) in self.levels.items()}
        return out


def bounds(a: Side, b: Side, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of every pair, all of ``a`` by all of ``b``."""
    (ma, da), (mb, db) = a.levels[level], b.levels[level]
    middle, spread = a.width[level] * (ma @ mb.T), da @ db.T
    spread += 1e-9 * np.outer(a.slack, b.slack) + 0.5
    return middle - spread, middle + spread


def pair_bounds(a: Side, b: Side, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of the pairs (i, j)."""
    (ma, da), (mb, db) = a.levels[level], b.levels[level]
    middle = a.width[level] * np.einsum("ps,ps->p", ma[i], mb[j])
    spread = np.einsum("ps,ps->p", da[i], db[j]) + 1e-9 * a.slack[i] * b.slack[j] + 0.5
    return middle - spread, middle + spread


def scores(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the pairs (i, j)."""
    out = np.empty(len(i), np.int64)
    # Every product and every sum is a whole number below 2**53 and so exact in double precision.
    exact = a.top * b.top * max(a.q.shape[1], 1) < 2.0**53
    step = max(1, CELLS // max(a.q.shape[1], 1))
    for at in range(0, len(i), step):
        p, r = i[at : at + step], j[at : at + step]
        if exact:
            out[at : at + step] = np.einsum("pd,pd->p", a.q[p], b.q[r])
        else:
            sums = (sum(int(x) * int(y) for x, y in zip(a.q[k], b.q[l])) for k, l in zip(p, r))
            out[at : at + step] = [max(-_64, min(_64, s)) for s in sums]
    return out


# Cells


class Best:
    """The first ``k`` rows of each slot: greatest score first, then smallest id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        #: Score that a new row must reach in a slot.
        self.least = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, id_ = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.id, id_]
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        kept = rank < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], id_[kept]
        full = rank == self.k - 1
        self.least[slot[full]] = score[full]


class Positives:
    """Search for the best rows of the anchor's own label."""

    def __init__(self, anchors: Side, ids: np.ndarray, labels: np.ndarray, k: int):
        self.anchors, self.ids, self.labels = anchors, ids, labels
        self.best = Best(len(ids), k)

    def rows(self, rows: Side, ids: np.ndarray, labels: np.ndarray) -> None:
        for label in np.intersect1d(self.labels, labels):
            mine, theirs = np.flatnonzero(self.labels == label), np.flatnonzero(labels == label)
            for at in range(0, len(mine), max(1, CELLS // len(theirs))):
                self._block(mine[at : at + max(1, CELLS // len(theirs))], rows.take(theirs), ids[theirs])

    def _block(self, mine: np.ndarray, rows: Side, ids: np.ndarray) -> None:
        some = self.anchors.take(mine)
        low = self.best.least[mine]
        _, top = bounds(some, rows, LEVELS[0])
        i, j = np.nonzero(~(top < low[:, None]) & (self.ids[mine][:, None] != ids[None, :]))
        for level in LEVELS[1:]:
            kept = ~(pair_bounds(some, rows, level, i, j)[1] < low[i])  # bounds that overflow decide nothing
            i, j = i[kept], j[kept]
        score = scores(some, rows, i, j)
        kept = score >= low[i]
        self.best.add(mine[i[kept]], score[kept], ids[j[kept]])


class Negatives:
    """Search for the best rows of other labels inside the range of each positive of an anchor.

    Slot ``anchor * POSITIVES + number`` belongs to one positive.
    """

    def __init__(self, anchors: Side, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.anchors, self.ids, self.labels = anchors, ids, labels
        self.low, self.high = low.astype(float), high.astype(float)  # (anchors, positives); an empty range is (inf, -inf)
        self.exact_low, self.exact_high = low, high
        self.best = Best(low.size, k)

    def _least(self, mine) -> np.ndarray:
        return np.maximum(self.low, self.best.least.reshape(self.low.shape))[mine]

    def rows(self, rows: Side, ids: np.ndarray, labels: np.ndarray) -> None:
        step = max(1, CELLS // max(len(ids), 1))
        for at in range(0, len(self.ids), step):
            mine = np.arange(at, min(at + step, len(self.ids)))
            some, least, most = self.anchors.take(mine), self._least(mine), self.high[mine]
            from_, to = least.min(axis=1), most.max(axis=1)
            low, top = bounds(some, rows, LEVELS[0])
            wanted = ~(top < from_[:, None]) & ~(low > to[:, None]) & (self.labels[mine][:, None] != labels[None, :])
            i, j = np.nonzero(wanted & (self.ids[mine][:, None] != ids[None, :]))
            for level in LEVELS[1:]:
                low, top = pair_bounds(some, rows, level, i, j)
                open_ = (~(top[:, None] < least[i]) & ~(low[:, None] > most[i])).any(axis=1)
                i, j = i[open_], j[open_]
            score = scores(some, rows, i, j)
            for number in range(self.low.shape[1]):
                fits = (score >= self.exact_low[mine[i], number]) & (score <= self.exact_high[mine[i], number]) & (score >= least[i, number])
                self.best.add(mine[i[fits]] * self.low.shape[1] + number, score[fits], ids[j[fits]])


def _side(batch: pa.RecordBatch, dim: int) -> Side:
    """Whole-number components, padded to ``dim``, with the stored summaries."""
    return Side(_components(batch.column("vec"), dim), _wide(batch.column("mean")), _wide(batch.column("dev")))


def _components(lists: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    if len(lists):
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        place = np.arange(dim)[None, :] < size[:, None]
        out[place] = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def _wide(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), LEVELS[-1])


# Spark


def prepare(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, vec, mean, dev) of the rows that take part, written; and the padded length."""
    finite = lambda x: x.isNotNull() & F.coalesce(F.abs(SCALE * x.cast("double")) < float("inf"), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("vec"))
    rows = rows.dropna().filter(F.forall("vec", finite))
    rows = rows.withColumn("label", F.when(F.pmod("vec_id", F.lit(SHIFTED_OF)) == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label")))
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    dim = math.ceil(max(longest, 1) / LEVELS[-1]) * LEVELS[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, dev = summaries(_components(batch.column("vec"), dim))
            offsets = pa.array(np.arange(len(mean) + 1, dtype=np.int32) * LEVELS[-1])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (mean, dev)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "mean", "dev"])

    kind = rows.schema["vec"].dataType.simpleString()
    schema = f"vec_id bigint, label bigint, vec {kind}, mean array<double>, dev array<double>"
    return written(rows.mapInArrow(run, schema), "vectors"), dim


def _grid(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int) -> DataFrame:
    """Both sides of every cell, sorted so that a cell's anchors come before its rows."""
    number = F.monotonically_increasing_id()  # of a written table, so the same in every attempt
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = anchors.withColumn("g", group).withColumn("cell", F.col("block") * groups + F.col("g")).drop("block", "g")
    right = rows.withColumn("g", F.pmod(F.xxhash64(number), F.lit(groups))).withColumn("block", block)
    right = right.withColumn("cell", F.col("block") * groups + F.col("g")).drop("block", "g")
    cells = left.withColumn("kind", F.lit(0)).unionByName(right.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return cells.repartitionById(blocks * groups, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(cell, kind, rows) of the parts of every batch."""
    for batch in batches:
        cell, kind = (batch.column(c).to_numpy() for c in ("cell", "kind"))
        edges = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1]), True]) if len(cell) else []
        for a, b in zip(edges, edges[1:]):
            yield int(cell[a]), int(kind[a]), batch.slice(a, b - a)


def _search(cells: DataFrame, dim: int, start, finish, schema: str) -> DataFrame:
    """Stream every cell's rows past its anchors; ``start`` makes a search, ``finish`` its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, search, step = None, [], None, FIRST_ROWS
        for cell, kind, part in _cells(batches):
            if cell != now:
                if search is not None:
                    yield finish(held, search)
                now, held, search, step = cell, [], None, FIRST_ROWS
            if kind == 0:
                held.append(part)
                continue
            if not held:
                continue
            if search is None:
                held = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                search = start(held)
            at = 0
            while at < part.num_rows:
                some = part.slice(at, step)
                search.rows(_side(some, dim), some.column("vec_id").to_numpy(), some.column("label").to_numpy())
                at, step = at + step, min(2 * step, 1 << 14)
        if search is not None:
            yield finish(held, search)

    return cells.mapInArrow(run, schema)


def mine(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = vectors.sparkSession
    rows, dim = prepare(vectors)
    anchors = rows.filter(F.pmod("vec_id", F.lit(ANCHORS_OF)) == 0).dropDuplicates(["vec_id", "label", "vec"])
    anchors = written(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n = anchors.count()
    blocks = max(1, math.ceil(n / min(BLOCK, max(1, BLOCK_BYTES // (8 * dim)))))
    groups = max(1, math.ceil(tasks(spark) / blocks))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))

    def start(held: pa.RecordBatch) -> Positives:
        return Positives(_side(held, dim), held.column("vec_id").to_numpy(), held.column("label").to_numpy(), POSITIVES)

    def finish(held: pa.RecordBatch, search: Positives) -> pa.RecordBatch:
        best = search.best
        return pa.RecordBatch.from_arrays(
            [held.column("anchor").take(pa.array(best.slot)), pa.array(best.id), pa.array(best.score)],
            ["anchor", "positive_id", "positive_score"],
        )

    # A cell hands on POSITIVES rows of an anchor at most, and an anchor has ``groups`` cells.
    found = _search(_grid(anchors, rows, blocks, groups), dim, start, finish, "anchor bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    positives = written(found.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= POSITIVES), "positives")
    lists = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("number", "positive_score"))).alias("p"))
    ranged = anchors.join(lists.select("anchor", F.col("p.positive_score").alias("p")), "anchor")

    def start_negatives(held: pa.RecordBatch) -> Negatives:
        low, high = np.full((2, held.num_rows, POSITIVES), np.iinfo(np.int64).max)
        high[:] = np.iinfo(np.int64).min
        for i, found in enumerate(held.column("p").to_pylist()):
            # Whole numbers s with LOW * p <= 100 * s <= HIGH * p
            low[i, : len(found)] = [-((-LOW * p) // 100) for p in found]
            high[i, : len(found)] = [HIGH * p // 100 for p in found]
        return Negatives(_side(held, dim), held.column("vec_id").to_numpy(), held.column("label").to_numpy(), low, high, NEGATIVES)

    def finish_negatives(held: pa.RecordBatch, search: Negatives) -> pa.RecordBatch:
        best = search.best
        anchor = pa.array(best.slot // POSITIVES)
        return pa.RecordBatch.from_arrays(
            [held.column("anchor").take(anchor), pa.array((best.slot % POSITIVES + 1).astype(np.int32)), pa.array(best.id), pa.array(best.score)],
            ["anchor", "number", "negative_id", "negative_score"],
        )

    found = _search(
        _grid(ranged, rows, blocks, groups), dim, start_negatives, finish_negatives, "anchor bigint, number int, negative_id bigint, negative_score bigint"
    )
    order = Window.partitionBy("anchor", "number").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    return ranked.join(positives, ["anchor", "number"]).join(anchors.select("anchor", "vec_id"), "anchor").select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
