"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are split into halves with a codebook each, fitted on a bounded sample; the two
nearest centroids name a vector's cell in the product grid. A vector visits cells by the
multi-sequence order: each half lists its centroids by rising lower bound on the squared distance
to their region (how far beyond the bisecting plane they lie), and the sums of two lists are taken
in rising order. Traversal ends where the sum passes a limit. The limit is calibrated for
the target recall: vectors at exactly the linking cosine from sampled ones, in random directions,
tell how far one has to go. The largest limit, the squared distance at that cosine, is exact.

Equal vectors of one label are one class, so a very common vector is compared once. In a cell,
visitors and members are dealt to tasks in blocks of bounded size and compared by matrix products;
cosines near the threshold are worked out again in one order of addition. A task returns a count
per vector and a spanning forest of its links, so nothing grows with the square of a group.
A pair that both sides can find is counted once: a member counts a visitor only if it does not
visit the visitor's own cell itself.

Cases: vectors with a null label, or that are null, empty, zero, or hold null or non-finite
components, are rows with no link and their own component; vectors of different lengths never
link; equal rows link with each other; rows with a null id have null ids but count as links;
repeated ids keep their rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.llm.common import written
from natal.llm.components import components

COSINE = 0.93
#: Rows to fit codebooks and the limit on, at most.
SAMPLE = 4_000
#: Share of pairs at exactly the linking cosine that traversal must reach from either side.
RECALL = 0.999
#: Members of a mean cell, and the most centroids per half.
CELL = 400
MOST_CENTROIDS = 256
BLOCK = 2_048
_PAIRS = "a bigint, b bigint, n bigint"


@dataclass(frozen=True)
class Index:
    """Codebooks of both halves and the traversal limit, for vectors of one length."""

    first: np.ndarray
    second: np.ndarray
    limit: float

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per half: lower bounds on the squared distance from each vector to each region."""
        cut = self.first.shape[1]
        return _bounds(x[:, :cut], self.first), _bounds(x[:, cut:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.bounds(x)
        return one.argmin(1) * len(self.second) + two.argmin(1)

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """Cells that each vector visits, nearest first; its own is the first."""
        return [_traverse(a, b, self.limit) for a, b in zip(*self.bounds(x))]

    def reaches(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether vector i visits ``cell[i]``."""
        one, two = self.bounds(x)
        rows = np.arange(len(x))
        return one[rows, cell // len(self.second)] + two[rows, cell % len(self.second)] <= self.limit


def _bounds(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance to the plane between the nearest centroid and each other one."""
    d = ((x**2).sum(1)[:, None] - 2 * x @ centroids.T) + (centroids**2).sum(1)
    nearest = d.argmin(1)
    apart = 2 * np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(2))[nearest]
    beyond = np.divide(d - d[np.arange(len(x)), nearest][:, None], apart, out=np.zeros_like(d), where=apart > 0)
    beyond[np.arange(len(x)), nearest] = 0.0
    # A centroid equal to the nearest one has no region of its own.
    return np.where((apart > 0) | (np.arange(len(centroids)) == nearest[:, None]), beyond**2, np.inf)


def _traverse(one: np.ndarray, two: np.ndarray, limit: float) -> list[int]:
    """Multi-sequence order over two sorted lists, up to a sum of ``limit``."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, seen, out = [(one[a[0]] + two[b[0]], 0, 0)], {(0, 0)}, []
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > limit:
            break
        out.append(int(a[i]) * len(two) + int(b[j]))
        for k, m in ((i + 1, j), (i, j + 1)):
            if k < len(a) and m < len(b) and (k, m) not in seen:
                seen.add((k, m))
                heapq.heappush(heap, (one[a[k]] + two[b[m]], k, m))
    return out


def _means(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample by Lloyd's steps."""
    centroids = x[draw.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)).argmin(1)
        for c in range(len(centroids)):
            own = x[near == c]
            if len(own):
                centroids[c] = own.mean(0)
    return centroids


def fit(x: np.ndarray, rows: int, cosine: float = COSINE, recall: float = RECALL, seed: int = 7) -> Index:
    """Codebooks and limit from sampled unit vectors; ``rows`` sets the number of cells."""
    draw = np.random.default_rng(seed)
    cut = max(1, x.shape[1] // 2)
    k = int(np.clip(round((rows / CELL) ** 0.5), 1, min(MOST_CENTROIDS, len(x))))
    index = Index(_means(x[:, :cut], k, draw), _means(x[:, cut:], k, draw) if x.shape[1] > cut else np.zeros((1, 0)), 0.0)
    if recall >= 1 or x.shape[1] < 2:
        return Index(index.first, index.second, 2 - 2 * cosine + 1e-9)
    noise = draw.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    other = cosine * x + (1 - cosine**2) ** 0.5 * noise
    needed = []
    for a, b in ((x, other), (other, x)):
        one, two = index.bounds(a)
        cell = index.cells(b)
        rows_ = np.arange(len(a))
        needed.append(one[rows_, cell // len(index.second)] + two[rows_, cell % len(index.second)])
    # A pair is found if either side reaches the other's cell.
    limit = float(np.quantile(np.minimum(*needed), recall, method="higher"))
    return Index(index.first, index.second, min(limit, 2 - 2 * cosine + 1e-9))


def usable(column: str):
    """Null, empty, zero vectors and those with null or non-finite components link with nothing."""
    c = F.col(column)
    fine = ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & fine & F.exists(c, lambda v: v != 0), F.lit(False))


def _unit(values) -> np.ndarray:
    x = np.array(list(values), dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors, each added up in the same order."""
    return np.einsum("ij,ij->i", a, b)


def _spread(classes: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """A member row in the own cell and a visitor row in every cell visited."""

    def run(frames):
        for f in frames:
            for at in range(0, len(f), 512):
                g = f.iloc[at : at + 512]
                for dim, part in g.groupby(g["vector"].map(len), sort=True):
                    index = indexes[int(dim)]
                    x = _unit(part["vector"])
                    home, visits = index.cells(x), index.visits(x)
                    n = [len(v) for v in visits]
                    visiting = part.loc[part.index.repeat(n)].assign(visitor=True, cell=np.concatenate(visits).astype(np.int64), home=np.repeat(home, n))
                    yield pd.concat([part.assign(visitor=False, cell=home, home=home), visiting])[
                        ["label", "cell", "visitor", "home", "id", "n", "vector"]
                    ]

    return classes.select("label", "id", "n", "vector").mapInPandas(
        run, "label int, cell bigint, visitor boolean, home bigint, id bigint, n bigint, vector array<double>"
    )


def _compare(indexes: dict[int, Index], cosine: float):
    """Links between the visitors and the members of one block pair."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        visitor = np.array(t.column("visitor").to_pylist(), dtype=bool)
        ids, n, home = (t.column(c).to_numpy() for c in ("id", "n", "home"))
        x = _unit(t.column("vector").to_pylist())
        index, cell = indexes[x.shape[1]], int(key[1].as_py())
        v, m = np.flatnonzero(visitor), np.flatnonzero(~visitor)
        counted: dict[str, list] = {"a": [], "n": []}
        found = []
        for at in range(0, len(v), 512):
            i, j = np.nonzero(x[v[at : at + 512]] @ x[m].T >= cosine - 1e-9)
            i, j = v[at + i], m[j]
            sure = (ids[i] != ids[j]) & (_exact(x[i], x[j]) >= cosine)
            i, j = i[sure], j[sure]
            # From its own cell each member is a visitor as well; elsewhere it may not come back.
            alone = ~index.reaches(x[j], home[i]) if len(j) else np.empty(0, bool)
            counted["a"] += [ids[i], ids[j[alone]]]
            counted["n"] += [n[j], n[i[alone]]]
            found.append((i, j))
        a = np.concatenate([np.empty(0, np.int64), *counted["a"]])
        who, place = np.unique(a, return_inverse=True)
        total = np.zeros(len(who), np.int64)
        np.add.at(total, place, np.concatenate([np.empty(0, np.int64), *counted["n"]]))
        node, root = _forest(ids, found)
        return pa.Table.from_arrays(
            [
                pa.array(np.r_[who, node]),
                pa.array([None] * len(who) + root.tolist(), pa.int64()),
                pa.array(total.tolist() + [None] * len(node), pa.int64()),
            ],
            ["a", "b", "n"],
        )

    return run


def _forest(ids: np.ndarray, found) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest id reached) for the ids that the links join."""
    known, place = np.unique(ids, return_inverse=True)
    root = np.arange(len(known))
    i = place[np.concatenate([np.empty(0, np.int64), *(a for a, _ in found)])]
    j = place[np.concatenate([np.empty(0, np.int64), *(b for _, b in found)])]
    while len(i):
        new = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(known)))
    return known[moved], known[root[moved]]


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    # Minus zero and zero are one value, also as part of a key.
    rows = rows.withColumn("vector", F.when(usable("vector") & F.col("label").isNotNull(), F.transform("vector", lambda v: v + F.lit(0.0))))
    keyed = rows.filter("vector is not null").groupBy("label", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
    # Classes are numbered by a hash of their vector, checked below to be unique.
    classes = written(keyed.withColumn("id", F.xxhash64("label", "vector")), "vector-classes")
    sizes = {r[0]: (r[1], r[2]) for r in classes.groupBy(F.size("vector")).agg(F.count(F.lit(1)), F.count_distinct("id")).collect()}
    if any(a != b for a, b in sizes.values()):
        raise ValueError("two different vectors share a 64-bit hash")
    indexes = {}
    for dim, (count, _) in sizes.items():
        top = classes.filter(F.size("vector") == dim).orderBy(F.xxhash64("id"), "id").select("vector").limit(sample)
        indexes[dim] = fit(_unit(r[0] for r in top.collect()), count, cosine, recall)
    if not indexes:
        none = rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
        return none.withColumn("kept", F.col("vec_id").isNotNull())
    seats = written(_spread(classes, indexes), "vector-seats")
    # Cells of one label with vectors of different lengths are different cells.
    place = ["label", "cell", "dim"]
    seats = seats.withColumn("dim", F.size("vector"))
    held = seats.groupBy(*place).agg(
        F.greatest(F.ceil(F.sum((~F.col("visitor")).cast("int")) / block), F.lit(1)).cast("int").alias("members"),
        F.greatest(F.ceil(F.sum(F.col("visitor").cast("int")) / block), F.lit(1)).cast("int").alias("visitors"),
        F.sum((~F.col("visitor")).cast("int")).alias("inside"),
    )
    dealt = seats.join(held.filter("inside > 0"), place)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("visitor"), F.col("visitors")).otherwise(F.col("members"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("visitor"), F.col("members")).otherwise(F.col("visitors")) - 1)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(other))
    pair = F.when(F.col("visitor"), F.struct(F.col("other").alias("m"), F.col("own").alias("v"))).otherwise(F.struct(F.col("own").alias("m"), F.col("other").alias("v")))
    dealt = dealt.withColumn("pair", pair).select(*place, "pair.m", "pair.v", "visitor", "home", "id", "n", "vector")
    found = written(dealt.groupBy(*place, "m", "v").applyInArrow(_compare(indexes, cosine), _PAIRS), "vector-links")
    linked = found.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    of = components(found.filter("b is not null").select("a", "b"), "vector-components").withColumnRenamed("node", "id")
    # Components have class numbers so far; the smallest vec_id names them.
    reached = classes.join(linked, "id", "left").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = reached.groupBy("component").agg(F.min("first_id").alias("component_id"))
    links = F.coalesce("others", F.lit(0)) + F.col("n") - 1
    classes = reached.join(named, "component").select("label", "vector", links.alias("n_links"), "component_id")
    # The class is found by label and hash: rows with one vector are split by adaptive execution.
    classes = classes.select(F.xxhash64("label", "vector").alias("id"), "n_links", "component_id")
    out = rows.withColumn("id", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector"))).select("vec_id", "id")
    out = out.join(classes, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
