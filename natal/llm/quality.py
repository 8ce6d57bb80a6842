"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are training rows labelled 1; everything else is unlabelled web text, whether
it carries a label 0 or none. The classifier is additive: each dense feature is cut into bins by
its quantiles in the sample and each bin has a weight. With class prior p, the risk is

    p E+[l(g)] + max(0, E_u[l(-g)] - p E+[l(-g)])

with sigmoid loss l; where the second part falls below zero only its negative is followed, as in
the non-negative estimator. The descent starts from a plain fit of positives against unlabelled
rows. The prior is estimated from the two samples by that first fit: over its cuts, the smallest
ratio of the shares of unlabelled and positive rows above the cut, with a margin for chance. The
score is the rising step function of g that best follows p f+(g) / f_u(g), which is the chance
of quality given g; it too needs no negative label.

Both samples are bounded and documented parameters; scoring covers every text.

Cases: null and empty texts have all features zero and are scored like others; without positives
the score is 0; without unlabelled rows it is 1; null and repeated ids keep their rows; equal texts
have equal scores; texts of any length are read whole; an empty table gives no rows; extra columns,
also of clashing names, are ignored by scores and kept by ``good``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from natal.llm.common import extended, packed, rows_of, written
from natal.llm.labelled import held_out, rows_picked, smallest, texts_of

#: Trusted positives and unlabelled rows to learn from, at most.
POSITIVES = 10_000
UNLABELLED = 15_000
BINS = 12
THRESHOLD = 0.3
FEATURES = 18
STEPS = 300
_SPACES = (32, 9, 10, 11, 12, 13)


def features(text: str | None) -> list[float]:
    """Dense features of one text: make-up of its characters, words, repeats and lines."""
    if not text:
        return [0.0] * FEATURES
    raw = text.encode()
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size, n = len(raw), max(1, len(words))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    spaces = int(sum(counts[s] for s in _SPACES))
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    stops = int(counts[46] + counts[44] + counts[59])
    seen = Counter(words)
    top = seen.most_common(1)[0][1] if words else 0
    again = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = raw.split(b"\n")
    filled = [x for x in lines if x]
    return [
        upper / max(1, upper + lower),
        (marks - stops) / size,
        stops / n,
        int(counts[33] + counts[63]) / size,
        int(counts[48:58].sum()) / size,
        int(counts[128:].sum()) / size,
        int(counts[124] + counts[60] + counts[62] + counts[123] + counts[125]) / size,
        spaces / size,
        (size - spaces) / n,
        max(map(len, words), default=0),
        len(seen) / n,
        top / n,
        again / n,
        pairs / n,
        len(set(filled)) / max(1, len(filled)),
        size / len(lines),
        np.log1p(len(words)),
        int(counts[46]) / n,
    ]


def featured(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = np.array([features(t) for t in rows_of(batch, "text")], dtype=float).reshape(-1, FEATURES)
            offsets = pa.array(np.arange(0, rows.size + 1, FEATURES, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "features"])

    return df.select(*keep, "text").mapInArrow(run, extended(df, keep, features=ArrayType(DoubleType())))


def samples(docs: DataFrame, labels: DataFrame, label: str, positives: int, unlabelled: int) -> DataFrame:
    """(text, positive): bounded samples of trusted positives and of all web text.

    Unlabelled rows are drawn from all documents that may be learned from, labelled or not, by
    the smallest hashes of their ids; each id sample is bounded before it is broadcast. Equal rows
    count once, and both bounds hold for rows also where one id has very many texts.
    """
    ids = F.col("doc_id").cast("bigint").alias("doc_id")
    may = F.col("doc_id").isNotNull() & ~held_out()
    trusted = labels.select(ids, F.col(label).alias("label")).filter(may).groupBy("doc_id").agg(F.max("label").alias("label"))
    trusted = trusted.filter("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id", F.lit(True).alias("positive"))
    web = docs.select(ids).filter(may).distinct().orderBy(F.xxhash64(F.lit("web"), "doc_id"), "doc_id").limit(unlabelled)
    chosen = trusted.unionByName(web.select("doc_id", F.lit(False).alias("positive")))
    found = texts_of(docs, chosen)
    keys = written(found.select("doc_id", "positive", "digest").distinct(), "quality-keys")
    picked = smallest(keys.filter("positive"), positives).unionByName(smallest(keys.filter("not positive"), unlabelled, "web"))
    return rows_picked(found, picked).select("positive", "text")


def prior(positive: np.ndarray, unlabelled: np.ndarray, margin: float = 2.0) -> float:
    """Share of positives among the unlabelled, from scores of both samples.

    Above any cut, unlabelled rows hold at least p times the share of positives there; the cut
    where the ratio is smallest, chance allowed for, bounds p best. Cuts leave at least 30 % of the
    positives above, so that no ratio rests on a few rows.
    """
    if not len(positive) or not len(unlabelled):
        return float(len(positive) > 0)
    grid = np.unique(np.quantile(positive, np.linspace(0, 0.7, 200)))
    above_p = 1 - np.searchsorted(np.sort(positive), grid, side="left") / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), grid, side="left") / len(unlabelled)
    ratio = above_u / np.maximum(above_p, 1e-9)
    # Standard error of the ratio, from both samples.
    noise = np.sqrt((1 - above_u) / np.maximum(above_u, 1e-9) / len(unlabelled) + (1 - above_p) / np.maximum(above_p, 1e-9) / len(positive))
    best = np.argmin(ratio * (1 + margin * noise))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.99))


@dataclass
class Model:
    """Cuts per feature, one weight per bin, a constant, the prior and the steps of the score."""

    cuts: list[np.ndarray]
    weights: list[np.ndarray]
    constant: float = 0.0
    prior: float = 0.0
    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    chance: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.constant + sum((w[b] for w, b in zip(self.weights, self.bins(x))), np.zeros(len(x)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.prior:  # one of the samples was empty
            return np.full(len(x), self.chance[0])
        g = self.odds(x)
        # Between the steps chances are joined as log odds; a small share of the plain logistic
        # keeps the order inside a step.
        bounded = np.clip(self.chance, 0.002, 0.998)
        return 0.98 * _logistic(np.interp(g, self.at, np.log(bounded / (1 - bounded)))) + 0.02 * _logistic(g)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(model: Model, xp: np.ndarray, xu: np.ndarray, p: float | None, steps: int, rate: float, penalty: float = 1e-3) -> Model:
    """Follow a risk downhill by Adam on full batches, from the weights of ``model``.

    Without ``p``: logistic loss of positives against unlabelled. With it: the non-negative risk
    with sigmoid loss, whose bounded values keep the difference of two means steady.
    """
    starts = np.concatenate([[0], np.cumsum([len(w) for w in model.weights])])
    at = [np.column_stack([b + s for b, s in zip(model.bins(x), starts)]) for x in (xp, xu)]
    w = np.concatenate([*model.weights, [model.constant]])
    m, v, hot = np.zeros(len(w)), np.zeros(len(w)), starts[-1]

    def outcome(rows, sign):
        """Mean loss of calling rows ``sign`` and its gradient."""
        off = _logistic(-sign * (w[rows].sum(1) + w[hot]))
        pull = -sign * (off if p is None else off * (1 - off)) / len(rows)
        g = np.bincount(rows.ravel(), np.repeat(pull, rows.shape[1]), minlength=len(w))
        g[hot] += pull.sum()
        return off.mean(), g

    for step in range(1, steps + 1):
        if p is None:
            g = outcome(at[0], 1)[1] + outcome(at[1], -1)[1]
            g[:hot] += penalty * w[:hot]
        else:
            plus, minus, web = outcome(at[0], 1)[1], outcome(at[0], -1), outcome(at[1], -1)
            g = p * plus + web[1] - p * minus[1] if web[0] >= p * minus[0] else p * minus[1] - web[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(model.cuts, [w[a:b] for a, b in zip(starts, starts[1:])], float(w[hot]), p or 0.0)


def _steps(gp: np.ndarray, gu: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising chances of being positive: pooled ratios of p x positive mass to unlabelled mass."""
    edges = np.unique(np.quantile(gu, np.linspace(0, 1, 201)))
    place = [np.searchsorted(edges[1:-1], g, side="right") for g in (gp, gu)]
    n = max(1, len(edges) - 1)
    mass = [p * np.bincount(place[0], minlength=n) / len(gp), np.bincount(place[1], minlength=n) / len(gu)]
    middle = np.bincount(place[1], gu, minlength=n)
    blocks: list[list[float]] = []
    for top, bottom, sum_g in zip(*mass, middle / len(gu)):
        blocks.append([top, bottom, sum_g])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    kept = [b for b in blocks if b[1] > 0]
    return np.array([b[2] / b[1] for b in kept]), np.clip([b[0] / b[1] for b in kept], 0, 1)


def learn(xp: np.ndarray, xu: np.ndarray) -> Model:
    """Fit on features of positives and unlabelled rows."""
    both = np.concatenate([xp, xu])
    cuts = [np.unique(np.quantile(both[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(both.shape[1])] if len(both) else [np.empty(0)] * FEATURES
    # Rare junk lies beyond the quantiles of the whole sample: its tails get cuts of their own.
    if len(both):
        cuts = [np.unique(np.concatenate([c, np.quantile(both[:, j], [0.01, 0.03, 0.97, 0.99])])) for j, c in enumerate(cuts)]
    blank = Model(cuts, [np.zeros(len(c) + 1) for c in cuts])
    if not len(xp) or not len(xu):
        blank.chance = np.full(1, float(len(xp) > 0))
        return blank
    half_p, half_u = np.arange(len(xp)) % 2 == 0, np.arange(len(xu)) % 2 == 0
    first = _descend(blank, xp[half_p], xu[half_u], None, 300, 0.05)
    p = prior(first.odds(xp[~half_p]), first.odds(xu[~half_u]))
    first.constant += float(np.log(2 * p))  # the first fit is log f+/f_u: at one half, p f+ = f_u / 2
    model = _descend(first, xp, xu, p, STEPS, 0.02)
    model.at, model.chance = _steps(model.odds(xp), model.odds(xu), p)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from bounded samples; only their features reach the driver, in a fixed order."""
    rows = featured(samples(docs, labels, label, positives, unlabelled), ("positive",)).collect()
    rows.sort(key=lambda r: (r["positive"], r["features"]))
    # An even spread of the sorted rows over both halves keeps the fit the same at any partitioning.
    x = {side: np.array([r["features"] for r in rows if r["positive"] == side], dtype=float).reshape(-1, FEATURES) for side in (True, False)}
    return learn(x[True], x[False])


def score(model: Model, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and ``score`` for every row of ``df``."""
    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in rows_of(batch, "text")], dtype=float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(model.scores(x))], [*keep, "score"])

    return df.select(*keep, "text").mapInArrow(run, extended(df, keep, score=DoubleType()))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns for every document."""
    model = fit(docs, labels)
    scored = score(model, docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ("doc_id",))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    return score(fit(docs, labels), packed(docs), ("row",)).filter(F.col("score") >= threshold).select("row.*")
