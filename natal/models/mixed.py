"""Logit with a random intercept per group.

For a given group SD the joint mode of coefficients and group effects is found by Newton steps on the
coefficients alone: given those, every group's own mode is a search in one number, which the task
that holds the group finishes by itself. Patterns are dealt to tasks by group once and kept there.
A step is one pass over them that sends the current coefficients of all grid points out and brings sums
back: the group effects leave no state behind, so nothing is joined, shuffled or checkpointed
between steps, a lost executor costs its share of the patterns only, and a grid of group SDs moves in
lockstep at the price of one.

A group that holds more than half a task's share of the patterns is spread over tasks. There are
never more such groups than twice the tasks; their effects take part in the driver's Newton step as
unknowns that are eliminated by a Schur complement.

The SD itself is integrated out over the grid with Laplace weights. This approximates the full
posterior; it is not a sampler.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.models.draws import DRAWS, DrawMatrix, normal_column, normals, uniforms
from natal.models.logit import INTERCEPT
from natal.models.patterns import HITS, TRIALS, pattern_counts
from natal.models.priors import Priors
from natal.models.scoring import CROSS, CURVES, MODES, STREAM, logistic, with_stream
from natal.operators.joins import lookup_join
from natal.session import cut_lineage

#: Group SDs at which the search for the posterior mass starts; it goes beyond them where it must.
COARSE = (0.02, 4.0)
POINTS = 11
#: Points that the final grid has inside the posterior mass, at least; and where the mass leans
#: to one side, as it does for an SD near zero.
INSIDE, INSIDE_LEANING = 6, 40
GROUP, HEAVY = "_grp", "_heavy"
DEPTH = 6.0  # log-posterior drop at which the grid may end
#: Patterns that a task works on: no fewer than the first where that leaves a task, no more than the second.
FEWEST, MOST = 4_000, 250_000
#: Tasks up to which their sums come to the driver one by one.
DIRECT = 512


@dataclass(frozen=True)
class MixedFit:
    """Laplace fit on a grid of group SDs.

    ``groups`` has one row per group: mode, curvature and cross terms for each grid point.
    """

    terms: tuple[str, ...]
    group: str
    sds: np.ndarray
    weights: np.ndarray
    modes: np.ndarray
    covs: np.ndarray
    groups: DataFrame
    n_groups: int
    nobs: int
    priors: Priors

    @property
    def predictors(self) -> tuple[str, ...]:
        return self.terms[1:]

    @property
    def mode(self) -> np.ndarray:
        return self.weights @ self.modes

    @property
    def sd(self) -> float:
        """Posterior mean of the group SD."""
        return float(self.weights @ self.sds)


def fit_random_intercept(
    df: DataFrame,
    outcome: str,
    predictors: Sequence[str],
    group: str,
    priors: Priors | None = None,
    sds: Sequence[float] | None = None,
    patterns: DataFrame | None = None,
    max_steps: int = 40,
    tol: float = 1e-6,
    max_grids: int = 20,
) -> MixedFit:
    """Fit ``outcome ~ predictors + (1 | group)``.

    ``sds`` fixes the grid of group SDs. By default an evenly spaced grid of log SDs is moved,
    widened and narrowed until its ends lie ``DEPTH`` below the best point and ``INSIDE`` points
    hold the mass between, however many groups make it narrow.
    """
    priors = priors or Priors()
    data = pattern_counts(df, outcome, predictors, group) if patterns is None else patterns.na.drop("any", subset=list(predictors))
    # Inside the fit the columns have fixed names, whatever the caller calls them.
    inner = [f"x{j}" for j in range(1, len(predictors) + 1)]
    data = data.filter(F.col(group).isNotNull()).select(
        F.col(group).alias(GROUP), *[F.col(p).cast("double").alias(x) for p, x in zip(predictors, inner)],
        F.col(TRIALS).cast("double").alias(TRIALS), F.col(HITS).cast("double").alias(HITS),
    )
    source = data.persist()
    held = None
    try:
        held, tasks, n_groups, heavy = dealt(source, inner)
        job = _Newton(held, tasks, len(inner) + 1, priors, n_groups, heavy, max_steps, tol)
        grid = np.array(sds, dtype=float) if sds is not None else np.exp(np.linspace(*np.log(COARSE), POINTS))
        fit = job.run(grid, np.zeros((len(grid), job.k)), np.zeros((len(heavy), len(grid))))
        for _ in range(max_grids if sds is None else 0):
            log_sds = next_grid(np.log(grid), fit.log_post)
            if log_sds is None:
                break
            near = np.abs(log_sds[:, None] - np.log(grid)[None, :]).argmin(axis=1)
            grid = np.exp(log_sds)
            fit = job.run(grid, fit.beta[near], fit.effects[:, near])
        else:
            if sds is None:
                raise RuntimeError(f"the posterior of the group SD was not enclosed in {max_grids} grids")
        weights = np.exp(fit.log_post - fit.log_post.max())
        return MixedFit(
            (INTERCEPT, *predictors), group, grid, weights / weights.sum(), fit.beta, fit.covs, job.groups(fit, group), n_groups, int(fit.nobs), priors
        )
    finally:
        source.unpersist()
        if held is not None:
            held.unpersist()


def dealt(data: DataFrame, inner: Sequence[str]) -> tuple[DataFrame, int, int, list]:
    """Patterns kept in tasks by group, the numbers of tasks and groups, and the groups that are spread over tasks."""
    spark = data.sparkSession
    sizes = data.groupBy(GROUP).agg(F.count("*").alias("size"))
    total = sizes.agg(F.count("*").alias("groups"), F.sum("size").alias("patterns"), F.max("size").alias("largest")).first()
    if not total["patterns"]:
        raise ValueError("no complete rows to fit")
    at_least = math.ceil(total["patterns"] / MOST)
    tasks = max(at_least, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total["patterns"] / FEWEST)))
    share = max(FEWEST, total["patterns"] / (2 * tasks))
    # Each holds more than 1 / (2 * tasks) of the patterns, so there are fewer than 2 * tasks of them.
    heavy = [r[GROUP] for r in sizes.filter(F.col("size") > share).select(GROUP).collect()] if total["largest"] > share else []
    number, salt = F.lit(None).cast("int"), F.lit(0)
    if heavy:
        kind = data.schema[GROUP].dataType
        rows = spark.createDataFrame([(g, i) for i, g in enumerate(heavy)], f"{GROUP} {kind.simpleString()}, {HEAVY} int")
        data = data.join(F.broadcast(rows), GROUP, "left")
        number, salt = F.col(HEAVY), F.when(F.col(HEAVY).isNotNull(), F.pmod(F.xxhash64(*inner, TRIALS, HITS), F.lit(4 * tasks))).otherwise(0)
    data = data.select("*", salt.alias("_salt")) if heavy else data.select("*", number.alias(HEAVY), salt.alias("_salt"))
    spread = data.repartition(tasks, GROUP, "_salt").sortWithinPartitions(GROUP).drop("_salt")
    return spread.persist(), tasks, total["groups"], heavy


def next_grid(x: np.ndarray, log_post: np.ndarray, points: int = POINTS) -> np.ndarray | None:
    """Log SDs to try after ``x``; ``None`` where ``x`` encloses the mass with enough points inside."""
    inside = np.flatnonzero(log_post > log_post.max() - DEPTH)
    first, last, width = inside[0], inside[-1], x[-1] - x[0]
    if first == 0 or last == len(x) - 1:
        return np.linspace(x[0] - width * (first == 0), x[-1] + width * (last == len(x) - 1), points)
    sides = sorted((x[last] - x[log_post.argmax()], x[log_post.argmax()] - x[first]))
    leaning = len(inside) >= INSIDE and sides[1] > 1.5 * sides[0] + x[1] - x[0]
    if len(inside) >= (INSIDE_LEANING if leaning else INSIDE):
        return None
    return np.linspace(x[first - 1], x[last + 1], INSIDE_LEANING + 6 if leaning else points)


@dataclass
class _Point:
    """A converged grid: coefficients, their covariance, log posterior, effects of the heavy groups."""

    beta: np.ndarray
    covs: np.ndarray
    log_post: np.ndarray
    sds: np.ndarray
    effects: np.ndarray
    curves: np.ndarray
    cross: np.ndarray
    nobs: float


@dataclass
class _Patterns:
    """One task's patterns as arrays; those of a group stand next to each other."""

    x: np.ndarray
    trials: np.ndarray
    hits: np.ndarray
    starts: np.ndarray
    groups: pa.Array
    heavy: np.ndarray

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch], k: int) -> _Patterns | None:
        held = [b for b in batches if b.num_rows]
        if not held:
            return None
        table = pa.Table.from_batches(held).combine_chunks()
        number = lambda c: table.column(c).to_numpy().astype(float)
        x = np.column_stack([np.ones(len(table)), *[number(f"x{j}") for j in range(1, k)]])
        group = table.column(GROUP).combine_chunks()
        codes = group.dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        heavy = table.column(HEAVY).combine_chunks().fill_null(-1).to_numpy()
        return cls(x, number(TRIALS), number(HITS), starts, group.take(pa.array(starts)), heavy[starts])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over the patterns of each group."""
        return np.add.reduceat(values, self.starts, axis=0)

    def spread(self, per_group: np.ndarray) -> np.ndarray:
        return np.repeat(per_group, np.diff(np.r_[self.starts, len(self.trials)]))

    def log_lik(self, eta: np.ndarray) -> np.ndarray:
        return self.hits * eta - self.trials * (np.maximum(eta, 0.0) + np.log1p(np.exp(-np.abs(eta))))

    def effects(self, offset: np.ndarray, tau: float, given: np.ndarray) -> np.ndarray:
        """Mode of every group's effect at the given linear predictor; those of heavy groups are ``given``.

        The log posterior of one effect is concave; a Newton step that would lower it is halved.
        """
        light = self.heavy < 0
        b = np.where(light, 0.0, given)
        if not light.any():
            return b

        def value(b):
            return self.sums(self.log_lik(offset + self.spread(b))) - 0.5 * tau * b * b

        now = value(b)
        for _ in range(200):
            p = logistic(offset + self.spread(b))
            r = self.sums(self.hits - self.trials * p) - tau * b
            move = np.where(light, r / (self.sums(self.trials * p * (1 - p)) + tau), 0.0)
            if not (np.abs(move) > 1e-13 * (1 + np.abs(b))).any():
                break
            new = value(b + move)
            for _ in range(60):
                worse = new < now - 1e-12 * (1 + np.abs(now))
                if not worse.any():
                    break
                move = np.where(worse, move / 2, move)
                new = value(b + move)
            b, now = b + move, new
        return b

    def blocks(self, beta: np.ndarray, tau: float, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(effect of each group; its log-likelihood, gradient and upper triangle of the information)."""
        offset = self.x @ beta
        b = self.effects(offset, tau, given)
        eta = offset + self.spread(b)
        p = logistic(eta)
        w = self.trials * p * (1 - p)
        k = self.x.shape[1]
        parts = [self.log_lik(eta)[:, None], self.x * (self.hits - self.trials * p)[:, None]]
        parts += [self.x[:, j : j + 1] * self.x[:, j:] * w[:, None] for j in range(k)]
        return b, self.sums(np.hstack(parts))


def _unpacked(block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, gradient, information) from the last axis of packed sums."""
    ll, grad = block[..., 0], block[..., 1 : k + 1]
    info = np.zeros((*block.shape[:-1], k, k))
    upper = np.triu_indices(k)
    info[..., upper[0], upper[1]] = info[..., upper[1], upper[0]] = block[..., k + 1 :]
    return ll, grad, info


class _Newton:
    def __init__(self, data: DataFrame, tasks: int, k: int, priors: Priors, n_groups: int, heavy: Sequence, max_steps: int, tol: float):
        self.data, self.tasks, self.k, self.priors, self.heavy = data, tasks, k, priors, list(heavy)
        self.n_groups, self.max_steps, self.tol = n_groups, max_steps, tol
        self.wide = 1 + k + k * (k + 1) // 2

    def pass_over(self, sds: np.ndarray, beta: np.ndarray, effects: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """One pass: sums over the light groups, packed sums of each heavy group, and respondents.

        Sums per grid point: log posterior of the effects given the coefficients, log determinant of
        their curvatures, gradient and information after eliminating them.
        """
        k, m, wide = self.k, len(sds), self.wide
        tau, heavy = 1.0 / sds**2, len(self.heavy)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = _Patterns.of(batches, k)
            if task is None:
                return
            light, total = task.heavy < 0, np.zeros((m, 2 + k + k * k))
            parts: dict[int, np.ndarray] = {int(h): np.zeros((m, wide)) for h in task.heavy[~light]}
            for s in range(m):
                given = effects[task.heavy, s] if heavy else np.zeros(len(light))
                b, block = task.blocks(beta[s], tau[s], given)
                for h, row in zip(task.heavy[~light], block[~light]):
                    parts[int(h)][s] += row
                ll, grad, info = _unpacked(block[light], k)
                d, h0 = info[:, 0, 0] + tau[s], info[:, 0, :]
                r = grad[:, 0] - tau[s] * b[light]
                total[s, 0] = (ll - 0.5 * tau[s] * b[light] ** 2).sum()
                total[s, 1] = np.log(d).sum()
                total[s, 2 : 2 + k] = (grad - h0 * (r / d)[:, None]).sum(axis=0)
                total[s, 2 + k :] = (info - h0[:, :, None] * h0[:, None, :] / d[:, None, None]).sum(axis=0).ravel()
            rows = [(-1, np.r_[task.trials.sum(), total.ravel()])] + [(h, v.ravel()) for h, v in parts.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in rows], pa.int32()), pa.array([v.tolist() for _, v in rows], pa.list_(pa.float64()))], [HEAVY, "sums"]
            )

        rows = self.data.mapInArrow(run, f"{HEAVY} int, sums array<double>")
        total, parts = np.zeros(1 + m * (2 + k + k * k)), np.zeros((heavy, m * wide))
        if self.tasks > DIRECT:
            cells = rows.select(HEAVY, F.posexplode("sums")).groupBy(HEAVY, "pos").agg(F.sum("col").alias("v"))
            for h, pos, v in cells.collect():  # as many rows as there are sums
                (total if h < 0 else parts[h])[pos] += v
        else:
            for h, v in rows.collect():  # one row of sums per task, and per heavy group of a task
                if h < 0:
                    total += v
                else:
                    parts[h] += v
        return total[1:].reshape(m, -1), parts.reshape(heavy, m, wide), total[0]

    def run(self, sds: np.ndarray, beta: np.ndarray, effects: np.ndarray) -> _Point:
        k, m = self.k, len(sds)
        penalty, tau = np.diag(self.priors.precision(k)), 1.0 / sds**2
        reached, before = np.full(m, -np.inf), (beta, effects)
        for _ in range(self.max_steps):
            total, parts, nobs = self.pass_over(sds, beta, effects)
            value, logdet = total[:, 0].copy(), total[:, 1].copy()
            grad, schur = total[:, 2 : 2 + k].copy(), total[:, 2 + k :].reshape(m, k, k).copy()
            ll, g, info = _unpacked(parts, k)
            cross, d = info[:, :, 0, :], info[:, :, 0, 0] + tau
            r = g[:, :, 0] - tau * effects
            value += (ll - 0.5 * tau * effects**2).sum(axis=0) - 0.5 * np.einsum("sk,kl,sl->s", beta, penalty, beta)
            logdet += np.log(d).sum(axis=0)
            grad += (g - cross * (r / d)[:, :, None]).sum(axis=0) - beta @ penalty
            schur += (info - cross[..., :, None] * cross[..., None, :] / d[..., None, None]).sum(axis=0) + penalty
            over = value < reached - 1e-9 * np.abs(reached)  # overshot: these points go back half way
            move = np.linalg.solve(schur, grad[:, :, None])[:, :, 0]
            # Newton decrement: coefficients after elimination, plus the effects of heavy groups.
            gain = np.einsum("sk,sk->s", move, grad) + (r * r / d).sum(axis=0)
            if gain.max() < self.tol and not over.any():
                log_post = self.log_posterior(sds, value, logdet, schur)
                return _Point(beta, np.linalg.inv(schur), log_post, sds, effects, d, cross, nobs)
            reached = np.where(over, reached, value)
            step = beta + move, effects + (r - np.einsum("hsk,sk->hs", cross, move)) / d
            half = (beta + before[0]) / 2, (effects + before[1]) / 2
            held = np.where(over[:, None], before[0], beta), np.where(over[None, :], before[1], effects)
            beta, effects = np.where(over[:, None], half[0], step[0]), np.where(over[None, :], half[1], step[1])
            before = held
        raise RuntimeError(f"no convergence in {self.max_steps} steps")

    def log_posterior(self, sds, value, logdet, schur):
        """Laplace log posterior of the log group SD, up to a constant."""
        out = value - self.n_groups * np.log(sds) - 0.5 * logdet - 0.5 * np.linalg.slogdet(schur)[1]
        return out + np.array([self.priors.log_group_sd(s) for s in sds]) + np.log(sds)

    def groups(self, fit: _Point, group: str) -> DataFrame:
        """One row per group with arrays over the grid, as many entries as grid points."""
        k, m, heavy = self.k, len(fit.sds), self.heavy
        beta, tau, effects = fit.beta, 1.0 / fit.sds**2, fit.effects
        kind = self.data.schema[GROUP].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = _Patterns.of(batches, k)
            if task is None:
                return
            light = task.heavy < 0
            modes, curves, cross = np.zeros((light.sum(), m)), np.zeros((light.sum(), m)), np.zeros((light.sum(), m, k))
            for s in range(m):
                b, block = task.blocks(beta[s], tau[s], effects[task.heavy, s] if heavy else np.zeros(len(light)))
                info = _unpacked(block[light], k)[2]
                modes[:, s], curves[:, s], cross[:, s] = b[light], info[:, 0, 0] + tau[s], info[:, 0, :]
            lists = [pa.array(list(x.reshape(len(modes), math.prod(x.shape[1:]))), pa.list_(pa.float64())) for x in (modes, curves, cross)]
            yield pa.RecordBatch.from_arrays([task.groups.filter(pa.array(light)), *lists], [GROUP, MODES, CURVES, CROSS])

        schema = f"`{GROUP}` {kind}, {MODES} array<double>, {CURVES} array<double>, {CROSS} array<double>"
        out = self.data.mapInArrow(run, schema)
        if heavy:
            rows = [(g, fit.effects[i].tolist(), fit.curves[i].tolist(), fit.cross[i].ravel().tolist()) for i, g in enumerate(heavy)]
            out = out.unionByName(self.data.sparkSession.createDataFrame(rows, schema))
        return cut_lineage(with_stream(out.withColumnRenamed(GROUP, group), group))


def mixed_draws(fit: MixedFit, n: int = DRAWS, seed: int = 42) -> DrawMatrix:
    """Coefficient draws: a grid point by its weight, then a normal around its mode."""
    below = np.cumsum(fit.weights)[:-1]
    component = np.searchsorted(below, uniforms(seed, "component", n), side="right")
    z = normals(seed, 0, (n, len(fit.terms)))
    chol = np.linalg.cholesky(fit.covs)
    values = fit.modes[component] + np.einsum("dij,dj->di", chol[component], z)
    return DrawMatrix(fit.terms, values, component, fit.modes, seed)


def sd_draws(fit: MixedFit, draws: DrawMatrix) -> np.ndarray:
    """Draws of the group SD that belong to the coefficient draws."""
    return fit.sds[draws.component]


def attach_groups(patterns: DataFrame, fit: MixedFit, prefix: str = "") -> DataFrame:
    """Add each row's group block, so that scoring includes the group effects.

    ``prefix`` keeps the blocks of several models apart.
    """
    blocks = fit.groups.withColumnsRenamed({c: prefix + c for c in (MODES, CURVES, CROSS)})
    shared = [c for c in (STREAM,) if c in patterns.columns]
    return lookup_join(patterns, blocks.drop(*shared), [fit.group], "inner", fit.n_groups)


def group_draws(fit: MixedFit, draws: DrawMatrix) -> DataFrame:
    """Long table ``(condition, term, draw, value)`` of group effects.

    Draws of groups are made by column expressions. The draws of the coefficients join as one row of
    arrays, whose size is set by the model and not by the data.
    """
    spark, k = fit.groups.sparkSession, len(fit.terms)
    shift = draws.values - draws.centre[draws.component]
    rows = pa.table({"draw": np.arange(len(draws)), "s": draws.component.astype("int32"), "shift": pa.array(shift.tolist(), pa.list_(pa.float64()))})
    numbered = F.broadcast(spark.createDataFrame(rows).agg(F.collect_list(F.struct("draw", "s", "shift")).alias("all")))
    one = F.col("one")
    at = one["s"]
    cross = [F.get(CROSS, at * k + j) * F.get(one["shift"], F.lit(j)) for j in range(k)]
    curve = F.get(CURVES, at)
    noise = normal_column(draws.seed, F.col(STREAM), one["draw"])
    value = F.get(MODES, at) - sum(cross[1:], cross[0]) / curve + noise / F.sqrt(curve)
    # The row of draws meets every group: one row on that side, not a product of tables.
    each = fit.groups.withColumn("_all", F.lit(1)).join(numbered.withColumn("_all", F.lit(1)), "_all").withColumn("one", F.explode("all"))
    return each.select(F.col(fit.group).alias("condition"), F.lit(INTERCEPT).alias("term"), one["draw"].alias("draw"), value.alias("value"))
