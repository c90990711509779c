"""Leave-one-group-out models, all folds in the same passes over the data.

A fold's training side is everything but one group, so its sums are the total
minus the group's own. Counts, spreads and curvature are gathered once per group;
each further pass moves the coefficients of all folds, which are one small table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane.session import cut

#: Groups are taken in blocks whose curvature matrices fill about this many bytes; tasks and driver hold one block.
BLOCK_BYTES = 64 << 20
PASSES = 60
#: Passes without convergence after which the curvature is gathered anew at each fold's own coefficients.
REFRESH = 6
TOTAL = -1


def _sum_by_place(rows: DataFrame, start: Callable[[], dict], add: Callable[[dict, list, np.ndarray, np.ndarray], None]) -> dict[int, np.ndarray]:
    """Arrays summed by place over all rows: every task adds up its own, a shuffle adds the tasks' arrays up by place."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = start()
        for b in batches:
            if b.num_rows:
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                add(sums, b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(float), np.hstack([x, np.ones((len(x), 1))]))
        for place, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([values], pa.list_(pa.float64()))], names=["place", "v"])

    parts = rows.mapInArrow(go, "place int, v array<double>")
    out = parts.groupBy("place").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    return {r["place"]: np.array(r["v"]) for r in out.collect()}  # one array per fold of the block


class _Problem:
    """Sums over the rows of one block's folds. Fold F is the model of all rows."""

    def __init__(self, rows: DataFrame, groups: list):
        self.rows, self.groups = rows, groups
        self.place = {g: i for i, g in enumerate(groups)}

    def spreads(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per fold: rows of class 0 and 1, means, sample deviations; the last fold is all rows."""
        place = self.place

        def add(sums, groups, y, x):
            at = np.array([place.get(g, TOTAL) for g in groups])
            for p in {*at.tolist(), TOTAL}:
                some = slice(None) if p == TOTAL else at == p
                part = np.concatenate([[np.sum(y[some] == 0), np.sum(y[some] == 1)], x[some, :d].sum(axis=0), (x[some, :d] ** 2).sum(axis=0)])
                sums[p] = sums.get(p, 0.0) + part

        found = _sum_by_place(self.rows, dict, add)
        total = found.get(TOTAL, np.zeros(2 + 2 * d))
        left = np.array([total - found.get(i, 0.0) for i in range(len(self.groups))] + [total])
        counts, n = left[:, :2], np.maximum(left[:, :2].sum(axis=1, keepdims=True), 1)
        mean = left[:, 2: 2 + d] / n
        var = np.maximum(left[:, 2 + d:] - n * mean**2, 0.0) / np.maximum(n - 1, 1)
        flat = var <= 1e-14 * np.maximum(left[:, 2 + d:] / n, 1e-300)
        return counts, mean, np.where(flat, 0.0, np.sqrt(var))

    def curvature(self, v: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> dict[int, np.ndarray]:
        """At one set of coefficients: sum of p (1 - p) z z' per own group and over all rows, per class."""
        place, d = self.place, len(mean)

        def add(sums, groups, y, x):
            z = np.hstack([(x[:, :d] - mean) / scale, x[:, d:]])
            p = 1 / (1 + np.exp(-np.clip(z @ v, -500, 500)))
            w = p * (1 - p)
            at = np.array([place.get(g, TOTAL) for g in groups])
            for c in (0, 1):
                for k in {*at.tolist(), TOTAL}:
                    some = (y == c) & ((at == k) | (k == TOTAL))
                    if some.any():
                        key = 2 * k + c if k != TOTAL else c - 2
                        sums[key] = sums.get(key, 0.0) + (z[some].T @ (z[some] * w[some, None])).ravel()

        found = _sum_by_place(self.rows, dict, add)
        return {k: m.reshape(d + 1, d + 1) for k, m in found.items()}

    def slopes(self, v: np.ndarray, weight: np.ndarray, mean: np.ndarray, scale: np.ndarray, own: bool, curved: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        """Per fold, at its own coefficients: loss and slope over its training rows; for ``curved`` folds the curvature too."""
        place, d, folds = self.place, len(mean), len(v)

        def add(sums, groups, y, x):
            z = np.hstack([(x[:, :d] - mean) / scale, x[:, d:]])
            margin = z @ v.T
            w = np.where(y[:, None] == 1, weight[None, :, 1], weight[None, :, 0])
            if own:
                at = np.array([place.get(g, TOTAL) for g in groups])
                hit = np.flatnonzero(at != TOTAL)
                w[hit, at[hit]] = 0.0
            p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            loss = (w * np.logaddexp(0, np.where(y[:, None] == 1, -margin, margin))).sum(axis=0)
            slope = (w * (p - y[:, None])).T @ z
            for k in range(folds):
                more = (z.T @ (z * (w[:, k] * p[:, k] * (1 - p[:, k]))[:, None])).ravel() if curved[k] else ()
                sums[k] = sums.get(k, 0.0) + np.concatenate([[loss[k]], slope[k], more])

        found = _sum_by_place(self.rows, dict, add)
        d1 = d + 1
        whole = [found.get(k, np.zeros(1 + d1 + d1 * d1 * curved[k])) for k in range(folds)]
        return (
            np.array([w[0] for w in whole]), np.array([w[1: 1 + d1] for w in whole]),
            {k: w[1 + d1:].reshape(d1, d1) for k, w in enumerate(whole) if curved[k]},
        )


def _settle(problem, v, curve, weight, n, pull, fixed, mean, scale, own, tol, passes):
    """Newton steps of all folds at once; a step that raises a fold's loss is halved, a stale curvature is gathered anew."""
    folds = len(v)
    open_, last, step = np.ones(folds, bool), np.full(folds, np.inf), np.zeros_like(v)
    base, refresh = v.copy(), np.array([k not in curve for k in range(folds)])
    slope = np.zeros_like(v)
    for turn in range(passes):
        loss, slope, more = problem.slopes(v, weight, mean, scale, own, refresh & open_)
        curve |= more
        loss = loss / n + (pull * v * v).sum(axis=1) / 2
        slope = slope / n[:, None] + pull * v
        slope[fixed] = 0.0
        worse = open_ & (loss > last + 1e-12 * np.maximum(1.0, np.abs(last)))
        for k in np.flatnonzero(open_):
            if worse[k]:
                step[k] /= 2
            else:
                base[k], last[k] = v[k], loss[k]
                h = curve[k] / n[k] + np.diag(pull[k])
                h[fixed[k]], h[:, fixed[k]] = 0.0, 0.0
                h[fixed[k], fixed[k]] = 1.0
                step[k] = np.linalg.lstsq(h + 1e-14 * np.trace(h) * np.eye(len(h)), slope[k], rcond=None)[0]
                if np.abs(slope[k]).max(initial=0.0) <= tol:
                    open_[k] = False
            v[k] = base[k] - (step[k] if open_[k] else 0.0)
        if not open_.any():
            break
        refresh = np.full(folds, own is False or turn % REFRESH == REFRESH - 1)
    return v, np.abs(slope).max(axis=1, initial=0.0)


def leave_one_out(
    df: DataFrame, group: str, label: str = "label", features: str = "features", reg: float = 1e-4, balanced: bool = False,
    tol: float = 1e-10, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(group, weights, intercept, rows, slope): the logistic model of every group's fold, learned without the group.

    Minimises the mean logistic loss (weighted by n / (2 rows of the class) if ``balanced``) plus
    reg / 2 times the squared coefficients in units of the fold's sample deviations; features
    that are flat in a fold get 0. First the model of all rows is settled; there the curvature is
    gathered per group, and total minus own serves each fold for Newton steps whose slopes,
    at each fold's own coefficients, all come from one pass. ``slope`` is the largest
    one left. Folds whose training rows have one class are left out; rows with a null group
    train everywhere and are no fold. ``features`` is a vector or an array.
    """
    x = F.col(features)
    if df.schema[features].dataType.typeName() not in ("array",):
        x = vector_to_array(x)
    rows = cut(df.where(F.col(label).isNotNull()).select(F.col(group).alias("g"), F.col(label).cast("int").alias("y"), x.cast("array<double>").alias("x")))
    first = rows.select(F.size("x").alias("d")).first()
    own = df.schema[group].dataType.simpleString()
    schema = f"{group} {own}, weights array<double>, intercept double, rows long, slope double"
    out = df.sparkSession.createDataFrame([], schema)
    if first is None:
        return out
    d = first["d"]
    names = rows.where("g is not null").select("g").distinct()
    blocks = max(1, -(-names.count() * 2 * (d + 1) ** 2 * 8 // block_bytes))
    for b in range(blocks):
        part = names if blocks == 1 else names.where(F.pmod(F.xxhash64("g"), F.lit(blocks)) == b)
        groups = sorted(r["g"] for r in part.collect())
        if not groups:
            continue
        found = _block(_Problem(rows, groups), d, reg, balanced, tol)
        if found:
            out = out.unionByName(df.sparkSession.createDataFrame(found, schema))
    return out


def _block(problem: _Problem, d: int, reg: float, balanced: bool, tol: float) -> list[tuple]:
    counts, mean, spread = problem.spreads(d)
    n, folds = counts.sum(axis=1), len(problem.groups)
    ok = counts.min(axis=1) > 0
    if not ok[-1]:
        return []
    scale = np.where(spread[-1] > 0, spread[-1], 1.0)
    middle = mean[-1]
    weight = np.ones_like(counts)
    if balanced:
        weight = n[:, None] / (2 * np.maximum(counts, 1))
    pull = np.hstack([reg * (spread / scale) ** 2, np.zeros((folds + 1, 1))])
    fixed = np.hstack([spread <= 0, np.zeros((folds + 1, 1), bool)])
    start = np.zeros((1, d + 1))
    whole, _ = _settle(problem, start, {}, weight[-1:], n[-1:], pull[-1:], fixed[-1:], middle, scale, False, tol, PASSES)
    curve = problem.curvature(whole[0], middle, scale)
    zero = np.zeros((d + 1, d + 1))
    use = np.flatnonzero(ok[:-1])
    left = {
        i: sum(weight[k, c] * (curve.get(c - 2, zero) - curve.get(2 * k + c, zero)) for c in (0, 1)) for i, k in enumerate(use)
    }
    if not len(use):
        return []
    chosen = _Problem(problem.rows, [problem.groups[k] for k in use])
    v, slope = _settle(chosen, np.repeat(whole, len(use), axis=0), left, weight[use], n[use], pull[use], fixed[use], middle, scale, True, tol, PASSES)
    w = v[:, :d] / scale
    return [
        (problem.groups[k], w[i].tolist(), float(v[i, d] - w[i] @ middle), int(n[k]), float(slope[i])) for i, k in enumerate(use)
    ]


def probability(weights: Column, intercept: Column, features: Column) -> Column:
    dot = F.aggregate(F.zip_with(weights, features, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + intercept)))


def score_left_out(df: DataFrame, models: DataFrame, group: str, features: str = "features", out: str = "prob") -> DataFrame:
    """Rows of the models' groups with the probability by the model that never saw their group."""
    x = F.col(features)
    if df.schema[features].dataType.typeName() not in ("array",):
        x = vector_to_array(x)
    m = models.select(group, F.col("weights").alias("_w"), F.col("intercept").alias("_b"))
    return df.join(m, group).withColumn(out, probability(F.col("_w"), F.col("_b"), x)).select(*df.columns, out)


# ---- vectors: axes, pooling and model per fold from moments --------------------

#: Subject means that a task may hold beside its folds.
MEANS_BYTES = 64 << 20


def moments(df: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """(group, n, s, ss): count, sum and second moments (d x d, by rows) of the vectors of each group, one pass."""
    v = F.col(vector).cast("array<double>")
    outer = F.flatten(F.transform("_v", lambda a: F.transform("_v", lambda b: a * b)))
    rows = df.select(*group, v.alias("_v")).where("_v is not null")
    both = rows.select(*group, array_to_vector(F.concat(F.col("_v"), outer)).alias("_m"), F.size("_v").alias("_d"))
    out = both.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(F.col("_m"))).alias("_s"), F.first("_d").alias("_d"))
    return out.select(*group, "n", F.slice("_s", 1, F.col("_d")).alias("s"), F.slice("_s", F.col("_d") + 1, F.col("_d") * F.col("_d")).alias("ss"))


def principal_axes(cov: np.ndarray, k: int) -> np.ndarray:
    """Leading eigenvectors as columns, each pointing to where its largest loading is positive."""
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, np.argsort(-values, kind="stable")[:k]]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float, tol: float = 1e-10) -> np.ndarray:
    """Coefficients and, last, the intercept, of one small weighted model (same objective as :func:`leave_one_out`)."""
    z, n = np.hstack([x, np.ones((len(x), 1))]), weight.sum()
    spread = x.std(axis=0, ddof=1)
    pull = np.append(reg * spread**2, 0.0)

    def loss(v):
        m = z @ v
        return (weight * np.logaddexp(0, np.where(y == 1, -m, m))).sum() / n + (pull * v * v).sum() / 2

    v = np.zeros(z.shape[1])
    for _ in range(PASSES):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -500, 500)))
        slope = z.T @ (weight * (p - y)) / n + pull * v
        if np.abs(slope).max() <= tol:
            break
        h = (z * (weight * p * (1 - p))[:, None]).T @ z / n + np.diag(pull)
        step, now = np.linalg.lstsq(h + 1e-14 * np.trace(h) * np.eye(len(h)), slope, rcond=None)[0], loss(v)
        while np.abs(step).max() > 1e-15 and loss(v - step) > now:
            step = step / 2
        v = v - step
    return v


def embedding_leave_one_out(
    df: DataFrame, group: str, label: str, vector: str, k: int, reg: float = 1e-4, means_bytes: int = MEANS_BYTES
) -> DataFrame:
    """(group, label, prob, explained, total): one fold per group of vectors, from one pass over them.

    A fold's principal axes come from the moments of all vectors minus its own group's; the
    mean of projections is the projection of the mean, so pooling needs no second pass. Each
    fold standardises the other groups' pooled vectors, fits a balanced logistic model and
    scores its own group; ``explained`` is the variance on the axes, ``total`` all of it, over its training
    vectors. Folds are spread over tasks; each holds the groups' means, which must fit
    ``means_bytes``. Groups without label, and folds with one class, have no row; a group
    with several labels counts with the smallest.
    """
    own = df.schema[group].dataType.simpleString()
    df = df.select(F.col(group).alias("_g"), F.col(label).alias("_y"), F.col(vector).alias("_v0"))
    labels = df.where("_y is not null").groupBy("_g").agg(F.min("_y").cast("int").alias("y"))
    table = cut(moments(df, ["_g"], "_v0").join(labels, "_g"))
    size = table.agg(F.sum(F.size("s") * 8), F.count(F.lit(1))).first()
    schema = f"{group} {own}, label int, prob double, explained double, total double"
    if not size[1]:
        return df.sparkSession.createDataFrame([], schema)
    if size[0] > means_bytes:
        raise ValueError(f"means of {size[1]} groups take {size[0]} bytes, more than {means_bytes}")
    whole = table.agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"), vector_to_array(Summarizer.sum(array_to_vector("ss"))).alias("ss")
    ).first()
    n_all, s_all = whole["n"], np.array(whole["s"])
    d = len(s_all)
    ss_all = np.array(whole["ss"]).reshape(d, d)
    small = table.select("_g", "n", "s", "y").toArrow()
    names = small.column(0).to_pylist()
    means = np.array([np.array(s) / n for s, n in zip(small.column("s").to_pylist(), small.column("n").to_pylist())])
    ys = np.array(small.column("y").to_pylist())

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for g, n, s, ss, y in zip(*[b.column(i).to_pylist() for i in range(5)]):
                other = np.array([x != g for x in names])
                if len(set(ys[other].tolist())) < 2:
                    continue
                left, s = n_all - n, s_all - np.array(s)
                mean = s / left
                cov = (ss_all - np.array(ss).reshape(d, d)) / max(1, left - 1) - np.outer(mean, mean) * left / max(1, left - 1)
                axes = principal_axes(cov, min(k, d))
                pooled = (means - mean) @ axes
                m, sd = pooled[other].mean(axis=0), pooled[other].std(axis=0)
                z = (pooled - m) / np.where(sd >= 1e-12, sd, 1.0)
                yy = ys[other]
                w = np.where(yy == 1, len(yy) / (2 * max(1, (yy == 1).sum())), len(yy) / (2 * max(1, (yy != 1).sum())))
                v = fit_logistic(z[other], (yy == 1).astype(float), w, reg)
                p = 1 / (1 + np.exp(-(z[names.index(g)] @ v[:-1] + v[-1])))
                rows.append((g, y, float(p), float(np.trace(axes.T @ cov @ axes)), float(np.trace(cov))))
            if rows:
                cols = list(zip(*rows))
                kinds = [b.schema.field(0).type, pa.int32(), *[pa.float64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[group, "label", "prob", "explained", "total"])

    return table.select("_g", "n", "s", "ss", "y").mapInArrow(go, schema)


def fold_averages(df: DataFrame, models: DataFrame, group: str, label: str = "label", features: str = "features", reg: float = 1e-4) -> DataFrame:
    """(group, j, matched): per fold and feature (the last j is the intercept), the mean of probability times feature over
    the fold's training rows, plus the pull of the penalty.

    At the minimum of :func:`leave_one_out` this equals the mean of label times feature. One pass; tasks hold the models.
    """
    fitted = models.select(group, "weights", "intercept").collect()  # one row per fold
    x = F.col(features)
    if df.schema[features].dataType.typeName() not in ("array",):
        x = vector_to_array(x)
    rows = df.where(F.col(label).isNotNull()).select(F.col(group).alias("g"), F.col(label).cast("int").alias("y"), x.cast("array<double>").alias("x"))
    own = f"{group} {df.schema[group].dataType.simpleString()}, j int, matched double"
    if not fitted:
        return df.sparkSession.createDataFrame([], own)
    problem = _Problem(rows, [r[0] for r in fitted])
    d, place = len(fitted[0]["weights"]), problem.place
    w = np.array([[*r["weights"], r["intercept"]] for r in fitted])
    counts, _, spread = problem.spreads(d)

    def add(sums, groups, y, x):
        p = 1 / (1 + np.exp(-np.clip(x @ w.T, -500, 500)))
        at = np.array([place.get(g, TOTAL) for g in groups])
        hit = np.flatnonzero(at != TOTAL)
        p[hit, at[hit]] = 0.0
        for k, total in enumerate(p.T @ x):
            sums[k] = sums.get(k, 0.0) + total

    found = _sum_by_place(rows, dict, add)
    out = []
    for k, r in enumerate(fitted):
        mean = found.get(k, np.zeros(d + 1)) / counts[k].sum()
        mean[:d] += reg * spread[k] ** 2 * w[k, :d]
        out += [(r[0], j, float(m)) for j, m in enumerate(mean)]
    return df.sparkSession.createDataFrame(out, own)
