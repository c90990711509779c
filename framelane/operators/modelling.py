"""Vectors, reducers and classifiers on MLlib."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelane.functions import geometry as G
from framelane.operators.ranked import percentiles
from framelane.session import cut, shared_folder

ROWS_PER_TASK = 65_536


def spread(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows dealt by ``key`` to a task per core, or to as many rounds of them as keep a task at about ``rows_per_task`` rows at most.

    Fits go over their rows again and again on the partitions they are given, and a table in one file or row group is
    one. Dealt and sorted by a unique key, what forests draw does not depend on the files the rows came from. A reader of
    the written rows packs small files together again, by cores and by spark.sql.files.maxPartitionBytes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rounds = max(1, -(-df.count() // (rows_per_task * cores)))
    return df.repartition(cores * rounds, key).sortWithinPartitions(key)


def vectorise(df: DataFrame, names: Sequence[str], out: str = "features") -> DataFrame:
    """Columns in their order as one vector; missing and non-finite values are 0."""
    safe = [G.finite_or(F.coalesce(F.col(n).cast("double"), F.lit(0.0)), 0.0).alias(f"_f_{n}") for n in names]
    rows = df.select("*", *safe)
    made = VectorAssembler(inputCols=[f"_f_{n}" for n in names], outputCol=out).transform(rows)
    return made.drop(*[f"_f_{n}" for n in names])


# Feature families of the ablation study.
GROUPS = {"G": ("geometry",), "D": ("texture",), "M": ("motion",), "GD": ("geometry", "texture"),
          "GM": ("geometry", "motion"), "DM": ("texture", "motion")}


def ablation_columns(families: dict[str, Sequence[str]], group: str) -> list[str]:
    """Columns of an ablation group (G, D, M or a pair)."""
    if group.upper() not in GROUPS:
        raise ValueError(f"unknown group {group!r}; choose from {sorted(GROUPS)}")
    return [c for f in GROUPS[group.upper()] for c in families[f]]


def pool(df: DataFrame, key: Sequence[str], vector: str, weight: str | None = None) -> DataFrame:
    """Mean of vectors per key; weighted where weights add up to something, plain otherwise."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    rows = df.select(*key, v.alias("_v"), *([F.col(weight).alias("_w")] if weight else []))
    aggs = [Summarizer.mean(F.col("_v")).alias("_m")]
    if weight:
        rows = rows.withColumn("_w", F.greatest(G.finite_or(F.col("_w"), 0.0), F.lit(0.0)))
        # a weight of 0 drops out of the weighted mean; the tiny floor only keeps it defined
        aggs += [Summarizer.mean(F.col("_v"), F.col("_w") + 1e-300).alias("_wm"), F.sum("_w").alias("_s")]
    out = rows.groupBy(*key).agg(*aggs)
    best = F.when(F.col("_s") > 1e-9, F.col("_wm")).otherwise(F.col("_m")) if weight else F.col("_m")
    return out.select(*key, vector_to_array(best).alias(vector))


def fit_pca(df: DataFrame, vector: str, k: int) -> dict:
    """Mean and principal axes (d x k on the driver). Each axis points to where its largest loading is positive."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    stats = rows.agg(Summarizer.mean(F.col("v")).alias("m"), F.count(F.lit(1)).alias("n")).first()
    d = len(stats["m"])
    if d <= k:
        return {"mean": [0.0] * d, "axes": None, "k": k}
    actual = min(k, d, stats["n"])
    axes = PCA(k=actual, inputCol="v", outputCol="o").fit(rows).pc.toArray()
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(actual)])
    return {"mean": [float(x) for x in stats["m"].toArray()], "axes": axes * sign, "k": k}


def project(df: DataFrame, vector: str, axes: np.ndarray, mean: Sequence[float] | None = None, k: int | None = None) -> DataFrame:
    """``vector`` times a d x k matrix held by the driver; padded with zeros to ``k``."""
    x = F.col(vector).cast("array<double>")
    offset = np.zeros(axes.shape[1]) if mean is None else np.asarray(mean) @ axes

    def dot(j: int) -> Column:
        col = F.array(*[F.lit(float(a)) for a in axes[:, j]])
        return F.aggregate(F.zip_with(x, col, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) - float(offset[j])

    parts = [dot(j) for j in range(axes.shape[1])]
    parts += [F.lit(0.0)] * max(0, (k or 0) - axes.shape[1])
    return df.withColumn(vector, F.array(*parts))


def apply_pca(df: DataFrame, vector: str, model: dict) -> DataFrame:
    if model["axes"] is None:
        pad = model["k"] - len(model["mean"])
        x = F.col(vector).cast("array<double>")
        return df.withColumn(vector, F.concat(x, F.array_repeat(F.lit(0.0), pad)) if pad > 0 else x)
    return project(df, vector, model["axes"], model["mean"], model["k"])


def projection_weights(spark: SparkSession, d: int, k: int, seed: int = 42) -> DataFrame:
    """(j, weights): a unit direction of d Gaussian numbers per output, drawn from digests of (seed, input, output)."""
    cells = spark.range(d).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("i").cast("string"), F.col("j").cast("string")))
    u, v = [(F.conv(F.substring(h, at, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0) for at in (1, 9)]
    cells = cells.withColumn("g", F.sqrt(-2.0 * F.log(u)) * F.cos(v * F.lit(6.283185307179586)))
    out = cells.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("i", "g"))).alias("g"), F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm"))
    return out.select("j", F.transform("g", lambda x: x["g"] / F.col("norm")).alias("weights"))


def random_projection(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """``vector`` on k random directions; vectors of at most k numbers are padded with zeros instead.

    The weights are one row (k arrays of the vector's length) beside every row.
    """
    first = df.select(F.size(vector).alias("d")).where("d >= 0").first()
    d = first["d"] if first else 0
    x = F.col(vector).cast("array<double>")
    if d <= k:
        return df.withColumn(vector, F.concat(x, F.array_repeat(F.lit(0.0), k - d)))
    rows = sorted((r["j"], r["weights"]) for r in projection_weights(df.sparkSession, d, k, seed).collect())  # k x d numbers
    parts = [
        F.aggregate(F.zip_with(x, F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        for _, weights in rows
    ]
    return df.withColumn(vector, F.array(*parts))


def channel_matrix(series: DataFrame, key: Sequence[str], channels: Sequence[str], value: str = "value") -> DataFrame:
    """Long series to one vector of channels per (key, step)."""
    wide = series.groupBy(*key, "step").agg(
        *[F.max(F.when(F.col("channel") == c, F.col(value))).alias(c) for c in channels]
    )
    return wide.select(*key, "step", F.array(*[F.coalesce(c, F.lit(0.0)) for c in channels]).alias("vector"))


def second_moments(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance (sample) and count; the d x d matrix comes from one distributed pass."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    s = rows.agg(Summarizer.metrics("mean", "std", "count").summary(F.col("v")).alias("s")).first()["s"]
    corr = np.nan_to_num(Correlation.corr(rows, "v").first()[0].toArray())
    std = s["std"].toArray()
    cov = corr * np.outer(std, std)
    np.fill_diagonal(cov, std**2)
    return s["mean"].toArray(), cov, int(s["count"])


def fit_lda(df: DataFrame, vector: str, label: str, k: int, ridge: float = 1e-6) -> np.ndarray:
    """Discriminant axes from class means and the pooled scatter (d x d on the driver)."""
    mean, cov, n = second_moments(df, vector)
    classes = df.groupBy(label).agg(
        Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("m"), F.count(F.lit(1)).alias("n")
    ).collect()  # one row per class
    between = sum(r["n"] * np.outer(r["m"].toArray() - mean, r["m"].toArray() - mean) for r in classes)
    within = cov * (n - 1) - between
    within += np.eye(len(mean)) * ridge * max(1.0, np.trace(within) / len(mean))
    vals, vecs = np.linalg.eig(np.linalg.solve(within, between))
    order = np.argsort(-vals.real)[: min(k, len(classes) - 1, len(mean))]
    axes = vecs[:, order].real
    axes = axes / np.linalg.norm(axes, axis=0, keepdims=True)
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


def fit_channel_lda(df: DataFrame, key: Sequence[str], vector: str, label: str, k: int, ridge: float = 1e-6) -> np.ndarray:
    """Discriminant axes of channels, from one vector of channels per (key, step).

    Between the classes counts what their mean series do at every step: class means per step against
    the mean of that step; within, what series differ from their class's mean series. Both scatters are channel x
    channel and come from grouped moments; the driver holds these, class means are one row per class and step.
    """
    x = array_to_vector(F.col(vector).cast("array<double>"))
    cells = df.groupBy(label, "step").agg(Summarizer.mean(x).alias("m"), F.count(F.lit(1)).alias("n"))
    steps = df.groupBy("step").agg(Summarizer.mean(x).alias("all"))
    gap = F.zip_with(vector_to_array("m"), vector_to_array("all"), lambda a, b: a - b)
    between = _scatter(cells.join(steps, "step").select(gap.alias("v"), F.col("n").cast("double").alias("w")))
    own = F.zip_with(F.col(vector).cast("array<double>"), vector_to_array("m"), lambda a, b: a - b)
    within = _scatter(df.join(cells, [label, "step"]).select(own.alias("v"), F.lit(1.0).alias("w")))
    d = len(within)
    within = within + np.eye(d) * ridge * max(1.0, np.trace(within) / d)
    classes = df.select(label).distinct().count()
    root = np.linalg.cholesky(within)
    inner = np.linalg.solve(root, np.linalg.solve(root, between).T)
    vals, vecs = np.linalg.eigh((inner + inner.T) / 2)
    # steps add to the rank of the class means, so there may be more axes than classes
    order = np.argsort(-vals, kind="stable")[: min(k, d) if classes > 1 else 0]
    axes = np.linalg.solve(root.T, vecs[:, order])
    axes = axes / np.linalg.norm(axes, axis=0, keepdims=True)
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


def _scatter(rows: DataFrame) -> np.ndarray:
    """Sum of w v v' over rows(v, w); d x d on the driver."""
    outer = F.flatten(F.transform("v", lambda a: F.transform("v", lambda b: a * b * F.col("w"))))
    out = rows.agg(vector_to_array(Summarizer.sum(array_to_vector(outer))).alias("s")).first()["s"]
    d = int(round(len(out) ** 0.5))
    return np.array(out).reshape(d, d)


def fit_pls(df: DataFrame, vector: str, target: str, k: int) -> np.ndarray:
    """Partial least squares axes for one target, from second moments only."""
    arr = F.col(vector).cast("array<double>")
    mean, cov, _ = second_moments(df.select(F.concat(arr, F.array(F.col(target).cast("double"))).alias("z")), "z")
    sxx, sxy = cov[:-1, :-1].copy(), cov[:-1, -1].copy()
    weights, loads = [], []
    for _ in range(min(k, len(sxy))):
        norm = np.linalg.norm(sxy)
        if norm < 1e-12:
            break
        w = sxy / norm
        t = float(w @ sxx @ w)
        if t < 1e-12:
            break
        p = sxx @ w / t
        weights.append(w)
        loads.append(p)
        sxx = sxx - t * np.outer(p, p)
        sxy = sxy - p * float(w @ sxy)
    w, p = np.array(weights).T, np.array(loads).T
    return w @ np.linalg.inv(p.T @ w)


def correlation_keep(df: DataFrame, names: Sequence[str], threshold: float = 0.98, min_keep: int = 1) -> list[str]:
    """Columns left when, from the first on, each kept one removes its near copies."""
    if len(names) <= min_keep or threshold >= 1.0:
        return list(names)
    corr = np.abs(np.nan_to_num(Correlation.corr(vectorise(df, names, "_v"), "_v").first()[0].toArray()))
    keep: list[int] = []
    for j in range(len(names)):
        if all(corr[i, j] < threshold for i in keep):
            keep.append(j)
    if len(keep) < min_keep:
        keep = list(range(min(min_keep, len(names))))
    return [names[j] for j in keep]


def restore_importances(kept: DataFrame, all_names: Sequence[str], feature: str = "feature") -> DataFrame:
    """Importances of kept columns placed in the full list; removed columns get 0."""
    full = kept.sparkSession.createDataFrame([(i, n) for i, n in enumerate(all_names)], f"position int, {feature} string")
    return full.join(kept, feature, "left").fillna(0.0, ["importance"])


def impute_values(df: DataFrame, names: Sequence[str], how: str = "median", constant: float = 0.0) -> dict[str, float]:
    """Replacement per column, learnt from the training rows."""
    if how == "constant":
        return {n: float(constant) for n in names}
    if how == "mean":
        row = df.agg(*[F.avg(G.finite_or(F.col(n))).alias(n) for n in names]).first()
        return {n: row[n] if row[n] is not None else 0.0 for n in names}
    rows = df.select(*[G.finite_or(F.col(n).cast("double")).alias(n) for n in names])
    long = rows.unpivot([], list(names), "name", "v").where(F.col("v").isNotNull())
    if how == "median":
        got = percentiles(long, ["name"], "v", {"m": 0.5}).collect()  # one row per column
        found = {r["name"]: r["m"] for r in got}
    elif how == "mode":
        counts = long.groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
        got = counts.groupBy("name").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("m")).collect()
        found = {r["name"]: r["m"] for r in got}
    else:
        raise ValueError(f"unknown imputation {how!r}")
    return {n: found.get(n, 0.0) for n in names}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({n: F.coalesce(G.finite_or(F.col(n).cast("double")), F.lit(v)) for n, v in values.items()})


# ---- classifiers -------------------------------------------------------------


class FourierFeatures:
    """Random Fourier features: their dot products approach the Gaussian kernel exp(-gamma |x - y|^2).

    Frequencies and phases are drawn from a fixed seed; ``gamma`` by default is 1 / (numbers of a vector x
    variance of all their entries), learned from the rows given to :meth:`fit`.
    """

    def __init__(self, components: int = 512, gamma: float | None = None, seed: int = 42):
        self.components, self.gamma, self.seed = components, gamma, seed

    def fit(self, df: DataFrame, features: str) -> FourierFeatures:
        if self.gamma is None:
            x = F.explode(vector_to_array(F.col(features)))
            row = df.select(F.size(vector_to_array(F.col(features))).alias("d"), x.alias("x")).agg(F.max("d").alias("d"), F.var_pop("x").alias("v")).first()
            self.gamma = 1.0 / (row["d"] * row["v"]) if row["d"] and row["v"] else 1.0
        return self

    def transform(self, df: DataFrame, features: str, out: str) -> DataFrame:
        components, gamma, seed = self.components, self.gamma, self.seed

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            if not len(x):
                return x
            z = np.stack(x.to_numpy())
            rng = np.random.default_rng(seed)
            w, b = rng.normal(size=(z.shape[1], components)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, components)
            return pd.Series(list(np.sqrt(2 / components) * np.cos(z @ w + b)))

        return df.withColumn(out, array_to_vector(mapped(vector_to_array(F.col(features)))))


class KernelSVC:
    """Support vector machine with a Gaussian kernel: random Fourier features before MLlib's linear machine.

    ``C`` is the usual weight of the hinge losses, so the linear machine is regularised by 1 / (C rows).
    """

    def __init__(self, featuresCol: str = "features", C: float = 1.0, components: int = 512, gamma: float | None = None, seed: int = 42, **linear):
        self.features, self.c, self.linear = featuresCol, C, linear
        self.map = FourierFeatures(components, gamma, seed)

    def fit(self, df: DataFrame) -> KernelSVCModel:
        self.map.fit(df, self.features)
        rows = self.map.transform(df, self.features, "_fourier")
        machine = LinearSVC(**{"maxIter": 50, "standardization": False, "regParam": 1.0 / (self.c * max(1, df.count())), **self.linear, "featuresCol": "_fourier"})
        return KernelSVCModel(machine.fit(rows), self.map, self.features)


class KernelSVCModel:
    def __init__(self, model, features_map: FourierFeatures, features: str):
        self.model, self.map, self.features = model, features_map, features

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.map.transform(df, self.features, "_fourier")).drop("_fourier")


def _logistic(**p):
    return LogisticRegression(**{"maxIter": 50, "regParam": 1e-4, **p})


CLASSIFIERS: dict[str, Callable] = {
    "random_forest": lambda **p: RandomForestClassifier(**{"numTrees": 200, "seed": 42, **p}),
    "decision_tree": lambda **p: DecisionTreeClassifier(**{"seed": 42, **p}),
    "svm": lambda **p: KernelSVC(**p),
    "linear_svm": lambda **p: LinearSVC(**{"maxIter": 50, **p}),
    "boosted_trees": lambda **p: GBTClassifier(**{"maxIter": 200, "seed": 42, **p}),
    "logistic_regression": _logistic,
    "mlp": lambda **p: MultilayerPerceptronClassifier(**{"maxIter": 100, "seed": 42, **p}),
}
WEIGHTED = {"random_forest", "decision_tree", "svm", "linear_svm", "boosted_trees", "logistic_regression"}


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """n / (classes * rows of the class), as one small map."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, c = sum(counts.values()), len(counts)
    w = F.lit(1.0)
    for value, rows in counts.items():
        w = F.when(F.col(label) == F.lit(value), F.lit(n / (c * rows))).otherwise(w)
    return df.withColumn(out, w)


def fit(df: DataFrame, kind: str, label: str = "label", features: str = "features", balanced: bool = False, **params):
    if kind not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {kind!r}; choose from {sorted(CLASSIFIERS)}")
    args = {"labelCol": label, "featuresCol": features, **params}
    if balanced and kind in WEIGHTED:
        df = balanced_weights(df, label)
        args["weightCol"] = "weight"
    sc = df.sparkSession.sparkContext
    if kind == "boosted_trees" and not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))  # else every round carries the lineage of all before
    if kind == "mlp" and "layers" not in params:
        args["layers"] = [len(df.select(features).first()[0]), 16, 2]
    return CLASSIFIERS[kind](**args).fit(df)


def positive_probability(model, df: DataFrame, out: str = "prob") -> DataFrame:
    """Probability of class 1; a margin classifier's margin goes through the logistic function."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        p = vector_to_array(F.col("probability"))[1]
    else:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array(F.col("rawPrediction"))[1]))
    drop = [c for c in ("rawPrediction", "probability", "prediction", "weight") if c not in df.columns]
    return scored.withColumn(out, p).drop(*drop)


def out_of_fold(
    df: DataFrame, group: str, kind: str = "logistic_regression", label: str = "label", features: str = "features", **params
) -> DataFrame:
    """Probabilities of each group from a model that never saw it; groups whose training side has one class are skipped.

    Logistic models of all folds are learned in the same passes (:func:`framelane.operators.folds.leave_one_out`);
    other kinds take one distributed fit per group, the groups of the reference being subjects.
    """
    if kind == "logistic_regression" and not set(params) - {"regParam"}:
        from framelane.operators import folds

        df = cut(df)
        return folds.score_left_out(df, folds.leave_one_out(df, group, label, features, params.get("regParam", 1e-4)), group, features)
    df = cut(df)
    groups = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]
    parts = []
    for g in groups:
        train, test = df.where(F.col(group) != F.lit(g)), df.where(F.col(group) == F.lit(g))
        if train.select(label).distinct().count() < 2:
            continue
        parts.append(positive_probability(fit(train, kind, label, features, **params), test))
    if not parts:
        raise ValueError("no group leaves two classes to train on")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def permutation_importance(model, df: DataFrame, names: Sequence[str], row_id: str, label: str = "label") -> DataFrame:
    """Accuracy lost when one column is dealt out anew among all rows, for every column.

    Row i of a random order gives its value to row i of the digest order of ids; both
    orders are cut into digest blocks, so no column is dealt in one task. A linear model's
    score changes by one term only, so its rows meet dealt values as single numbers and
    what is moved is linear in rows times columns; other models get the changed vectors.
    """
    from framelane.operators.associate import shuffled_positions

    if hasattr(model, "coefficients") and hasattr(model, "intercept"):
        return _linear_permutation_importance(model, df, names, row_id, label)
    arr = F.array(*[F.col(n).cast("double") for n in names])
    rows = cut(df.select(row_id, label, arr.alias("x")))
    feature = F.array(*[F.lit(n) for n in names])
    place = shuffled_positions(rows.select(row_id), row_id, 1).select(row_id, F.col("pos0").alias("i"))
    dealt = shuffled_positions(rows.select(row_id, "x"), row_id, len(names), first=1)
    dealt = dealt.select(F.col("pos0").alias("i"), (F.col("perm") - 1).alias("at"), F.get("x", F.col("perm") - 1).alias("v"))
    mixed = rows.join(place, row_id).join(dealt, "i")
    x = F.transform("x", lambda v, i: F.when(i == F.col("at"), F.col("v")).otherwise(v))
    mixed = mixed.select(F.get(feature, F.col("at")).alias("feature"), label, x.alias("x"))
    both = rows.select(F.lit("").alias("feature"), label, "x").unionByName(mixed)
    scored = positive_probability(model, both.withColumn("features", array_to_vector("x")))
    hit = ((F.col("prob") >= 0.5).cast("int") == F.col(label)).cast("double")
    acc = cut(scored.groupBy("feature").agg(F.avg(hit).alias("acc")))
    whole = acc.where(F.col("feature") == "").first()["acc"]
    return acc.where(F.col("feature") != "").select(
        "feature", (F.lit(whole) - F.col("acc")).alias("importance"), F.lit(whole).alias("base_accuracy")
    )


def _linear_permutation_importance(model, df: DataFrame, names: Sequence[str], row_id: str, label: str) -> DataFrame:
    from framelane.operators.associate import shuffled_positions

    weights = [float(w) for w in model.coefficients]
    margin = sum((F.col(n).cast("double") * w for n, w in zip(names, weights)), F.lit(float(model.intercept)))
    cells = F.array(*[F.struct(F.lit(j + 1).alias("perm"), F.lit(n).alias("feature"), F.lit(w).alias("w"), F.col(n).cast("double").alias("v")) for j, (n, w) in enumerate(zip(names, weights))])
    rows = cut(df.select(row_id, label, margin.alias("margin"), cells.alias("cells")))
    place = shuffled_positions(rows.select(row_id), row_id, 1).select(row_id, F.col("pos0").alias("i"))
    long = rows.join(place, row_id).select("i", label, "margin", F.inline("cells"))
    dealt = shuffled_positions(rows.select(row_id), row_id, len(names), first=1).select(row_id, "perm", F.col("pos0").alias("i"))
    dealt = dealt.join(rows.select(row_id, F.inline(F.transform("cells", lambda c: F.struct(c["perm"].alias("perm"), c["v"].alias("dealt"))))), [row_id, "perm"])
    mixed = long.join(dealt.select("i", "perm", "dealt"), ["i", "perm"])
    right = ((F.col("margin") + F.col("w") * (F.col("dealt") - F.col("v")) >= 0).cast("int") == F.col(label)).cast("double")
    base = rows.agg(F.avg(((F.col("margin") >= 0).cast("int") == F.col(label)).cast("double")).alias("a")).first()["a"]
    return mixed.groupBy("feature").agg(F.avg(right).alias("acc")).select(
        "feature", (F.lit(base) - F.col("acc")).alias("importance"), F.lit(base).cast("double").alias("base_accuracy")
    )


def embedding_pipeline(
    train: DataFrame, test: DataFrame, key: Sequence[str], vector: str, k: int, weight: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """PCA on all training regions, pool per key, standardise with training statistics; columns e0 .. e{k-1}."""
    from framelane.operators.features import apply_zscore, fit_zscore

    model = fit_pca(train, vector, k)
    names = [f"e{i}" for i in range(k)]
    out = []
    for df in (train, test):
        pooled = pool(apply_pca(df, vector, model), key, vector, weight)
        out.append(pooled.select(*key, *[F.col(vector)[i].alias(n) for i, n in enumerate(names)]))
    train_f = cut(out[0])
    z = fit_zscore(train_f, names)
    return apply_zscore(train_f, z), apply_zscore(out[1], z)
