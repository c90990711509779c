"""Models over folds, discriminants, importances and splits against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from framelane.operators import folds, report, splits
from framelane.operators import modelling as M
from framelane.sources import readers


def sample(n=240, d=5, groups=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 10, 0.1, 1, 1][:d]
    x[:, -1] = 3.0  # flat
    y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=n) > 0).astype(int)
    return pd.DataFrame({"id": range(n), "g": [f"s{i % groups}" for i in range(n)], "label": y, **{f"f{j}": x[:, j] for j in range(d)}})


def given(spark, pdf, d=5):
    return M.vectorise(spark.createDataFrame(pdf), [f"f{j}" for j in range(d)])


def plain_fit(x, y, weight, reg):
    keep = x.std(axis=0) > 1e-9
    v = folds.fit_logistic(x[:, keep], y.astype(float), weight, reg)
    w = np.zeros(x.shape[1])
    w[keep] = v[:-1]
    return w, v[-1]


@pytest.mark.parametrize("balanced", [False, True])
def test_leave_one_out_equals_a_fit_per_fold(spark, balanced):
    pdf = sample()
    df = given(spark, pdf).repartition(5)
    got = {r["g"]: r for r in folds.leave_one_out(df, "g", reg=1e-3, balanced=balanced).collect()}
    assert set(got) == set(pdf.g) and max(r["slope"] for r in got.values()) < 1e-9
    x = pdf[[f"f{j}" for j in range(5)]].to_numpy()
    for g, r in got.items():
        train = (pdf.g != g).to_numpy()
        y = pdf.label.to_numpy()[train]
        weight = len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum())) if balanced else np.ones(len(y))
        w, b = plain_fit(x[train], y, weight, 1e-3)
        assert np.allclose(r["weights"], w, atol=1e-6) and abs(r["intercept"] - b) < 1e-6 and r["rows"] == train.sum()


def test_leave_one_out_equals_the_library_and_takes_blocks_of_folds(spark):
    pdf = sample(seed=3)
    df = given(spark, pdf)
    got = {r["g"]: r for r in folds.leave_one_out(df, "g", reg=1e-2).collect()}
    small = {r["g"]: r for r in folds.leave_one_out(df, "g", reg=1e-2, block_bytes=1500).collect()}
    for g in ("s0", "s5"):
        one = LogisticRegression(regParam=1e-2, maxIter=200, tol=1e-12).fit(df.where(F.col("g") != g))
        assert np.allclose(got[g]["weights"], one.coefficients.toArray(), atol=1e-5) and abs(got[g]["intercept"] - one.intercept) < 1e-4
    assert set(small) == set(got) and all(np.allclose(small[g]["weights"], got[g]["weights"], atol=1e-7) for g in got)


def test_leave_one_out_edge_cases(spark):
    pdf = sample(n=60, groups=4)
    pdf["label"] = (pdf.g == "s0").astype(int)  # without s0 one class is left
    df = given(spark, pdf)
    assert {r["g"] for r in folds.leave_one_out(df, "g").collect()} == {"s1", "s2", "s3"}
    none = df.withColumn("g", F.when(F.col("g") != "s1", F.col("g")))
    assert {r["g"] for r in folds.leave_one_out(none, "g").collect()} == {"s2", "s3"}
    assert folds.leave_one_out(df.limit(0), "g").collect() == []
    assert folds.leave_one_out(df.where("label = 1"), "g").collect() == []
    scored = M.out_of_fold(df, "g", "logistic_regression")
    assert scored.count() == 45 and scored.columns == [*df.columns, "prob"]


def test_embedding_folds_equal_a_plain_version(spark):
    rng = np.random.default_rng(2)
    n, d, k = 150, 8, 3
    x = rng.normal(size=(n, d)) + np.repeat(rng.normal(size=(10, d)), 15, axis=0)
    pdf = pd.DataFrame({"s": np.repeat(np.arange(10), 15), "embedding": list(x), "label": np.repeat(np.arange(10) % 2, 15)})
    got = {r["s"]: r for r in folds.embedding_leave_one_out(spark.createDataFrame(pdf).repartition(4), "s", "label", "embedding", k).collect()}
    means = np.array([x[pdf.s == s].mean(axis=0) for s in range(10)])
    y = np.arange(10) % 2
    for s, r in got.items():
        train = x[(pdf.s != s).to_numpy()]
        values, vectors = np.linalg.eigh(np.cov(train.T))
        axes = vectors[:, ::-1][:, :k]
        z = (means - train.mean(axis=0)) @ axes
        other = np.arange(10) != s
        z = (z - z[other].mean(axis=0)) / z[other].std(axis=0)
        w = np.where(y[other] == 1, other.sum() / (2 * y[other].sum()), other.sum() / (2 * (1 - y[other]).sum()))
        v = folds.fit_logistic(z[other], y[other].astype(float), w, 1e-4)
        assert r["prob"] == pytest.approx(1 / (1 + np.exp(-(z[s] @ v[:-1] + v[-1]))), abs=1e-5)
        assert r["explained"] == pytest.approx(values[::-1][:k].sum()) and r["total"] == pytest.approx(values.sum())
    assert len(got) == 10
    with pytest.raises(ValueError):
        folds.embedding_leave_one_out(spark.createDataFrame(pdf), "s", "label", "embedding", k, means_bytes=10)


def test_linear_importance_equals_changing_whole_vectors(spark):
    pdf = sample(n=120)
    names = [f"f{j}" for j in range(5)]
    df = spark.createDataFrame(pdf)
    model = M.fit(M.vectorise(df, names), "logistic_regression")

    class Whole:
        def transform(self, rows):
            return model.transform(rows)

    fast = {r["feature"]: (r["importance"], r["base_accuracy"]) for r in M.permutation_importance(model, df, names, "id").collect()}
    slow = {r["feature"]: (r["importance"], r["base_accuracy"]) for r in M.permutation_importance(Whole(), df, names, "id").collect()}
    assert set(fast) == set(names) and all(fast[n] == pytest.approx(slow[n]) for n in names)
    assert fast["f0"][0] > fast["f3"][0] and fast["f4"][0] == 0


def test_kernel_machine_learns_what_a_linear_one_cannot(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, size=(400, 2))
    pdf = pd.DataFrame({"f0": x[:, 0], "f1": x[:, 1], "label": (x[:, 0] * x[:, 1] > 0).astype(int)})
    df = M.vectorise(spark.createDataFrame(pdf), ["f0", "f1"])
    right = {}
    for kind in ("svm", "linear_svm"):
        out = M.positive_probability(M.fit(df.limit(300), kind), df).toPandas()
        right[kind] = ((out.prob >= 0.5) == (out.label == 1)).mean()
    assert right["svm"] > 0.9 > 0.7 > right["linear_svm"]


def test_fourier_features_approach_the_kernel(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20, 3))
    df = M.vectorise(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])), ["a", "b", "c"])
    mapped = M.FourierFeatures(components=20_000, gamma=0.3).fit(df, "features").transform(df, "features", "z").toPandas()
    z = np.array([v.toArray() for v in mapped.z])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_channel_discriminants_equal_a_dense_solve(spark):
    rng = np.random.default_rng(7)
    rows, cells = [], {}
    for i in range(60):
        label = i % 3
        for step in range(4):
            v = rng.normal(size=5) * [1, 2, 1, 3, 1] + [label * (step == 1), 0, label * (step > 1), 0, 0]
            rows.append((i, label, step, [float(a) for a in v]))
            cells.setdefault((label, step), []).append(v)
    df = spark.createDataFrame(rows, "vid long, label int, step int, vector array<double>").repartition(4)
    axes = M.fit_channel_lda(df, ["vid"], "vector", "label", 2)
    every = {s: np.array([v for (_, t), vs in cells.items() if t == s for v in vs]).mean(axis=0) for s in range(4)}
    between = sum(len(vs) * np.outer(np.mean(vs, axis=0) - every[s], np.mean(vs, axis=0) - every[s]) for (_, s), vs in cells.items())
    within = sum(np.outer(v - np.mean(vs, axis=0), v - np.mean(vs, axis=0)) for vs in cells.values() for v in vs)
    values, vectors = np.linalg.eig(np.linalg.solve(within + np.eye(5) * 1e-6 * np.trace(within) / 5, between))
    for j, k in enumerate(np.argsort(-values.real)[:2]):
        v = vectors[:, k].real / np.linalg.norm(vectors[:, k].real)
        assert abs(abs(v @ axes[:, j]) - 1) < 1e-9
    assert M.fit_channel_lda(df.where("label = 1"), ["vid"], "vector", "label", 2).shape[1] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_splits_of_few_subjects_test_someone(spark, n):
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(n)], "subject_id int, label int")
    roles = [r["role"] for r in splits.stratified_split(df, 1, 0.6, 0.2).collect()]
    assert len(roles) == n and "test" in roles and (n == 1 or "train" in roles)


def test_features_absent_from_a_fold_count_as_zero(spark):
    imp = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (0, "b", -4.0), (2, "c", 0.3)], "fold int, feature string, importance double")
    got = {(r["list"], r["feature"]): r["mean_importance"] for r in report.fold_importance(imp, k=2).collect()}
    assert got == {("top", "a"): pytest.approx(4 / 3), ("top", "c"): pytest.approx(0.1), ("bottom", "c"): pytest.approx(0.1), ("bottom", "b"): pytest.approx(-4 / 3)}


def test_stage_summaries_of_mixed_metadata(spark):
    rows = [
        ("a", '{"stages":[],"metrics":{"detection":{"t":{"iou_mean":1,"fps":"9"},"u":{"iou_mean":0.5,"fps":null}},"segmentation":[1],"classification":{}}}', '{"f1":0.5}'),
        ("b", "[1]", None), ("c", None, None), ("d", "{}", "oops"), ("e", '{"metrics":7,"stages":"x"}', '{"f1":"0.5","accuracy":true}'),
    ]
    got = {r["name"]: r for r in readers.stage_summaries(spark.createDataFrame(rows, "name string, meta string, more string"), "meta", "more").collect()}
    assert got["a"]["det_iou_mean"] == 0.75 and got["a"]["det_fps"] is None and got["a"]["seg_dice_mean"] is None and got["a"]["clf_f1"] == 0.5
    assert [got[n]["status"] for n in "abcde"] == ["OK", "BROKEN", "BROKEN", "OK", "OK"]
    assert got["e"]["clf_f1"] is None and got["e"]["clf_accuracy"] is None and got["d"]["n_stages"] == 0 and got["b"]["n_stages"] is None
