"""Ranks, thresholds, smoothing recurrences and reconstruction against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelane.operators import classify, confidence, modelling, reconstruct, splits
from framelane.operators.ranked import percentiles


def test_percentiles_of_one_hot_group(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=5000), 2)
    df = spark.createDataFrame([(1, float(x)) for x in v], "k int, v double")
    row = percentiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}).first()
    assert np.allclose([row["a"], row["b"], row["c"]], np.quantile(v, [0.05, 0.5, 0.95]))


def test_auc_mirrors(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.random() < 0.4), round(float(rng.random()), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "label_true int, prob double")
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    brute = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    a = classify.auc(df, []).first()["auc"]
    b = classify.auc(df.withColumn("prob", 1 - F.col("prob")), []).first()["auc"]
    assert a == pytest.approx(brute) and a + b == pytest.approx(1.0)


def test_first_frame_confidence(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0)], "video_id int, frame_index int, x double, y double, w double, h double")
    assert confidence.estimate(df, ["video_id"]).first()["estimated"] == pytest.approx(0.689974, abs=1e-6)


@pytest.mark.parametrize("alpha", [0.7, 0.05])
def test_ema_over_many_blocks(spark, alpha):
    rng = np.random.default_rng(3)
    v = rng.random(3000)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "video_id int, frame_index int, v double")
    got = [r["e"] for r in confidence.ema(df, ["video_id"], "v", "e", alpha).orderBy("frame_index").collect()]
    want = [v[0]]
    for x in v[1:]:
        want.append((1 - alpha) * want[-1] + alpha * x)
    assert np.allclose(got, want, rtol=1e-12)


def test_increments_match_dense_least_squares(spark):
    rng = np.random.default_rng(4)
    n = 300
    v, d, ok = rng.normal(size=n) * 5, rng.normal(size=n), rng.random(n) < 0.3
    rows = [(1, i, float(v[i]), float(d[i]), bool(ok[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "video_id int, frame_index int, v double, d double, ok boolean")
    got = [r["o"] for r in reconstruct.from_increments(df, ["video_id"], "v", "d", "ok", "o").orderBy("frame_index").collect()]
    first = int(np.where(ok)[0][0])
    a, b = [np.eye(n)[first]], [v[first]]
    for i in range(1, n):
        a.append(np.eye(n)[i] - np.eye(n)[i - 1])
        b.append(d[i])
    for i in np.where(ok)[0]:
        a.append(2 * np.eye(n)[i])
        b.append(2 * v[i])
    want = np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0]
    assert np.allclose(got, want, atol=1e-9)


def test_cubic_fill_reproduces_a_cubic(spark):
    f = lambda t: 0.01 * t**3 + t
    rows = [(1, t, f(t) if t % 3 == 0 else None) for t in range(0, 61)]
    df = spark.createDataFrame(rows, "video_id int, frame_index int, v double")
    got = reconstruct.cubic_fill(df, ["video_id"], ["v"], F.col("v").isNotNull()).collect()
    assert all(r["v"] == pytest.approx(f(r["frame_index"]), abs=1e-6) for r in got)


def test_lowess_follows_a_line_past_an_outlier(spark):
    rows = [(1, t, 2.0 * t + (80.0 if t == 20 else 0.0)) for t in range(40)]
    df = spark.createDataFrame(rows, "video_id int, frame_index int, v double")
    got = {r["frame_index"]: r for r in reconstruct.lowess(df, ["video_id"], "v").collect()}
    assert got[20]["residual"] == max(r["residual"] for r in got.values()) > 60
    assert got[5]["fit"] == pytest.approx(10.0, abs=1.0)


def test_splits_keep_subjects_apart(spark):
    v = spark.range(60).select(F.col("id").alias("video_id"), (F.col("id") % 9).alias("subject_id"))
    s = splits.subject_split(v, 1)
    assert s.groupBy("subject_id").agg(F.countDistinct("role").alias("n")).where("n > 1").isEmpty()
    fold = splits.loso_fold(v, 3)
    splits.assert_disjoint(fold.where("role = 'train'"), fold.where("role = 'test'"))
    with pytest.raises(ValueError):
        splits.assert_disjoint(v, v)


def test_pooling_without_weight_is_the_mean(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0.0), (1, [3.0, 6.0], 0.0), (2, [1.0, 1.0], 1.0), (2, [5.0, 9.0], 3.0)], "k int, v array<double>, w double")
    got = {r["k"]: r["v"] for r in modelling.pool(df, ["k"], "v", "w").collect()}
    assert got[1] == pytest.approx([2.0, 4.0]) and got[2] == pytest.approx([4.0, 7.0])


def test_missing_label_fails_the_job(spark):
    import pytest

    from framelane.operators import splits

    rows = spark.createDataFrame([(1,), (2,)], "subject_id long")
    labels = spark.createDataFrame([(1, 0)], "subject_id long, label int")
    assert splits.labelled(rows, labels).count() == 1
    with pytest.raises(Exception, match="missing label"):
        splits.require_match(splits.labelled(rows, labels, how="left"), "label", "label").collect()


def test_interpolation_kinds(spark):
    import pytest
    from pyspark.sql import functions as F

    from framelane.operators import interpolate

    rows = spark.createDataFrame([(1, t, float(t**3) if t != 4 else None) for t in range(8)], "k int, frame_index int, x double")
    got = interpolate.fill(rows, ["k"], ["x"], F.col("x").isNotNull(), kind="cubic").where("frame_index = 4").first()
    assert got["x"] == pytest.approx(64.0) and got["knots"] == 7
    with pytest.raises(ValueError, match="unknown kind"):
        interpolate.fill(rows, ["k"], ["x"], F.col("x").isNotNull(), kind="quartic")


def test_mean_displacement_counts_the_first_sample(spark):
    from framelane.operators import report

    rows = spark.createDataFrame([(1, t, 3.0 * t, 4.0 * t, 1.0, 1.0) for t in (0, 2, 4)], "k int, frame_index int, cx double, cy double, w double, h double")
    assert report.trajectory_quality(rows, ["k"]).first()["mean_speed"] == 20.0 / 3
    assert [r["displacement"] for r in report.track_samples(rows, ["k"]).orderBy("frame_index").collect()] == [0.0, 10.0, 10.0]


def test_random_projection_is_reproducible_and_unit(spark):
    import pytest

    from framelane.operators import modelling

    rows = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(6)]) for i in range(6)], "i int, v array<double>")
    one = [r["v"] for r in modelling.random_projection(rows, "v", 3).orderBy("i").collect()]
    assert one == [r["v"] for r in modelling.random_projection(rows.repartition(4), "v", 3).orderBy("i").collect()]
    for j in range(3):
        assert sum(x[j] ** 2 for x in one) == pytest.approx(1.0)
    assert len(modelling.random_projection(rows, "v", 8).first()["v"]) == 8
