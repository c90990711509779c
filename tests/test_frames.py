"""Hand values and properties of the ordered operators; long trajectories cross block borders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelane.operators import dedup, evaluate, frames, interpolate, smooth
from framelane.operators.ordered import neighbours, next_known, previous_known, row_position, running_sum, scan

KEY = ["video_id"]


def boxes(spark, rows, extra=""):
    """rows: (video, frame, x, y, w, h, score, is_fallback)"""
    return spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)],
        "video_id long, frame_index int, x double, y double, w double, h double, score double, is_fallback boolean, pos long",
    )


def test_scan_crosses_blocks(spark):
    df = spark.range(1000).select(F.lit(1).alias("video_id"), (F.col("id") * 3).cast("int").alias("frame_index"))
    df = df.withColumn("v", F.when(F.col("frame_index") % 10 == 0, F.col("frame_index").cast("double")))
    out = scan(
        df, KEY, "frame_index", row_position(), running_sum("s", F.col("frame_index")),
        previous_known("p", F.col("v"), "frame_index"), next_known("n", F.col("v"), "frame_index"), span=16,
    ).orderBy("frame_index").collect()
    known = [3 * i for i in range(1000) if 3 * i % 10 == 0]
    total = 0
    for i, r in enumerate(out):
        total += 3 * i
        before = [k for k in known if k < 3 * i]
        after = [k for k in known if k > 3 * i]
        assert (r["pos0"], r["s"]) == (i, total)
        assert r["p"] == (before[-1] if before else None)
        assert r["n"] == (after[0] if after else None)


def test_neighbours_cross_sparse_blocks(spark):
    f = [0, 5, 100, 101, 500, 501, 502, 9000]
    df = spark.createDataFrame([(1, x, float(x)) for x in f], "video_id int, frame_index int, v double")
    out = neighbours(df, KEY, "frame_index", ["v"], back=3, ahead=2, span=16).orderBy("frame_index").collect()
    for i, r in enumerate(out):
        for j in (1, 2, 3):
            assert r[f"v_lag{j}"] == (f[i - j] if i >= j else None)
        for j in (1, 2):
            assert r[f"v_lead{j}"] == (f[i + j] if i + j < len(f) else None)


def test_small_and_large_gaps(spark):
    near = boxes(spark, [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9, False), (1, 2, 20.0, 20.0, 10.0, 10.0, 0.9, False)])
    got = interpolate.fill_gaps(near, KEY, 5).orderBy("frame_index").collect()
    assert [r["frame_index"] for r in got] == [0, 1, 2]
    assert got[1]["is_fallback"] and got[1]["bbox_source"] == "interpolated_pchip"
    assert got[1]["x"] == pytest.approx(10.0)
    far = boxes(spark, [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9, False), (1, 10, 20.0, 20.0, 10.0, 10.0, 0.9, False)])
    assert interpolate.fill_gaps(far, KEY, 3).count() == 2


def test_filled_values_stay_in_range(spark):
    rows = [(1, f, x, x, 10.0, 10.0, 0.9, False) for f, x in ((0, 0.0), (3, 30.0), (6, 5.0), (9, 40.0))]
    got = interpolate.fill_gaps(boxes(spark, rows), KEY, 5).collect()
    assert len(got) == 10
    assert all(0.0 <= r["x"] <= 40.0 for r in got)


def test_repair_with_enough_anchors(spark):
    rows = [(1, 0, 10.0, 10.0, 10.0, 10.0, 0.9, False), (1, 1, 90.0, 90.0, 10.0, 10.0, 0.1, False),
            (1, 2, 30.0, 30.0, 10.0, 10.0, 0.9, False), (1, 3, 40.0, 40.0, 10.0, 10.0, 0.9, False)]
    got = {r["frame_index"]: r for r in interpolate.repair(boxes(spark, rows), None, KEY).collect()}
    assert got[1]["bbox_source"] == "interpolated_pchip" and got[1]["is_fallback"]
    assert got[1]["x"] == pytest.approx(20.0, abs=2.0)
    assert got[2]["bbox_source"] == "detector"


def test_repair_with_too_few_anchors(spark):
    rows = [(1, 0, 10.0, 10.0, 10.0, 10.0, 0.9, False), (1, 2, 30.0, 30.0, 10.0, 10.0, 0.9, False)]
    q = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "video_id long, frame_index int")
    got = {r["frame_index"]: r for r in interpolate.repair(boxes(spark, rows), q, KEY).collect()}
    assert (got[1]["x"], got[1]["w"], got[1]["bbox_source"]) == (0.0, 0.0, "missing")


def test_repair_fills_the_ends(spark):
    rows = [(1, f, float(f), float(f), 10.0, 10.0, 0.9, False) for f in (5, 10, 15)]
    q = spark.createDataFrame([(1, f) for f in (0, 5, 10, 15, 20)], "video_id long, frame_index int")
    got = {r["frame_index"]: r["x"] for r in interpolate.repair(boxes(spark, rows), q, KEY).collect()}
    assert got[0] == pytest.approx(5.0) and got[20] == pytest.approx(15.0)


def test_dedup_rules(spark):
    rows = [(1, 0, 1.0, 1.0, 10.0, 10.0, 0.2, False), (1, 0, 2.0, 1.0, 10.0, 10.0, 0.9, True), (1, 0, 3.0, 1.0, 10.0, 10.0, 0.4, False)]
    df = boxes(spark, rows)
    on = ["video_id", "frame_index"]
    assert dedup.first_per_frame(df, on).first()["x"] == 1.0
    assert dedup.detector_first(df, on).first()["x"] == 3.0
    assert dedup.most_confident(df, on).first()["x"] == 2.0


def test_hampel_hand_value(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 1.0, 100.0, 3.0, 4.0])], "video_id int, frame_index int, v double")
    out = smooth.hampel_then_fill(df, KEY, ["v"], macro_sigma=999.0, micro_half=1, micro_sigma=1.0).orderBy("frame_index").collect()
    assert out[2]["v_outlier"] and out[2]["v"] == pytest.approx(2.0)


def test_savgol_keeps_polynomials(spark):
    v = [0.5 * i * i - 3 * i + 2 for i in range(9000)]
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "video_id int, frame_index int, v double")
    out = smooth.savgol(df, KEY, ["v"], 7, 2).orderBy("frame_index").collect()
    assert np.allclose([r["v"] for r in out], v, rtol=1e-9, atol=1e-6)
    again = smooth.adaptive_savgol(df, KEY, ["v"], 7, 2).orderBy("frame_index").collect()
    assert np.allclose([r["v"] for r in again], v, rtol=1e-9, atol=1e-6)


def test_two_scale_hampel_same_in_any_block_size(spark, monkeypatch):
    from framelane.operators import kernels

    rng = np.random.default_rng(0)
    v = np.cumsum(rng.normal(size=600))
    v[::37] += 30
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "video_id int, frame_index int, v double")
    whole = smooth.two_scale_hampel(df, KEY, ["v"]).orderBy("frame_index").collect()
    monkeypatch.setattr(kernels, "CORE", 64)
    cut = smooth.two_scale_hampel(df, KEY, ["v"]).orderBy("frame_index").collect()
    assert whole == cut and any(r["v_outlier"] for r in whole)


def test_runs_over_block_borders(spark):
    df = spark.range(9000).select(F.lit(1).alias("video_id"), F.col("id").cast("int").alias("frame_index"), (F.col("id") > 10).alias("low"))
    got = frames.runs(df, KEY, F.col("low")).collect()
    assert [(r["start"], r["stop"]) for r in got] == [(11, 9000)]


def test_perfect_match(spark):
    rows = [(1, f, float(f), 1.0, 10.0, 10.0, 0.9, False) for f in range(5)]
    df = boxes(spark, rows)
    s = evaluate.video_summary(df, df, KEY).first()
    assert (s["count"], s["tp_50"], s["fn_50"]) == (5, 5, 0)
    assert s["iou_mean"] == pytest.approx(1.0) and s["success_auc"] == pytest.approx(1.0) and s["drift_rate"] == 0.0
