"""Streams against plain versions: choice of candidates, signals that run ahead of each other."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelane.operators import confidence as C
from framelane.sources.readers import read_coco_vid
from framelane.streaming import online


def plain_choice(frame, ids, box, score, track, last, target):
    out = []
    for f in np.unique(frame):
        at = np.flatnonzero(frame == f)
        for want, name in ((target, "target"), (track, "sticky")):
            hit = at[ids[at] == want] if want is not None else at[:0]
            if len(hit):
                i, why = hit[0], name
                break
        else:
            over = online._overlap(box[at], last) if last is not None else np.zeros(len(at))
            i, why = (at[int(np.argmax(over))], "overlap") if over.max() > 0 else (at[int(np.argmax(score[at]))], "score")
        track, last = ids[i], box[i]
        out.append((i, why))
    return out


def test_choice_by_runs_equals_choice_by_frame():
    rng = np.random.default_rng(1)
    for trial in range(200):
        n = int(rng.integers(1, 60))
        frame = np.sort(rng.integers(0, 25, n))
        ids, score = rng.integers(0, 4, n), rng.random(n).round(1)
        box = np.column_stack([rng.integers(0, 30, (n, 2)), rng.integers(1, 15, (n, 2))]).astype(float)
        track, last = (None, None) if trial % 3 == 0 else (int(rng.integers(0, 4)), box[0] + 1)
        target = None if trial % 2 else 2
        picked, why = online.choose(frame, ids, box, score, track, last, target)
        assert list(zip(picked.tolist(), why.tolist())) == [(int(i), w) for i, w in plain_choice(frame, ids, box, score, track, last, target)]


def source(spark, folder, rows, schema, runs, files):
    for k, part in enumerate(runs):
        spark.createDataFrame([r for r in rows if part[0] <= r[1] < part[1]], schema).repartition(files, "video_id").write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(folder))


def test_frames_wait_for_their_signals(spark, tmp_path):
    rng = np.random.default_rng(2)
    frames = [(v, f, p, *[float(x) for x in rng.integers(1, 50, 4)], bool(rng.random() < 0.2)) for v in range(5) for f in range(30) for p in range(1 + (f % 7 == 0))]
    signals = [(v, f, 0, None if rng.random() < 0.3 else float(rng.random())) for v in range(5) for f in range(30)]
    boxes = "video_id long, frame_index int, pos long, x double, y double, w double, h double, is_fallback boolean"
    values = "video_id long, frame_index int, pos long, value double"
    stream = online.confidence_stream(
        source(spark, tmp_path / "b", frames, boxes, [(0, 10), (10, 20), (20, 30)], 2), 0.7,
        token=source(spark, tmp_path / "t", signals, values, [(0, 3), (3, 25), (25, 30)], 3),
        distribution=source(spark, tmp_path / "d", signals, values, [(0, 30)], 1),
    )
    got = online.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check")).toPandas().sort_values(["video_id", "frame_index"])
    first = spark.createDataFrame([r for r in frames if r[2] == 0], boxes).join(spark.createDataFrame(signals, values).select("video_id", "frame_index", "value"), ["video_id", "frame_index"])
    want = C.estimate(first, ["video_id"], F.col("value"), F.col("value")).toPandas().sort_values(["video_id", "frame_index"])
    assert len(got) == 150 and np.allclose(got.confidence, want.estimated) and np.allclose(got.drift, want.drift)
    for v, part in got.groupby("video_id"):
        run, held = 0, np.nan
        for (_, r), box in zip(part.iterrows(), [x for x in frames if x[0] == v and x[2] == 0]):
            run = run + 1 if r.confidence < 0.7 else 0
            held = held if box[7] else box[3]
            assert r.low_streak == run and (r.x == held or np.isnan(r.x) and np.isnan(held)) and r.held == (box[7] and not np.isnan(held))


def test_boxes_alone_need_no_signals(spark, tmp_path):
    frames = [(1, f, 0, 1.0 * f, 2.0, 10.0, 10.0, False) for f in range(12)] + [(1, 3, 1, 99.0, 2.0, 10.0, 10.0, False)]
    boxes = "video_id long, frame_index int, pos long, x double, y double, w double, h double, is_fallback boolean"
    stream = online.confidence_stream(source(spark, tmp_path / "b", frames, boxes, [(0, 6), (6, 12)], 1))
    got = online.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check")).toPandas().sort_values("frame_index")
    drift, blended, conf = online.preview(pd.DataFrame({"x": np.arange(12.0), "y": 2.0, "w": 10.0, "h": 10.0}), (0.0, 2.0, 10.0, 10.0), None)
    assert np.allclose(got.confidence, conf) and np.allclose(got.drift, drift) and got.token.isna().all()


def test_many_boxes_of_one_image_and_document(spark, tmp_path):
    import json

    images = [{"id": i + 1} for i in range(300)]
    boxes = [{"id": k, "image_id": k % 200 + 1, "bbox": [k, 0, 1, 1]} for k in range(3000)]
    (tmp_path / "v.json").write_text(json.dumps({"images": images, "annotations": boxes}))
    got = read_coco_vid(spark, str(tmp_path)).toPandas()
    assert len(got) == 3100 and got.x.isna().sum() == 100 and (got.video_id == "v").all()
    assert (got.dropna(subset="x").frame_index == got.x.dropna() % 200).all() and got.ann_pos.dropna().is_unique


@pytest.mark.parametrize("value", [None, float("nan"), 2.0])
def test_preview_ignores_missing_signals(value):
    rows = pd.DataFrame({"x": [0.0, 1.0], "y": [0.0, 0.0], "w": [4.0, 4.0], "h": [3.0, 3.0]})
    signal = None if value is None else np.full(2, value)
    _, blended, _ = online.preview(rows, (0.0, 0.0, 4.0, 3.0), None, token=signal)
    more = 0.4 if value == 2.0 else 0.0
    assert blended[0] == pytest.approx(1 / (1 + np.exp(-0.8 - more)))


def test_state_of_many_videos_is_packed(spark, tmp_path):
    rng = np.random.default_rng(3)
    frames = [(v, f, 10 * f + p, *[float(x) for x in rng.integers(1, 50, 4)], bool(rng.random() < 0.3)) for v in range(-70, 230) for f in range(v % 4, 12) for p in range(1 + f % 2)]
    boxes = "video_id long, frame_index int, pos long, x double, y double, w double, h double, is_fallback boolean"
    stream = online.confidence_stream(source(spark, tmp_path / "b", frames, boxes, [(0, 5), (5, 12)], 3), 0.68)
    got = online.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check")).toPandas().sort_values(["video_id", "frame_index"])
    assert spark.read.format("statestore").load(str(tmp_path / "check")).count() == 6
    first = spark.createDataFrame([r for r in frames if r[2] % 10 == 0], boxes)
    want = C.estimate(first, ["video_id"]).toPandas().sort_values(["video_id", "frame_index"])
    assert len(got) == len(want) and np.allclose(got.confidence, want.estimated) and np.allclose(got.drift, want.drift)

    cands = [(v, f, p, int(rng.integers(0, 3)), *r[3:7], float(rng.random())) for r in frames for v, f, p in [r[:3]]]
    names = "video_id long, frame_index int, pos long, track_id long, x double, y double, w double, h double, score double"
    stream = online.candidate_stream(source(spark, tmp_path / "c", cands, names, [(0, 5), (5, 12)], 3))
    got = online.run_available(stream, str(tmp_path / "out2"), str(tmp_path / "check2")).toPandas().sort_values(["video_id", "frame_index"])
    assert spark.read.format("statestore").load(str(tmp_path / "check2")).count() == 6
    for v, part in got.groupby("video_id"):
        mine = [r for r in cands if r[0] == v]
        box = np.array([r[4:8] for r in mine])
        want = plain_choice(np.array([r[1] for r in mine]), np.array([r[3] for r in mine]), box, np.array([r[8] for r in mine]), None, None, None)
        assert [(mine[i][1], mine[i][3], mine[i][8], why) for i, why in want] == list(zip(part.frame_index, part.track_id, part.score, part.reason))
    assert got.video_id.nunique() == 300
