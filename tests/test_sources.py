"""Files of the kinds the readers take."""

import json

import pytest

from framelane.sources import readers, sinks


def test_annotation_document(spark, tmp_path):
    doc = {
        "info": {"mask_root": "m"}, "videos": [{"id": 1, "name": "v1"}],
        "images": [{"id": 1, "frame_index": 4}, {"id": 3}, {"id": 9}],
        "annotations": [{"id": 1, "image_id": 1, "bbox": [1, 2, 3, 4]}, {"id": 2, "image_id": 3, "bbox": [5, 6, 7, 8]},
                        {"id": 3, "image_id": 3}, {"id": 4, "image_id": 77, "bbox": [0, 0, 1, 1]}],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    got = {r["frame_index"]: r["x"] for r in readers.read_coco_vid(spark, str(tmp_path)).collect()}
    assert got == {4: 1.0, 2: 5.0, 8: None}


def test_prediction_file(spark, tmp_path):
    place = tmp_path / "e1" / "test" / "predictions"
    place.mkdir(parents=True)
    (place / "Tracker.json").write_text(json.dumps([{"frame_index": 3, "bbox": [1, 2, 3, 4], "score": 0.5}, {"bbox": [1, 2, 3, 4]}]))
    got = readers.read_predictions(spark, str(place / "*.json")).collect()
    assert [(r["experiment"], r["tracker"], r["frame_index"], r["w"]) for r in got] == [("e1", "Tracker", 3, 3.0)]
    (place / "Tracker.json").write_text(json.dumps([{"frame_index": 3, "bbox": [1, 2]}]))
    with pytest.raises(Exception, match="bad bbox"):
        readers.read_predictions(spark, str(place / "*.json")).collect()


def test_labels(spark, tmp_path):
    (tmp_path / "ann.txt").write_text("# note\n001 1\n\n002 x\n003 0\n001 0\n")
    got = {r["subject_id"]: r["label"] for r in readers.read_labels(spark, str(tmp_path / "ann.txt")).collect()}
    assert got == {"001": 0, "003": 0}


def test_video_listing(spark, tmp_path):
    for name in ("001/Rest.avi", "001/Rest.json", "n02/D.mp4", "n02/x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = readers.scan_videos(readers.list_files(spark, str(tmp_path)), str(tmp_path)).collect()
    assert sorted((r["subject_id"], r["video_stem"], r["has_annotation"]) for r in got) == [("001", "Rest", True), ("n02", "D", False)]


def test_confidence_columns(spark):
    df = spark.createDataFrame([("t", 3, float("nan"), 0.25)], "tracker string, total_frames long, token_mean double, confidence_mean double")
    r = sinks.confidence_csv(df).first()
    assert (r["tracker"], r["total_frames"], r["token_component_mean"], r["confidence_mean"]) == ("t", "3", "", "0.250000")


def test_prediction_folders_do_not_grow_with_videos(spark, sf, monkeypatch):
    from framelane.plans import catalog, q_sources

    paths, make = [], q_sources.scratch
    monkeypatch.setattr(q_sources, "scratch", lambda s: paths.append(make(s)) or paths[-1])
    back = catalog.QUERIES["prediction_files"](spark, sf)
    rows = back.collect()
    want = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type", "int(user_id % 12)", "int(user_id)", "event_id").collect()
    assert sorted((r["model"], r["subject_id"], r["video_id"], r["pos"]) for r in rows) == sorted(map(tuple, want))
    files = spark.read.parquet(paths[0]).inputFiles()
    folders = {f.rsplit("/", 1)[0] for f in files}
    assert len(folders) == len({(r["model"], r["subject_id"]) for r in rows}) < len({(r["model"], r["subject_id"], r["video_id"]) for r in rows})
    assert len(files) < len(folders) + 8


@pytest.mark.parametrize("kind, text", [
    ("csv", "path,label\na.png,1\n ,0\nb.png,x\n"),
    ("json", '[{"image": "a.png", "y": "1"}, {"image": "", "y": "0"}, {"image_path": "b.png", "target": "x"}]'),
    ("jsonl", '{"image": "a.png", "y": 1}\n{"image": "", "y": 0}\n{"image_path": "b.png", "target": "x"}\n'),
])
def test_roi_manifests(spark, tmp_path, kind, text):
    (tmp_path / "m").write_text(text)
    got = readers.read_roi_manifest(spark, str(tmp_path / "m"), kind).collect()
    assert sorted((r["image_path"], r["label"]) for r in got) == [("a.png", 1), ("b.png", None)]
    with pytest.raises(ValueError, match="unknown manifest"):
        readers.read_roi_manifest(spark, str(tmp_path / "m"), "xml")
