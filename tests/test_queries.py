"""Every registered query with SQL equals DuckDB on the smallest tables (a quick subset by default)."""

import pytest

from check import compare, connect
from framelane.plans import catalog

QUICK = [
    "video_summary", "detection_counts", "success_curve", "fill_gaps", "repair_query_frames", "drop_long_runs", "savgol",
    "confidence_estimate", "roc_auc", "youden_threshold", "score_correlation", "trajectory_quality", "grey_cooccurrence",
    "stratified_split", "coco_vid_source", "dataset_cube", "stage_summaries", "lda_conditions", "pca_embeddings", "canonical_modalities",
]


@pytest.fixture(scope="session")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sf, duck, name):
    state, _, rows, note = compare(spark, duck, name, catalog.QUERIES[name], catalog.ORACLES[name], sf)
    assert state == "ok", note
    assert rows


def test_registry_is_consistent():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) == set(catalog.COVERS)
