"""Queries on single frames: geometry, predicates, one row per frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.functions import geometry as G
from framelane.operators import dedup as D
from framelane.plans.fixtures import BEST, DETECT, FIRST, PREDS, dedup_sql, preds
from framelane.plans.registry import pick, query, r6

FRAME = ["video_id", "frame_index"]


@query("dedup_first", "D1 D4", f"WITH {PREDS}, {FIRST} SELECT video_id, frame_index, pos FROM pf")
def _(spark, sf):
    return D.first_per_frame(preds(spark, sf), FRAME).select(*FRAME, "pos")


@query("dedup_detector_first", "D2", f"WITH {PREDS}, {DETECT} SELECT video_id, frame_index, pos FROM pd")
def _(spark, sf):
    return D.detector_first(preds(spark, sf), FRAME).select(*FRAME, "pos")


@query("dedup_most_confident", "D3 P6", f"WITH {PREDS}, {BEST} SELECT video_id, frame_index, pos FROM pb")
def _(spark, sf):
    return D.most_confident(preds(spark, sf), FRAME).select(*FRAME, "pos")


_SCORE = dedup_sql("ps", "preds", "coalesce(score, CAST('-infinity' AS DOUBLE)) DESC, pos")


@query("dedup_highest_score", "D5", f"WITH {PREDS}, {_SCORE} SELECT video_id, frame_index, pos FROM ps")
def _(spark, sf):
    return D.highest_score(preds(spark, sf), FRAME).select(*FRAME, "pos")
