"""Evaluation queries: prediction boxes against annotation boxes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framelane.operators import evaluate as E
from framelane.plans.fixtures import FIRST, GT, GT1, KEY, MATCHED, PREDS, gt, preds, sq_ce, sq_iou
from framelane.plans.registry import pick, query, r6

_UNION = f"""u AS (
  SELECT video_id, frame_index, pf.score, g1.x IS NOT NULL AS has_gt, pf.x IS NOT NULL AS has_pred,
         {sq_iou('pf', 'g1')} AS iou, {sq_ce('pf', 'g1')} AS ce
  FROM g1 FULL OUTER JOIN pf USING (video_id, frame_index))"""
UNION = f"WITH {PREDS}, {GT}, {FIRST}, {GT1}, {_UNION}"

_DET = """count(*) FILTER (WHERE has_gt AND has_pred AND iou >= {t}) AS tp_{s},
  count(*) FILTER (WHERE has_pred AND (NOT has_gt OR iou < {t})) AS fp_{s},
  count(*) FILTER (WHERE has_gt AND NOT has_pred) AS fn_{s}"""

_SUMMARY = f"""lagged AS (SELECT *, CASE WHEN ce IS NOT NULL THEN lag(ce IGNORE NULLS) OVER
    (PARTITION BY video_id ORDER BY frame_index) END AS prev_ce FROM u),
  s AS (SELECT video_id, count(iou) AS count,
    coalesce(avg(iou), 0) AS iou_mean, coalesce(stddev_pop(iou), 0) AS iou_std,
    coalesce(avg(ce), 0) AS ce_mean, coalesce(stddev_pop(ce), 0) AS ce_std,
    coalesce(sum(iou), 0) AS sum_iou, coalesce(sum(iou * iou), 0) AS sum_iou_sq,
    coalesce(sum(ce), 0) AS sum_ce, coalesce(sum(ce * ce), 0) AS sum_ce_sq,
    coalesce(avg(CAST((SELECT count(*) FROM range(101) t(i) WHERE iou >= i / CAST(100 AS DOUBLE)) AS DOUBLE) / 101)
      FILTER (WHERE iou IS NOT NULL), 0) AS success_auc,
    coalesce(avg(abs(ce - prev_ce)), 0) AS drift_rate,
    {_DET.format(t=0.5, s=50)}, {_DET.format(t=0.75, s=75)}
    FROM lagged GROUP BY video_id)"""

_COLS = [
    "iou_mean", "iou_std", "ce_mean", "ce_std", "sum_iou", "sum_iou_sq", "sum_ce", "sum_ce_sq", "success_auc",
    "drift_rate",
]
_R = ", ".join(f"round({c}, 6) AS {c}" for c in _COLS)


@query(
    "video_summary",
    "J1 J2 D1 P2 P4 A1 A2 A3 A4",
    f"""{UNION}, {_SUMMARY}
    SELECT video_id, count, {_R}, tp_50, fp_50, fn_50, tp_75, fp_75, fn_75,
      round(CASE WHEN tp_50 + fp_50 > 0 THEN tp_50 / (tp_50 + fp_50) ELSE 0 END, 6) AS success_rate_50,
      round(CASE WHEN tp_75 + fp_75 > 0 THEN tp_75 / (tp_75 + fp_75) ELSE 0 END, 6) AS success_rate_75
    FROM s""",
)
def _(spark, sf):
    s = E.video_summary(preds(spark, sf), gt(spark, sf), KEY)
    return pick(s, *s.columns)


@query(
    "per_frame_metrics",
    "J1 J3 P2 P4",
    f"""{UNION} SELECT video_id, frame_index, round(score, 6) AS score, round(iou, 6) AS iou, round(ce, 6) AS ce
    FROM u""",
)
def _(spark, sf):
    f = E.per_frame(preds(spark, sf), gt(spark, sf), KEY)
    return pick(f, *f.columns)


@query(
    "matched_last_annotation",
    "J1 J8",
    f"""WITH {PREDS}, {GT}, {FIRST}, gl AS (
      SELECT * FROM gt QUALIFY row_number() OVER (PARTITION BY video_id, frame_index ORDER BY pos DESC) = 1)
    SELECT video_id, frame_index, round({sq_iou('pf', 'gl')}, 6) AS iou, round({sq_ce('pf', 'gl')}, 6) AS ce
    FROM gl JOIN pf USING (video_id, frame_index)""",
)
def _(spark, sf):
    return pick(E.matched(preds(spark, sf), gt(spark, sf), KEY, which="last"), *KEY, "frame_index", "iou", "ce")


@query(
    "success_curve",
    "A2",
    f"""{MATCHED} SELECT video_id, i / CAST(100 AS DOUBLE) AS threshold,
      round(count(*) FILTER (WHERE iou >= i / CAST(100 AS DOUBLE)) / CAST(count(*) AS DOUBLE), 6) AS success_rate
    FROM m, range(101) t(i) GROUP BY video_id, i""",
)
def _(spark, sf):
    c = E.success_curve(E.matched(preds(spark, sf), gt(spark, sf), KEY), KEY)
    return pick(c, *c.columns)


@query(
    "detection_counts",
    "J2 A3 O4",
    f"""{UNION}, d AS (SELECT video_id, {_DET.format(t=0.5, s='t')} FROM u GROUP BY video_id)
    SELECT video_id, tp_t AS tp, fp_t AS fp, fn_t AS fn,
      round(CASE WHEN tp_t + fp_t > 0 THEN tp_t / (tp_t + fp_t) ELSE 0 END, 6) AS precision,
      round(CASE WHEN tp_t + fn_t > 0 THEN tp_t / (tp_t + fn_t) ELSE 0 END, 6) AS recall
    FROM d""",
)
def _(spark, sf):
    c = E.detection_counts(preds(spark, sf), gt(spark, sf), KEY)
    return pick(c, *c.columns)


@query(
    "predictions_without_annotation",
    "J3",
    f"""WITH {PREDS}, {GT}, {FIRST}
    SELECT video_id, frame_index, pos FROM pf
    WHERE NOT EXISTS (SELECT 1 FROM gt WHERE gt.video_id = pf.video_id AND gt.frame_index = pf.frame_index)""",
)
def _(spark, sf):
    return E.missing_frames(preds(spark, sf), gt(spark, sf), KEY).select("video_id", "frame_index", "pos")


@query(
    "restrict_to_annotated",
    "J4",
    f"""WITH {PREDS}, {GT} SELECT video_id, frame_index, pos FROM preds
    WHERE (video_id, frame_index) IN (SELECT (video_id, frame_index) FROM gt)""",
)
def _(spark, sf):
    return E.restrict_to_annotated(preds(spark, sf), gt(spark, sf), KEY).select("video_id", "frame_index", "pos")


@query(
    "offset_alignment",
    "J5",
    f"""WITH {PREDS}, {GT}, f AS (SELECT DISTINCT video_id, frame_index FROM gt WHERE video_id % 3 = 0 OR frame_index > 5),
      d AS (SELECT video_id, (SELECT min(frame_index) FROM f WHERE f.video_id = p.video_id) - min(frame_index) AS delta
            FROM preds p GROUP BY video_id),
      a AS (SELECT p.video_id, p.pos, p.frame_index, 0 AS off FROM preds p SEMI JOIN f USING (video_id, frame_index)),
      b AS (SELECT p.video_id, p.pos, p.frame_index + delta AS frame_index, delta AS off FROM preds p
            JOIN d USING (video_id)
            WHERE delta <> 0 AND (p.video_id, p.frame_index + delta) IN (SELECT (video_id, frame_index) FROM f)),
      c AS (SELECT video_id, (SELECT count(*) FROM b WHERE b.video_id = d.video_id)
              > (SELECT count(*) FROM a WHERE a.video_id = d.video_id) AS moved FROM d WHERE delta IS NOT NULL)
    SELECT video_id, pos, frame_index, CAST(off AS INTEGER) AS "offset" FROM a JOIN c USING (video_id) WHERE NOT moved
    UNION ALL
    SELECT video_id, pos, frame_index, CAST(off AS INTEGER) FROM b JOIN c USING (video_id) WHERE moved""",
)
def _(spark, sf):
    late = gt(spark, sf).where((F.col("video_id") % 3 == 0) | (F.col("frame_index") > 5))
    out = E.align_offset(preds(spark, sf), late, KEY)
    return out.select("video_id", "pos", "frame_index", F.col("offset").cast("int").alias("offset"))


@query(
    "coverage_stats",
    "A5",
    f"""WITH {PREDS}, {GT}, g AS (SELECT DISTINCT video_id, frame_index, 1 AS g FROM gt),
      p AS (SELECT DISTINCT video_id, frame_index, 1 AS p FROM preds),
      c AS (SELECT video_id, count(g) AS gt_frames, count(p) AS pred_frames, count(g + p) AS matched_frames,
        min(frame_index) FILTER (WHERE g = 1) AS gt_first, max(frame_index) FILTER (WHERE g = 1) AS gt_last,
        min(frame_index) FILTER (WHERE p = 1) AS pred_first, max(frame_index) FILTER (WHERE p = 1) AS pred_last
        FROM g FULL OUTER JOIN p USING (video_id, frame_index) GROUP BY video_id)
    SELECT *, round(CASE WHEN gt_frames > 0 THEN matched_frames / gt_frames ELSE 0 END, 6) AS coverage_ratio,
      gt_first - pred_first AS suggested_offset FROM c""",
)
def _(spark, sf):
    c = E.coverage(preds(spark, sf), gt(spark, sf), KEY)
    return pick(c, *c.columns)


@query(
    "dataset_rollup",
    "A6",
    f"""{UNION}, {_SUMMARY}, a AS (SELECT video_id % 5 AS fold, sum(count) AS n, sum(sum_iou) AS si,
        sum(sum_iou_sq) AS si2, sum(sum_ce) AS sc, sum(sum_ce_sq) AS sc2, sum(tp_50) AS t5, sum(fp_50) AS f5,
        sum(tp_75) AS t7, sum(fp_75) AS f7, avg(success_auc) AS success_auc, avg(drift_rate) AS drift_rate,
        sum(count) AS fr, sum(CAST(1 + video_id % 7 AS DOUBLE)) AS tm
      FROM s GROUP BY 1)
    SELECT fold, CAST(n AS BIGINT) AS frames_count, round(si / n, 6) AS iou_mean,
      round(sqrt(greatest(0, si2 / n - (si / n) * (si / n))), 6) AS iou_std, round(sc / n, 6) AS ce_mean,
      round(sqrt(greatest(0, sc2 / n - (sc / n) * (sc / n))), 6) AS ce_std,
      round(t5 / (t5 + f5), 6) AS success_rate_50, round(t7 / (t7 + f7), 6) AS success_rate_75,
      round(success_auc, 6) AS success_auc, round(drift_rate, 6) AS drift_rate, round(fr / tm, 6) AS fps
    FROM a""",
)
def _(spark, sf):
    s = E.video_summary(preds(spark, sf), gt(spark, sf), KEY).withColumns(
        {
            "fold": F.col("video_id") % 5,
            "infer_frames": F.col("count"),
            "infer_time": (F.lit(1) + F.col("video_id") % 7).cast("double"),
        }
    )
    out = E.dataset_rollup(s, ["fold"])
    return pick(out, *out.columns)


@query(
    "fold_summary",
    "A7",
    f"""{UNION}, {_SUMMARY}, f AS (SELECT video_id % 2 AS model, video_id % 5 AS fold, avg(iou_mean) AS iou,
        avg(ce_mean) AS ce FROM s GROUP BY 1, 2)
    SELECT model, round(avg(iou), 6) AS iou_mean, round(stddev_pop(iou), 6) AS iou_std, round(avg(ce), 6) AS ce_mean,
      round(stddev_pop(ce), 6) AS ce_std FROM f GROUP BY model""",
)
def _(spark, sf):
    s = E.video_summary(preds(spark, sf), gt(spark, sf), KEY)
    folds = s.groupBy((F.col("video_id") % 2).alias("model"), (F.col("video_id") % 5).alias("fold")).agg(
        F.avg("iou_mean").alias("iou"), F.avg("ce_mean").alias("ce")
    )
    out = E.fold_summary(folds, ["model"], ["iou", "ce"])
    return pick(out, *out.columns)


@query(
    "registered_evaluators",
    "U1 A3",
    f"""{UNION}, d AS (SELECT video_id, {_DET.format(t=0.5, s='t')} FROM u GROUP BY video_id), {_SUMMARY}
    SELECT video_id, tp_t AS tp, fp_t AS fp, fn_t AS fn, round(iou_mean, 6) AS iou_mean, round(ce_mean, 6) AS ce_mean FROM d JOIN s USING (video_id)""",
)
def _(spark, sf):
    """Two evaluators chosen by name."""
    from framelane import registry

    p, g = preds(spark, sf), gt(spark, sf)
    counts = registry.get("evaluator", "detection")(p, g, KEY).select("video_id", "tp", "fp", "fn")
    means = registry.get("evaluator", "video_summary")(p, g, KEY).select("video_id", "iou_mean", "ce_mean")
    return pick(counts.join(means, "video_id"), "video_id", "tp", "fp", "fn", "iou_mean", "ce_mean")


@query(
    "evaluation_files",
    "S8",
    f"""{UNION}, {_SUMMARY}, m AS (SELECT * FROM u WHERE iou IS NOT NULL)
    SELECT 'frame' AS file, video_id, frame_index::DOUBLE AS at, round(iou, 6) AS value, round(ce, 6) AS other FROM u
    UNION ALL SELECT 'curve', video_id, i / CAST(100 AS DOUBLE), round(count(*) FILTER (WHERE iou >= i / CAST(100 AS DOUBLE)) / CAST(count(*) AS DOUBLE), 6), NULL FROM m, range(101) t(i) GROUP BY video_id, i
    UNION ALL SELECT 'summary', video_id, NULL, round(iou_mean, 6), round(ce_mean, 6) FROM s""",
)
def _(spark, sf):
    """Per-frame rows, success curve and summary written as files and read back."""
    from framelane import session
    from framelane.sources import sinks

    p, g = preds(spark, sf), gt(spark, sf)
    folder = f"{session.shared_folder(spark).rstrip('/')}/evaluation-{uuid.uuid4().hex}"
    curve = E.success_curve(E.matched(p, g, KEY), KEY)
    sinks.write_evaluation(E.per_frame(p, g, KEY), curve, E.video_summary(p, g, KEY).select("video_id", "iou_mean", "ce_mean"), folder)
    read = spark.read.option("header", True)
    none = F.lit(None).cast("double")
    frames = read.schema("video_id bigint, frame_index int, score double, iou double, ce double").csv(f"{folder}/frames")
    curve = read.schema("video_id bigint, threshold double, success_rate double").csv(f"{folder}/success_curve")
    summary = spark.read.schema("video_id bigint, iou_mean double, ce_mean double").json(f"{folder}/summary")
    out = frames.select(F.lit("frame").alias("file"), "video_id", F.col("frame_index").cast("double").alias("at"), F.col("iou").alias("value"), F.col("ce").alias("other"))
    out = out.unionByName(curve.select(F.lit("curve").alias("file"), "video_id", F.col("threshold").alias("at"), F.col("success_rate").alias("value"), none.alias("other")))
    out = out.unionByName(summary.select(F.lit("summary").alias("file"), "video_id", none.alias("at"), F.col("iou_mean").alias("value"), F.col("ce_mean").alias("other")))
    return pick(out, "file", "video_id", "at", "value", "other")
