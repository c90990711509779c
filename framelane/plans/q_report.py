"""Roll-up, ablation and sweep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.operators import classify as C
from framelane.operators import dedup as D
from framelane.operators import report as R
from framelane.operators import smooth as S
from framelane.plans.fixtures import (
    CLF,
    FIRST,
    GT,
    GT1,
    KEY,
    PREDS,
    clf,
    gt,
    pchip_sql,
    preds,
    shapes,
    sq_ce,
    sq_iou,
)
from framelane.plans.q_classify import _CONF
from framelane.plans.q_smooth import _POS, poly_sql, window_sql
from framelane.plans.registry import pick, query
from framelane.session import cut

FRAME = ["video_id", "frame_index"]
BOX = ("x", "y", "w", "h")

_ACC = "avg(CASE WHEN label_true = label_pred THEN 1.0::DOUBLE ELSE 0 END)"
_FM = "fm AS (" + " UNION ALL ".join(
    f"SELECT modality, fold, '{n}' AS metric, {e} AS value FROM clf GROUP BY ALL"
    for n, e in (("accuracy", _ACC), ("prob", "max(prob)"), ("prob_mean", "avg(prob)"), ("prob_std", "stddev_pop(prob)"))
) + ")"


@query(
    "fold_preview",
    "A8",
    f"""WITH {CLF}, {_FM} SELECT modality, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
    FROM fm WHERE metric NOT IN ('prob', 'prob_std') GROUP BY modality, metric""",
)
def _(spark, sf):
    m = clf(spark, sf).groupBy("modality", "fold").agg(
        F.avg((F.col("label_true") == F.col("label_pred")).cast("double")).alias("accuracy"),
        F.max("prob").alias("prob"),
        F.avg("prob").alias("prob_mean"),
        F.stddev_pop("prob").alias("prob_std"),
    )
    long = m.unpivot(["modality", "fold"], ["accuracy", "prob", "prob_mean", "prob_std"], "metric", "value")
    out = R.fold_preview(long, ["modality"])
    return pick(out, *out.columns)


@query(
    "leaderboard",
    "A9 O1",
    f"""WITH {CLF} SELECT modality, round(avg(prob), 6) AS prob, round(avg(label_pred), 6) AS rate FROM clf GROUP BY modality""",
)
def _(spark, sf):
    df = clf(spark, sf).withColumn("rate", F.col("label_pred").cast("double"))
    out = R.leaderboard(df, ["modality"], ["prob", "rate"], "prob")
    return pick(out, *out.columns)


_TRACE = """tr AS (SELECT video_id, frame_index, is_fallback, CASE pos % 4 WHEN 0 THEN 'Detector' WHEN 1 THEN ' tracker ' WHEN 2 THEN 'missing' END AS src FROM pf),
  fr AS (SELECT video_id, count(*) AS frames, count(*) FILTER (WHERE is_fallback OR coalesce(lower(trim(src)), '') NOT IN ('detector', 'tracker')) AS fallback_frames FROM tr GROUP BY 1)"""


def trace(spark, sf):
    m = F.col("pos") % 4
    src = F.when(m == 0, "Detector").when(m == 1, " tracker ").when(m == 2, "missing")
    return D.first_per_frame(preds(spark, sf), FRAME).withColumn("bbox_source", src)


@query(
    "roi_fallback_rate",
    "A10",
    f"WITH {PREDS}, {FIRST}, {_TRACE} SELECT video_id, frames, fallback_frames, round(fallback_frames / frames, 6) AS fallback_rate FROM fr",
)
def _(spark, sf):
    out = R.fallback_rate(trace(spark, sf), KEY)
    return pick(out, *out.columns)


@query(
    "roi_fallback_dataset",
    "A10",
    f"""WITH {PREDS}, {FIRST}, {_TRACE} SELECT video_id % 5 AS fold, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(fallback_frames) AS BIGINT) AS fallback_frames,
      round(sum(fallback_frames) / sum(frames), 6) AS fallback_rate FROM fr GROUP BY 1""",
)
def _(spark, sf):
    per = R.fallback_rate(trace(spark, sf), KEY).withColumn("fold", F.col("video_id") % 5)
    out = R.fallback_rate_overall(per, ["fold"])
    return pick(out, *out.columns)


@query(
    "inference_fallback",
    "A53",
    f"""WITH {PREDS} SELECT video_id, count(*) AS frames, count(*) FILTER (WHERE is_fallback) AS fallback_frames,
      round(count(*) FILTER (WHERE is_fallback) / count(*), 6) AS fallback_rate FROM preds GROUP BY video_id""",
)
def _(spark, sf):
    out = R.inference_fallback(preds(spark, sf), KEY)
    return pick(out, *out.columns)


@query(
    "stage_status",
    "A51",
    f"""WITH {CLF}, s AS (SELECT subject_id, CASE WHEN prob < 0.02 THEN 'failed' WHEN prob < 0.2 THEN 'skipped' ELSE 'ok' END AS status, prob * 10 AS d FROM clf)
    SELECT subject_id, CASE WHEN bool_or(status = 'failed') THEN 'FAILED' WHEN bool_or(status = 'skipped') THEN 'PARTIAL' ELSE 'OK' END AS status,
      count(*) AS stages, round(sum(d), 6) AS duration_sec FROM s GROUP BY subject_id""",
)
def _(spark, sf):
    df = clf(spark, sf).select(
        "subject_id",
        F.when(F.col("prob") < 0.02, "Failed").when(F.col("prob") < 0.2, "SKIPPED").otherwise("ok").alias("status"),
        (F.col("prob") * 10).alias("duration_sec"),
    )
    out = R.stage_status(df, ["subject_id"])
    return pick(out, *out.columns)


@query(
    "dataset_cube",
    "A41 P14b",
    f"""WITH {PREDS}, f AS (SELECT modality, subject_id, CASE WHEN subject_id % 3 = 0 THEN 1 ELSE 0 END AS label FROM preds)
    SELECT modality, label, count(*) AS frames, count(DISTINCT subject_id) AS subjects, CAST(grouping(modality, label) AS INTEGER) AS level
    FROM f GROUP BY CUBE (modality, label)""",
)
def _(spark, sf):
    df = preds(spark, sf).withColumn("label", F.when(F.col("subject_id") % 3 == 0, 1).otherwise(0))
    return R.dataset_stats(df)


@query(
    "geometry_grouping_sets",
    "A42",
    f"""WITH {PREDS}, {FIRST}, s AS (SELECT subject_id, CASE WHEN subject_id % 3 = 0 THEN 1 ELSE 0 END AS label, w * h * 0.785::DOUBLE AS area, 2 * (w + h) AS perimeter,
      sqrt(w * h) AS eq_diam FROM pf)
    SELECT subject_id, label, count(area) AS frames, {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std' for c in ('area', 'perimeter', 'eq_diam'))}
    FROM s GROUP BY GROUPING SETS ((subject_id), (label))""",
)
def _(spark, sf):
    df = shapes(D.first_per_frame(preds(spark, sf), FRAME))
    df = df.withColumn("label", F.when(F.col("subject_id") % 3 == 0, 1).otherwise(0))
    out = R.geometry_stats(df)
    return pick(out, *out.columns)


@query(
    "mask_metric_rollup",
    "A44",
    f"""WITH {CLF} SELECT fold, round(coalesce(avg(prob), 'nan'::DOUBLE), 6) AS prob_mean, round(coalesce(stddev_pop(prob), 'nan'::DOUBLE), 6) AS prob_std, count(prob) AS prob_count,
      coalesce(avg(CASE WHEN fold > 1 THEN prob END), -1) = -1 AS empty FROM clf GROUP BY fold""",
)
def _(spark, sf):
    df = clf(spark, sf).withColumn("other", F.when(F.col("fold") > 1, F.col("prob")))
    out = R.mask_metric_rollup(df, ["fold"], ["prob", "other"])
    return pick(out.withColumn("empty", F.isnan("other_mean")), "fold", "prob_mean", "prob_std", "prob_count", "empty")


_IMP = "im AS (SELECT fold, modality || '-' || (subject_id % 4) AS feature, sum(prob - 0.5) AS importance FROM clf GROUP BY ALL)"


def importances(spark, sf):
    return clf(spark, sf).groupBy(
        "fold", F.concat_ws("-", "modality", (F.col("subject_id") % 4).cast("string")).alias("feature")
    ).agg(F.sum(F.col("prob") - 0.5).alias("importance"))


@query(
    "fold_importance",
    "A48 O2",
    f"""WITH {CLF}, {_IMP}, m AS (SELECT feature, sum(importance) / (SELECT count(DISTINCT fold) FROM im) AS m FROM im GROUP BY feature)
    SELECT feature, round(m, 6) AS mean_importance, 'top' AS list FROM m QUALIFY row_number() OVER (ORDER BY m DESC, feature) <= 10
    UNION ALL SELECT feature, round(m, 6), 'bottom' FROM m QUALIFY row_number() OVER (ORDER BY abs(m), m, feature) <= 10""",
)
def _(spark, sf):
    out = R.fold_importance(importances(spark, sf))
    return pick(out, "feature", "mean_importance", "list")


@query(
    "preferred_importance",
    "A49",
    f"""WITH {CLF}, {_IMP}, s AS (SELECT *, CASE (ascii(feature) + fold * 3) % 3 WHEN 0 THEN 'model_agnostic' WHEN 1 THEN 'model_reported' ELSE 'other' END AS source FROM im),
    r AS (SELECT *, CASE source WHEN 'model_reported' THEN 3 WHEN 'model_agnostic' THEN 4 ELSE 5 END AS rk FROM s)
    SELECT fold, feature, source, round(importance, 6) AS importance FROM r QUALIFY rk = min(rk) OVER (PARTITION BY fold)""",
)
def _(spark, sf):
    k = (F.ascii("feature") + F.col("fold") * 3) % 3
    df = importances(spark, sf).withColumn(
        "source", F.when(k == 0, "model_agnostic").when(k == 1, "model_reported").otherwise("other")
    )
    return pick(R.preferred_importance(df, ["fold"]), "fold", "feature", "source", "importance")


@query(
    "dataset_coverage",
    "A50",
    f"""WITH {PREDS}, v AS (SELECT video_id, bool_or(pos % 50 = 0) AS a FROM preds GROUP BY 1), s AS (SELECT 'v' || video_id AS stem, a FROM v)
    SELECT count(*) AS discovered, count(*) FILTER (WHERE a) AS annotated, count(*) FILTER (WHERE NOT a) AS missing,
      (SELECT string_agg(stem, ',' ORDER BY stem) FROM (SELECT stem FROM s WHERE NOT a ORDER BY stem LIMIT 5)) AS preview FROM s""",
)
def _(spark, sf):
    v = preds(spark, sf).groupBy("video_id").agg(F.bool_or(F.col("pos") % 50 == 0).alias("has_annotation"))
    return R.dataset_coverage(v.withColumn("video_stem", F.concat(F.lit("v"), F.col("video_id").cast("string"))))


# ---- filter stages ----------------------------------------------------------

_SG = f"""s0 AS (SELECT video_id, frame_index, x, y, w, h, {_POS} FROM pf), s1 AS (SELECT *, {window_sql('n', '7')} AS wl FROM s0),
  {poly_sql('o', 's1', ('x', 'y'))}, sm AS (SELECT s1.video_id, s1.frame_index, o.x, o.y, s1.w, s1.h FROM o JOIN s1 USING (video_id, i)),
  cmp AS (SELECT g1.video_id, g1.frame_index, {sq_iou('pf', 'g1')} AS raw_iou, {sq_ce('pf', 'g1')} AS raw_ce, {sq_iou('sm', 'g1')} AS iou, {sq_ce('sm', 'g1')} AS ce
    FROM g1 JOIN pf USING (video_id, frame_index) JOIN sm USING (video_id, frame_index))"""
CMP = f"WITH {PREDS}, {GT}, {FIRST}, {GT1}, {_SG}"


def comparison(spark, sf):
    raw = cut(D.first_per_frame(preds(spark, sf), FRAME).select(*FRAME, *BOX))
    return R.stage_comparison(raw, S.savgol(raw, KEY, ["x", "y"]), gt(spark, sf), KEY)


_ABL = """avg(iou) AS iou_mean, avg(ce) AS ce_mean, avg(iou) - avg(raw_iou) AS delta_iou, avg(ce) - avg(raw_ce) AS delta_ce,
  count(*) FILTER (WHERE iou - raw_iou < -1e-9) AS worse_iou, count(*) FILTER (WHERE ce - raw_ce > 1e-9) AS worse_ce"""


@query(
    "stage_ablation",
    "A34 J15",
    f"""{CMP}, a AS (SELECT video_id, {_ABL} FROM cmp GROUP BY video_id) SELECT video_id, round(iou_mean, 6) AS iou_mean, round(ce_mean, 6) AS ce_mean,
      round(delta_iou, 6) AS delta_iou, round(delta_ce, 6) AS delta_ce, worse_iou, worse_ce FROM a""",
)
def _(spark, sf):
    out = R.ablation(comparison(spark, sf), KEY, eps=R.EPS)
    return pick(out, *out.columns)


@query(
    "candidate_ranking",
    "A35 J14",
    f"""{CMP}, k AS (SELECT *, unnest([0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS keep FROM (SELECT video_id, frame_index FROM cmp)),
    b AS (SELECT k.keep, k.video_id, k.frame_index, keep * pf.x + (1 - keep) * sm.x AS x, keep * pf.y + (1 - keep) * sm.y AS y, pf.w, pf.h
      FROM k JOIN pf USING (video_id, frame_index) JOIN sm USING (video_id, frame_index)),
    e AS (SELECT keep, b.frame_index % 40 = 0 AS kf, c.raw_iou, c.raw_ce, {sq_iou('b', 'g1')} AS iou, {sq_ce('b', 'g1')} AS ce
      FROM b JOIN g1 USING (video_id, frame_index) JOIN cmp c USING (video_id, frame_index)),
    r AS (SELECT keep, avg(iou) - avg(raw_iou) AS di, avg(ce) - avg(raw_ce) AS dc, bool_or(kf AND (iou - raw_iou < -0.01 OR ce - raw_ce > 0.5)) AS rejected,
      sum(CASE WHEN kf THEN greatest(0, raw_iou - iou) * 10 + greatest(0, ce - raw_ce) ELSE 0 END) AS penalty FROM e GROUP BY keep)
    SELECT keep, round(di, 6) AS delta_iou, round(dc, 6) AS delta_ce, rejected, round(penalty, 4) AS penalty,
      round(di * 100 - greatest(0, dc) - penalty * 0.01, 5) AS score FROM r""",
)
def _(spark, sf):
    raw = cut(D.first_per_frame(preds(spark, sf), FRAME).select(*FRAME, *BOX))
    sm = S.savgol(raw, KEY, ["x", "y"])
    both = raw.join(sm.select(*FRAME, F.col("x").alias("sx"), F.col("y").alias("sy")), FRAME)
    grid = both.withColumn("keep", F.explode(F.array(*[F.lit(k) for k in (0.25, 0.5, 1.0)])))
    mix = {c: F.col("keep") * F.col(c) + (F.lit(1.0) - F.col("keep")) * F.col(f"s{c}") for c in ("x", "y")}
    cand = grid.withColumns(mix).drop("sx", "sy")
    frames = _candidates(raw, cand, gt(spark, sf))
    out = R.rank_candidates(frames, ["keep"], F.col("frame_index") % 40 == 0)
    return out.select(
        "keep", F.round("delta_iou", 6).alias("delta_iou"), F.round("delta_ce", 6).alias("delta_ce"), "rejected",
        F.round("penalty", 4).alias("penalty"), F.round("score", 5).alias("score"),
    )


def _candidates(raw, cand, annotations, name="keep"):
    """Every candidate's boxes compared with the raw ones; candidates only multiply the filtered side."""
    from framelane.functions import geometry as G
    from framelane.operators.evaluate import box

    g = D.first_per_frame(annotations, FRAME).select(*FRAME, *[F.col(c).alias(f"g_{c}") for c in BOX])
    r = raw.select(*FRAME, *[F.col(c).alias(f"r_{c}") for c in BOX])
    j = cand.join(g, FRAME).join(r, FRAME)
    return j.select(
        *FRAME, name,
        G.iou(box("r_"), box("g_")).alias("raw_iou"), G.center_error(box("r_"), box("g_")).alias("raw_ce"),
        G.iou(box(), box("g_")).alias("iou"), G.center_error(box(), box("g_")).alias("ce"),
    )


@query(
    "experiment_ranking",
    "A35",
    f"""{CMP}, a AS (SELECT video_id, {_ABL} FROM cmp GROUP BY video_id)
    SELECT video_id % 4 AS candidate, count(*) AS videos, round(avg(CASE WHEN delta_iou > 1e-9 AND delta_ce < -1e-9 THEN 1 ELSE 0 END), 6) AS both_improved,
      round(avg(delta_iou), 6) AS mean_delta_iou, round(avg(delta_ce), 6) AS mean_delta_ce FROM a GROUP BY 1""",
)
def _(spark, sf):
    videos = R.ablation(comparison(spark, sf), KEY).withColumn("candidate", F.col("video_id") % 4)
    out = R.rank_experiments(videos, ["candidate"], eps=R.EPS)
    return pick(out, *out.columns)


_THR = (0.2, 0.5, 0.8, 0.95)
_SW = f"""tv AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _THR)}]) AS threshold),
  kp AS (SELECT threshold * 100000 + video_id AS vk, threshold, pf.video_id, frame_index, x, y, w, h, score FROM pf, tv WHERE NOT is_fallback AND w > 1 AND h > 1 AND coalesce(score, 0) >= threshold),
  gg AS (SELECT threshold * 100000 + video_id AS vk, threshold, video_id AS vid, frame_index, x, y, w, h FROM g1, tv),
  qq AS (SELECT vk AS video_id, frame_index FROM gg ANTI JOIN kp USING (vk, frame_index)), kk AS (SELECT vk AS video_id, frame_index, x, y, w, h FROM kp),
  {pchip_sql('ff', 'kk', 'qq', BOX)},
  bx AS (SELECT video_id AS vk, frame_index, x, y, w, h, nk >= 3 AS has, false AS known, 0::DOUBLE AS score FROM ff
    UNION ALL SELECT vk, frame_index, x, y, w, h, true, true, score FROM kp),
  fr AS (SELECT vid % 5 AS fold, gg.threshold, coalesce(has, false) AS has, known, bx.score AS prob,
      CASE WHEN has AND bx.w > 1 AND bx.h > 1 THEN {sq_iou('bx', 'gg')} ELSE 0 END AS iou,
      CASE WHEN has AND bx.w > 1 AND bx.h > 1 THEN {sq_ce('bx', 'gg')} ELSE sqrt(gg.w * gg.w + gg.h * gg.h) END AS ce
    FROM gg JOIN bx USING (vk, frame_index)),
  rk AS (SELECT *, iou >= 0.5 AS y, rank() OVER (PARTITION BY fold, threshold ORDER BY prob) + (count(*) OVER (PARTITION BY fold, threshold, prob) - 1) / 2.0::DOUBLE AS r FROM fr),
  sw AS (SELECT fold, threshold, avg(iou) AS iou, avg(ce) AS ce, count(*) AS n_eval_frames, count(*) FILTER (WHERE NOT has) AS n_without_box, count(*) FILTER (WHERE known) AS n_known,
    (sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)) AS auroc FROM rk GROUP BY 1, 2)"""
SWEEP = f"WITH {PREDS}, {GT}, {FIRST}, {GT1}, {_SW}"


def sweep(spark, sf):
    annotations = gt(spark, sf).withColumn("fold", F.col("video_id") % 5)
    return R.threshold_sweep(preds(spark, sf), annotations, KEY, ["fold"], _THR, min_points=3)


@query(
    "threshold_sweep",
    "A36 J14 T21 P22",
    f"""{SWEEP} SELECT fold, threshold, round(iou, 6) AS iou, round(ce, 6) AS ce, n_eval_frames, n_without_box, n_known, round(auroc, 6) AS auroc FROM sw""",
)
def _(spark, sf):
    out = sweep(spark, sf)
    return pick(out, *out.columns)


@query(
    "sweep_fold_rollup",
    "A52 A40",
    f"""{SWEEP} SELECT threshold, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std, count({m}) AS {m}_folds' for m in ('iou', 'ce', 'auroc'))} FROM sw GROUP BY threshold""",
)
def _(spark, sf):
    out = R.sweep_rollup(sweep(spark, sf), ["threshold"], ["iou", "ce", "auroc"])
    return pick(out, *out.columns)


# Detections that miss the annotation (IoU below 0.5) are the corrupt ones; the filter flags what it moves.
MOVED = 1.0
_FIL = f"""fr AS (SELECT g1.video_id, g1.frame_index, g1.x AS g_x, g1.y AS g_y, g1.w AS g_w, g1.h AS g_h, g1.x + g1.w / 2 AS gx, g1.y + g1.h / 2 AS gy,
    pf.x + pf.w / 2 AS rx, pf.y + pf.h / 2 AS ry, sm.x AS s_x, sm.y AS s_y, sm.w AS s_w, sm.h AS s_h, sm.x + sm.w / 2 AS sx, sm.y + sm.h / 2 AS sy,
    coalesce({sq_iou('pf', 'g1')} < 0.5, false) AS corrupt FROM g1 LEFT JOIN pf USING (video_id, frame_index) LEFT JOIN sm USING (video_id, frame_index)),
  mv AS (SELECT *, coalesce(sqrt(power(sx - rx, 2) + power(sy - ry, 2)), 0) AS moved FROM fr)"""


def filtered(spark, sf):
    """Annotated frames with the raw and the smoothed detection, if any."""
    from framelane.functions import geometry as G
    from framelane.operators.evaluate import box

    raw = cut(D.first_per_frame(preds(spark, sf), FRAME).select(*FRAME, *BOX))
    sm = S.savgol(raw, KEY, ["x", "y"]).select(*FRAME, *[F.col(c).alias(f"s_{c}") for c in BOX])
    g = D.first_per_frame(gt(spark, sf), FRAME).select(*FRAME, *[F.col(c).alias(f"g_{c}") for c in BOX])
    df = g.join(raw, FRAME, "left").join(sm, FRAME, "left")
    df = df.withColumn("corrupt", F.coalesce(G.iou(box(), box("g_")) < 0.5, F.lit(False)))
    for out, p in (("g", "g_"), ("r", ""), ("s", "s_")):
        df = df.withColumns({f"{out}{a}": F.col(f"{p}{a}") + F.col(f"{p}{n}") / 2 for a, n in (("x", "w"), ("y", "h"))})
    moved = F.coalesce(F.hypot(F.col("sx") - F.col("rx"), F.col("sy") - F.col("ry")), F.lit(0.0))
    return df.withColumn("moved", moved)


@query(
    "simulation_objective",
    "A37",
    f"""{CMP}, {_FIL}, b AS (SELECT *, unnest(['raw', 'smoothed']) AS method FROM mv),
    f AS (SELECT *, CASE method WHEN 'raw' THEN rx ELSE sx END AS fx, CASE method WHEN 'raw' THEN ry ELSE sy END AS fy FROM b),
    er AS (SELECT *, sqrt(power(rx - gx, 2) + power(ry - gy, 2)) AS re, sqrt(power(fx - gx, 2) + power(fy - gy, 2)) AS fe FROM f),
    cs AS (SELECT method, video_id, avg(fe) AS filtered_mean_err, avg(re) AS raw_observed_mean_err, coalesce(avg(fe - re) FILTER (WHERE rx IS NOT NULL AND NOT corrupt), 0) AS normal_err_delta,
      coalesce(avg(CASE WHEN fe - re > 1e-6 THEN 1 ELSE 0 END) FILTER (WHERE rx IS NOT NULL AND NOT corrupt), 0) AS normal_harm_rate,
      coalesce(avg(re - fe) FILTER (WHERE rx IS NOT NULL AND corrupt), 0) AS corrupted_gain FROM er GROUP BY ALL),
    ag AS (SELECT method, {', '.join(f'avg({c}) AS {c}' for c in ('filtered_mean_err', 'raw_observed_mean_err', 'normal_err_delta', 'normal_harm_rate', 'corrupted_gain'))} FROM cs GROUP BY method)
    SELECT method, {', '.join(f'round({c}, 6) AS {c}' for c in ('filtered_mean_err', 'raw_observed_mean_err', 'normal_err_delta', 'normal_harm_rate', 'corrupted_gain'))},
      round(filtered_mean_err + 1.5 * greatest(normal_err_delta, 0) + normal_harm_rate - 0.8 * corrupted_gain, 6) AS objective FROM ag""",
)
def _(spark, sf):
    df = filtered(spark, sf).withColumn("method", F.explode(F.array(F.lit("raw"), F.lit("smoothed"))))
    df = df.withColumns({f"f{a}": F.when(F.col("method") == "raw", F.col(f"r{a}")).otherwise(F.col(f"s{a}")) for a in "xy"})
    df = df.withColumn("flagged", F.col("moved") > MOVED)
    out = R.simulation_objective(R.simulation_cases(df, ["method", *KEY]), ["method"])
    return pick(out, *out.columns)


@query(
    "repair_benchmark",
    "A38 T32",
    f"""{CMP}, {_FIL}, rp AS (SELECT *, video_id % 5 AS fold, moved > {MOVED} AS p, round(moved, 9) AS anomaly,
      greatest(0, least(s_x + s_w, g_x + g_w) - greatest(s_x, g_x)) * greatest(0, least(s_y + s_h, g_y + g_h) - greatest(s_y, g_y)) AS it FROM mv WHERE rx IS NOT NULL),
    rs AS (SELECT *, corrupt AS t, it / (s_w * s_h + g_w * g_h - it) AS iou, abs(sx - gx) AS ax, abs(sy - gy) AS ay,
      rank() OVER (PARTITION BY fold ORDER BY anomaly) + (count(*) OVER (PARTITION BY fold, anomaly) - 1) / 2.0::DOUBLE AS r FROM rp),
    ra AS (SELECT fold, avg(iou) AS iou_mean, stddev_pop(iou) AS iou_std, avg(sqrt(ax * ax + ay * ay)) AS error_mean, stddev_pop(sqrt(ax * ax + ay * ay)) AS error_std,
      avg((abs(s_x - g_x) + abs(s_y - g_y) + abs(s_w - g_w) + abs(s_h - g_h)) / 4) AS roi_l1_mean, avg((ax * ax + ay * ay) / 2) AS mse, avg((ax + ay) / 2) AS mae,
      count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn,
      (sum(r) FILTER (WHERE t) - count(*) FILTER (WHERE t) * (count(*) FILTER (WHERE t) + 1) / 2) / (count(*) FILTER (WHERE t) * count(*) FILTER (WHERE NOT t)) AS auroc FROM rs GROUP BY fold)
    SELECT fold, {', '.join(f'round({c}, 6) AS {c}' for c in ('iou_mean', 'iou_std', 'error_mean', 'error_std', 'roi_l1_mean', 'mse', 'mae', 'auroc'))}, tp, fp, fn, tn,
      round((tp + tn) / (tp + fp + fn + tn), 6) AS det_accuracy, round(tp / (tp + fp), 6) AS det_precision, round(tp / (tp + fn), 6) AS det_recall,
      round(2 * tp / (2 * tp + fp + fn), 6) AS det_f1, round(tn / (tn + fp), 6) AS det_specificity FROM ra""",
)
def _(spark, sf):
    df = filtered(spark, sf).where(F.col("rx").isNotNull()).select(
        (F.col("video_id") % 5).alias("fold"), "corrupt", (F.col("moved") > MOVED).alias("flagged"), F.round("moved", 9).alias("anomaly"),
        *[f"g_{c}" for c in BOX], *[f"s_{c}" for c in BOX],
    )
    out = R.repair_metrics(cut(df), ["fold"])
    return pick(out, *out.columns)


@query(
    "method_benchmark",
    "A40",
    f"""{CMP}, a AS (SELECT video_id, avg(raw_iou) AS r_iou, avg(raw_ce) AS r_ce, avg(iou) AS s_iou, avg(ce) AS s_ce FROM cmp GROUP BY video_id),
    c AS (SELECT 'raw' AS method, r_iou AS iou, r_ce AS ce FROM a UNION ALL SELECT 'smoothed', s_iou, s_ce FROM a)
    SELECT method, round(avg(iou), 6) AS iou_mean, round(stddev_pop(iou), 6) AS iou_std, round(avg(ce), 6) AS ce_mean, round(stddev_pop(ce), 6) AS ce_std FROM c GROUP BY method""",
)
def _(spark, sf):
    """Raw and smoothed detections as two methods over the same videos."""
    means = comparison(spark, sf).groupBy(*KEY).agg(*[F.avg(c).alias(c) for c in ("raw_iou", "raw_ce", "iou", "ce")])
    methods = F.array(
        F.struct(F.lit("raw").alias("method"), F.col("raw_iou").alias("iou"), F.col("raw_ce").alias("ce")),
        F.struct(F.lit("smoothed").alias("method"), F.col("iou"), F.col("ce")),
    )
    out = R.method_rollup(means.select(*KEY, F.inline(methods)), ["method"], ["iou", "ce"])
    return pick(out, *out.columns)


_WINDOWS = (5, 7, 11)
_SWEEP = f"""WITH {PREDS}, {GT}, {FIRST}, {GT1}, s0 AS (SELECT video_id, frame_index, x, y, w, h, {_POS} FROM pf), """ + ", ".join(
    f"s1_{w} AS (SELECT *, {window_sql('n', str(w))} AS wl FROM s0), {poly_sql(f'o_{w}', f's1_{w}', ('x', 'y'))}" for w in _WINDOWS
) + ", sm AS (" + " UNION ALL ".join(
    f"SELECT {w}::INTEGER AS smoothing, s.video_id, s.frame_index, o.x, o.y, s.w, s.h FROM o_{w} o JOIN s1_{w} s USING (video_id, i)" for w in _WINDOWS
) + f"""), e AS (SELECT smoothing, video_id, frame_index, frame_index % 40 = 0 AS kf, {sq_iou('pf', 'g1')} AS raw_iou, {sq_ce('pf', 'g1')} AS raw_ce, {sq_iou('sm', 'g1')} AS iou, {sq_ce('sm', 'g1')} AS ce
    FROM sm JOIN g1 USING (video_id, frame_index) JOIN pf USING (video_id, frame_index))"""


def window_sweep(spark, sf):
    """Every smoothing window on the same trajectories, compared with the annotations."""
    raw = cut(D.first_per_frame(preds(spark, sf), FRAME).select(*FRAME, *BOX))
    cand = None
    for w in _WINDOWS:
        part = S.savgol(raw, KEY, ["x", "y"], window=w).withColumn("smoothing", F.lit(w))
        cand = part if cand is None else cand.unionByName(part)
    return cut(_candidates(raw, cand, gt(spark, sf), "smoothing"))


@query(
    "filter_sweep",
    "A35 J14",
    f"""{_SWEEP}, r AS (SELECT smoothing, avg(iou) - avg(raw_iou) AS di, avg(ce) - avg(raw_ce) AS dc, bool_or(kf AND (iou - raw_iou < -0.01 OR ce - raw_ce > 0.5)) AS rejected,
      sum(CASE WHEN kf THEN greatest(0, raw_iou - iou) * 10 + greatest(0, ce - raw_ce) ELSE 0 END) AS penalty FROM e GROUP BY smoothing)
    SELECT smoothing, round(di, 6) AS delta_iou, round(dc, 6) AS delta_ce, rejected, round(penalty, 4) AS penalty, round(di * 100 - greatest(0, dc) - penalty * 0.01, 5) AS score FROM r""",
)
def _(spark, sf):
    out = R.rank_candidates(window_sweep(spark, sf), ["smoothing"], F.col("frame_index") % 40 == 0)
    return out.select(
        "smoothing", F.round("delta_iou", 6).alias("delta_iou"), F.round("delta_ce", 6).alias("delta_ce"), "rejected",
        F.round("penalty", 4).alias("penalty"), F.round("score", 5).alias("score"),
    )


@query(
    "filter_sweep_by_video",
    "A35",
    f"""{_SWEEP}, a AS (SELECT smoothing, video_id, {_ABL} FROM e GROUP BY smoothing, video_id)
    SELECT smoothing, count(*) AS videos, round(avg(CASE WHEN delta_iou > 1e-9 AND delta_ce < -1e-9 THEN 1 ELSE 0 END), 6) AS both_improved,
      round(avg(delta_iou), 6) AS mean_delta_iou, round(avg(delta_ce), 6) AS mean_delta_ce FROM a GROUP BY smoothing""",
)
def _(spark, sf):
    videos = R.ablation(window_sweep(spark, sf), ["smoothing", *KEY])
    return pick(R.rank_experiments(videos, ["smoothing"], eps=R.EPS), "smoothing", "videos", "both_improved", "mean_delta_iou", "mean_delta_ce")
