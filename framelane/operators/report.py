"""Roll-ups over runs, folds, videos, subjects and modalities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane.functions import geometry as G
from framelane.operators import dedup
from framelane.operators.evaluate import BOX, box, ratio
from framelane.operators.ordered import neighbours

# Box sources that count as direct observations.
DIRECT_SOURCES = ("detector", "tracker")


def trajectory_quality(df: DataFrame, key: Sequence[str], order: str = "frame_index") -> DataFrame:
    """Jitter, smoothness, area stability, path length and mean displacement per sample (0 for the first) of each trajectory."""
    out = neighbours(df, key, order, [order, "cx", "cy", "w", "h"], back=2)
    dt0 = F.greatest(F.col(order) - F.col(f"{order}_lag1"), F.lit(1))
    dt1 = F.greatest(F.col(f"{order}_lag1") - F.col(f"{order}_lag2"), F.lit(1))
    out = out.withColumns(
        {
            "_dt0": F.when(F.col(f"{order}_lag1").isNotNull(), dt0),
            "_dt1": F.when(F.col(f"{order}_lag2").isNotNull(), dt1),
        }
    )
    v0 = {c: (F.col(c) - F.col(f"{c}_lag1")) / F.col("_dt0") for c in ("cx", "cy", "w", "h")}
    v1 = {c: (F.col(f"{c}_lag1") - F.col(f"{c}_lag2")) / F.col("_dt1") for c in ("cx", "cy")}
    mid = F.greatest((F.col("_dt0") + F.col("_dt1")) / 2.0, F.lit(1.0))
    step = F.hypot(F.col("cx") - F.col("cx_lag1"), F.col("cy") - F.col("cy_lag1"))
    area = F.col("w") * F.col("h")

    def z(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    steady = F.when(
        (F.count(F.lit(1)) >= 2) & (F.avg(area) > 1e-9),
        F.greatest(F.lit(0.0), F.lit(1.0) - F.stddev_pop(area) / F.avg(area)),
    )
    return out.groupBy(*key).agg(
        *[z(F.stddev_pop(v)).alias(f"jitter_{c}") for c, v in v0.items()],
        *[z(F.avg(F.abs((v0[c] - v1[c]) / mid))).alias(f"smoothness_{c}") for c in ("cx", "cy")],
        z(steady).alias("area_stability"),
        z(F.sum(step)).alias("path_length"),
        F.avg(z(step)).alias("mean_speed"),
    )


def track_samples(df: DataFrame, key: Sequence[str], order: str = "frame_index") -> DataFrame:
    """Centre and displacement of every sample (0 for the first), to three decimals as tracks are stored."""
    out = neighbours(df, key, order, ["cx", "cy"], back=1)
    step = F.coalesce(F.hypot(F.col("cx") - F.col("cx_lag1"), F.col("cy") - F.col("cy_lag1")), F.lit(0.0))
    return out.select(*key, order, *[G.track_value(c).alias(n) for n, c in (("cx", F.col("cx")), ("cy", F.col("cy")), ("displacement", step))])


def fallback_rate(trace: DataFrame, key: Sequence[str]) -> DataFrame:
    """Frames shown from anything but a direct observation, per key."""
    direct = F.lower(F.trim(F.coalesce("bbox_source", F.lit("")))).isin(*DIRECT_SOURCES)
    bad = F.count_if(F.coalesce("is_fallback", F.lit(False)) | ~direct)
    return trace.groupBy(*key).agg(
        F.count(F.lit(1)).alias("frames"), bad.alias("fallback_frames"), (bad / F.count(F.lit(1))).alias("fallback_rate")
    )


def fallback_rate_overall(per_key: DataFrame, by: Sequence[str]) -> DataFrame:
    """Frame-weighted rate over videos."""
    return per_key.groupBy(*by).agg(
        F.sum("frames").alias("frames"),
        F.sum("fallback_frames").alias("fallback_frames"),
        (F.sum("fallback_frames") / F.sum("frames")).alias("fallback_rate"),
    )


def inference_fallback(preds: DataFrame, key: Sequence[str]) -> DataFrame:
    bad = F.count_if(F.coalesce("is_fallback", F.lit(False)))
    n = F.count(F.lit(1))
    return preds.groupBy(*key).agg(n.alias("frames"), bad.alias("fallback_frames"), (bad / n).alias("fallback_rate"))


def fold_preview(metrics: DataFrame, by: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Mean and sample spread over folds of a long metric table.

    Metrics named ``*_std`` are dropped, and ``m`` gives way to ``m_mean`` where
    both occur in the group.
    """
    rows = metrics.where(~F.endswith(F.col(name), F.lit("_std")) & F.col(value).isNotNull())
    out = rows.groupBy(*by, name).agg(
        F.avg(value).alias("mean"), F.when(F.count(value) >= 2, F.stddev_samp(value)).alias("std")
    )
    long = rows.where(F.endswith(F.col(name), F.lit("_mean"))).select(
        *by, F.regexp_replace(name, "_mean$", "").alias(name)
    ).distinct()
    return out.join(long, [*by, name], "left_anti")


def leaderboard(stages: DataFrame, by: Sequence[str], metrics: Sequence[str], sort: str) -> DataFrame:
    """Mean of each stage metric per experiment, best first; a missing sort value counts as -1."""
    out = stages.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])
    return out.orderBy(F.coalesce(F.col(sort), F.lit(-1.0)).desc(), *by)


def stage_status(stages: DataFrame, by: Sequence[str]) -> DataFrame:
    """FAILED if a stage failed, PARTIAL if one was skipped, else OK; with the total duration."""
    s = F.lower(F.coalesce("status", F.lit("unknown")))
    return stages.groupBy(*by).agg(
        F.when(F.bool_or(s == "failed"), "FAILED").when(F.bool_or(s == "skipped"), "PARTIAL").otherwise("OK").alias("status"),
        F.count(F.lit(1)).alias("stages"),
        F.sum("duration_sec").alias("duration_sec"),
    )


def sweep_rollup(sweep: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Finite-only mean and population spread over folds (NaN below two), and how many folds count."""
    aggs = []
    for m in metrics:
        v = G.finite_or(F.col(m))
        aggs += [
            F.coalesce(F.avg(v), F.lit(float("nan"))).alias(f"{m}_mean"),
            F.when(F.count(v) >= 2, F.stddev_pop(v)).otherwise(F.lit(float("nan"))).alias(f"{m}_std"),
            F.count(v).alias(f"{m}_folds"),
        ]
    return sweep.groupBy(*by).agg(*aggs)


def method_rollup(cases: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population spread per method, finite values only."""
    return cases.groupBy(*by).agg(
        *[
            e
            for m in metrics
            for e in (
                F.avg(G.finite_or(F.col(m))).alias(f"{m}_mean"),
                F.stddev_pop(G.finite_or(F.col(m))).alias(f"{m}_std"),
            )
        ]
    )


def dataset_stats(frames: DataFrame, modality: str = "modality", group: str = "label") -> DataFrame:
    """Frames and subjects per modality and group with all totals, in one cube."""
    return frames.cube(modality, group).agg(
        F.count(F.lit(1)).alias("frames"),
        F.countDistinct("subject_id").alias("subjects"),
        F.grouping_id().cast("int").alias("level"),
    )


def geometry_stats(frames: DataFrame, subject: str = "subject_id", group: str = "label") -> DataFrame:
    """Shape statistics per subject and per group from one pass (grouping sets)."""
    cols = ("area", "perimeter", "eq_diam")
    return frames.groupingSets([[F.col(subject)], [F.col(group)]], F.col(subject), F.col(group)).agg(
        F.count("area").alias("frames"),
        *[e for c in cols for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))],
    )


def mask_metric_rollup(metrics: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean, spread and count per metric; NaN where a group has no value."""
    nan = F.lit(float("nan"))
    return metrics.groupBy(*by).agg(
        *[
            e
            for n in names
            for e in (
                F.coalesce(F.avg(n), nan).alias(f"{n}_mean"),
                F.coalesce(F.stddev_pop(n), nan).alias(f"{n}_std"),
                F.count(n).alias(f"{n}_count"),
            )
        ]
    )


def fold_importance(imp: DataFrame, feature: str = "feature", value: str = "importance", fold: str = "fold", k: int = 10) -> DataFrame:
    """Mean importance over all folds (absent counts as 0) and the places of the top and bottom features."""
    folds = imp.agg(F.countDistinct(fold)).first()[0]
    mean = imp.groupBy(feature).agg((F.sum(value) / F.lit(float(max(1, folds)))).alias("mean_importance"))
    m = F.col("mean_importance")
    lists = {
        "top": [m.desc(), F.col(feature)],
        "bottom": [F.abs(m).asc(), m.asc(), F.col(feature)],
    }
    out = None
    for name, order in lists.items():
        part = mean.orderBy(*order).limit(k).withColumn("list", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# Where feature importances may come from, best first.
IMPORTANCE_SOURCES = [
    "tree_model_feature_importances",
    "tabpfn_extensions_interpretability",
    "model_reported",
    "model_agnostic",
]


def preferred_importance(imp: DataFrame, by: Sequence[str], source: str = "source") -> DataFrame:
    """Rows of the best source each run offers."""
    rank = F.array_position(F.array(*[F.lit(s) for s in IMPORTANCE_SOURCES]), F.col(source))
    rank = F.when(rank > 0, rank).otherwise(F.lit(len(IMPORTANCE_SOURCES) + 1))
    best = imp.groupBy(*by).agg(F.min_by(source, F.struct(rank, F.col(source))).alias(source))
    return imp.join(best, [*by, source], "left_semi")


def dataset_coverage(videos: DataFrame) -> DataFrame:
    """Videos found, annotated and missing, with the first five missing names."""
    missing = videos.where(~F.col("has_annotation"))
    first5 = missing.select("video_stem").orderBy("video_stem").limit(5)
    names = F.array_sort(F.collect_list(F.col("video_stem")))
    preview = first5.agg(F.concat_ws(",", names).alias("preview")).first()["preview"]
    return videos.agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if("has_annotation").alias("annotated"),
        F.count_if(~F.col("has_annotation")).alias("missing"),
    ).withColumn("preview", F.lit(preview))


# ---- before / after comparisons ---------------------------------------------


def stage_comparison(raw: DataFrame, stage: DataFrame, gt: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per frame: IoU and centre error of the raw and the filtered box against the first annotation."""
    on = [*key, "frame_index"]

    def named(df: DataFrame, p: str) -> DataFrame:
        return df.select(*on, *[F.col(c).alias(f"{p}{c}") for c in BOX])

    j = named(dedup.first_per_frame(gt, on), "g_").join(named(raw, "r_"), on).join(named(stage, "s_"), on)
    return j.select(
        *on,
        G.iou(box("r_"), box("g_")).alias("raw_iou"),
        G.center_error(box("r_"), box("g_")).alias("raw_ce"),
        G.iou(box("s_"), box("g_")).alias("iou"),
        G.center_error(box("s_"), box("g_")).alias("ce"),
    )


EPS = 1e-9


def ablation(frames: DataFrame, by: Sequence[str], eps: float = 0.0) -> DataFrame:
    """Change of mean IoU and centre error, and how many frames got worse (by more than ``eps``)."""
    di, dc = F.col("iou") - F.col("raw_iou"), F.col("ce") - F.col("raw_ce")
    return frames.groupBy(*by).agg(
        F.avg("iou").alias("iou_mean"),
        F.avg("ce").alias("ce_mean"),
        (F.avg("iou") - F.avg("raw_iou")).alias("delta_iou"),
        (F.avg("ce") - F.avg("raw_ce")).alias("delta_ce"),
        F.count_if(di < -eps).alias("worse_iou"),
        F.count_if(dc > eps).alias("worse_ce"),
    )


def rank_candidates(
    frames: DataFrame, candidate: Sequence[str], key_frame: Column, max_iou_loss: float = 0.01, max_ce_gain: float = 0.5
) -> DataFrame:
    """Score parameter candidates: mean gains minus harm on key frames; a catastrophic key frame rejects one."""
    di, dc = F.col("iou") - F.col("raw_iou"), F.col("ce") - F.col("raw_ce")
    bad = key_frame & ((di < -max_iou_loss) | (dc > max_ce_gain))
    harm = F.greatest(F.lit(0.0), -di) * 10.0 + F.greatest(F.lit(0.0), dc)
    out = frames.groupBy(*candidate).agg(
        (F.avg("iou") - F.avg("raw_iou")).alias("delta_iou"),
        (F.avg("ce") - F.avg("raw_ce")).alias("delta_ce"),
        F.bool_or(bad).alias("rejected"),
        F.sum(F.when(key_frame, harm).otherwise(0.0)).alias("penalty"),
    )
    score = F.col("delta_iou") * 100.0 - F.greatest(F.lit(0.0), F.col("delta_ce")) - F.col("penalty") * 0.01
    return out.withColumn("score", score).orderBy("rejected", F.col("score").desc(), *candidate)


def rank_experiments(videos: DataFrame, candidate: Sequence[str], eps: float = 0.0) -> DataFrame:
    """Order candidates by the share of videos where IoU and centre error both improve, then by mean gains."""
    both = (F.col("delta_iou") > eps) & (F.col("delta_ce") < -eps)
    out = videos.groupBy(*candidate).agg(
        F.count(F.lit(1)).alias("videos"),
        F.avg(both.cast("double")).alias("both_improved"),
        F.avg("delta_iou").alias("mean_delta_iou"),
        F.avg("delta_ce").alias("mean_delta_ce"),
    )
    return out.orderBy(F.col("both_improved").desc(), F.col("mean_delta_iou").desc(), F.col("mean_delta_ce"), *candidate)


def _dist(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.hypot(F.col(ax) - F.col(bx), F.col(ay) - F.col(by))


def simulation_cases(frames: DataFrame, case: Sequence[str]) -> DataFrame:
    """Error of noisy and filtered centres against the truth, per simulated trajectory.

    Columns: gx, gy (truth), rx, ry (noisy, null where missing), fx, fy
    (filtered), corrupt (outlier put in), flagged (filter saw an outlier).
    """
    seen = F.col("rx").isNotNull()
    raw, fil = _dist("rx", "ry", "gx", "gy"), _dist("fx", "fy", "gx", "gy")
    normal, hit = seen & ~F.col("corrupt"), seen & F.col("corrupt")
    moved = normal & (_dist("fx", "fy", "rx", "ry") > 1e-9)

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return frames.groupBy(*case).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if(~seen).alias("n_missing"),
        F.count_if("corrupt").alias("n_injected_outliers"),
        F.count_if("flagged").alias("n_flagged_by_filter"),
        F.avg(F.when(seen, raw)).alias("raw_observed_mean_err"),
        F.avg(fil).alias("filtered_mean_err"),
        F.avg(F.when(normal, raw)).alias("normal_raw_mean_err"),
        F.avg(F.when(normal, fil)).alias("normal_filtered_mean_err"),
        zero(F.avg(F.when(normal, fil - raw))).alias("normal_err_delta"),
        zero(F.avg(F.when(normal, (fil - raw > 1e-6).cast("double")))).alias("normal_harm_rate"),
        F.avg(F.when(moved, fil)).alias("moved_normal_mean_err"),
        zero(F.avg(F.when(hit, raw - fil))).alias("corrupted_gain"),
    )


def simulation_objective(cases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means over cases and the objective (lower is better)."""
    names = ["filtered_mean_err", "raw_observed_mean_err", "normal_err_delta", "normal_harm_rate", "corrupted_gain"]
    out = cases.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])
    return out.withColumn(
        "objective",
        F.col("filtered_mean_err")
        + F.greatest(F.col("normal_err_delta"), F.lit(0.0)) * 1.5
        + F.col("normal_harm_rate")
        - F.col("corrupted_gain") * 0.8,
    )


def repair_metrics(frames: DataFrame, by: Sequence[str]) -> DataFrame:
    """Repair benchmark: box and centre errors, and detection quality of the flags.

    Needs g_ / s_ boxes, ``corrupt`` (truth), ``flagged`` (detected) and ``anomaly`` (score).
    """
    from framelane.operators.classify import auc, rates

    g, s = box("g_"), box("s_")
    dx = G.center_x(s[0], s[2]) - G.center_x(g[0], g[2])
    dy = G.center_y(s[1], s[3]) - G.center_y(g[1], g[3])
    l1 = sum((F.abs(a - b) for a, b in zip(s[1:], g[1:])), F.abs(s[0] - g[0])) / 4.0
    t, p = F.col("corrupt"), F.col("flagged")
    iou = G.iou(s, g)
    out = frames.groupBy(*by).agg(
        F.avg(iou).alias("iou_mean"),
        F.stddev_pop(iou).alias("iou_std"),
        F.avg(F.hypot(dx, dy)).alias("error_mean"),
        F.stddev_pop(F.hypot(dx, dy)).alias("error_std"),
        F.avg(l1).alias("roi_l1_mean"),
        F.avg((dx * dx + dy * dy) / 2.0).alias("mse"),
        F.avg((F.abs(dx) + F.abs(dy)) / 2.0).alias("mae"),
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )
    out = rates(out).select(
        *out.columns,
        F.col("accuracy").alias("det_accuracy"),
        F.col("precision_positive").alias("det_precision"),
        F.col("recall_positive").alias("det_recall"),
        F.col("f1_positive").alias("det_f1"),
        F.col("specificity").alias("det_specificity"),
    )
    a = auc(frames.withColumn("label_true", t.cast("int")), by, "anomaly").select(*by, F.col("auc").alias("auroc"))
    return out.join(a, list(by), "left")


def threshold_sweep(
    preds: DataFrame,
    gt: DataFrame,
    key: Sequence[str],
    by: Sequence[str],
    thresholds: Sequence[float],
    min_points: int = 1,
    penalty: Column | None = None,
) -> DataFrame:
    """Per score threshold: IoU, centre error and AUROC when weak boxes are dropped and filled in again.

    ``by`` are columns of ``gt`` constant per key (a fold). Every annotated
    frame counts: one that stays without a box has IoU 0 and the penalty
    distance (default: the diagonal of the annotation).
    """
    from framelane.operators.classify import auc
    from framelane.operators.interpolate import fill
    from framelane.session import cut

    on = [*key, "frame_index"]
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    score = G.finite_or(F.col("score"), 0.0)
    good = G.valid_box(*[F.col(c) for c in BOX], 1.0) & (F.col("w") > 1) & (F.col("h") > 1)
    usable = ~F.coalesce("is_fallback", F.lit(False)) & good
    p = dedup.first_per_frame(preds, on).where(usable).withColumn("score", score)
    passed = F.filter(grid, lambda t: t <= F.col("score"))
    p = p.select(*on, *BOX, "score", F.explode(passed).alias("threshold"), F.lit(True).alias("known"))
    g = dedup.first_per_frame(gt, on)
    extra = [c for c in by if c not in key]
    g = g.select(*on, *extra, *[F.col(c).alias(f"g_{c}") for c in BOX], F.explode(grid).alias("threshold"))
    rows = g.join(p, [*on, "threshold"], "full_outer").withColumn("known", F.coalesce("known", F.lit(False)))
    rows = cut(rows)
    rows = fill(rows, ["threshold", *key], BOX, F.col("known"))
    has = F.col("known") | ((F.col("knots") > 0) & (F.col("knots") >= min_points))
    far = G.diagonal(F.col("g_w"), F.col("g_h")) if penalty is None else penalty
    iou = F.when(has & good, G.iou(box(), box("g_"))).otherwise(F.lit(0.0))
    ce = F.when(has & good, G.center_error(box(), box("g_"))).otherwise(far)
    frames = rows.where(F.col("g_x").isNotNull()).select(
        "threshold", *by, iou.alias("iou"), ce.alias("ce"), has.alias("has"), "known",
        (iou >= 0.5).cast("int").alias("label_true"),
        F.when(F.col("known"), F.col("score")).otherwise(F.lit(0.0)).alias("prob"),
    )
    frames = cut(frames)
    out = frames.groupBy(*by, "threshold").agg(
        F.avg("iou").alias("iou"),
        F.avg("ce").alias("ce"),
        F.count(F.lit(1)).alias("n_eval_frames"),
        F.count_if(~F.col("has")).alias("n_without_box"),
        F.count_if("known").alias("n_known"),
    )
    a = auc(frames, [*by, "threshold"]).select(*by, "threshold", F.col("auc").alias("auroc"))
    return out.join(a, [*by, "threshold"], "left")
