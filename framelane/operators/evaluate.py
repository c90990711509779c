"""Prediction-versus-annotation evaluation: matching, success curve, detection counts, roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane.functions import geometry as G
from framelane.operators import dedup
from framelane.operators.ordered import previous_known, scan

BOX = ("x", "y", "w", "h")
LEVELS = 100


def _boxes(df: DataFrame, key: Sequence[str], prefix: str, *extra: str) -> DataFrame:
    return df.select(
        *key, "frame_index", *[F.col(c).alias(f"{prefix}{c}") for c in BOX], *extra
    )


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in BOX]


def success_level(iou: Column) -> Column:
    """Largest i in 0..100 with ``iou >= i / 100``, compared in doubles exactly as the definition states."""
    k = F.floor(iou * LEVELS).cast("int")
    k = F.when((k + 1).cast("double") / LEVELS <= iou, k + 1).otherwise(k)
    k = F.when(k.cast("double") / LEVELS > iou, k - 1).otherwise(k)
    return F.when(iou.isNotNull(), F.least(k, F.lit(LEVELS)))


def frame_union(preds: DataFrame, gt: DataFrame, key: Sequence[str], which: str = "first") -> DataFrame:
    """Full outer match of one prediction and one annotation per frame, with ``iou`` and ``ce``.

    An annotation row with a null box stands for an annotated frame without objects.
    """
    pick = dedup.first_per_frame if which == "first" else dedup.last_per_frame
    on = [*key, "frame_index"]
    p = _boxes(dedup.first_per_frame(preds, on), key, "p_", F.col("score")).withColumn("has_pred", F.lit(True))
    g = _boxes(pick(gt, on), key, "g_").withColumn("in_gt", F.lit(True))
    out = g.join(p, on, "full_outer")
    both = F.col("g_x").isNotNull() & F.col("has_pred")
    return out.select(
        *on,
        *box("g_"),
        *box("p_"),
        "score",
        F.coalesce("in_gt", F.lit(False)).alias("in_gt"),
        F.col("g_x").isNotNull().alias("has_gt"),
        F.coalesce("has_pred", F.lit(False)).alias("has_pred"),
        F.when(both, G.iou(box("p_"), box("g_"))).alias("iou"),
        F.when(both, G.center_error(box("p_"), box("g_"))).alias("ce"),
    )


def per_frame(preds: DataFrame, gt: DataFrame, key: Sequence[str], which: str = "first") -> DataFrame:
    """Rows of the per-frame report: every annotated frame, then predictions outside annotated frames."""
    u = frame_union(preds, gt, key, which)
    return u.where(F.col("has_gt") | ~F.col("in_gt")).select(*key, "frame_index", "score", "iou", "ce")


def matched(preds: DataFrame, gt: DataFrame, key: Sequence[str], which: str = "first") -> DataFrame:
    """Frames that have both a prediction and an annotation (inner, so nothing else is shuffled on)."""
    pick = dedup.first_per_frame if which == "first" else dedup.last_per_frame
    on = [*key, "frame_index"]
    p = _boxes(dedup.first_per_frame(preds, on), key, "p_", F.col("score"))
    g = _boxes(pick(gt.where(F.col("x").isNotNull()), on), key, "g_")
    out = g.join(p, on, "inner")
    return out.withColumns({"iou": G.iou(box("p_"), box("g_")), "ce": G.center_error(box("p_"), box("g_"))})


def missing_frames(preds: DataFrame, gt: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predictions on frames the annotation does not know at all."""
    on = [*key, "frame_index"]
    return dedup.first_per_frame(preds, on).join(gt.select(*on).distinct(), on, "left_anti")


def restrict_to_annotated(preds: DataFrame, gt: DataFrame, key: Sequence[str]) -> DataFrame:
    on = [*key, "frame_index"]
    return preds.join(gt.select(*on).distinct(), on, "left_semi")


def align_offset(preds: DataFrame, gt: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predictions on annotated frames, shifted by ``min(gt) - min(pred)`` where that covers strictly more rows.

    ``offset`` tells the shift applied. Both candidates are counted in one
    aggregate over rows tagged with the shift they belong to.
    """
    on = [*key, "frame_index"]
    starts = preds.groupBy(*key).agg(F.min("frame_index").alias("_p0"))
    starts = starts.join(gt.groupBy(*key).agg(F.min("frame_index").alias("_g0")), list(key))
    starts = starts.select(*key, (F.col("_g0") - F.col("_p0")).alias("_delta"))
    frames = gt.select(*on).distinct()
    both = preds.join(starts, list(key)).withColumn(
        "offset",
        F.explode(
            F.when(F.col("_delta") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.col("_delta")))
        ),
    )
    both = both.withColumn("frame_index", (F.col("frame_index") + F.col("offset")).cast("int"))
    hits = both.join(frames, on, "left_semi")
    better = (
        hits.groupBy(*key)
        .agg(
            F.count_if(F.col("offset") == 0).alias("direct"),
            F.count_if(F.col("offset") != 0).alias("moved"),
            F.max("_delta").alias("_d"),
        )
        .select(*key, F.when(F.col("moved") > F.col("direct"), F.col("_d")).otherwise(0).alias("offset"))
    )
    return hits.join(better, [*key, "offset"], "left_semi").drop("_delta")


def success_curve(frames: DataFrame, key: Sequence[str]) -> DataFrame:
    """Share of matched frames with IoU at or above i/100, i = 0..100.

    Frames are counted per level, then a key's levels (101 at most) are listed, and the thresholds are
    the last step: nothing of their number is shuffled or held.
    """
    m = frames.where(F.col("iou").isNotNull())
    hist = m.groupBy(*key, success_level(F.col("iou")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    levels = hist.groupBy(*key).agg(F.collect_list(F.struct("level", "n")).alias("_levels"), F.sum("n").alias("n"))
    steps = levels.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    i = F.col("i")
    hits = F.aggregate("_levels", F.lit(0).cast("long"), lambda s, e: s + F.when(e["level"] >= i, e["n"]).otherwise(0))
    return steps.select(*key, (i.cast("double") / LEVELS).alias("threshold"), (hits / F.col("n")).alias("success_rate"))


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def detection_columns(threshold: float, suffix: str) -> list[Column]:
    """TP / FP / FN of one operating point; a matched box below the threshold is a false positive only."""
    hit = F.col("iou") >= threshold
    return [
        F.count_if(F.col("has_gt") & F.col("has_pred") & hit).alias(f"tp_{suffix}"),
        F.count_if(F.col("has_pred") & (~F.col("has_gt") | (F.col("iou") < threshold))).alias(f"fp_{suffix}"),
        F.count_if(F.col("has_gt") & ~F.col("has_pred")).alias(f"fn_{suffix}"),
    ]


def detection_counts(preds: DataFrame, gt: DataFrame, key: Sequence[str], threshold: float = 0.5) -> DataFrame:
    u = frame_union(preds, gt, key)
    out = u.groupBy(*key).agg(*detection_columns(threshold, "t"))
    tp, fp, fn = F.col("tp_t"), F.col("fp_t"), F.col("fn_t")
    return out.select(
        *key,
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
    )


def video_summary(preds: DataFrame, gt: DataFrame, key: Sequence[str]) -> DataFrame:
    """Everything the evaluator reports per video, from one match, one ordered scan and one aggregate."""
    u = frame_union(preds, gt, key)
    u = scan(u, key, "frame_index", previous_known("prev_ce", F.col("ce"), "frame_index"))
    iou, ce = F.col("iou"), F.col("ce")
    out = u.groupBy(*key).agg(
        F.count("iou").alias("count"),
        F.coalesce(F.avg(iou), F.lit(0.0)).alias("iou_mean"),
        F.coalesce(F.stddev_pop(iou), F.lit(0.0)).alias("iou_std"),
        F.coalesce(F.avg(ce), F.lit(0.0)).alias("ce_mean"),
        F.coalesce(F.stddev_pop(ce), F.lit(0.0)).alias("ce_std"),
        F.coalesce(F.sum(iou), F.lit(0.0)).alias("sum_iou"),
        F.coalesce(F.sum(iou * iou), F.lit(0.0)).alias("sum_iou_sq"),
        F.coalesce(F.sum(ce), F.lit(0.0)).alias("sum_ce"),
        F.coalesce(F.sum(ce * ce), F.lit(0.0)).alias("sum_ce_sq"),
        F.coalesce(F.avg((success_level(iou) + 1).cast("double") / (LEVELS + 1)), F.lit(0.0)).alias("success_auc"),
        F.coalesce(F.avg(F.abs(ce - F.col("prev_ce"))), F.lit(0.0)).alias("drift_rate"),
        *detection_columns(0.5, "50"),
        *detection_columns(0.75, "75"),
    )
    return out.withColumns(
        {
            f"success_rate_{s}": ratio(F.col(f"tp_{s}"), F.col(f"tp_{s}") + F.col(f"fp_{s}"))
            for s in ("50", "75")
        }
    )


def coverage(preds: DataFrame, gt: DataFrame, key: Sequence[str]) -> DataFrame:
    """Frame counts, ranges and the offset that would align the first frames."""
    on = [*key, "frame_index"]
    g = gt.where(F.col("x").isNotNull()).select(*on).distinct().withColumn("g", F.lit(1))
    p = preds.select(*on).distinct().withColumn("p", F.lit(1))
    f = F.col("frame_index")
    u = g.join(p, on, "full_outer").groupBy(*key).agg(
        F.count("g").alias("gt_frames"),
        F.count("p").alias("pred_frames"),
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("matched_frames"),
        F.min(F.when(F.col("g").isNotNull(), f)).alias("gt_first"),
        F.max(F.when(F.col("g").isNotNull(), f)).alias("gt_last"),
        F.min(F.when(F.col("p").isNotNull(), f)).alias("pred_first"),
        F.max(F.when(F.col("p").isNotNull(), f)).alias("pred_last"),
    )
    return u.withColumns(
        {
            "coverage_ratio": ratio(F.col("matched_frames"), F.col("gt_frames")),
            "suggested_offset": F.col("gt_first") - F.col("pred_first"),
        }
    )


def dataset_rollup(videos: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge per-video partials: frame-weighted IoU / CE, micro precision, per-video mean of AUC and drift.

    ``infer_frames`` / ``infer_time`` are optional columns of ``videos``.
    """
    timed = {"infer_frames", "infer_time"} <= set(videos.columns)
    s = videos.groupBy(*by).agg(
        F.sum("count").alias("_n"),
        *[F.sum(c).alias(c) for c in ("sum_iou", "sum_iou_sq", "sum_ce", "sum_ce_sq")],
        *[F.sum(c).alias(c) for c in ("tp_50", "fp_50", "tp_75", "fp_75")],
        F.avg("success_auc").alias("success_auc"),
        F.avg("drift_rate").alias("drift_rate"),
        *([F.sum("infer_frames").alias("_if"), F.sum("infer_time").alias("_it")] if timed else []),
    )
    n = F.greatest(F.col("_n"), F.lit(1))

    def spread(name: str) -> Column:
        mean = F.col(f"sum_{name}") / n
        return F.sqrt(F.greatest(F.lit(0.0), F.col(f"sum_{name}_sq") / n - mean * mean))

    return s.select(
        *by,
        n.alias("frames_count"),
        (F.col("sum_iou") / n).alias("iou_mean"),
        spread("iou").alias("iou_std"),
        (F.col("sum_ce") / n).alias("ce_mean"),
        spread("ce").alias("ce_std"),
        ratio(F.col("tp_50"), F.col("tp_50") + F.col("fp_50")).alias("success_rate_50"),
        ratio(F.col("tp_75"), F.col("tp_75") + F.col("fp_75")).alias("success_rate_75"),
        "success_auc",
        "drift_rate",
        *([ratio(F.col("_if").cast("double"), F.col("_it")).alias("fps")] if timed else []),
    )


def fold_summary(folds: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population spread of each metric over folds."""
    return folds.groupBy(*by).agg(
        *[e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    )
