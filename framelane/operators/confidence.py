"""Per-frame confidence: drift, token and distribution signals, blended and smoothed along a trajectory."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelane.functions import geometry as G
from framelane.operators.frames import run_bounds, top_k
from framelane.operators.ordered import first_known, row_position, scan
from framelane.operators.ranked import percentiles_of
from framelane.session import cut

# Weights and shape parameters of the confidence blend.
WEIGHTS = {"distribution": 1.0, "drift": 0.8, "token": 0.4}
TOKEN_GAMMA = 1.2
DISTRIBUTION_BETA = 2.0
ALPHA = 0.7
DRIFT_NORMALIZER = 2.5


def token_component(tokens: Column) -> Column:
    """exp(-gamma * dispersion) of a (tokens x channels) matrix, energy-normalised; null for an empty one."""
    clean = F.transform(tokens, lambda r: F.transform(r, lambda v: G.finite_or(v.cast("double"), 0.0)))
    rows, width = F.size(tokens), F.size(tokens[0])
    zero = F.lit(0.0)

    def energy(m: Column) -> Column:
        return F.aggregate(F.flatten(m), zero, lambda s, v: s + v * v)

    mean_energy = energy(clean) / rows
    scale = F.sqrt(mean_energy / width)
    scale = F.when((mean_energy > 0) & (scale > 1e-6), scale).otherwise(F.lit(1.0))
    total_ = F.aggregate(
        clean,
        F.array_repeat(zero, width),
        lambda s, r: F.zip_with(s, r, lambda a, b: a + b),
    )
    # sum of squared deviations = energy - rows * |mean|^2
    spread = energy(clean) - F.aggregate(total_, zero, lambda s, v: s + v * v) / rows
    variance = spread / (scale * scale) / rows / width
    value = G.unit_clip(F.exp(F.lit(-TOKEN_GAMMA) * variance))
    return F.when((rows > 0) & (width > 0), value)


def distribution_component(edges: Column) -> Column:
    """exp(-beta * mean normalised entropy) over a map of probability vectors; null without any."""

    def entropy(p: Column) -> Column:
        floor_ = F.transform(p, lambda v: F.greatest(v.cast("double"), F.lit(1e-8)))
        mass = F.aggregate(floor_, F.lit(0.0), lambda s, v: s + v)
        # -sum(p/m * ln(p/m)) = ln m - sum(p ln p) / m
        raw = F.log(mass) - F.aggregate(floor_, F.lit(0.0), lambda s, v: s + v * F.log(v)) / mass
        n = F.size(p)
        return F.when(n > 1, G.unit_clip(raw / F.log(n.cast("double")))).otherwise(F.lit(0.0))

    vectors = F.filter(F.map_values(edges), lambda p: p.isNotNull() & (F.size(p) > 0))
    n = F.size(vectors)
    mean = F.aggregate(F.transform(vectors, entropy), F.lit(0.0), lambda s, v: s + v) / n
    return F.when(n > 0, G.unit_clip(F.exp(F.lit(-DISTRIBUTION_BETA) * mean)))


def drift_component(box: Sequence[Column], anchor: Sequence[Column]) -> Column:
    """1 at the anchor, falling to 0 at 2.5 anchor diagonals."""
    diag = F.greatest(G.diagonal(anchor[2], anchor[3]), F.lit(1e-6))
    return F.greatest(F.lit(0.0), F.lit(1.0) - G.center_error(box, anchor) / (diag * DRIFT_NORMALIZER))


def blend(drift: Column, distribution: Column | None = None, token: Column | None = None) -> Column:
    """Weighted logit of the available components (null ones drop out)."""
    z = F.lit(0.0)
    for name, c in (("distribution", distribution), ("drift", drift), ("token", token)):
        if c is not None:
            z = z + F.coalesce(G.unit_clip(c) * WEIGHTS[name], F.lit(0.0))
    return z


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def ema(
    df: DataFrame, key: Sequence[str], value: str, out: str, alpha: float = ALPHA, order: str = "frame_index"
) -> DataFrame:
    """Exponential smoothing in order: first value as is, then ``(1 - alpha) * previous + alpha * value``.

    Rows are numbered and cut into blocks short enough that ``keep ** -i`` stays
    far from overflow; inside a block the result is a scaled running sum. What
    reaches a block is the fold of the preceding blocks' sums, as many as still
    count in double precision (``keep ** rows`` above 1e-300).
    """
    keep = 1.0 - float(alpha)
    if keep <= 0.0:
        return df.withColumn(out, F.col(value))
    decay = -math.log(keep)
    size = max(1, min(256, int(600 / decay)))
    reach = max(1, math.ceil(700 / (size * decay)))
    k, a = F.lit(keep), F.lit(float(alpha))
    rows = scan(df, key, order, row_position("_pos"), first_known("_v0", F.col(value), order))
    i = F.pmod(F.col("_pos"), F.lit(size))
    rows = rows.withColumns({"_b": F.floor(F.col("_pos") / size), "_i": i})
    v, idx = F.col(value), F.col("_i")
    sums = rows.groupBy(*key, "_b").agg(
        F.sum(v * F.pow(k, F.lit(size - 1) - idx) * a).alias("_add"), F.first("_v0").alias("_v0")
    )
    w = Window.partitionBy(*key).orderBy("_b")
    before = F.collect_list("_add").over(w.rowsBetween(-reach, -1))
    start = F.when(F.col("_b") <= reach, F.col("_v0")).otherwise(F.lit(0.0))
    carry = sums.withColumns({"_l": before, "_s": start}).select(
        *key, "_b", F.aggregate("_l", F.col("_s"), lambda s, e: s * F.lit(keep**size) + e).alias("_carry")
    )
    inside = Window.partitionBy(*key, "_b").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carry, [*key, "_b"])
    c = F.sum(v * F.pow(k, -idx)).over(inside) * F.pow(k, idx) * a + F.pow(k, idx + 1) * F.col("_carry")
    return rows.select(*df.columns, c.alias(out))


def estimate(
    df: DataFrame,
    key: Sequence[str],
    distribution: Column | None = None,
    token: Column | None = None,
    order: str = "frame_index",
) -> DataFrame:
    """Add drift, distribution, token, logit, blended, drift_pixels and the smoothed confidence.

    The first box of a trajectory is the anchor, so its own drift component is 1.
    """
    box = F.struct("x", "y", "w", "h")
    rows = scan(df, key, order, first_known("_anchor", box, order))
    cur = [F.col(c) for c in ("x", "y", "w", "h")]
    anchor = [F.col("_anchor")[c] for c in ("x", "y", "w", "h")]
    none = F.lit(None).cast("double")
    rows = rows.withColumns(
        {
            "drift": drift_component(cur, anchor),
            "distribution": none if distribution is None else distribution,
            "token": none if token is None else token,
            "drift_pixels": G.center_error(cur, anchor),
        }
    ).drop("_anchor")
    rows = rows.withColumn("logit", blend(F.col("drift"), F.col("distribution"), F.col("token")))
    rows = rows.withColumn("blended", sigmoid(F.col("logit")))
    return ema(cut(rows), key, "blended", "estimated", order=order)


def with_stored(df: DataFrame, estimated: str = "estimated") -> DataFrame:
    """Components and confidence stored in the file win over the estimate.

    Needs ``components`` (map, may be null or empty) and ``confidence``; a frame
    with stored components shows only those.
    """
    stored = F.col("components").isNotNull() & (F.size("components") > 0)
    out = {
        "confidence": F.when(stored, F.coalesce("confidence", estimated)).otherwise(F.col(estimated)),
    }
    for name in ("drift", "distribution", "token", "attention", "short_iou"):
        own = F.col(name) if name in df.columns else F.lit(None).cast("double")
        out[name] = F.when(stored, F.col("components")[name]).otherwise(own)
    raw = F.when(stored, F.coalesce(F.col("components")["raw_score"], F.col("components")["score"]))
    out["score_component"] = F.coalesce(raw, G.unit_clip(F.col("score")) + F.col("score") * 0)
    return df.withColumns(out)


def summarise(
    frames: DataFrame, key: Sequence[str], threshold: float = 0.5, order: str = "frame_index"
) -> DataFrame:
    """Sequence summary of ``confidence`` and the component columns."""
    c = F.col("confidence")
    base = frames.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_frames"),
        F.avg(c).alias("confidence_mean"),
        F.stddev_pop(c).alias("confidence_std"),
        F.min(c).alias("confidence_min"),
        F.count_if(c < threshold).alias("below_threshold"),
        F.avg((c < threshold).cast("double")).alias("below_threshold_ratio"),
        *[
            F.avg(G.finite_or(F.col(n))).alias(f"{n}_mean")
            for n in ("score_component", "token", "distribution", "attention", "short_iou", "drift")
        ],
        F.avg("drift_pixels").alias("drift_pixels_mean"),
        F.avg("score").alias("raw_score_mean"),
    )
    runs = run_bounds(frames, key, c < threshold, order)
    streak = runs.groupBy(*key).agg(
        F.coalesce(F.max(F.col("run_last") - F.col("run_first") + 1), F.lit(0)).cast("long").alias("longest_low_streak")
    )
    out = base.join(streak, list(key))
    spread = {"confidence": {"confidence_p10": 0.1, "confidence_p05": 0.05}, "drift_pixels": {"drift_pixels_p95": 0.95}, "score": {"raw_score_p10": 0.1}}
    return out.join(percentiles_of(frames, key, spread), list(key), "left")


def worst_frames(frames: DataFrame, key: Sequence[str], k: int, order: str = "frame_index") -> DataFrame:
    """The ``k`` least confident frames per sequence; equal ones in frame order."""
    return top_k(frames, key, [F.col("confidence"), F.col(order)], max(1, k))


def scan_report(summary: DataFrame, tracker: str, trackers: Sequence[str] | None = None) -> DataFrame:
    """Summaries of the wanted trackers, least reliable first."""
    out = summary if trackers is None else summary.where(F.col(tracker).isin(list(trackers)))
    return out.orderBy("confidence_p05", "confidence_mean")
