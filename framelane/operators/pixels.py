"""Texture and mask statistics on pixel tables (image, y, x, v), one row per pixel.

Windows run along one image row or one image column, so a window never holds
more than an image side, however many pixels one image has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelane.functions import geometry as G
from framelane.operators.frames import top_k
from framelane.operators.ranked import percentiles

LEVELS = 16


def _along(key: Sequence[str], fixed: str, moving: str):
    return Window.partitionBy(*key, fixed).orderBy(moving)


def cooccurrence(px: DataFrame, key: Sequence[str]) -> DataFrame:
    """Contrast, dissimilarity, homogeneity, energy and correlation of horizontal neighbours on 16 grey levels."""
    g = F.least(F.floor(F.col("v") * (LEVELS - 1) / 255), F.lit(LEVELS - 1)).cast("int")
    rows = px.select(*key, "y", "x", g.alias("i"))
    rows = rows.withColumn("j", F.lead("i").over(_along(key, "y", "x"))).where(F.col("j").isNotNull())
    both = rows.select(*key, F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"))
    cells = both.groupBy(*key, F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    i, j, n = F.col("i"), F.col("j"), F.col("n")
    d = i - j
    s = cells.groupBy(*key).agg(
        F.sum(n).alias("t"),
        F.sum(d * d * n).alias("c"),
        F.sum(F.abs(d) * n).alias("ds"),
        F.sum(n / (d * d + 1.0)).alias("hm"),
        F.sum(n * n).alias("en"),
        F.sum(i * n).alias("si"),
        F.sum(i * i * n).alias("sii"),
        F.sum(i * j * n).alias("sij"),
    )
    t = F.col("t").cast("double")
    mu = F.col("si") / t
    # the table is symmetric, so both marginals agree
    spread = F.pow(F.sqrt(F.greatest(F.col("sii") / t - mu * mu, F.lit(0.0))) + 1e-9, 2)
    return s.select(
        *key,
        (F.col("c") / t).alias("glcm_contrast"),
        (F.col("ds") / t).alias("glcm_dissimilarity"),
        (F.col("hm") / t).alias("glcm_homogeneity"),
        (F.col("en") / (t * t)).alias("glcm_energy"),
        ((F.col("sij") / t - mu * mu) / spread).alias("glcm_correlation"),
    )


def neighbourhood(px: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add the eight neighbours (``n_ul`` .. ``n_dr``), reflected at the border without repeating it, and ``inner``."""
    w = _along(key, "y", "x")
    l, r = F.lag("v").over(w), F.lead("v").over(w)
    rows = px.withColumns({"_l": l, "_r": r})
    trio = F.struct(
        F.coalesce("_l", "_r", "v").alias("l"), F.col("v").alias("m"), F.coalesce("_r", "_l", "v").alias("r")
    )
    rows = rows.withColumns({"_t": trio, "_in": F.col("_l").isNotNull() & F.col("_r").isNotNull()})
    h = _along(key, "x", "y")
    rows = rows.withColumns({"_u": F.lag("_t").over(h), "_d": F.lead("_t").over(h)})
    up, down = F.coalesce("_u", "_d", "_t"), F.coalesce("_d", "_u", "_t")
    return rows.select(
        *px.columns,
        *[up[c].alias(f"n_u{c}") for c in ("l", "m", "r")],
        F.col("_t.l").alias("n_l"),
        F.col("_t.r").alias("n_r"),
        *[down[c].alias(f"n_d{c}") for c in ("l", "m", "r")],
        (F.col("_in") & F.col("_u").isNotNull() & F.col("_d").isNotNull()).alias("inner"),
    )


# Neighbour of bit 0..7 of the binary pattern, clockwise from the upper left.
PATTERN = ["n_ul", "n_um", "n_ur", "n_r", "n_dr", "n_dm", "n_dl", "n_l"]


def binary_pattern(px: DataFrame, key: Sequence[str], bins: int = 10) -> DataFrame:
    """Share of inner pixels per bin of their 8-bit neighbour pattern; every bin of every image is listed."""
    n = neighbourhood(px, key).where("inner")
    code = sum(((F.col(c) >= F.col("v")).cast("int") * (1 << b) for b, c in enumerate(PATTERN)), F.lit(0))
    b = F.least(F.floor(code * bins / 256.0), F.lit(bins - 1)).cast("int")
    hist = n.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(b == i).alias(f"lbp_{i:02d}") for i in range(bins)]
    )
    return hist.select(*key, *[(F.col(f"lbp_{i:02d}") / F.col("_n")).alias(f"lbp_{i:02d}") for i in range(bins)])


def grey_stats(px: DataFrame, key: Sequence[str]) -> DataFrame:
    """Grey level moments and gradient magnitude (3 x 3 derivative, reflected border)."""
    n = neighbourhood(px, key)
    gx = (F.col("n_ur") + F.col("n_r") * 2 + F.col("n_dr")) - (F.col("n_ul") + F.col("n_l") * 2 + F.col("n_dl"))
    gy = (F.col("n_dl") + F.col("n_dm") * 2 + F.col("n_dr")) - (F.col("n_ul") + F.col("n_um") * 2 + F.col("n_ur"))
    m = F.hypot(gx.cast("double"), gy.cast("double"))
    v = F.col("v").cast("double")
    some = F.stddev_pop(v) > 1e-9
    return n.groupBy(*key).agg(
        F.avg(v).alias("gray_mean"),
        F.stddev_pop(v).alias("gray_std"),
        F.when(some, F.skewness(v)).otherwise(0.0).alias("gray_skewness"),
        F.when(some, F.kurtosis(v)).otherwise(0.0).alias("gray_kurtosis"),
        F.avg(m).alias("grad_mean"),
        F.stddev_pop(m).alias("grad_std"),
    )


def video_texture(px: DataFrame, frames: DataFrame, key: Sequence[str], image: str, top: int = 5) -> DataFrame:
    """Texture of the ``top`` best scored frames of each video, as mean and spread.

    ``frames`` lists (key, image, score); the other frames' pixels are never read past the join.
    """
    best = top_k(frames, key, [F.col("score").desc_nulls_last(), F.col(image)], top).select(*key, image)
    use = px.join(best.select(image), image, "left_semi")
    t = cooccurrence(use, [image]).join(grey_stats(use, [image]), image).join(best, image)
    return t.groupBy(*key).agg(
        F.avg("glcm_contrast").alias("tex_glcm_contrast_mean"),
        F.stddev_pop("glcm_contrast").alias("tex_glcm_contrast_std"),
        F.avg("glcm_homogeneity").alias("tex_glcm_homogeneity_mean"),
        F.stddev_pop("glcm_homogeneity").alias("tex_glcm_homogeneity_std"),
        F.avg("glcm_energy").alias("tex_glcm_energy_mean"),
        F.avg("glcm_correlation").alias("tex_glcm_correlation_mean"),
        *[F.avg(c).alias(f"tex_{c}") for c in ("gray_mean", "gray_std", "grad_mean", "grad_std")],
    )


def compress_range(
    px: DataFrame, key: Sequence[str], clip: float = 99.5, method: str = "log", gamma: float = 0.6, eps: float = 1e-6
) -> DataFrame:
    """Dynamic range compression per image: percentile clip, scale by the maximum, log or gamma, back to 0..255."""
    rows = px.withColumn("v", F.col("v").cast("double"))
    top = F.lit(None).cast("double")
    if 0 < clip < 100:
        rows = rows.join(percentiles(rows, key, "v", {"_hi": clip / 100.0}), list(key))
        top = F.col("_hi")
    else:
        rows = rows.withColumn("_hi", F.lit(None).cast("double"))
    v = F.when(top > 0, F.greatest(F.lit(0.0), F.least(F.col("v"), top))).otherwise(F.col("v"))
    rows = rows.withColumn("v", v)
    peak = rows.groupBy(*key).agg(F.max("v").alias("_mx"))
    rows = rows.join(peak, list(key))
    f = F.col("v") / F.when(F.col("_mx") <= 0, F.lit(eps)).otherwise(F.col("_mx"))
    f = F.log1p(f * (math.e - 1.0)) if method == "log" else F.pow(f, F.lit(max(1e-3, gamma)))
    out = F.least(F.greatest(F.floor(F.round(f * 255.0, 9)), F.lit(0)), F.lit(255)).cast("int")
    return rows.withColumn("v", out).select(*px.columns)


def depth_gain(
    px: DataFrame, key: Sequence[str], start: float = 1.0, end: float = 2.0, mode: str = "linear", power: float = 1.0,
    points: Sequence[tuple[float, float]] = (),
) -> DataFrame:
    """Multiply each row of an image by a gain that grows with depth (linear, exponential or piecewise linear)."""
    h = px.groupBy(*key).agg((F.max("y") + 1).alias("_h"))
    rows = px.join(h, list(key))
    t = F.when(F.col("_h") > 1, F.col("y").cast("double") / (F.col("_h") - 1)).otherwise(F.lit(0.0))
    if mode == "linear":
        gain = F.lit(start) + F.lit(end - start) * t
    elif mode == "exp":
        gain = F.lit(start) * F.pow(F.lit(end / max(1e-6, start)), F.pow(t, F.lit(power)))
    else:
        pts = sorted((float(a), float(b)) for a, b in points)
        if not pts:
            raise ValueError("mode custom needs points")
        gain = F.lit(pts[-1][1])
        for (x0, g0), (x1, g1) in reversed(list(zip(pts, pts[1:]))):
            gain = F.when(t <= x1, F.lit(g0) + (t - x0) * ((g1 - g0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(gain)
        gain = F.when(t <= pts[0][0], F.lit(pts[0][1])).otherwise(gain)
    v = F.floor(F.round(F.col("v").cast("double") * gain, 9))
    return rows.withColumn("v", F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("int")).select(*px.columns)


def mask_stats(px: DataFrame, key: Sequence[str], foreground: Column) -> DataFrame:
    """Area, bounding box, centroid and equivalent diameter of a mask; zeros for an empty one."""
    def on(c: Column) -> Column:
        return F.when(foreground, c)

    x, y = F.col("x"), F.col("y")

    def zero(c: Column) -> Column:
        return F.coalesce(c.cast("double"), F.lit(0.0))

    area = F.count(on(x)).cast("double")
    return px.groupBy(*key).agg(
        area.alias("area"),
        zero(F.min(on(x))).alias("x"),
        zero(F.min(on(y))).alias("y"),
        zero(F.max(on(x)) - F.min(on(x)) + 1).alias("w"),
        zero(F.max(on(y)) - F.min(on(y)) + 1).alias("h"),
        zero(F.avg(on(x))).alias("cx"),
        zero(F.avg(on(y))).alias("cy"),
        G.equivalent_diameter(area).alias("eq_diam"),
    )


def mask_overlap(px: DataFrame, key: Sequence[str], pred: Column, truth: Column, eps: float = 1e-6) -> DataFrame:
    """Dice and IoU of two masks on one pixel grid (1 where both are empty) and the distance of their centroids."""
    a, b = F.count_if(pred), F.count_if(truth)
    both, either = F.count_if(pred & truth), F.count_if(pred | truth)
    dx = F.avg(F.when(pred, F.col("x"))) - F.avg(F.when(truth, F.col("x")))
    dy = F.avg(F.when(pred, F.col("y"))) - F.avg(F.when(truth, F.col("y")))
    return px.groupBy(*key).agg(
        F.when(either == 0, F.lit(1.0)).otherwise(both * 2.0 / (a + b + F.lit(eps))).alias("dice"),
        F.when(either == 0, F.lit(1.0)).otherwise(both / (either + F.lit(eps))).alias("iou"),
        F.hypot(dx, dy).alias("centroid_distance"),
    )
