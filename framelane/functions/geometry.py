"""Box geometry as column expressions. Boxes are (x, y, w, h) unless said otherwise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def d(v: float) -> Column:
    return F.lit(float(v))


def finite(c: Column) -> Column:
    """True for a non-null, non-NaN, non-infinite double."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite_or(c: Column, default: float | None = None) -> Column:
    out = F.when(finite(c), c)
    return out if default is None else out.otherwise(F.lit(float(default)))


def center_x(x: Column, w: Column) -> Column:
    return x + w / d(2)


def center_y(y: Column, h: Column) -> Column:
    return y + h / d(2)


def diagonal(w: Column, h: Column) -> Column:
    return F.hypot(w, h)


def area(w: Column, h: Column) -> Column:
    return w * h


def aspect(w: Column, h: Column) -> Column:
    return w / (h + d(1e-9))


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two xywh boxes; 0 where the union is not positive."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    iw = F.greatest(d(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    ih = F.greatest(d(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = iw * ih
    union = aw * ah + bw * bh - inter
    any_null = ax.isNull() | bx.isNull()
    return F.when(any_null, F.lit(None).cast("double")).when(union <= 0, d(0)).otherwise(inter / union)


def iou_xyxy(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """IoU of corner boxes; sides are clamped at 0."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b

    def side(lo: Column, hi: Column) -> Column:
        return F.greatest(d(0), hi - lo)

    inter = side(F.greatest(ax1, bx1), F.least(ax2, bx2)) * side(F.greatest(ay1, by1), F.least(ay2, by2))
    union = side(ax1, ax2) * side(ay1, ay2) + side(bx1, bx2) * side(by1, by2) - inter
    return F.when(union <= 0, d(0)).otherwise(inter / union)


def center_error(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.hypot(
        center_x(a[0], a[2]) - center_x(b[0], b[2]),
        center_y(a[1], a[3]) - center_y(b[1], b[3]),
    )


def valid_box(x: Column, y: Column, w: Column, h: Column, min_wh: float = 2.0) -> Column:
    ok = finite(x) & finite(y) & finite(w) & finite(h)
    return F.coalesce(ok & (w >= d(min_wh)) & (h >= d(min_wh)), F.lit(False))


def observed(x: Column, y: Column, w: Column, h: Column) -> Column:
    ok = finite(x) & finite(y) & finite(w) & finite(h)
    return F.coalesce(ok & (w > 0) & (h > 0), F.lit(False))


def prediction_confidence(*sources: Column) -> Column:
    """First non-null source; anything not finite counts as minus infinity."""
    return finite_or(F.coalesce(*sources), NEG_INF)


def to_center_form(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return center_x(x, w), center_y(y, h), w, h


def from_center_form(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    w1, h1 = F.greatest(w, d(1)), F.greatest(h, d(1))
    return cx - w1 / d(2), cy - h1 / d(2), w1, h1


def circularity(area_: Column, perimeter: Column) -> Column:
    return F.when(perimeter <= 0, d(0)).otherwise(d(4 * math.pi) * area_ / (perimeter * perimeter))


# The shape tables list this value a second time under the name compactness.
compactness = circularity


def equivalent_diameter(area_: Column) -> Column:
    return F.sqrt(d(4) * area_ / d(math.pi))


def unit_clip(c: Column) -> Column:
    return F.least(F.greatest(c, d(0)), d(1))


def expand_box(
    x: Column, y: Column, w: Column, h: Column, pad: float, img_w: Column, img_h: Column
) -> tuple[Column, Column, Column, Column]:
    """Pad every side by ``pad`` of the box and clip to the image."""
    p = max(0.0, float(pad))
    nw, nh = w * d(1 + 2 * p), h * d(1 + 2 * p)
    x0 = F.greatest(d(0), center_x(x, w) - nw / d(2))
    y0 = F.greatest(d(0), center_y(y, h) - nh / d(2))
    return x0, y0, F.least(nw, img_w - x0), F.least(nh, img_h - y0)


def choose_roi(gt_box: Column, seg_box: Column, pred_box: Column, pad: float, img_w: float, img_h: float) -> Column:
    """Padded region of the first box that exists (annotation mask, segmentation, prediction), else the whole image.

    Boxes are structs x, y, w, h; a region of at most one pixel becomes the whole image too.
    """
    whole = F.struct(*[d(v).alias(n) for n, v in zip("xywh", (0.0, 0.0, img_w, img_h))])
    b = F.coalesce(gt_box, seg_box, pred_box, whole)
    x, y, w, h = expand_box(b["x"], b["y"], b["w"], b["h"], pad, d(img_w), d(img_h))
    roi = F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    return F.when((w <= 1) | (h <= 1), whole).otherwise(roi)


def project_to_roi(box: Sequence[Column], roi: Column) -> Column:
    """Corners of a box inside a region, clipped to it; null when less than a pixel is left."""
    x, y, w, h = box

    def clip(v: Column, size: Column) -> Column:
        return F.greatest(d(0), F.least(v, size - d(1)))

    x0, x1 = clip(x - roi["x"], roi["w"]), clip(x - roi["x"] + w, roi["w"])
    y0, y1 = clip(y - roi["y"], roi["h"]), clip(y - roi["y"] + h, roi["h"])
    ok = (x1 - x0 >= 1) & (y1 - y0 >= 1) & (roi["w"] > 1) & (roi["h"] > 1)
    return F.when(ok, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


# Other names of the weight sources.
WEIGHT_NAMES = {
    "score": "detection_score",
    "det_score": "detection_score",
    "detector_score": "detection_score",
    "conf": "confidence",
    "iou": "iou_pred",
    "iou_predicted": "iou_pred",
}


def sample_weight(source: str) -> Column:
    """Weight of a frame (columns score, confidence, components, seg_score) by source, with fall-backs, never negative."""
    name = (source or "").strip().lower()
    name = WEIGHT_NAMES.get(name, name)
    comp = F.col("components")
    own = {
        "iou_pred": [comp["iou_pred"], comp["iou"], comp["pred_iou"], F.col("seg_score")],
        "confidence": [F.col("confidence")],
    }.get(name, [F.col("score")])
    return F.greatest(d(0), F.coalesce(*own, F.col("score"), F.col("confidence"), d(0)))


def track_value(c: Column) -> Column:
    """Track coordinates are stored to three decimals."""
    return F.round(c, 3)
