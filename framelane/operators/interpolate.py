"""Gap filling: shape-preserving cubic (PCHIP), linear and hold, on whole trajectories or chosen frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane.functions import geometry as G
from framelane.operators import dedup
from framelane.operators.ordered import neighbours, next_known, previous_known, scan, total
from framelane.session import cut

BOX = ("x", "y", "w", "h")


def _sign(c: Column) -> Column:
    return F.signum(c)


def _inner_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """Weighted harmonic mean of the secants; 0 at a local extreme."""
    a, b = h1 * 2 + h0, h1 + h0 * 2
    flat = (_sign(m0) != _sign(m1)) | (m0 == 0) | (m1 == 0)
    return F.when(flat, F.lit(0.0)).otherwise((a + b) / (a / m0 + b / m1))


def _end_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """One-sided three-point slope, limited so that the end interval keeps its shape."""
    s = ((h0 * 2 + h1) * m0 - h0 * m1) / (h0 + h1)
    return (
        F.when(_sign(s) != _sign(m0), F.lit(0.0))
        .when((_sign(m0) != _sign(m1)) & (F.abs(s) > F.abs(m0) * 3), m0 * 3)
        .otherwise(s)
    )


def pieces(
    knots: DataFrame, key: Sequence[str], values: Sequence[str], order: str = "frame_index", kind: str = "pchip"
) -> DataFrame:
    """Attach to each knot the polynomial of the interval that starts there (null at the last knot).

    A slope needs one knot on either side, so the knot before and the two after
    are all a piece ever looks at.
    """
    out = neighbours(knots, key, order, [order, *values], back=1, ahead=2)
    t = F.col(order).cast("double")
    # Staged projections: secants, slopes, coefficients. Each is used several times in the next stage.
    secants = {
        "_hp": t - F.col(f"{order}_lag1"),
        "_h0": F.col(f"{order}_lead1") - t,
        "_h1": F.col(f"{order}_lead2") - F.col(f"{order}_lead1"),
    }
    out = out.withColumns({n: c.cast("double") for n, c in secants.items()})
    hp, h0, h1 = F.col("_hp"), F.col("_h0"), F.col("_h1")
    out = out.withColumns(
        {
            n: c
            for v in values
            for n, c in (
                (f"_a_{v}", (F.col(v) - F.col(f"{v}_lag1")) / hp),
                (f"_m_{v}", (F.col(f"{v}_lead1") - F.col(v)) / h0),
                (f"_z_{v}", (F.col(f"{v}_lead2") - F.col(f"{v}_lead1")) / h1),
            )
        }
    )
    if kind not in ("pchip", "linear"):
        raise ValueError(f"unknown kind of piece {kind!r}")
    coef = []
    if kind == "linear":
        zero = F.lit(0.0)
        for v in values:
            coef += [F.col(v).alias(f"{v}_y"), F.col(f"_m_{v}").alias(f"{v}_d"), zero.alias(f"{v}_c"), zero.alias(f"{v}_b")]
    else:
        slopes = {}
        for v in values:
            m_prev, m, m_next = F.col(f"_a_{v}"), F.col(f"_m_{v}"), F.col(f"_z_{v}")
            slopes[f"_l_{v}"] = (
                F.when(hp.isNotNull(), _inner_slope(hp, h0, m_prev, m))
                .when(h1.isNotNull(), _end_slope(h0, h1, m, m_next))
                .otherwise(m)
            )
            slopes[f"_r_{v}"] = (
                F.when(h1.isNotNull(), _inner_slope(h0, h1, m, m_next))
                .when(hp.isNotNull(), _end_slope(h0, hp, m, m_prev))
                .otherwise(m)
            )
        out = out.withColumns(slopes)
        for v in values:
            m, left = F.col(f"_m_{v}"), F.col(f"_l_{v}")
            bend = (left + F.col(f"_r_{v}") - m * 2) / h0
            coef += [
                F.col(v).alias(f"{v}_y"),
                left.alias(f"{v}_d"),
                ((m - left) / h0 - bend).alias(f"{v}_c"),
                (bend / h0).alias(f"{v}_b"),
            ]
    piece = F.struct(t.alias("t0"), (t + h0).alias("t1"), *coef)
    return out.select(*knots.columns, F.when(h0.isNotNull(), piece).alias("piece"))


def at(piece: Column, v: str, t: Column) -> Column:
    s = t.cast("double") - piece["t0"]
    return ((piece[f"{v}_b"] * s + piece[f"{v}_c"]) * s + piece[f"{v}_d"]) * s + piece[f"{v}_y"]


def fill(
    rows: DataFrame,
    key: Sequence[str],
    values: Sequence[str],
    known: Column,
    order: str = "frame_index",
    kind: str = "pchip",
) -> DataFrame:
    """Replace ``values`` on rows that are not ``known``; adds ``knots`` (known rows of the key).

    Outside the knots the end piece goes on (``linear``: stays flat) and is
    clipped to the range of the knots. One knot: constant. No knot: 0.
    """
    if kind == "cubic":
        from framelane.operators.reconstruct import cubic_fill

        return cubic_fill(rows, key, values, known, order, count="knots")
    flagged = rows.withColumn("_k", F.coalesce(known, F.lit(False)))
    knots = pieces(flagged.where("_k"), key, values, order, kind)
    rest = flagged.where(~F.col("_k"))
    both = knots.unionByName(rest, allowMissingColumns=True)
    steps = [
        previous_known("_before", F.col("piece"), order, True),
        next_known("_after", F.col("piece"), order),
        total("knots", F.count_if("_k")),
    ]
    for v in values:
        v_known = F.when(F.col("_k"), F.col(v))
        steps += [total(f"_lo_{v}", F.min(v_known), F.min), total(f"_hi_{v}", F.max(v_known), F.max)]
    out = scan(both, key, order, *steps)
    piece = F.coalesce("_before", "_after")
    new = []
    for c in rows.columns:
        if c not in values:
            new.append(F.col(c))
            continue
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        inside = F.least(F.greatest(at(piece, c, F.col(order)), lo), hi)
        if kind == "linear":
            # flat before the first knot: the piece starts after the row
            inside = F.when(F.col("_before").isNull(), piece[f"{c}_y"]).otherwise(
                at(piece, c, F.least(F.col(order).cast("double"), piece["t1"]))
            )
        filled = F.when(F.col("knots") == 0, F.lit(0.0)).when(F.col("knots") == 1, lo).otherwise(inside)
        new.append(F.when(F.col("_k"), F.col(c)).otherwise(filled).alias(c))
    return out.select(*new, "knots")


def fill_nulls(
    df: DataFrame, key: Sequence[str], value: str, order: str = "frame_index", kind: str = "pchip"
) -> DataFrame:
    """Fill the nulls (or NaNs) of one column."""
    return fill(df, key, [value], G.finite(F.col(value)), order, kind).drop("knots")


def fill_gaps(
    preds: DataFrame,
    key: Sequence[str],
    max_gap: int = 30,
    source: str = "interpolated_pchip",
    kind: str = "pchip",
) -> DataFrame:
    """Add rows for the frames inside gaps of at most ``max_gap`` frames.

    A piece knows the gap that follows its knot, so filling is a flat map over
    knots. Inside an interval PCHIP stays between its two knots, hence within
    the range of all knots. Output: key, frame, box, score, is_fallback, bbox_source.
    """
    limit = max(2, int(max_gap))
    clean = dedup.detector_first(preds, [*key, "frame_index"])
    if "bbox_source" not in clean.columns:
        clean = clean.withColumn("bbox_source", F.lit("detector"))
    # knots, their neighbours and the result all read this one table
    kept = cut(clean.select(*key, "frame_index", *BOX, "score", "is_fallback", "bbox_source"))
    p = F.col("piece")
    gap = p["t1"] - p["t0"]
    new = pieces(kept, key, BOX, kind=kind).where((gap > 1) & (gap <= limit))
    new = new.select(
        *key, "piece", F.explode(F.sequence(F.col("frame_index") + 1, p["t1"].cast("int") - 1)).alias("frame_index")
    )
    new = new.select(
        *key,
        "frame_index",
        *[at(p, v, F.col("frame_index")).alias(v) for v in BOX],
        F.lit(None).cast("double").alias("score"),
        F.lit(True).alias("is_fallback"),
        F.lit(source).alias("bbox_source"),
    )
    return kept.unionByName(new)


def repair(
    preds: DataFrame,
    queries: DataFrame | None,
    key: Sequence[str],
    confidence_threshold: float = 0.5,
    min_known: int = 3,
    min_wh: float = 2.0,
    source: str = "interpolated_pchip",
    missing_source: str = "missing",
) -> DataFrame:
    """One row per query frame: trusted detection, else interpolated box, else a zero box tagged missing.

    ``queries`` (key + frame_index) defaults to the frames that have a prediction.
    """
    on = [*key, "frame_index"]
    best = dedup.most_confident(preds, on, min_wh=min_wh)
    if "bbox_source" not in best.columns:
        best = best.withColumn("bbox_source", F.lit("detector"))
    conf = G.prediction_confidence(*[F.col(c) for c in ("confidence", "score") if c in best.columns])
    trusted = (
        G.valid_box(*[F.col(c) for c in BOX], min_wh)
        & ~F.coalesce("is_fallback", F.lit(False))
        & (conf >= confidence_threshold)
    )
    best = best.select(*on, *BOX, "score", "bbox_source", trusted.alias("anchor"))
    if queries is None:
        rows = best.withColumn("asked", F.lit(True))
    else:
        q = queries.select(*on).distinct().withColumn("asked", F.lit(True))
        rows = best.join(q, on, "full_outer")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("anchor", "asked")})
    rows = cut(rows.where(F.col("anchor") | F.col("asked")))
    out = fill(rows, key, BOX, F.col("anchor")).where("asked")
    ok = G.valid_box(*[F.col(c) for c in BOX], min_wh)
    usable = (F.col("knots") >= max(1, int(min_known))) & ok
    return out.select(
        *on,
        *[F.when(F.col("anchor") | usable, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in BOX],
        "score",
        (~F.col("anchor")).alias("is_fallback"),
        F.when(F.col("anchor"), F.col("bbox_source"))
        .when(usable, F.lit(source))
        .otherwise(F.lit(missing_source))
        .alias("bbox_source"),
    )


def ground_truth_trajectory(gt: DataFrame, queries: DataFrame, key: Sequence[str]) -> DataFrame:
    """Annotations as anchors, every query frame filled."""
    rows = gt.withColumns({"score": F.lit(1.0), "is_fallback": F.lit(False), "bbox_source": F.lit("ground_truth")})
    return repair(
        rows, queries, key, 0.0, 3, 1e-6, "ground_truth_interpolated_pchip", "ground_truth_missing"
    )


def bracket(rows: DataFrame, key: Sequence[str], known: Column, max_gap: int, order: str = "frame_index") -> DataFrame:
    """As-of view of the unknown rows: nearest known order before and after, and whether the gap may be filled."""
    at_known = F.when(known, F.col(order))
    out = scan(
        rows, key, order,
        previous_known("left_known", at_known, order), next_known("right_known", at_known, order),
    )
    gap = F.col("right_known") - F.col("left_known")
    return out.where(~F.coalesce(known, F.lit(False))).withColumn(
        "fillable", F.coalesce(gap <= max(2, max_gap), F.lit(False))
    )


def fill_with_backoff(known: DataFrame, queries: DataFrame, key: Sequence[str]) -> DataFrame:
    """Missing query frames: PCHIP from three knots on, linear with two, hold with one; tagged accordingly."""
    on = [*key, "frame_index"]
    k = known.select(*on, *BOX, F.col("score")).withColumn("known", F.lit(True))
    q = queries.select(*on).distinct().withColumn("asked", F.lit(True))
    rows = cut(k.join(q, on, "full_outer").withColumn("known", F.coalesce("known", F.lit(False))))
    # With two knots PCHIP is the straight line, clipped outside; a flat end is the same clip.
    out = fill(rows, key, BOX, F.col("known")).where((F.col("knots") > 0) & (F.col("known") | F.col("asked")))
    return out.select(
        *on,
        *BOX,
        "score",
        (~F.col("known")).alias("is_fallback"),
        F.when(F.col("known"), F.lit("detector"))
        .when(F.col("knots") >= 3, F.lit("interpolated_pchip"))
        .when(F.col("knots") == 2, F.lit("interpolated_linear"))
        .otherwise(F.lit("interpolated_hold"))
        .alias("bbox_source"),
    )
