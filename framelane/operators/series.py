"""Channel time series of trajectories: fill every frame, smooth, derive, resample to a fixed number of steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelane.functions import geometry as G
from framelane.operators.interpolate import at, fill, pieces
from framelane.operators.ordered import BLOCK, SPAN, apart, is_short, neighbours, scan, short_at_once, total
from framelane.operators.ranked import percentiles_of
from framelane.operators.smooth import savgol, two_scale_hampel
from framelane.session import cut

FRAME = "frame_index"
HAMPEL = ("cx", "cy", "circularity", "eq_diam")
SMOOTH = ("cx", "cy", "area", "circularity", "eq_diam")
TEXTURE = ("glcm_contrast", "glcm_homogeneity", "gray_mean")


def base_channels(df: DataFrame, key: Sequence[str], fall_back: bool = False) -> DataFrame:
    """Channels at the observed frames. Missing mask values are 0, or with ``fall_back`` those of the box."""
    w, h = F.col("w"), F.col("h")
    area, per, eq = (F.coalesce(c, F.lit(0.0)) for c in ("area", "perimeter", "eq_diam"))
    if fall_back:
        bw, bh = F.greatest(w, F.lit(0.0)), F.greatest(h, F.lit(0.0))
        area = F.when(area <= 0, bw * bh).otherwise(area)
        per = F.when(per <= 0, (bw + bh) * 2).otherwise(per)
        eq = F.when(eq <= 0, G.equivalent_diameter(area)).otherwise(eq)
    return df.select(
        *key, FRAME, "cx", "cy", "w", "h",
        (w * h).alias("box_area"), area.alias("area"), G.circularity(area, per).alias("circularity"), eq.alias("eq_diam"),
        G.aspect(w, h).alias("flatness"),
        *[c for c in TEXTURE if c in df.columns],
    )


def _frames_to(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Frames 0 .. last of each key, made block by block."""
    ends = df.groupBy(*key).agg(F.max(FRAME).alias("_b"))
    cells = ends.withColumn(BLOCK, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_b") / SPAN))))
    lo = (F.col(BLOCK) * SPAN).cast("int")
    hi = F.least(F.col("_b"), (F.col(BLOCK) * SPAN + (SPAN - 1)).cast("int"))
    return cells.select(*key, F.explode(F.sequence(lo, hi)).alias(FRAME))


def _every_frame(rows: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Short trajectories at frames 0 .. last: each row makes the frames up to the next one from its piece, the first one those before it too.

    Equals :func:`framelane.operators.interpolate.fill` of the dense table, but nothing dense is shuffled.
    """
    steps = [total("_knots", F.count(F.lit(1)))]
    for v in values:
        steps += [total(f"_lo_{v}", F.min(v), F.min), total(f"_hi_{v}", F.max(v), F.max)]
    out = scan(pieces(rows, key, values), key, FRAME, *steps)
    first = F.lag(FRAME).over(Window.partitionBy(*key).orderBy(FRAME)).isNull()
    start = F.when(first, F.lit(0)).otherwise(F.col(FRAME)).cast("int")
    stop = F.coalesce(F.col("piece.t1").cast("int") - 1, F.col(FRAME)).cast("int")
    out = out.withColumns({"_start": start, "_stop": stop}).withColumn("_t", F.explode(F.sequence("_start", "_stop")))
    own = F.col("_t") == F.col(FRAME)

    def value(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        between = F.least(F.greatest(at(F.col("piece"), c, F.col("_t")), lo), hi)
        return F.when(own, F.col(c)).when(F.col("_knots") == 1, lo).otherwise(between).alias(c)

    return out.select(*key, F.col("_t").alias(FRAME), *[value(c) for c in values])


def _once(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Written once, unless short trajectories let all steps share one shuffle by key."""
    return df if is_short(key) else cut(df)


def timeline(
    df: DataFrame,
    key: Sequence[str],
    fall_back: bool = False,
    hampel: Sequence[str] = HAMPEL,
    smooth: Sequence[str] = SMOOTH,
    kind: str = "pchip",
) -> DataFrame:
    """Every frame from 0 to the last one with all base channels and the speed of the smoothed centre.

    ``hampel`` channels lose outliers before filling, ``smooth`` channels are smoothed after it.
    """
    rows = base_channels(df, key, fall_back)
    if hampel:
        clean = two_scale_hampel(rows, key, list(hampel), micro_half=3)
        rows = clean.select(*[F.col(f"{c}_clean").alias(c) if c in hampel else F.col(c) for c in rows.columns])
    rows = cut(rows.withColumn("_k", F.lit(True)))
    values = [c for c in rows.columns if c not in (*key, FRAME, "_k")]
    if is_short(key) and kind == "pchip":
        full = _every_frame(rows, key, values)
    else:
        # written once: filling reads it several times, and a join with exploded frames must not be a broadcast of them
        dense = cut(_frames_to(rows, key).join(apart(rows), [*key, FRAME], "left"))
        full = cut(fill(dense, key, values, F.col("_k"), kind=kind).drop("_k", "knots"))
    if smooth:
        full = savgol(full, key, list(smooth))
    out = neighbours(full, key, FRAME, ["cx", "cy"], back=1)
    speed = F.hypot(F.col("cx") - F.col("cx_lag1"), F.col("cy") - F.col("cy_lag1"))
    return out.withColumn("speed", F.coalesce(speed, F.lit(0.0))).drop("cx_lag1", "cy_lag1")


def derived_channels(full: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Sixteen channels: centre as displacement from its median, plus acceleration, heading, area change, radius, bend.

    Columns named in ``keep`` go along.
    """
    full = _once(full, key)
    rows = neighbours(full, key, FRAME, ["cx", "cy", "speed", "box_area"], back=2)
    if is_short(key):
        whole = Window.partitionBy(*key)
        given = {m: F.when(~F.isnan(c), F.col(c)) for m, c in (("_mx", "cx"), ("_my", "cy"))}
        rows = rows.withColumns({m: F.percentile(c, F.lit(0.5)).over(whole) for m, c in given.items()})
    else:
        rows = rows.join(percentiles_of(full, key, {"cx": {"_mx": 0.5}, "cy": {"_my": 0.5}}), list(key))
    vx, vy = F.col("cx") - F.col("cx_lag1"), F.col("cy") - F.col("cy_lag1")
    ux, uy = F.col("cx_lag1") - F.col("cx_lag2"), F.col("cy_lag1") - F.col("cy_lag2")
    mag = F.hypot(vx, vy)
    zero = F.lit(0.0)

    def z(c: Column) -> Column:
        return F.coalesce(c, zero)

    dx, dy = F.col("cx") - F.col("_mx"), F.col("cy") - F.col("_my")
    long_enough = F.col("_n") > 2
    rows = scan(rows, key, FRAME, total("_n", F.count(F.lit(1))))
    return rows.select(
        *key, FRAME,
        dx.alias("dx"), dy.alias("dy"), "w", "h", "box_area", "area", "circularity", "eq_diam", "speed", "flatness",
        F.when(long_enough, z(F.abs(F.col("speed") - F.col("speed_lag1")))).otherwise(zero).alias("accel"),
        z(vy / (mag + 1e-12)).alias("heading_sin"),
        z(vx / (mag + 1e-12)).alias("heading_cos"),
        z(F.col("box_area") - F.col("box_area_lag1")).alias("d_area"),
        F.hypot(dx, dy).alias("radial"),
        z(F.abs(ux * vy - uy * vx) / (F.hypot(ux, uy) * mag + 1e-12)).alias("bend"),
        *keep,
    )


def resample(full: DataFrame, key: Sequence[str], channels: Sequence[str], steps: int = 256) -> DataFrame:
    """Long table (key, channel, step, value) at ``steps`` evenly spaced frames, rounded half to even."""
    top = steps - 1
    if is_short(key):
        rows = full.withColumn("_t", F.max(FRAME).over(Window.partitionBy(*key)))
    else:
        rows = full.join(full.groupBy(*key).agg(F.max(FRAME).alias("_t")), list(key))
    # A frame names the steps that fall on it: the few about its share of the way, all of them on a single frame.
    gap = F.col("_t").cast("double") / F.lit(float(max(1, top)))
    one = F.col("_t") == 0
    wide = F.when(~one, gap)
    lo = F.when(one, 0).otherwise(F.greatest(F.lit(0), F.floor((F.col(FRAME) - 0.5) / wide).cast("int") - 1))
    hi = F.when(one, top).otherwise(F.least(F.lit(top), F.ceil((F.col(FRAME) + 0.5) / wide).cast("int") + 1))
    near = F.when(lo <= hi, F.sequence(lo, hi))
    mine = F.filter(near, lambda s: F.least(F.bround(s * gap).cast("int"), F.col("_t")) == F.col(FRAME))
    got = rows.where(F.col(FRAME).between(0, F.col("_t"))).withColumn("step", F.explode(mine))
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), G.finite_or(F.col(c), 0.0).alias("value")) for c in channels])
    return got.select(*key, "step", F.inline(pairs))


def resample_centers(df: DataFrame, key: Sequence[str], steps: int, scale: float = 1.0) -> DataFrame:
    """Centres (cx, cy) at ``steps`` even times by PCHIP, and the step displacements with a leading 0, times ``scale``.

    A piece knows its interval, so it emits the query times that fall into it.
    """
    rows = cut(df.select(*key, FRAME, "cx", "cy"))
    ends = rows.groupBy(*key).agg(F.min(FRAME).alias("_a"), F.max(FRAME).alias("_b"))
    p = pieces(rows, key, ["cx", "cy"]).join(ends, list(key))
    gap = (F.col("_b") - F.col("_a")).cast("double") / float(max(1, steps - 1))
    one = F.col("_a") == F.col("_b")
    t0, t1 = F.col("piece.t0"), F.col("piece.t1")
    lo = F.ceil((t0 - F.col("_a")) / gap - 1e-9)
    hi = F.when(t1 >= F.col("_b"), F.lit(steps - 1)).otherwise(F.ceil((t1 - F.col("_a")) / gap - 1e-9) - 1)
    idx = F.when(one, F.sequence(F.lit(0), F.lit(steps - 1))).when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int")))
    q = p.where(one | F.col("piece").isNotNull()).withColumn("step", F.explode(idx))
    t = F.col("_a") + F.col("step") * gap
    q = q.select(
        *key, "step", *[F.when(one, F.col(c)).otherwise(at(F.col("piece"), c, t)).alias(c) for c in ("cx", "cy")]
    )
    out = neighbours(q, key, "step", ["cx", "cy"], back=1)
    return out.select(
        *key, "step", "cx", "cy",
        *[(F.coalesce(F.col(c) - F.col(f"{c}_lag1"), F.lit(0.0)) * scale).alias(d) for c, d in (("cx", "dx"), ("cy", "dy"))],
    )


# Channel sets: (base options, channels) of the three series variants.
GEOMETRY_SERIES = ("cx", "cy", "w", "h", "box_area", "area", "circularity", "eq_diam", "speed", "flatness")
DERIVED_SERIES = (
    "dx", "dy", "w", "h", "box_area", "area", "circularity", "eq_diam", "speed", "flatness", "accel", "heading_sin",
    "heading_cos", "d_area", "radial", "bend",
)
BOX_SERIES = ("area", "eq_diam", "circularity", "flatness", "speed", "accel", "dx", "dy", "heading_sin", "heading_cos")
LITE_SERIES = ("speed", "accel", "dx", "dy", "heading_sin", "heading_cos", "area", "eq_diam", "flatness")
ALL_SIX = ("cx", "cy", "area", "eq_diam", "circularity", "flatness")
LITE_FOUR = ("cx", "cy", "area", "eq_diam")


@short_at_once(from_zero=True)
def geometry_series(df: DataFrame, key: Sequence[str], steps: int = 256) -> DataFrame:
    return resample(_once(timeline(df, key), key), key, GEOMETRY_SERIES, steps)


@short_at_once(from_zero=True)
def derived_series(df: DataFrame, key: Sequence[str], steps: int = 256) -> DataFrame:
    return resample(_once(derived_channels(timeline(df, key), key), key), key, DERIVED_SERIES, steps)


@short_at_once(from_zero=True)
def box_series(df: DataFrame, key: Sequence[str], steps: int = 256) -> DataFrame:
    """Ten channels; frames without mask values take them from the box."""
    full = timeline(df, key, True, ALL_SIX, ALL_SIX)
    return resample(_once(derived_channels(full, key), key), key, BOX_SERIES, steps)


@short_at_once(from_zero=True)
def lite_series(df: DataFrame, key: Sequence[str], steps: int = 256) -> DataFrame:
    """Nine channels, and the texture columns among ``glcm_contrast, glcm_homogeneity, gray_mean`` that are given."""
    tex = [c for c in TEXTURE if c in df.columns]
    full = timeline(df, key, False, [*LITE_FOUR, *tex], [*LITE_FOUR, *tex])
    return resample(_once(derived_channels(full, key, tex), key), key, [*LITE_SERIES, *tex], steps)
