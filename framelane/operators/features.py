"""Per-trajectory features and their aggregation to subjects.

Input rows: one per (key, frame_index) with the centre ``cx, cy``, the box
``w, h`` and, where a mask exists, ``area, perimeter, eq_diam``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane.functions import geometry as G
from framelane.operators.ordered import neighbours, previous_known, row_position, scan, total
from framelane.operators.ranked import percentiles, percentiles_of
from framelane.session import cut

FRAME = "frame_index"
TINY = 1e-9


def zero(c: Column) -> Column:
    """Empty aggregates count as 0."""
    return F.coalesce(c.cast("double"), F.lit(0.0))


def mean0(c: Column) -> Column:
    return zero(F.avg(c))


def std0(c: Column) -> Column:
    return zero(F.stddev_pop(c))


def max0(c: Column) -> Column:
    return zero(F.max(c))


def first(c: Column) -> Column:
    """First non-null value in frame order."""
    return zero(F.min_by(c, F.when(c.isNotNull(), F.col(FRAME))))


def last(c: Column) -> Column:
    return zero(F.max_by(c, F.when(c.isNotNull(), F.col(FRAME))))


def motion_steps(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Step-wise quantities of each row against the three rows before it; null where a row has too few."""
    out = neighbours(df, key, FRAME, [FRAME, "cx", "cy"], back=3)

    def diff(c: str, j: int) -> Column:
        newer = F.col(c) if j == 0 else F.col(f"{c}_lag{j}")
        return newer - F.col(f"{c}_lag{j + 1}")

    out = out.withColumns({f"_{n}{j}": diff(c, j) for j in (0, 1, 2) for n, c in (("dx", "cx"), ("dy", "cy"), ("dt", FRAME))})
    out = out.withColumns({f"_step{j}": F.hypot(f"_dx{j}", f"_dy{j}") for j in (0, 1, 2)})
    out = out.withColumns({f"_speed{j}": F.col(f"_step{j}") / F.col(f"_dt{j}") for j in (0, 1, 2)})
    acc0, acc1 = (F.abs(F.col(f"_speed{j}") - F.col(f"_speed{j + 1}")) for j in (0, 1))
    turn = F.abs(F.atan2("_dy0", "_dx0") - F.atan2("_dy1", "_dx1"))
    cross = F.abs(F.col("_dx1") * F.col("_dy0") - F.col("_dy1") * F.col("_dx0"))
    slow = F.col("_step1") <= 1.0
    return out.select(
        *df.columns,
        F.col("_dx0").alias("dx"),
        F.col("_dy0").alias("dy"),
        F.col("_dt0").alias("dt"),
        F.col("_step0").alias("step"),
        F.col("_speed0").alias("speed"),
        acc0.alias("acc"),
        F.abs(acc0 - acc1).alias("jerk"),
        F.least(turn, F.lit(2 * math.pi) - turn).alias("turn"),
        F.when(cross.isNotNull(), F.when(slow, F.lit(0.0)).otherwise(cross / (F.pow("_step1", 3) + TINY))).alias("curvature"),
    )


def net_displacement() -> tuple[Column, Column, Column]:
    dx = last(F.col("cx")) - first(F.col("cx"))
    dy = last(F.col("cy")) - first(F.col("cy"))
    return dx, dy, F.hypot(dx, dy)


def motion(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Thirty motion features."""
    rows = neighbours(motion_steps(df.withColumn("_area", F.col("w") * F.col("h")), key), key, FRAME, ["_area"], back=1)
    rows = cut(rows.withColumn("area_step", F.abs(F.col("_area") - F.col("_area_lag1"))))
    dx, dy, net = net_displacement()
    path = zero(F.sum("step"))
    speed, acc, jerk = F.col("speed"), F.col("acc"), F.col("jerk")
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).cast("double").alias("num_points"),
        (F.max(FRAME) - F.min(FRAME)).cast("double").alias("duration_frames"),
        dx.alias("displacement_x"),
        dy.alias("displacement_y"),
        net.alias("net_displacement"),
        (F.max("cx") - F.min("cx")).alias("span_x"),
        (F.max("cy") - F.min("cy")).alias("span_y"),
        path.alias("path_length"),
        (net / F.greatest(path, F.lit(TINY))).alias("straightness_ratio"),
        mean0(speed).alias("mean_speed"),
        max0(speed).alias("max_speed"),
        std0(speed).alias("std_speed"),
        mean0(acc).alias("mean_acc"),
        max0(acc).alias("max_acc"),
        std0(acc).alias("std_acc"),
        mean0(jerk).alias("mean_jerk"),
        max0(jerk).alias("max_jerk"),
        std0(jerk).alias("std_jerk"),
        mean0(F.col("curvature")).alias("curvature_mean"),
        std0(F.col("curvature")).alias("curvature_std"),
        mean0(F.col("turn")).alias("angular_change_mean"),
        std0(F.col("turn")).alias("angular_change_std"),
        mean0(F.col("_area")).alias("area_mean"),
        std0(F.col("_area")).alias("area_std"),
        (F.max("_area") - F.min("_area")).alias("area_range"),
        mean0(F.col("area_step")).alias("area_change_mean"),
        std0(F.col("area_step")).alias("area_change_std"),
    )
    q = percentiles(rows, key, "speed", {"median_speed": 0.5, "p95_speed": 0.95, "p5_speed": 0.05})
    out = out.join(q, list(key), "left")
    return out.withColumns({c: zero(F.col(c)) for c in ("median_speed", "p95_speed", "p5_speed")})


def cross_section(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """First and last mask: area, perimeter, equivalent diameter, circularity."""
    circ = G.circularity(F.col("area"), F.col("perimeter"))
    has = F.col("area").isNotNull()
    cols = {"area": F.col("area"), "perimeter": F.col("perimeter"), "eq_diameter": F.col("eq_diam"), "circularity": circ}
    return df.groupBy(*key).agg(
        *[e for n, c in cols.items() for e in (first(F.when(has, c)).alias(f"csa_first_{n}"), last(F.when(has, c)).alias(f"csa_last_{n}"))]
    )


def _usable(c: Column) -> Column:
    return F.when(F.col("area") > 0, c)


def from_median(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add ``radius``: distance of each centre from the median position of its trajectory."""
    rows = df.join(percentiles_of(df, key, {c: {f"_med_{c}": 0.5} for c in ("cx", "cy")}), list(key))
    r = F.hypot(F.col("cx") - F.col("_med_cx"), F.col("cy") - F.col("_med_cy"))
    return rows.withColumn("radius", r).drop("_med_cx", "_med_cy")


def reference_size() -> Column:
    """First positive equivalent diameter, else the side of the first box."""
    seen = F.min_by("eq_diam", F.when(F.col("eq_diam") > 0, F.col(FRAME)))
    side = F.sqrt(F.greatest(F.min_by(F.col("w") * F.col("h"), FRAME), F.lit(TINY)))
    return F.greatest(F.coalesce(seen, side), F.lit(TINY))


def motion_lite(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Thirteen motion features without absolute positions."""
    rows = cut(motion_steps(df, key))
    rows = from_median(rows, key)
    _, _, net = net_displacement()
    path = zero(F.sum("step"))
    ref = reference_size()
    r = F.col("radius")
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).cast("double").alias("num_points"),
        (F.max(FRAME) - F.min(FRAME)).cast("double").alias("duration_frames"),
        path.alias("path_length"),
        (net / F.greatest(path, F.lit(TINY))).alias("straightness_ratio"),
        mean0(F.col("speed")).alias("mean_speed"),
        std0(F.col("speed")).alias("std_speed"),
        mean0(F.col("acc")).alias("mean_acc"),
        std0(F.col("acc")).alias("std_acc"),
        (F.avg(r) / ref).alias("disp_median_mean"),
        (F.stddev_pop(r) / ref).alias("disp_median_std"),
        (F.max(r) / ref).alias("disp_median_max"),
        mean0(F.col("turn")).alias("mean_heading_change"),
    )
    q = percentiles(rows, key, "speed", {"median_speed": 0.5})
    return out.join(q, list(key), "left").withColumn("median_speed", zero(F.col("median_speed")))


def curve_fit(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Quadratic fit of the centre over row position: residual sum, mean curvature, R2 (0 below three rows).

    On the symmetric grid u = -1..1 odd power sums vanish, so the normal
    equations are solved by hand from sums that reach every row with the scan.
    """
    rows = scan(df, key, FRAME, row_position("_pos"), total("_n", F.count(F.lit(1))))
    u = F.when(F.col("_n") > 1, F.col("_pos") * 2.0 / (F.col("_n") - 1) - 1.0).otherwise(F.lit(0.0))
    rows = cut(rows.withColumn("_u", u).select(*key, FRAME, "cx", "cy", "_u", "_n"))
    u = F.col("_u")
    steps = [total("_s2", F.sum(u * u)), total("_s4", F.sum(u * u * u * u))]
    for c in ("cx", "cy"):
        steps += [total(f"_{c}{i}", F.sum(F.col(c) * F.pow(u, i))) for i in (0, 1, 2)]
    rows = scan(rows, key, FRAME, *steps)
    n, s2, s4 = F.col("_n"), F.col("_s2"), F.col("_s4")
    for c in ("cx", "cy"):
        quad = (n * F.col(f"_{c}2") - s2 * F.col(f"_{c}0")) / (n * s4 - s2 * s2)
        rows = rows.withColumn(f"_q_{c}", quad)
        rows = rows.withColumns({f"_l_{c}": F.col(f"_{c}1") / s2, f"_a_{c}": (F.col(f"_{c}0") - s2 * F.col(f"_q_{c}")) / n})
        rows = rows.withColumns(
            {
                f"_e_{c}": F.col(c) - (F.col(f"_a_{c}") + F.col(f"_l_{c}") * u + F.col(f"_q_{c}") * u * u),
                # derivatives by t in 0..1, u = 2t - 1
                f"_d_{c}": (F.col(f"_l_{c}") + F.col(f"_q_{c}") * u * 2) * 2,
                f"_dd_{c}": F.col(f"_q_{c}") * 8,
                f"_m_{c}": F.col(c) - F.col(f"_{c}0") / n,
            }
        )
    sq = F.pow("_e_cx", 2) + F.pow("_e_cy", 2)
    bend = F.abs(F.col("_d_cx") * F.col("_dd_cy") - F.col("_d_cy") * F.col("_dd_cx"))
    flow = F.pow(F.pow("_d_cx", 2) + F.pow("_d_cy", 2), 1.5) + TINY
    sst = F.sum(F.pow("_m_cx", 2) + F.pow("_m_cy", 2))
    some = F.max("_n") >= 3
    return rows.groupBy(*key).agg(
        F.when(some, F.sum(F.sqrt(sq))).otherwise(0.0).alias("curve_amplitude"),
        F.when(some, F.avg(bend / flow)).otherwise(0.0).alias("curve_curvature"),
        F.when(some & (sst > TINY), F.lit(1.0) - F.sum(sq) / (sst + TINY)).otherwise(0.0).alias("curve_fit_r2"),
    )


def motion_curve(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Fifteen motion features: the lite family with a quadratic fit."""
    lite = motion_lite(df, key)
    turns = motion_steps(df, key).groupBy(*key).agg(std0(F.col("turn")).alias("heading_change_std"))
    names = {
        "duration_frames": "duration",
        "path_length": "path_length",
        "straightness_ratio": "straightness",
        "mean_speed": "speed_mean",
        "std_speed": "speed_std",
        "mean_acc": "acc_mean",
        "std_acc": "acc_std",
        "disp_median_mean": "disp_mean",
        "disp_median_std": "disp_std",
        "disp_median_max": "disp_max",
        "mean_heading_change": "heading_change_mean",
    }
    out = lite.select(*key, *[F.col(a).alias(b) for a, b in names.items()])
    return finite_features(out.join(turns, list(key)).join(curve_fit(df, key), list(key)), key)


def static_lite(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Ten shape features relative to the first mask."""
    a, e = _usable(F.col("area")), _usable(F.col("eq_diam"))
    circ = _usable(G.circularity(F.col("area"), F.col("perimeter")))
    asp = G.aspect(F.col("w"), F.col("h"))
    a0, e0 = F.greatest(first(a), F.lit(TINY)), F.greatest(first(e), F.lit(TINY))
    return df.groupBy(*key).agg(
        mean0(a).alias("csa_mean"),
        std0(a).alias("csa_std"),
        zero((F.max(a) - F.min(a)) / a0).alias("csa_strain"),
        zero(F.max(a) / a0).alias("swelling_ratio"),
        mean0(e).alias("eq_diam_mean"),
        zero((F.max(e) - F.min(e)) / e0).alias("eq_diam_strain"),
        mean0(circ).alias("circularity_mean"),
        std0(circ).alias("circularity_std"),
        mean0(asp).alias("aspect_ratio_mean"),
        std0(asp).alias("aspect_ratio_std"),
    )


def geometry(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean and spread of area, equivalent diameter, circularity and aspect (after any unit scaling)."""
    cols = {
        "csa": _usable(F.col("area")),
        "eq_diam": _usable(F.col("eq_diam")),
        "circularity": _usable(G.circularity(F.col("area"), F.col("perimeter"))),
        "aspect_ratio": G.aspect(F.col("w"), F.col("h")),
    }
    out = df.groupBy(*key).agg(
        *[e for n, c in cols.items() for e in (mean0(c).alias(f"{n}_mean"), std0(c).alias(f"{n}_std"))]
    )
    return finite_features(out, key)


def static(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Thirty-five shape and displacement features. Echo columns (``echo_mean``, ``echo_std``) are optional."""
    rows = neighbours(df, key, FRAME, ["cx", "cy"], back=1)
    rows = rows.withColumn("step", F.hypot(F.col("cx") - F.col("cx_lag1"), F.col("cy") - F.col("cy_lag1")))
    a, e = _usable(F.col("area")), _usable(F.col("eq_diam"))
    circ = _usable(G.circularity(F.col("area"), F.col("perimeter")))
    comp = _usable(G.compactness(F.col("area"), F.col("perimeter")))
    flat = G.aspect(F.col("w"), F.col("h"))
    _, _, net = net_displacement()
    echo = "echo_mean" in df.columns
    em, es = (F.col("echo_mean"), F.col("echo_std")) if echo else (F.lit(None).cast("double"),) * 2
    return rows.groupBy(*key).agg(
        zero(F.min(a)).alias("cts_csa_min"),
        max0(a).alias("cts_csa_max"),
        mean0(a).alias("cts_csa_mean"),
        std0(a).alias("cts_csa_std"),
        zero(F.max(a) - F.min(a)).alias("cts_csa_range"),
        zero(F.stddev_pop(a) / (F.avg(a) + TINY)).alias("cts_csa_cv"),
        first(a).alias("cts_csa_first"),
        last(a).alias("cts_csa_last"),
        zero(F.max(a) / (F.min(a) + TINY)).alias("cts_swelling_ratio"),
        mean0(flat).alias("cts_flat_mean"),
        std0(flat).alias("cts_flat_std"),
        max0(flat).alias("cts_flat_max"),
        zero(F.min(flat)).alias("cts_flat_min"),
        first(circ).alias("cts_circularity_first"),
        last(circ).alias("cts_circularity_last"),
        mean0(circ).alias("cts_circularity_mean"),
        std0(circ).alias("cts_circularity_std"),
        mean0(e).alias("cts_eq_diam_mean"),
        std0(e).alias("cts_eq_diam_std"),
        first(e).alias("cts_eq_diam_first"),
        last(e).alias("cts_eq_diam_last"),
        mean0(comp).alias("cts_compact_mean"),
        std0(comp).alias("cts_compact_std"),
        first(em).alias("cts_echo_mean_first"),
        first(es).alias("cts_echo_std_first"),
        last(em).alias("cts_echo_mean_last"),
        last(es).alias("cts_echo_std_last"),
        (last(em) - first(em)).alias("cts_echo_delta"),
        net.alias("cts_nerve_net_disp"),
        zero(F.sum("step")).alias("cts_nerve_path_len"),
        std0(F.col("cx")).alias("cts_nerve_stability_x"),
        std0(F.col("cy")).alias("cts_nerve_stability_y"),
        first(flat).alias("cts_aspect_first"),
        last(flat).alias("cts_aspect_last"),
    )


def static_extra(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Twenty-four more shape features: quartiles, skew and kurtosis, gradients, radial spread, path efficiency."""
    circ = _usable(G.circularity(F.col("area"), F.col("perimeter")))
    rows = motion_steps(
        df.withColumns({"_csa": _usable(F.col("area")), "_circ": circ, "_eq": _usable(F.col("eq_diam")),
                        "_flat": G.aspect(F.col("w"), F.col("h"))}),
        key,
    )
    # gradients follow usable masks only, so they look back to the last one
    rows = scan(rows, key, FRAME, previous_known("_pc", F.col("_csa"), FRAME), previous_known("_pf", F.col("_flat"), FRAME))
    rows = cut(rows)
    rows = from_median(rows, key)
    a, r = F.col("_csa"), F.col("radius")
    _, _, net = net_displacement()
    path = zero(F.sum("step"))
    enough3 = F.count(a) >= 3
    flat3 = F.count("_flat") >= 3
    spread = F.stddev_pop(a) >= 1e-12
    grad, fgrad = a - F.col("_pc"), F.col("_flat") - F.col("_pf")
    out = rows.groupBy(*key).agg(
        F.count(a).alias("_na"),
        F.count("_flat").alias("_nf"),
        F.when(enough3 & spread, F.skewness(a)).otherwise(0.0).alias("cts_csa_skew"),
        F.when((F.count(a) >= 4) & spread, F.kurtosis(a)).otherwise(0.0).alias("cts_csa_kurt"),
        F.when(enough3, F.avg(grad)).otherwise(0.0).alias("cts_csa_grad_mean"),
        F.when(enough3, F.stddev_pop(grad)).otherwise(0.0).alias("cts_csa_grad_std"),
        F.when(flat3, F.avg(fgrad)).otherwise(0.0).alias("cts_flat_grad_mean"),
        F.when(flat3, F.stddev_pop(fgrad)).otherwise(0.0).alias("cts_flat_grad_std"),
        F.avg(r).alias("cts_disp_median_mean"),
        F.max(r).alias("cts_disp_median_max"),
        F.sum(r * r).alias("cts_temporal_energy"),
        (F.max(r) - F.min(r)).alias("cts_radial_range"),
        mean0(F.col("turn")).alias("cts_mean_angular_change"),
        F.when(path > TINY, net / (path + TINY)).otherwise(0.0).alias("cts_path_efficiency"),
    )
    shapes = (("_csa", "csa", "_na"), ("_circ", "circ", "_na"), ("_eq", "eq_diam", "_na"), ("_flat", "flat", "_nf"))
    quartiles = percentiles_of(rows, key, {c: {f"cts_{n}_q25": 0.25, f"cts_{n}_q75": 0.75} for c, n, _ in shapes})
    out = out.join(quartiles, list(key), "left")
    for _, n, cnt in shapes:
        ok = F.col(cnt) >= 2
        out = out.withColumns({f"cts_{n}_{q}": F.when(ok, F.col(f"cts_{n}_{q}")).otherwise(0.0) for q in ("q25", "q75")})
        out = out.withColumn(f"cts_{n}_iqr", F.col(f"cts_{n}_q75") - F.col(f"cts_{n}_q25"))
    return out.drop("_na", "_nf")


def finite_features(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """NaN and infinities become 0 in every feature column."""
    return df.select(
        *[F.col(c) if c in key or t != "double" else G.finite_or(F.col(c), 0.0).alias(c) for c, t in df.dtypes]
    )


def feature_names(df: DataFrame, key: Sequence[str]) -> list[str]:
    return [c for c, t in df.dtypes if c not in key and t in ("double", "float", "int", "bigint")]


def subject_stats(
    videos: DataFrame, by: Sequence[str], names: Sequence[str], stats: Sequence[str] = ("mean", "std", "min", "max", "median")
) -> DataFrame:
    """``video_count`` and ``{stat}__{feature}`` per subject; missing features count as 0."""
    rows = videos.select(*by, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    fn = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    simple = [fn.get(s, F.avg)(n).alias(f"{s}__{n}") for s in stats if s != "median" for n in names]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("video_count"), *simple)
    if "median" in stats:
        long = rows.unpivot(list(by), list(names), "_name", "_v")
        med = percentiles(long, [*by, "_name"], "_v", {"m": 0.5})
        wide = med.groupBy(*by).agg(
            *[F.max(F.when(F.col("_name") == n, F.col("m"))).alias(f"median__{n}") for n in names]
        )
        out = out.join(wide, list(by))
    return out


def subject_mean(videos: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    return videos.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])


def fit_zscore(train: DataFrame, names: Sequence[str], bypass: Sequence[str] = ()) -> dict[str, tuple[float, float]]:
    """Mean and population spread per feature (one number pair each on the driver); a flat feature gets spread 1."""
    use = [n for n in names if n not in set(bypass)]
    row = train.agg(
        *[e for n in use for e in (F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"))]
    ).first()
    out = {}
    for n in use:
        m, s = row[f"m_{n}"] or 0.0, row[f"s_{n}"] or 0.0
        out[n] = (m, s if s >= TINY else 1.0)
    return out


def apply_zscore(df: DataFrame, model: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({n: G.finite_or((F.col(n) - m) / s, 0.0) for n, (m, s) in model.items()})


def channel_zscore(series: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    """Standardise each channel over all videos and steps of a long table."""
    stats = series.groupBy(channel).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    out = F.lit(None).cast("double")
    for r in stats.collect():  # one row per channel
        m, sd = float(r["_m"] or 0.0), float(r["_s"] or 0.0)
        z = (F.col(value) - m) / (sd if sd >= TINY else 1.0)
        out = F.when(F.col(channel) == F.lit(r[channel]), z).otherwise(out)
    return series.withColumn(value, G.finite_or(out, 0.0))


def scale_lengths(df: DataFrame, scale: Column) -> DataFrame:
    """Pixels to centimetres: lengths times ``scale``, areas times its square; no scale leaves a row as it is."""
    s = F.coalesce(scale, F.lit(1.0))
    lengths = [c for c in ("x", "y", "w", "h", "cx", "cy", "perimeter", "eq_diam") if c in df.columns]
    new = {c: F.col(c) * s for c in lengths}
    if "area" in df.columns:
        new["area"] = F.col("area") * s * s
    return df.withColumns(new)
