"""Feature queries: one row per video, then per subject."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.operators import dedup as D
from framelane.operators import features as X
from framelane.operators import smooth as S
from framelane.plans.fixtures import FIRST, KEY, PREDS, preds, shapes
from framelane.plans.q_smooth import CEN, center_sql
from framelane.plans.registry import ORACLES, TIE, pick, query
from framelane.session import cut

FRAME = ["video_id", "frame_index"]


def rows(spark, sf):
    df = shapes(D.first_per_frame(preds(spark, sf), FRAME))
    df = df.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    # a fifth of the frames carry no mask
    masked = F.col("pos") % 5 != 0
    df = df.withColumns({c: F.when(masked, F.col(c)) for c in ("area", "perimeter", "eq_diam")})
    return df.select("video_id", "subject_id", "frame_index", "cx", "cy", "w", "h", "area", "perimeter", "eq_diam")


SHAPE = """sh AS (SELECT video_id, subject_id, frame_index, x + w / 2 AS cx, y + h / 2 AS cy, w, h, w / (h + 1e-9) AS flat,
    CASE WHEN pos % 5 <> 0 THEN w * h * 0.785::DOUBLE END AS area, CASE WHEN pos % 5 <> 0 THEN 2 * (w + h) END AS perimeter,
    CASE WHEN pos % 5 <> 0 THEN sqrt(w * h) END AS eq_diam FROM pf),
  sc AS (SELECT *, 4 * pi() * area / (perimeter * perimeter) AS circ FROM sh)"""
BASE = f"WITH {PREDS}, {FIRST}, {SHAPE}"


def steps_sql(src: str) -> str:
    return f"""st0 AS (SELECT *, cx - lag(cx) OVER v AS dx, cy - lag(cy) OVER v AS dy, frame_index - lag(frame_index) OVER v AS dt,
      abs(w * h - lag(w * h) OVER v) AS area_step FROM {src} WINDOW v AS (PARTITION BY video_id ORDER BY frame_index)),
    st1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS step, sqrt(dx * dx + dy * dy) / dt AS speed, atan2(dy, dx) AS ang,
      lag(dx) OVER v AS pdx, lag(dy) OVER v AS pdy FROM st0 WINDOW v AS (PARTITION BY video_id ORDER BY frame_index)),
    st2 AS (SELECT *, abs(speed - lag(speed) OVER v) AS acc, abs(ang - lag(ang) OVER v) AS t0, sqrt(pdx * pdx + pdy * pdy) AS n1
      FROM st1 WINDOW v AS (PARTITION BY video_id ORDER BY frame_index)),
    st AS (SELECT *, abs(acc - lag(acc) OVER v) AS jerk, least(t0, 2 * pi() - t0) AS turn,
      CASE WHEN pdx IS NOT NULL THEN CASE WHEN n1 > 1 THEN abs(pdx * dy - pdy * dx) / (n1 * n1 * n1 + 1e-9) ELSE 0 END END AS curv
      FROM st2 WINDOW v AS (PARTITION BY video_id ORDER BY frame_index))"""


def z(expr: str, name: str) -> str:
    return f"round(coalesce({expr}, 0), 6) AS {name}"


def zt(expr: str, name: str) -> str:
    return f"round(coalesce({expr}, 0) + {TIE}, 6) AS {name}"


_NET = "sqrt(power(max_by(cx, frame_index) - min_by(cx, frame_index), 2) + power(max_by(cy, frame_index) - min_by(cy, frame_index), 2))"
_MOTION = f"""count(*)::DOUBLE AS num_points, (max(frame_index) - min(frame_index))::DOUBLE AS duration_frames,
  {z('max_by(cx, frame_index) - min_by(cx, frame_index)', 'displacement_x')}, {z('max_by(cy, frame_index) - min_by(cy, frame_index)', 'displacement_y')},
  {z(_NET, 'net_displacement')}, {z('max(cx) - min(cx)', 'span_x')}, {z('max(cy) - min(cy)', 'span_y')}, {z('sum(step)', 'path_length')},
  {z(f'{_NET} / greatest(coalesce(sum(step), 0), 1e-9)', 'straightness_ratio')}, {z('avg(speed)', 'mean_speed')}, {z('max(speed)', 'max_speed')},
  {z('stddev_pop(speed)', 'std_speed')}, {z('avg(acc)', 'mean_acc')}, {z('max(acc)', 'max_acc')}, {z('stddev_pop(acc)', 'std_acc')},
  {z('avg(jerk)', 'mean_jerk')}, {z('max(jerk)', 'max_jerk')}, {z('stddev_pop(jerk)', 'std_jerk')}, {z('avg(curv)', 'curvature_mean')},
  {z('stddev_pop(curv)', 'curvature_std')}, {z('avg(turn)', 'angular_change_mean')}, {z('stddev_pop(turn)', 'angular_change_std')},
  {z('avg(w * h)', 'area_mean')}, {z('stddev_pop(w * h)', 'area_std')}, {z('max(w * h) - min(w * h)', 'area_range')},
  {z('avg(area_step)', 'area_change_mean')}, {z('stddev_pop(area_step)', 'area_change_std')}, {z('quantile_cont(speed, 0.5)', 'median_speed')},
  {z('quantile_cont(speed, 0.95)', 'p95_speed')}, {z('quantile_cont(speed, 0.05)', 'p5_speed')}"""


@query("motion_features", "F1", f"{BASE}, {steps_sql('sc')} SELECT video_id, {_MOTION} FROM st GROUP BY video_id")
def _(spark, sf):
    out = X.motion(rows(spark, sf), KEY)
    return pick(out, *out.columns)


# smoothing adds a division by widely varying sums; four places keep both engines on one side
_M4 = _MOTION.replace(", 6) AS", ", 4) AS")


@query(
    "motion_features_smoothed",
    "F1 T12",
    f"""{BASE}, {CEN}, {center_sql('c', 'cn')}, sm AS (SELECT c.video_id, c.frame_index, c.cx, c.cy, w, h FROM c JOIN sc USING (video_id, frame_index)),
    {steps_sql('sm')} SELECT video_id, {_M4} FROM st GROUP BY video_id""",
)
def _(spark, sf):
    df = S.smooth_center(rows(spark, sf).select(*FRAME, "cx", "cy", "w", "h"), KEY)
    out = X.motion(cut(df), KEY)
    kinds = dict(out.dtypes)
    return out.select(*[F.round(c, 4).alias(c) if kinds[c] == "double" else F.col(c) for c in out.columns])


def fl(v: str, name: str) -> str:
    return f"""{z(f'min_by({v}, frame_index) FILTER (WHERE area IS NOT NULL)', f'csa_first_{name}')},
      {z(f'max_by({v}, frame_index) FILTER (WHERE area IS NOT NULL)', f'csa_last_{name}')}"""


@query(
    "cross_section_features",
    "F2 P11",
    f"{BASE} SELECT video_id, {fl('area', 'area')}, {fl('perimeter', 'perimeter')}, {fl('eq_diam', 'eq_diameter')}, {fl('circ', 'circularity')} FROM sc GROUP BY video_id",
)
def _(spark, sf):
    out = X.cross_section(rows(spark, sf), KEY)
    return pick(out, *out.columns)


_RAD = """md AS (SELECT video_id, median(cx) AS mx, median(cy) AS my FROM st GROUP BY video_id),
  rr AS (SELECT st.*, sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)) AS radius FROM st JOIN md USING (video_id))"""
_REF = "greatest(coalesce(min_by(eq_diam, frame_index) FILTER (WHERE eq_diam > 0), sqrt(greatest(min_by(w * h, frame_index), 1e-9))), 1e-9)"


@query(
    "motion_lite_features",
    "F3",
    f"""{BASE}, {steps_sql('sc')}, {_RAD} SELECT video_id, count(*)::DOUBLE AS num_points, (max(frame_index) - min(frame_index))::DOUBLE AS duration_frames,
      {z('sum(step)', 'path_length')}, {z(f'{_NET} / greatest(coalesce(sum(step), 0), 1e-9)', 'straightness_ratio')}, {z('avg(speed)', 'mean_speed')},
      {z('stddev_pop(speed)', 'std_speed')}, {z('median(speed)', 'median_speed')}, {z('avg(acc)', 'mean_acc')}, {z('stddev_pop(acc)', 'std_acc')},
      {z(f'avg(radius) / {_REF}', 'disp_median_mean')}, {z(f'stddev_pop(radius) / {_REF}', 'disp_median_std')}, {z(f'max(radius) / {_REF}', 'disp_median_max')},
      {z('avg(turn)', 'mean_heading_change')} FROM rr GROUP BY video_id""",
)
def _(spark, sf):
    out = X.motion_lite(rows(spark, sf), KEY)
    return pick(out, *out.columns)


_STATIC = f"""{zt('avg(a)', 'csa_mean')}, {zt('stddev_pop(a)', 'csa_std')}, {zt('(max(a) - min(a)) / min_by(a, frame_index) FILTER (WHERE a IS NOT NULL)', 'csa_strain')},
  {zt('max(a) / min_by(a, frame_index) FILTER (WHERE a IS NOT NULL)', 'swelling_ratio')}, {zt('avg(eq_diam)', 'eq_diam_mean')},
  {zt('(max(eq_diam) - min(eq_diam)) / min_by(eq_diam, frame_index) FILTER (WHERE a IS NOT NULL)', 'eq_diam_strain')}, {zt('avg(circ)', 'circularity_mean')},
  {zt('stddev_pop(circ)', 'circularity_std')}, {zt('avg(flat)', 'aspect_ratio_mean')}, {zt('stddev_pop(flat)', 'aspect_ratio_std')}"""


@query(
    "static_lite_features",
    "F4 F6",
    f"{BASE}, u AS (SELECT *, area AS a FROM sc) SELECT video_id, {_STATIC} FROM u GROUP BY video_id",
)
def _(spark, sf):
    out = X.static_lite(rows(spark, sf), KEY)
    return pick(out, *out.columns, tie=TIE)


@query(
    "motion_curve_features",
    "F5 P24",
    f"""{BASE}, {steps_sql('sc')}, {_RAD}, b AS (SELECT video_id, (max(frame_index) - min(frame_index))::DOUBLE AS duration, {z('sum(step)', 'path_length')},
      {z(f'{_NET} / greatest(coalesce(sum(step), 0), 1e-9)', 'straightness')}, {z('avg(speed)', 'speed_mean')}, {z('stddev_pop(speed)', 'speed_std')},
      {z('avg(acc)', 'acc_mean')}, {z('stddev_pop(acc)', 'acc_std')}, {z(f'avg(radius) / {_REF}', 'disp_mean')}, {z(f'stddev_pop(radius) / {_REF}', 'disp_std')},
      {z(f'max(radius) / {_REF}', 'disp_max')}, {z('avg(turn)', 'heading_change_mean')}, {z('stddev_pop(turn)', 'heading_change_std')} FROM rr GROUP BY video_id),
    i AS (SELECT video_id, cx, cy, count(*) OVER (PARTITION BY video_id) AS n, (row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1)
      / CAST(greatest(count(*) OVER (PARTITION BY video_id) - 1, 1) AS DOUBLE) AS t FROM sc),
    m AS (SELECT video_id, any_value(n) AS n, avg(t) AS tm, avg(cx) AS xm, avg(cy) AS ym FROM i GROUP BY video_id),
    k AS (SELECT i.*, m.xm, m.ym, t - tm AS p1 FROM i JOIN m USING (video_id)),
    k1 AS (SELECT video_id, sum(p1 * p1) / any_value(n) AS q, sum(p1 * p1) AS s1 FROM k GROUP BY video_id),
    k2 AS (SELECT k.*, p1 * p1 - q AS p2, s1 FROM k JOIN k1 USING (video_id)),
    c AS (SELECT video_id, sum(p1 * cx) / any_value(s1) AS bx, sum(p1 * cy) / any_value(s1) AS by_, sum(p2 * cx) / sum(p2 * p2) AS qx, sum(p2 * cy) / sum(p2 * p2) AS qy FROM k2 GROUP BY video_id),
    f AS (SELECT k2.*, cx - xm - bx * p1 - qx * p2 AS ex, cy - ym - by_ * p1 - qy * p2 AS ey, bx + 2 * qx * p1 AS dx, by_ + 2 * qy * p1 AS dy, 2 * qx AS ddx, 2 * qy AS ddy FROM k2 JOIN c USING (video_id)),
    g AS (SELECT video_id, any_value(n) AS n, sum(sqrt(ex * ex + ey * ey)) AS ca, avg(abs(dx * ddy - dy * ddx) / (power(dx * dx + dy * dy, 1.5) + 1e-9)) AS cc,
      sum(ex * ex + ey * ey) AS sse, sum((cx - xm) * (cx - xm) + (cy - ym) * (cy - ym)) AS sst FROM f GROUP BY video_id)
    SELECT b.*, round(CASE WHEN n >= 3 THEN ca ELSE 0 END, 6) AS curve_amplitude, round(CASE WHEN n >= 3 THEN cc ELSE 0 END, 6) AS curve_curvature,
      round(CASE WHEN n >= 3 AND sst > 1e-9 THEN 1 - sse / (sst + 1e-9) ELSE 0 END, 6) AS curve_fit_r2 FROM b JOIN g USING (video_id)""",
)
def _(spark, sf):
    out = X.motion_curve(cut(rows(spark, sf)), KEY)
    return pick(out, *out.columns)


@query(
    "geometry_features_scaled",
    "F7 P19 P20",
    f"""{BASE}, sl AS (SELECT *, CASE WHEN video_id % 4 <> 0 THEN 0.01::DOUBLE * (1 + video_id % 3) ELSE 1 END AS s FROM sc)
    SELECT video_id, {zt('avg(area * s * s)', 'csa_mean')}, {zt('stddev_pop(area * s * s)', 'csa_std')}, {zt('avg(eq_diam * s)', 'eq_diam_mean')},
      {zt('stddev_pop(eq_diam * s)', 'eq_diam_std')}, {zt('avg(circ)', 'circularity_mean')}, {zt('stddev_pop(circ)', 'circularity_std')},
      {zt('avg(w * s / (h * s + 1e-9))', 'aspect_ratio_mean')}, {zt('stddev_pop(w * s / (h * s + 1e-9))', 'aspect_ratio_std')} FROM sl GROUP BY video_id""",
)
def _(spark, sf):
    from framelane.functions.keys import path_key

    df = rows(spark, sf)
    # the scale table is keyed by path, as the depth-scale file is; a quarter of the videos are not in it
    scales = df.select("video_id").distinct().where(F.col("video_id") % 4 != 0).select(
        path_key(F.concat(F.lit("Data\\Video/"), F.col("video_id").cast("string"), F.lit(".AVI"))).alias("path_key"),
        (F.lit(0.01) * (F.lit(1) + F.col("video_id") % 3)).alias("scale"),
    )
    df = df.withColumn("path_key", path_key(F.concat(F.lit("data/video/"), F.col("video_id").cast("string"), F.lit(".avi"))))
    df = df.join(scales, "path_key", "left")
    out = X.geometry(X.scale_lengths(df, F.col("scale")), KEY)
    return pick(out, *out.columns, tie=TIE)


def flast(v: str, name: str) -> str:
    return f"""{z(f'min_by({v}, frame_index) FILTER (WHERE area IS NOT NULL)', f'{name}_first')},
      {z(f'max_by({v}, frame_index) FILTER (WHERE area IS NOT NULL)', f'{name}_last')}"""


@query(
    "static_features",
    "F8",
    f"""{BASE}, {steps_sql('sc')} SELECT video_id, {z('min(area)', 'cts_csa_min')}, {z('max(area)', 'cts_csa_max')}, {z('avg(area)', 'cts_csa_mean')},
      {z('stddev_pop(area)', 'cts_csa_std')}, {z('max(area) - min(area)', 'cts_csa_range')}, {z('stddev_pop(area) / (avg(area) + 1e-9)', 'cts_csa_cv')},
      {flast('area', 'cts_csa')}, {z('max(area) / (min(area) + 1e-9)', 'cts_swelling_ratio')}, {z('avg(flat)', 'cts_flat_mean')},
      {z('stddev_pop(flat)', 'cts_flat_std')}, {z('max(flat)', 'cts_flat_max')}, {z('min(flat)', 'cts_flat_min')}, {flast('circ', 'cts_circularity')},
      {z('avg(circ)', 'cts_circularity_mean')}, {z('stddev_pop(circ)', 'cts_circularity_std')}, {z('avg(eq_diam)', 'cts_eq_diam_mean')},
      {z('stddev_pop(eq_diam)', 'cts_eq_diam_std')}, {flast('eq_diam', 'cts_eq_diam')}, {z('avg(circ)', 'cts_compact_mean')}, {z('stddev_pop(circ)', 'cts_compact_std')},
      {', '.join(f'CAST(0 AS DOUBLE) AS cts_echo_{n}' for n in ('mean_first', 'std_first', 'mean_last', 'std_last', 'delta'))},
      {z(_NET, 'cts_nerve_net_disp')}, {z('sum(step)', 'cts_nerve_path_len')}, {z('stddev_pop(cx)', 'cts_nerve_stability_x')}, {z('stddev_pop(cy)', 'cts_nerve_stability_y')},
      {z('min_by(flat, frame_index)', 'cts_aspect_first')}, {z('max_by(flat, frame_index)', 'cts_aspect_last')} FROM st GROUP BY video_id""",
)
def _(spark, sf):
    out = X.static(rows(spark, sf), KEY)
    return pick(out, *out.columns)


def quart(v: str, name: str) -> str:
    q = {p: f"quantile_cont({v}, {p})" for p in (0.25, 0.75)}
    ok = f"count({v}) >= 2"
    return f"""{z(f'CASE WHEN {ok} THEN {q[0.25]} END', f'cts_{name}_q25')}, {z(f'CASE WHEN {ok} THEN {q[0.75]} END', f'cts_{name}_q75')},
      {z(f'CASE WHEN {ok} THEN {q[0.75]} - {q[0.25]} END', f'cts_{name}_iqr')}"""


@query(
    "static_extra_features",
    "F9",
    f"""{BASE}, {steps_sql('sc')}, {_RAD}, gr AS (SELECT *, area - CASE WHEN area IS NOT NULL THEN lag(area IGNORE NULLS) OVER v END AS ga,
        flat - lag(flat) OVER v AS gf, avg(area) OVER (PARTITION BY video_id) AS ma, stddev_pop(area) OVER (PARTITION BY video_id) AS sa
      FROM rr WINDOW v AS (PARTITION BY video_id ORDER BY frame_index))
    SELECT video_id, {z('CASE WHEN count(area) >= 3 AND any_value(sa) >= 1e-12 THEN avg(power((area - ma) / sa, 3)) END', 'cts_csa_skew')},
      {z('CASE WHEN count(area) >= 4 AND any_value(sa) >= 1e-12 THEN avg(power((area - ma) / sa, 4)) - 3 END', 'cts_csa_kurt')},
      {z('CASE WHEN count(area) >= 3 THEN avg(ga) END', 'cts_csa_grad_mean')}, {z('CASE WHEN count(area) >= 3 THEN stddev_pop(ga) END', 'cts_csa_grad_std')},
      {z('CASE WHEN count(*) >= 3 THEN avg(gf) END', 'cts_flat_grad_mean')}, {z('CASE WHEN count(*) >= 3 THEN stddev_pop(gf) END', 'cts_flat_grad_std')},
      {z('avg(radius)', 'cts_disp_median_mean')}, {z('max(radius)', 'cts_disp_median_max')}, {z('sum(radius * radius)', 'cts_temporal_energy')},
      {z('max(radius) - min(radius)', 'cts_radial_range')}, {z('avg(turn)', 'cts_mean_angular_change')},
      {z(f'CASE WHEN sum(step) > 1e-9 THEN {_NET} / (sum(step) + 1e-9) END', 'cts_path_efficiency')},
      {quart('area', 'csa')}, {quart('circ', 'circ')}, {quart('eq_diam', 'eq_diam')}, {quart('flat', 'flat')} FROM gr GROUP BY video_id""",
)
def _(spark, sf):
    out = X.static_extra(rows(spark, sf), KEY)
    return pick(out, *out.columns)


_VF = "vf AS (SELECT video_id, any_value(subject_id) AS subject_id, avg(w * h) AS f1, stddev_pop(cx) AS f2, CASE WHEN video_id % 7 <> 0 THEN max(flat) END AS f3 FROM sc GROUP BY video_id)"


def video_features(spark, sf):
    df = rows(spark, sf)
    flat = F.max(F.col("w") / (F.col("h") + 1e-9))
    return df.groupBy("video_id").agg(
        F.first("subject_id").alias("subject_id"),
        F.avg(F.col("w") * F.col("h")).alias("f1"),
        F.stddev_pop("cx").alias("f2"),
        F.when(F.col("video_id") % 7 != 0, flat).alias("f3"),
    )


_AGG = ", ".join(
    f"round({fn}(coalesce({f}, 0)), 6) AS {s}__{f}"
    for s, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"), ("median", "median"))
    for f in ("f1", "f2", "f3")
)


@query("subject_stats", "F14 F26", f"{BASE}, {_VF} SELECT subject_id, count(*)::DOUBLE AS video_count, {_AGG} FROM vf GROUP BY subject_id")
def _(spark, sf):
    out = X.subject_stats(cut(video_features(spark, sf)), ["subject_id"], ["f1", "f2", "f3"])
    return pick(out, *out.columns)


@query(
    "subject_mean_vector",
    "F15",
    f"{BASE}, {_VF} SELECT subject_id, round(avg(f1), 6) AS f1, round(avg(f2), 6) AS f2 FROM vf GROUP BY subject_id",
)
def _(spark, sf):
    out = X.subject_mean(video_features(spark, sf), ["subject_id"], ["f1", "f2"])
    return pick(out, *out.columns)


@query(
    "global_zscore",
    "F16 U2",
    f"""{BASE}, {_VF}, m AS (SELECT avg(f1) AS m1, stddev_pop(f1) AS s1, avg(f3) AS m3, stddev_pop(f3) AS s3 FROM vf WHERE subject_id < 8)
    SELECT video_id, round((f1 - m1) / s1, 6) AS f1, round(f2, 6) AS f2, round(coalesce((f3 - m3) / s3, 0), 6) AS f3 FROM vf, m""",
)
def _(spark, sf):
    df = cut(video_features(spark, sf))
    model = X.fit_zscore(df.where("subject_id < 8"), ["f1", "f2", "f3"], bypass=["f2"])
    return pick(X.apply_zscore(df, model), "video_id", "f1", "f2", "f3")


@query(
    "channel_zscore",
    "F17",
    f"""{BASE}, l AS (SELECT video_id, frame_index, 'cx' AS channel, cx AS value FROM sc UNION ALL SELECT video_id, frame_index, 'flat', flat FROM sc)
    SELECT video_id, frame_index, channel, round((value - avg(value) OVER (PARTITION BY channel)) / stddev_pop(value) OVER (PARTITION BY channel), 6) AS value FROM l""",
)
def _(spark, sf):
    df = rows(spark, sf).withColumn("flat", F.col("w") / (F.col("h") + 1e-9))
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in ("cx", "flat")])
    long = df.select(*FRAME, F.inline(pairs))
    return pick(X.channel_zscore(long), *FRAME, "channel", "value")


@query(
    "trajectory_quality",
    "A33 A43",
    f"""{BASE}, {steps_sql('sc')}, q AS (SELECT *, dx / greatest(dt, 1) AS vx, dy / greatest(dt, 1) AS vy, (w - lag(w) OVER v) / greatest(dt, 1) AS vw,
        (h - lag(h) OVER v) / greatest(dt, 1) AS vh, lag(dt) OVER v AS pdt FROM st WINDOW v AS (PARTITION BY video_id ORDER BY frame_index)),
    s AS (SELECT *, (vx - lag(vx) OVER v) / greatest((pdt + dt) / 2.0, 1) AS ax, (vy - lag(vy) OVER v) / greatest((pdt + dt) / 2.0, 1) AS ay
      FROM q WINDOW v AS (PARTITION BY video_id ORDER BY frame_index))
    SELECT video_id, {z('stddev_pop(vx)', 'jitter_cx')}, {z('stddev_pop(vy)', 'jitter_cy')}, {z('stddev_pop(vw)', 'jitter_w')}, {z('stddev_pop(vh)', 'jitter_h')},
      {z('avg(abs(ax))', 'smoothness_cx')}, {z('avg(abs(ay))', 'smoothness_cy')},
      {z('CASE WHEN count(*) >= 2 AND avg(w * h) > 1e-9 THEN greatest(0, 1 - stddev_pop(w * h) / avg(w * h)) END', 'area_stability')}, {z('sum(step)', 'path_length')},
      {z('avg(coalesce(step, 0))', 'mean_speed')} FROM s GROUP BY video_id""",
)
def _(spark, sf):
    from framelane.operators.report import trajectory_quality

    out = trajectory_quality(rows(spark, sf), KEY)
    return pick(out, *out.columns)


@query(
    "track_samples",
    "A43 P25",
    f"""{BASE}, d AS (SELECT video_id, frame_index, cx, cy, coalesce(sqrt(power(cx - lag(cx) OVER v, 2) + power(cy - lag(cy) OVER v, 2)), 0) AS step
      FROM sc WINDOW v AS (PARTITION BY video_id ORDER BY frame_index))
    SELECT video_id, frame_index, round(cx, 3) AS cx, round(cy, 3) AS cy, round(step, 3) AS displacement FROM d""",
)
def _(spark, sf):
    from framelane.operators.report import track_samples

    return track_samples(rows(spark, sf), KEY)


@query(
    "ablation_group_columns",
    "F27 U1",
    f"""{BASE}, {_VF}, m AS (SELECT video_id, round(f1, 6) AS f1, round(coalesce(f2, 0), 6) AS f2 FROM vf) SELECT video_id, f1, f2 FROM m""",
)
def _(spark, sf):
    from framelane.operators.modelling import ablation_columns

    families = {"geometry": ["f1"], "texture": ["f3"], "motion": ["f2"]}
    return pick(video_features(spark, sf), "video_id", *ablation_columns(families, "GM"))


@query(
    "ablation_groups",
    "F27",
    f"""{BASE}, {_VF}, m AS (SELECT video_id, coalesce(f1, 0) AS geometry, coalesce(f2, 0) AS motion, coalesce(f3, 0) AS texture FROM vf)
    SELECT video_id, unnest(['G', 'D', 'M', 'GD', 'GM', 'DM']) AS name, unnest([1, 1, 1, 2, 2, 2]) AS columns,
      round(unnest([geometry, texture, motion, geometry + texture, geometry + motion, texture + motion]), 6) AS total FROM m""",
)
def _(spark, sf):
    """All six groups of feature families: how many columns each has, and their sum."""
    from framelane.operators.modelling import GROUPS, ablation_columns

    families = {"geometry": ["f1"], "texture": ["f3"], "motion": ["f2"]}
    parts = []
    for name in GROUPS:
        used = ablation_columns(families, name)
        total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in used[1:]), F.coalesce(F.col(used[0]).cast("double"), F.lit(0.0)))
        parts.append(F.struct(F.lit(name).alias("name"), F.lit(len(used)).alias("columns"), total.alias("total")))
    out = video_features(spark, sf).select("video_id", F.inline(F.array(*parts)))
    return pick(out, *out.columns)


def _smoothed(name: str) -> str:
    """SQL of a motion query over smoothed centres, to four places."""
    sm = f"{CEN}, {center_sql('ce', 'cn')}, sm AS (SELECT sc.* EXCLUDE (cx, cy), ce.cx, ce.cy FROM ce JOIN sc USING (video_id, frame_index))"
    sql = ORACLES[name].replace(f"{BASE}, {steps_sql('sc')}", f"{BASE}, {sm}, {steps_sql('sm')}").replace("AS t FROM sc)", "AS t FROM sm)")
    return f"SELECT video_id, round(COLUMNS(* EXCLUDE video_id) + 3.3e-7, 4) FROM ({sql})"


def four(df):
    out = pick(df, *df.columns)
    kinds = dict(out.dtypes)
    return out.select(*[F.round(F.col(c) + 3.3e-7, 4).alias(c) if kinds[c] == "double" else F.col(c) for c in out.columns])


def smoothed_rows(spark, sf):
    """Rows whose centres went through outlier filter, gap filling and smoothing."""
    return cut(S.smooth_center(rows(spark, sf), KEY))


@query("motion_lite_smoothed", "F3 T12", _smoothed("motion_lite_features"))
def _(spark, sf):
    return four(X.motion_lite(smoothed_rows(spark, sf), KEY))


@query("motion_curve_smoothed", "F5 T12 P24", _smoothed("motion_curve_features"))
def _(spark, sf):
    return four(X.motion_curve(smoothed_rows(spark, sf), KEY))


_ECHO = ", ".join(
    f"round(coalesce({f}({c}, frame_index) FILTER (WHERE {c} IS NOT NULL), 0), 6) AS cts_echo_{c}_{n}" for n, f in (("first", "min_by"), ("last", "max_by")) for c in ("mean", "std")
)


@query(
    "static_features_echo",
    "F8",
    f"""{BASE}, e AS (SELECT video_id, frame_index, CASE WHEN pos % 3 > 0 THEN (pos % 17) * 1.5::DOUBLE END AS mean, CASE WHEN pos % 4 > 0 THEN (pos % 5) * 0.5::DOUBLE END AS std FROM pf),
    f AS (SELECT video_id, {_ECHO} FROM e GROUP BY video_id) SELECT *, round(cts_echo_mean_last - cts_echo_mean_first, 6) AS cts_echo_delta FROM f""",
)
def _(spark, sf):
    """Echo intensities of the mask at the first and last frame that have them."""
    pos = F.col("pos")
    signal = D.first_per_frame(preds(spark, sf), FRAME).select(
        *FRAME, F.when(pos % 3 > 0, (pos % 17) * 1.5).alias("echo_mean"), F.when(pos % 4 > 0, (pos % 5) * 0.5).alias("echo_std")
    )
    out = X.static(rows(spark, sf).join(signal, FRAME), KEY)
    return pick(out, "video_id", *[c for c in out.columns if c.startswith("cts_echo_")])
