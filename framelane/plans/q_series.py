"""Channel series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.operators import series as S
from framelane.plans.fixtures import FIRST, KEY, PREDS, pchip_sql
from framelane.plans.q_features import SHAPE, rows
from framelane.plans.q_smooth import _POS, poly_sql, two_scale_sql, window_sql
from framelane.plans.registry import query

STEPS = 256
CHANNELS = ("cx", "cy", "w", "h", "box_area", "area", "circularity", "eq_diam", "flatness")


def _base(fall_back: bool, more: tuple[str, ...] = ()) -> str:
    a = "coalesce(area, 0)"
    e, p = "coalesce(eq_diam, 0)", "coalesce(perimeter, 0)"
    if fall_back:
        a, p = "coalesce(area, w * h)", "coalesce(perimeter, 2 * (w + h))"
        e = "coalesce(eq_diam, sqrt(4 * w * h / pi()))"
    return f"""bc AS (SELECT video_id, frame_index, cx, cy, w, h, w * h AS box_area, {a} AS area,
      CASE WHEN {p} > 0 THEN 4 * pi() * {a} / ({p} * {p}) ELSE 0 END AS circularity, {e} AS eq_diam, flat AS flatness{''.join(f', {c}' for c in more)}, {_POS} FROM sh)"""


def timeline_sql(fall_back: bool, hampel: tuple[str, ...], smooth: tuple[str, ...], more: tuple[str, ...] = ()) -> str:
    _ALL = (*CHANNELS, *more)
    ham = ", ".join(two_scale_sql(f"hm_{c}", "bc", c, 3) for c in hampel)
    joins = " ".join(f"JOIN hm_{c} USING (video_id, i)" for c in hampel)
    cols = ", ".join(f"hm_{c}.{c}" if c in hampel else f"bc.{c}" for c in _ALL)
    fin = ", ".join(f"o.{c}" if c in smooth else f"s1.{c}" for c in _ALL)
    return f"""{_base(fall_back, more)}, {ham}, kn AS (SELECT bc.video_id, bc.frame_index, {cols} FROM bc {joins}),
    fx AS (SELECT video_id, CAST(unnest(range(0, b + 1)) AS INTEGER) AS frame_index FROM (SELECT video_id, max(frame_index) AS b FROM kn GROUP BY 1)),
    ms AS (SELECT * FROM fx ANTI JOIN kn USING (video_id, frame_index)), {pchip_sql('f', 'kn', 'ms', _ALL)},
    u AS (SELECT video_id, frame_index, {', '.join(_ALL)} FROM f UNION ALL SELECT video_id, frame_index, {', '.join(_ALL)} FROM kn),
    s0 AS (SELECT *, {_POS} FROM u), s1 AS (SELECT *, {window_sql('n', '7')} AS wl FROM s0), {poly_sql('o', 's1', smooth)},
    t0 AS (SELECT s1.video_id, s1.frame_index, s1.n, {fin} FROM s1 JOIN o USING (video_id, i)),
    t1 AS (SELECT *, cx - lag(cx) OVER v AS vx, cy - lag(cy) OVER v AS vy, lag(box_area) OVER v AS pa, median(cx) OVER (PARTITION BY video_id) AS mx, median(cy) OVER (PARTITION BY video_id) AS my
      FROM t0 WINDOW v AS (PARTITION BY video_id ORDER BY frame_index)),
    t2 AS (SELECT *, coalesce(sqrt(vx * vx + vy * vy), 0) AS speed, lag(vx) OVER v AS ux, lag(vy) OVER v AS uy FROM t1 WINDOW v AS (PARTITION BY video_id ORDER BY frame_index)),
    tl AS (SELECT *, cx - mx AS dx, cy - my AS dy, CASE WHEN n > 2 THEN coalesce(abs(speed - lag(speed) OVER v), 0) ELSE 0 END AS accel, coalesce(vy / (speed + 1e-12), 0) AS heading_sin,
      coalesce(vx / (speed + 1e-12), 0) AS heading_cos, coalesce(box_area - pa, 0) AS d_area, sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)) AS radial,
      coalesce(abs(ux * vy - uy * vx) / (sqrt(ux * ux + uy * uy) * speed + 1e-12), 0) AS bend FROM t2 WINDOW v AS (PARTITION BY video_id ORDER BY frame_index))"""


def series_sql(fall_back: bool, hampel, smooth, channels, shape: str = SHAPE, more: tuple[str, ...] = ()) -> str:
    parts = " UNION ALL ".join(
        f"SELECT video_id, CAST(step AS INTEGER) AS step, '{c}' AS channel, round({c} + 3e-6, 4) + 0::DOUBLE AS value FROM rs" for c in channels
    )
    return f"""WITH {PREDS}, {FIRST}, {shape}, {timeline_sql(fall_back, hampel, smooth, more)},
    rs AS (SELECT tl.*, step FROM (SELECT video_id, max(frame_index) AS t FROM tl GROUP BY 1) m, range({STEPS}) r(step), tl
      WHERE tl.video_id = m.video_id AND tl.frame_index = CAST(round_even(step * (t / CAST({STEPS - 1} AS DOUBLE)), 0) AS INTEGER)) {parts}"""


def four(df):
    return df.select("video_id", "step", "channel", (F.round(F.col("value") + 3e-6, 4) + F.lit(0.0)).alias("value"))  # no negative zeros




@query("geometry_series", "F10 T4", series_sql(False, S.HAMPEL, S.SMOOTH, S.GEOMETRY_SERIES))
def _(spark, sf):
    return four(S.geometry_series(rows(spark, sf), KEY, STEPS))


@query("derived_series", "F11", series_sql(False, S.HAMPEL, S.SMOOTH, S.DERIVED_SERIES))
def _(spark, sf):
    return four(S.derived_series(rows(spark, sf), KEY, STEPS))


@query("box_series", "F12", series_sql(True, S.ALL_SIX, S.ALL_SIX, S.BOX_SERIES))
def _(spark, sf):
    return four(S.box_series(rows(spark, sf), KEY, STEPS))


@query("lite_series", "F13", series_sql(False, S.LITE_FOUR, S.LITE_FOUR, S.LITE_SERIES))
def _(spark, sf):
    return four(S.lite_series(rows(spark, sf), KEY, STEPS))


@query(
    "resampled_centers",
    "T34",
    f"""WITH {PREDS}, {FIRST}, {SHAPE}, kn AS (SELECT video_id, CAST(frame_index AS DOUBLE) AS frame_index, cx, cy FROM sh),
    q AS (SELECT video_id, CASE WHEN step = 31 THEN b ELSE a + step * ((b - a) / CAST(31 AS DOUBLE)) END AS frame_index, step FROM (SELECT video_id, min(frame_index) AS a, max(frame_index) AS b FROM kn GROUP BY 1), range(32) r(step)),
    qq AS (SELECT video_id, frame_index FROM q), {pchip_sql('f', 'kn', 'qq', ('cx', 'cy'))}, r AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS step, cx, cy FROM f)
    SELECT video_id, CAST(step AS INTEGER) AS step, round(cx, 4) AS cx, round(cy, 4) AS cy, round(coalesce(cx - lag(cx) OVER w, 0) * 0.5, 4) AS dx, round(coalesce(cy - lag(cy) OVER w, 0) * 0.5, 4) AS dy
    FROM r WINDOW w AS (PARTITION BY video_id ORDER BY step)""",
)
def _(spark, sf):
    out = S.resample_centers(rows(spark, sf), KEY, 32, scale=0.5)
    return out.select("video_id", "step", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "dx", "dy")])


_TEXTURE = {"glcm_contrast": "(frame_index * 37 + video_id) % 11 * 0.5", "glcm_homogeneity": "(frame_index * 13 + video_id) % 7 / 8.0", "gray_mean": "(frame_index * 5 + video_id) % 97 * 1.0"}
_TEX_SHAPE = SHAPE.replace("sh AS", "sh_ AS", 1).replace("FROM sh)", "FROM sh_)") + ", sh AS (SELECT *, " + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in _TEXTURE.items()) + " FROM sh_)"
_LITE_TEX = (*S.LITE_FOUR, *S.TEXTURE)


@query("lite_series_texture", "F13", series_sql(False, _LITE_TEX, _LITE_TEX, (*S.LITE_SERIES, *S.TEXTURE), _TEX_SHAPE, S.TEXTURE))
def _(spark, sf):
    """All twelve channels: texture of every frame joins the geometry and is filtered, filled and smoothed with it."""
    f, v = F.col("frame_index"), F.col("video_id")
    made = {"glcm_contrast": (f * 37 + v) % 11 * 0.5, "glcm_homogeneity": (f * 13 + v) % 7 / 8.0, "gray_mean": (f * 5 + v) % 97 * 1.0}
    return four(S.lite_series(rows(spark, sf).withColumns({c: e.cast("double") for c, e in made.items()}), KEY, STEPS))
