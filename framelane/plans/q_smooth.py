"""Smoothing queries and the SQL that states the same rules with self joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.operators import dedup as D
from framelane.operators import smooth as S
from framelane.plans.fixtures import FIRST, GT, GT1, KEY, PREDS, gt, pchip_sql, preds
from framelane.plans.registry import TIE, pick, query

FRAME = ["video_id", "frame_index"]
_POS = "row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n"


def first(spark, sf):
    return D.first_per_frame(preds(spark, sf), FRAME)


def centers(spark, sf):
    df = first(spark, sf)
    return df.select(
        *FRAME, "pos", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), "w", "h",
        "is_fallback",
    )


CEN = "cn AS (SELECT video_id, frame_index, x + w / 2 AS cx, y + h / 2 AS cy, w, h, is_fallback FROM pf)"


def hampel_sql(p: str, src: str, v: str, k: str, sigma: float) -> str:
    """One pass on ``src(video_id, i, v, k)``."""
    return f"""{p}_w AS (SELECT a.video_id, a.i, a.{k} AS kk, a.{v} AS v, median(b.{v}) AS med FROM {src} a JOIN {src} b
      ON a.video_id = b.video_id AND b.i BETWEEN a.i - a.{k} AND a.i + a.{k} GROUP BY ALL),
    {p}_d AS (SELECT a.video_id, a.i, a.v, a.med, median(abs(b.{v} - a.med)) AS mad FROM {p}_w a JOIN {src} b
      ON a.video_id = b.video_id AND b.i BETWEEN a.i - a.kk AND a.i + a.kk GROUP BY ALL),
    {p} AS (SELECT video_id, i, coalesce(abs(v - med) > {sigma} * 1.4826 * (mad + 1e-12), false) AS hit,
      CASE WHEN abs(v - med) > {sigma} * 1.4826 * (mad + 1e-12) THEN med ELSE v END AS {v} FROM {p}_d)"""


def two_scale_sql(p: str, src: str, v: str, micro: int = 7) -> str:
    """Reflect ``src(video_id, i, n, v)``, run both passes, strip; gives ``p(video_id, i, v, hit)``."""
    return f"""{p}_s AS (SELECT video_id, i, n, {v}, least(greatest(greatest(5, CAST(floor(n * 0.15 / 2) AS BIGINT)), {micro}), n - 1) AS pad,
      greatest(5, CAST(floor(n * 0.15 / 2) AS BIGINT)) AS wide FROM {src} WHERE n >= 3),
    {p}_p AS (SELECT video_id, i, {v}, least(wide, (n + 2 * pad - 1) // 2) AS k1, least({micro}, (n + 2 * pad - 1) // 2) AS k2 FROM {p}_s
      UNION ALL SELECT video_id, -i, {v}, least(wide, (n + 2 * pad - 1) // 2), least({micro}, (n + 2 * pad - 1) // 2) FROM {p}_s WHERE i BETWEEN 1 AND pad
      UNION ALL SELECT video_id, 2 * (n - 1) - i, {v}, least(wide, (n + 2 * pad - 1) // 2), least({micro}, (n + 2 * pad - 1) // 2) FROM {p}_s
        WHERE i BETWEEN n - 1 - pad AND n - 2),
    {hampel_sql(f'{p}_1', f'{p}_p', v, 'k1', 3.0)},
    {p}_q AS (SELECT o.video_id, o.i, o.{v}, o.hit AS hit1, k1, k2 FROM {p}_1 o JOIN {p}_p USING (video_id, i)),
    {hampel_sql(f'{p}_2', f'{p}_q', v, 'k2', 3.0)},
    {p} AS (SELECT s.video_id, s.i, coalesce(t.{v}, s.{v}) AS {v}, coalesce(q.hit1 OR t.hit, false) AS hit
      FROM {src} s LEFT JOIN {p}_2 t USING (video_id, i) LEFT JOIN {p}_q q USING (video_id, i))"""


def window_sql(n: str, want: str) -> str:
    cap = f"least({want}, greatest(5, {n} // 2 + CASE WHEN ({n} // 2) % 2 = 0 THEN 1 ELSE 0 END), {n})"
    return f"CASE WHEN {n} < 4 THEN 0 WHEN ({cap}) % 2 = 0 THEN greatest(({cap}) - 1, 3) ELSE {cap} END"


def poly_sql(p: str, src: str, vals: tuple[str, ...]) -> str:
    """Quadratic window fit of ``src(video_id, i, n, wl, vals)`` by the orthogonal polynomials 1, u, u^2 - q."""
    m = "CAST(wl // 2 AS DOUBLE)"
    q = f"({m} * ({m} + 1) / 3)"
    n0 = f"(2 * {m} + 1)"
    coef = (
        f"1 / {n0} + e * u * 3 / ({m} * ({m} + 1) * {n0}) + (e * e - {q}) * (u * u - {q}) * 45 / "
        f"({n0} * {m} * ({m} + 1) * (2 * {m} - 1) * (2 * {m} + 3))"
    )
    sums = ", ".join(f"sum(({coef}) * {v}) AS {v}" for v in vals)
    raw = ", ".join(vals)
    return f"""{p}_w AS (SELECT *, greatest(0, least(i - wl // 2, n - wl)) AS st FROM {src} WHERE wl >= 3),
    {p} AS (SELECT video_id, i, {sums} FROM (SELECT a.video_id, a.i, a.wl, CAST(a.i - a.st - a.wl // 2 AS DOUBLE) AS e,
        CAST(b.i - a.st - a.wl // 2 AS DOUBLE) AS u, {', '.join(f'b.{v}' for v in vals)}
        FROM {p}_w a JOIN {src} b ON a.video_id = b.video_id AND b.i BETWEEN a.st AND a.st + a.wl - 1) GROUP BY video_id, i
      UNION ALL SELECT video_id, i, {raw} FROM {src} WHERE wl < 3)"""


def adaptive_sql(p: str, src: str, vals: tuple[str, ...], window: int = 7) -> str:
    """``src(video_id, frame_index, vals)`` -> ``p(video_id, frame_index, vals)``, time-aware smoothing."""
    raw = ", ".join(vals)
    return f"""{p}_a AS (SELECT *, frame_index - lag(frame_index) OVER (PARTITION BY video_id ORDER BY frame_index) AS g, {_POS} FROM {src}),
    {p}_b AS (SELECT video_id, min(g) AS g0, max(g) AS g1, any_value(n) AS n, min(frame_index) AS f0, max(frame_index) AS f1
      FROM {p}_a GROUP BY video_id),
    {p}_n AS (SELECT video_id, n, CAST(f0 AS BIGINT) AS f0, CAST(f1 - f0 + 1 AS BIGINT) AS len FROM {p}_b
      WHERE n >= 4 AND g0 <> g1),
    {p}_m AS (SELECT video_id, CAST(unnest(range(f0, f0 + len)) AS INTEGER) AS frame_index FROM {p}_n),
    {p}_x AS (SELECT * FROM {p}_m ANTI JOIN {src} USING (video_id, frame_index)),
    {p}_k AS (SELECT * FROM {src} SEMI JOIN {p}_n USING (video_id)),
    {pchip_sql(f'{p}_f', f'{p}_k', f'{p}_x', vals)},
    {p}_u AS (SELECT video_id, frame_index, {raw} FROM {p}_f UNION ALL SELECT video_id, frame_index, {raw} FROM {p}_k),
    {p}_v AS (SELECT u.video_id, u.frame_index - f0 AS i, len AS n, u.frame_index, {raw}, least(greatest(3,
        CAST(round_even({window} * (CAST(len AS DOUBLE) / n.n), 0) AS BIGINT)), len) AS want FROM {p}_u u JOIN {p}_n n USING (video_id)),
    {p}_y AS (SELECT video_id, i, n, frame_index, {raw}, {window_sql('n', '(CASE WHEN want % 2 = 0 THEN greatest(want - 1, 3) ELSE want END)')} AS wl
        FROM {p}_v UNION ALL
      SELECT video_id, i, n, frame_index, {raw}, {window_sql('n', str(window))} FROM {p}_a ANTI JOIN {p}_n USING (video_id)),
    {poly_sql(f'{p}_s', f'{p}_y', vals)},
    {p} AS (SELECT s.video_id, y.frame_index, {', '.join(f's.{v}' for v in vals)} FROM {p}_s s JOIN {p}_y y USING (video_id, i)
      SEMI JOIN {src} o ON o.video_id = s.video_id AND o.frame_index = y.frame_index)"""


def marked_sql(p: str, src: str, v: str, micro: int = 7, max_run: int = 2) -> str:
    """Outlier marking of ``src(video_id, frame_index, v)``: ``p(video_id, frame_index, v, hit)`` with v null at short bursts."""
    return f"""{p}_i AS (SELECT video_id, frame_index, {v}, {_POS} FROM {src}),
    {two_scale_sql(f'{p}_h', f'{p}_i', v, micro)},
    {p}_g AS (SELECT i.video_id, i.frame_index, i.{v}, i.i, h.hit, i.i - row_number() OVER (PARTITION BY i.video_id, h.hit ORDER BY i.i) AS island
      FROM {p}_i i JOIN {p}_h h USING (video_id, i)),
    {p}_r AS (SELECT *, hit AND count(*) OVER (PARTITION BY video_id, hit, island) <= {max_run} AS out FROM {p}_g),
    {p} AS (SELECT video_id, frame_index, out AS hit, CASE WHEN NOT out THEN {v} END AS {v} FROM {p}_r)"""


def filled_sql(p: str, src: str, v: str, micro: int = 7) -> str:
    return f"""{marked_sql(f'{p}_m', src, v, micro)},
    {p}_k AS (SELECT * FROM {p}_m WHERE {v} IS NOT NULL), {p}_z AS (SELECT * FROM {p}_m WHERE {v} IS NULL),
    {pchip_sql(f'{p}_f', f'{p}_k', f'{p}_z', (v,))},
    {p} AS (SELECT video_id, frame_index, {v} FROM {p}_f UNION ALL SELECT video_id, frame_index, {v} FROM {p}_k)"""


@query(
    "mirror_pad",
    "T6",
    f"""WITH {PREDS}, {FIRST}, s AS (SELECT video_id, round(x, 6) AS x, {_POS} FROM pf)
    SELECT video_id, i AS pos, x FROM s UNION ALL SELECT video_id, -i, x FROM s WHERE i BETWEEN 1 AND least(9, n - 1)
    UNION ALL SELECT video_id, 2 * (n - 1) - i, x FROM s WHERE i BETWEEN n - 1 - least(9, n - 1) AND n - 2""",
)
def _(spark, sf):
    return pick(S.mirror_pad(first(spark, sf).select(*FRAME, "x"), KEY, 9), "video_id", "pos", "x")


@query(
    "hampel_pass",
    "T7",
    f"""WITH {PREDS}, {FIRST}, s AS (SELECT video_id, frame_index, x, {_POS} FROM pf),
    s2 AS (SELECT *, least(3, (n - 1) // 2) AS k FROM s), {hampel_sql('h', 's2', 'x', 'k', 1.0)}
    SELECT s.video_id, s.frame_index, round(CASE WHEN n >= 3 THEN h.x ELSE s.x END, 6) AS x_clean, n >= 3 AND hit AS x_outlier
    FROM s JOIN h USING (video_id, i)""",
)
def _(spark, sf):
    out = S.hampel(first(spark, sf).select(*FRAME, "x"), KEY, "x", 3, 1.0)
    return pick(out, *FRAME, "x_clean", "x_outlier")


@query(
    "two_scale_hampel",
    "T8 U3",
    f"""WITH {PREDS}, {FIRST}, s AS (SELECT video_id, frame_index, x, {_POS} FROM pf), {two_scale_sql('h', 's', 'x')}
    SELECT s.video_id, s.frame_index, round(h.x, 6) AS x_clean, hit AS x_outlier FROM s JOIN h USING (video_id, i)""",
)
def _(spark, sf):
    out = S.two_scale_hampel(first(spark, sf).select(*FRAME, "x"), KEY, ["x"])
    return pick(out, *FRAME, "x_clean", "x_outlier")


@query(
    "hampel_then_pchip",
    "T9",
    f"""WITH {PREDS}, {FIRST}, s AS (SELECT video_id, frame_index, x FROM pf), {filled_sql('o', 's', 'x')}
    SELECT o.video_id, o.frame_index, round(o.x + {TIE}, 6) AS x, hit AS x_outlier
    FROM o JOIN o_m USING (video_id, frame_index)""",
)
def _(spark, sf):
    out = S.hampel_then_fill(first(spark, sf).select(*FRAME, "x"), KEY, ["x"])
    return pick(out, *FRAME, "x", "x_outlier", tie=TIE)


@query(
    "savgol",
    "T10",
    f"""WITH {PREDS}, {FIRST}, s0 AS (SELECT video_id, frame_index, x, y, {_POS} FROM pf),
    s AS (SELECT *, {window_sql('n', '7')} AS wl FROM s0), {poly_sql('o', 's', ('x', 'y'))}
    SELECT s.video_id, s.frame_index, round(o.x + {TIE}, 6) AS x, round(o.y + {TIE}, 6) AS y FROM o JOIN s USING (video_id, i)""",
)
def _(spark, sf):
    out = S.savgol(first(spark, sf).select(*FRAME, "x", "y"), KEY, ["x", "y"])
    return pick(out, *out.columns, tie=TIE)


@query(
    "adaptive_savgol",
    "T11",
    f"""WITH {PREDS}, {FIRST}, s AS (SELECT video_id, frame_index, x, y FROM pf), {adaptive_sql('o', 's', ('x', 'y'))}
    SELECT video_id, frame_index, round(x + {TIE}, 6) AS x, round(y + {TIE}, 6) AS y FROM o""",
)
def _(spark, sf):
    out = S.adaptive_savgol(first(spark, sf).select(*FRAME, "x", "y"), KEY, ["x", "y"])
    return pick(out, *out.columns, tie=TIE)


def two_scale_pair(p: str, src: str, micro: int) -> str:
    return f"""{p}_i AS (SELECT *, {_POS} FROM {src}), {two_scale_sql(f'{p}_w', f'{p}_i', 'w', micro)},
    {two_scale_sql(f'{p}_h', f'{p}_i', 'h', micro)},
    {p} AS (SELECT i.video_id, i.frame_index, a.w, b.h FROM {p}_i i JOIN {p}_w a USING (video_id, i) JOIN {p}_h b USING (video_id, i))"""


def center_sql(p: str, src: str) -> str:
    return f"""{filled_sql(f'{p}_x', src, 'cx')}, {filled_sql(f'{p}_y', src, 'cy')},
    {p}_j AS (SELECT video_id, frame_index, cx, cy FROM {p}_x JOIN {p}_y USING (video_id, frame_index)),
    {adaptive_sql(f'{p}_o', f'{p}_j', ('cx', 'cy'))},
    {p} AS (SELECT r.video_id, r.frame_index, CASE WHEN n > 2 THEN o.cx ELSE r.cx END AS cx, CASE WHEN n > 2 THEN o.cy ELSE r.cy END AS cy
      FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM {src}) r JOIN {p}_o o USING (video_id, frame_index))"""


def _r(*cols: str) -> str:
    return ", ".join(f"round({c} + {TIE}, 6) AS {c.split('.')[-1]}" for c in cols)


@query(
    "smooth_center",
    "T12",
    f"WITH {PREDS}, {FIRST}, {CEN}, {center_sql('c', 'cn')} SELECT video_id, frame_index, {_r('cx', 'cy')} FROM c",
)
def _(spark, sf):
    out = S.smooth_center(centers(spark, sf).select(*FRAME, "cx", "cy"), KEY)
    return pick(out, *out.columns, tie=TIE)


@query(
    "size_independent",
    "T13",
    f"""WITH {PREDS}, {FIRST}, {CEN}, sz AS (SELECT video_id, frame_index, w, h FROM cn), {two_scale_pair('p', 'sz', 5)},
    {adaptive_sql('o', 'p', ('w', 'h'))}
    SELECT video_id, frame_index, round(greatest(w, 1) + {TIE}, 6) AS w, round(greatest(h, 1) + {TIE}, 6) AS h FROM o""",
)
def _(spark, sf):
    out = S.size_independent(centers(spark, sf).select(*FRAME, "w", "h"), KEY)
    return pick(out, *out.columns, tie=TIE)


@query(
    "size_fixed_percentile",
    "T14",
    f"""WITH {PREDS}, {FIRST} SELECT video_id, frame_index, round(greatest(quantile_cont(w, 0.95) OVER p, 1), 6) AS w,
      round(greatest(quantile_cont(h, 0.95) OVER p, 1), 6) AS h FROM pf WINDOW p AS (PARTITION BY video_id)""",
)
def _(spark, sf):
    out = S.size_fixed(centers(spark, sf).select(*FRAME, "w", "h"), KEY)
    return pick(out, *out.columns)


_AREA = f"""ar AS (SELECT video_id, frame_index, w, h, coalesce(abs(w * h - lag(w * h) OVER v) / (lag(w * h) OVER v + 1e-9) > 0.2, false) AS bad
    FROM cn WINDOW v AS (PARTITION BY video_id ORDER BY frame_index)),
  ac AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY video_id) AS calm FROM ar),
  ak AS (SELECT video_id, frame_index, w, h FROM ac WHERE calm >= 3 AND NOT bad),
  az AS (SELECT video_id, frame_index FROM ac WHERE calm >= 3 AND bad), {pchip_sql('af', 'ak', 'az', ('w', 'h'))},
  am AS (SELECT video_id, frame_index, w, h FROM af UNION ALL SELECT video_id, frame_index, w, h FROM ak),
  {adaptive_sql('ao', 'am', ('w', 'h'))},
  fw AS (SELECT video_id, frame_index, w, h FROM ac WHERE calm < 3), {two_scale_pair('fp', 'fw', 5)},
  {adaptive_sql('fo', 'fp', ('w', 'h'))}"""


@query(
    "size_area_limit",
    "T15",
    f"""WITH {PREDS}, {FIRST}, {CEN}, {_AREA}
    SELECT video_id, frame_index, round(greatest(w, 1) + {TIE}, 6) AS w, round(greatest(h, 1) + {TIE}, 6) AS h
    FROM (SELECT * FROM ao UNION ALL SELECT * FROM fo)""",
)
def _(spark, sf):
    out = S.size_area_limit(centers(spark, sf).select(*FRAME, "w", "h"), KEY)
    return pick(out, *FRAME, "w", "h", tie=TIE)


def size_hampel_sql(p: str) -> str:
    return f"""{filled_sql(f'{p}w', 'cn', 'w', 5)}, {filled_sql(f'{p}h', 'cn', 'h', 5)},
    {p} AS (SELECT video_id, frame_index, greatest(w, 1) AS w, greatest(h, 1) AS h FROM {p}w JOIN {p}h USING (video_id, frame_index))"""


@query(
    "size_hampel_only",
    "T17",
    f"WITH {PREDS}, {FIRST}, {CEN}, {size_hampel_sql('z')} SELECT video_id, frame_index, {_r('w', 'h')} FROM z",
)
def _(spark, sf):
    out = S.size_hampel_only(centers(spark, sf).select(*FRAME, "w", "h"), KEY)
    return pick(out, *out.columns, tie=TIE)


@query(
    "filter_detections",
    "T18 T12 T17",
    f"""WITH {PREDS}, {FIRST}, {CEN}, {center_sql('c', 'cn')}, {size_hampel_sql('z')},
    j AS (SELECT c.video_id, c.frame_index, NOT is_fallback AS a, {', '.join(f'CASE WHEN NOT is_fallback THEN 0.3 * cn.{v} + 0.7 * {t}.{v} ELSE {t}.{v} END AS {v}' for v, t in (('cx', 'c'), ('cy', 'c'), ('w', 'z'), ('h', 'z')))}
      FROM c JOIN z USING (video_id, frame_index) JOIN cn USING (video_id, frame_index))
    SELECT video_id, frame_index, {_r('cx', 'cy', 'w', 'h')} FROM j""",
)
def _(spark, sf):
    out = S.filter_detections(
        centers(spark, sf), KEY, "hampel_only", anchor=~F.col("is_fallback"), anchor_keep=0.3
    )
    return pick(out, *FRAME, "cx", "cy", "w", "h", tie=TIE)


_GCEN = "gc AS (SELECT video_id, frame_index, x + w / 2 AS cx, y + h / 2 AS cy, w, h FROM g1)"


@query(
    "dense_smoothed_annotations",
    "T23 J10",
    f"""WITH {GT}, {GT1}, {_GCEN}, ok AS (SELECT video_id, min(frame_index) AS a, max(frame_index) AS b FROM g1 GROUP BY 1 HAVING count(*) >= 4),
    sp AS (SELECT video_id, CAST(unnest(range(a, b + 1)) AS INTEGER) AS frame_index FROM ok),
    mi AS (SELECT * FROM sp ANTI JOIN gc USING (video_id, frame_index)), kn AS (SELECT * FROM gc SEMI JOIN ok USING (video_id)),
    {pchip_sql('f', 'kn', 'mi', ('cx', 'cy', 'w', 'h'))},
    u AS (SELECT video_id, frame_index, cx, cy, greatest(w, 1) AS w, greatest(h, 1) AS h FROM f UNION ALL SELECT video_id, frame_index, cx, cy, w, h FROM kn),
    s0 AS (SELECT *, {_POS} FROM u), s AS (SELECT *, {window_sql('n', '5')} AS wl FROM s0), {poly_sql('o', 's', ('cx', 'cy', 'w', 'h'))},
    r AS (SELECT s.video_id, s.frame_index, o.cx, o.cy, greatest(o.w, 1) AS w, greatest(o.h, 1) AS h FROM o JOIN s USING (video_id, i))
    SELECT video_id, frame_index, round(cx - w / 2 + {TIE}, 6) AS x, round(cy - h / 2 + {TIE}, 6) AS y, {_r('w', 'h')} FROM r""",
)
def _(spark, sf):
    out = S.dense_smoothed(gt(spark, sf), KEY)
    return pick(out, *out.columns, tie=TIE)


@query(
    "gaussian_smoothing",
    "T25",
    f"""WITH {PREDS}, {FIRST}, s AS (SELECT video_id, frame_index, x, y, {_POS} FROM pf),
    k AS (SELECT o, exp(-0.5 * (o / 1.25) * (o / 1.25)) AS k FROM range(-4, 5) t(o)),
    kk AS (SELECT o, k / (SELECT sum(k) FROM k) AS k FROM k),
    w AS (SELECT a.video_id, a.frame_index, sum(kk.k * b.x) AS x, sum(kk.k * b.y) AS y FROM s a, kk, s b
      WHERE b.video_id = a.video_id AND b.i = least(greatest(a.i + o, 0), a.n - 1) AND a.n >= 3 GROUP BY 1, 2)
    SELECT video_id, frame_index, {_r('x', 'y')} FROM w UNION ALL SELECT video_id, frame_index, {_r('x', 'y')} FROM s WHERE n < 3""",
)
def _(spark, sf):
    out = S.gaussian(first(spark, sf).select(*FRAME, "x", "y"), KEY, ["x", "y"])
    return pick(out, *out.columns, tie=TIE)
