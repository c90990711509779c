"""Reconstruction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.operators import dedup as D
from framelane.operators import reconstruct as C
from framelane.plans.fixtures import FIRST, KEY, PREDS, gt, preds
from framelane.plans.q_features import SHAPE
from framelane.plans.q_smooth import adaptive_sql, centers, first
from framelane.plans.registry import TIE, pick, query

FRAME = ["video_id", "frame_index"]


def tridiagonal_sql(p: str, src: str, key: str) -> str:
    """Solve ``src(key, k, lo, di, up, rhs, last)``, k from 1 to last, by recursion over k; gives ``p(key, k, m)``."""
    on = " AND ".join(f"s.{c} = f.{c}" for c in key.split(", "))
    cols = ", ".join(f"s.{c}" for c in key.split(", "))
    return f"""{p}_f AS (SELECT {key}, k, last, up / di AS cp, rhs / di AS dp FROM {src} WHERE k = 1
      UNION ALL SELECT {cols}, s.k, s.last, s.up / (s.di - s.lo * f.cp), (s.rhs - s.lo * f.dp) / (s.di - s.lo * f.cp)
      FROM {p}_f f JOIN {src} s ON {on} AND s.k = f.k + 1),
    {p} AS (SELECT {key}, k, dp AS m FROM {p}_f WHERE k = last
      UNION ALL SELECT {cols}, s.k, s.dp - s.cp * f.m FROM {p} f JOIN {p}_f s ON {on} AND s.k = f.k - 1)"""


#: Pieces of the cubic splines through ``kn(video_id, ch, t, v)``, first two and last two pieces one cubic each; ``pc`` has one row per piece.
SPLINE = f"""ks AS MATERIALIZED (SELECT *, row_number() OVER o - 1 AS k, count(*) OVER (PARTITION BY video_id, ch) AS n, t - lag(t) OVER o AS h0, lead(t) OVER o - t AS h1,
      lead(t) OVER o AS t1, lead(v) OVER o AS v1, (lead(v) OVER o - v) / (lead(t) OVER o - t) - (v - lag(v) OVER o) / (t - lag(t) OVER o) AS bend
      FROM kn WINDOW o AS (PARTITION BY video_id, ch ORDER BY t)),
    sy AS MATERIALIZED (SELECT video_id, ch, k, n - 2 AS last, 6 * bend AS rhs,
      CASE WHEN k = 1 THEN 0 WHEN k = n - 2 THEN h0 - h1 * h1 / h0 ELSE h0 END AS lo,
      2 * (h0 + h1) + CASE WHEN k = 1 THEN h0 * (1 + h0 / h1) ELSE 0 END + CASE WHEN k = n - 2 THEN h1 * (1 + h1 / h0) ELSE 0 END AS di,
      CASE WHEN k = n - 2 THEN 0 WHEN k = 1 THEN h1 - h0 * h0 / h1 ELSE h1 END AS up FROM ks WHERE n >= 4 AND k BETWEEN 1 AND n - 2),
    {tridiagonal_sql("mi", "sy", "video_id, ch")},
    ma AS (SELECT video_id, ch, k, m FROM mi
      UNION ALL SELECT a.video_id, a.ch, 0, a.m + (a.m - b.m) * h0 / h1 FROM mi a JOIN mi b USING (video_id, ch) JOIN ks USING (video_id, ch)
        WHERE a.k = 1 AND b.k = 2 AND ks.k = 1
      UNION ALL SELECT a.video_id, a.ch, n - 1, a.m + (a.m - b.m) * h1 / h0 FROM mi a JOIN mi b USING (video_id, ch) JOIN ks USING (video_id, ch)
        WHERE a.k = n - 2 AND b.k = n - 3 AND ks.k = n - 2),
    pc AS MATERIALIZED (SELECT ks.video_id, ks.ch, ks.k, n, t AS t0, t1, v AS y, coalesce(p.m, 0) / 2 AS c, (coalesce(q.m, 0) - coalesce(p.m, 0)) / (6 * h1) AS b,
      (v1 - v) / h1 - h1 * (2 * coalesce(p.m, 0) + coalesce(q.m, 0)) / 6 AS d
      FROM ks LEFT JOIN ma p ON p.video_id = ks.video_id AND p.ch = ks.ch AND p.k = ks.k
      LEFT JOIN ma q ON q.video_id = ks.video_id AND q.ch = ks.ch AND q.k = ks.k + 1 WHERE ks.k < n - 1)"""


@query(
    "cubic_fill",
    "T2 T4",
    f"""WITH RECURSIVE {PREDS}, {FIRST}, r AS (SELECT video_id, frame_index, CAST(frame_index AS DOUBLE) AS t, CASE WHEN coalesce(score, 0) >= 0.3 THEN x END AS x FROM pf),
    kn AS (SELECT video_id, 'x' AS ch, t, x AS v FROM r WHERE x IS NOT NULL), {SPLINE},
    e AS (SELECT video_id, count(*) AS n, min(v) AS lo, max(v) AS hi FROM kn GROUP BY 1),
    u AS (SELECT r.*, coalesce(g.k, 0) AS k FROM r ASOF LEFT JOIN pc g ON r.video_id = g.video_id AND r.t >= g.t0),
    f AS (SELECT u.*, e.n, lo, hi, y, c, b, d, CASE WHEN e.n < 4 THEN least(greatest(u.t, t0), t1) ELSE u.t END - t0 AS z
      FROM u LEFT JOIN e USING (video_id) LEFT JOIN pc USING (video_id, k))
    SELECT video_id, frame_index, round(CASE WHEN x IS NOT NULL THEN x WHEN n IS NULL THEN 0 WHEN n = 1 THEN lo
      ELSE least(greatest(y + z * (d + z * (c + z * b)), lo), hi) END, 6) AS x FROM f""",
)
def _(spark, sf):
    df = first(spark, sf).select(*FRAME, F.when(F.coalesce("score", F.lit(0.0)) >= 0.3, F.col("x")).alias("x"))
    return pick(C.cubic_fill(df, KEY, ["x"], F.col("x").isNotNull()), *FRAME, "x")


@query(
    "spline_gaps",
    "T24 D5",
    f"""WITH RECURSIVE {PREDS}, best AS (SELECT * FROM preds QUALIFY row_number() OVER (PARTITION BY video_id, frame_index ORDER BY score DESC NULLS LAST, pos) = 1),
    kn AS (SELECT video_id, ch, CAST(frame_index AS DOUBLE) AS t, v FROM (SELECT video_id, frame_index, x, y, w, h, coalesce(score, 0.6) AS s FROM best) UNPIVOT (v FOR ch IN (x, y, w, h, s))),
    {SPLINE}, g AS (SELECT video_id, ch, unnest(range(CAST(t0 AS INTEGER) + 1, CAST(t1 AS INTEGER))) AS frame_index, t0, y, c, b, d FROM pc WHERE t1 - t0 > 1 AND t1 - t0 <= 20),
    z AS (SELECT video_id, CAST(frame_index AS INTEGER) AS frame_index, ch, y + (frame_index - t0) * (d + (frame_index - t0) * (c + (frame_index - t0) * b)) AS v FROM g),
    sc AS (SELECT video_id, count(score) > 0 AS scored FROM best GROUP BY 1),
    n AS (SELECT video_id, frame_index, max(v) FILTER (WHERE ch = 'x') AS x, max(v) FILTER (WHERE ch = 'y') AS y, max(v) FILTER (WHERE ch = 'w') AS w,
      max(v) FILTER (WHERE ch = 'h') AS h, max(v) FILTER (WHERE ch = 's') AS s FROM z GROUP BY 1, 2)
    SELECT video_id, frame_index, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, round(score, 6) AS score, false AS filled FROM best
    UNION ALL SELECT video_id, frame_index, round(x, 6), round(y, 6), round(w, 6), round(h, 6),
      CASE WHEN scored THEN round(least(greatest(s, 0), 1), 6) END, true FROM n JOIN sc USING (video_id)""",
)
def _(spark, sf):
    out = C.spline_gaps(preds(spark, sf), KEY)
    return pick(out, *FRAME, "x", "y", "w", "h", "score", "filled")


def local_fit_sql(p: str, src: str) -> str:
    """One pass of locally weighted lines on ``src(video_id, t, x, n, h, mean, rw)``; ``p`` adds ``fit`` and the next weights ``rw``."""
    return f"""{p}_s AS (SELECT a.video_id, a.t, a.x, a.n, a.h, a.mean, b.t - a.t AS u, b.x AS bx, pow(1 - pow(least(abs(b.t - a.t) / a.h, 1), 3), 3) * b.rw AS w
      FROM {src} a JOIN {src} b USING (video_id)),
    {p}_m AS (SELECT video_id, t, x, n, h, mean, count(*) FILTER (WHERE w > 1e-12) AS used, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2,
      sum(w * bx) AS b0, sum(w * u * bx) AS b1 FROM {p}_s GROUP BY ALL),
    {p}_f AS (SELECT video_id, t, x, n, h, mean, CASE WHEN used < 2 THEN mean WHEN s0 * s2 - s1 * s1 > 1e-14 * s0 * s2
      THEN (s2 * b0 - s1 * b1) / (s0 * s2 - s1 * s1) ELSE b0 / s0 END AS fit FROM {p}_m),
    {p}_c AS (SELECT video_id, median(x - fit) AS mid FROM {p}_f GROUP BY 1),
    {p}_d AS (SELECT video_id, median(abs(x - fit - mid)) AS mad FROM {p}_f JOIN {p}_c USING (video_id) GROUP BY 1),
    {p} AS MATERIALIZED (SELECT {p}_f.*, CASE WHEN abs(x - fit) < (mad * 1.4826 + 1e-6) * 6
      THEN pow(1 - pow((x - fit) / ((mad * 1.4826 + 1e-6) * 6), 2), 2) ELSE 0 END AS rw FROM {p}_f JOIN {p}_d USING (video_id))"""


@query(
    "lowess_residuals",
    "T26",
    f"""WITH {PREDS}, {FIRST}, r AS (SELECT video_id, frame_index AS t, x, count(*) OVER v AS n, avg(x) OVER v AS mean FROM pf WINDOW v AS (PARTITION BY video_id)),
    hs AS (SELECT a.video_id, a.t, abs(b.t - a.t) AS h, least(a.n, greatest(4, CAST(ceil(a.n * 0.5) AS BIGINT))) AS reach,
      row_number() OVER (PARTITION BY a.video_id, a.t ORDER BY abs(b.t - a.t)) AS place FROM r a JOIN r b USING (video_id)),
    l0 AS MATERIALIZED (SELECT r.*, CASE WHEN h > 1e-12 THEN h ELSE 1 END AS h, 1::DOUBLE AS rw FROM r JOIN hs USING (video_id, t) WHERE place = reach),
    {local_fit_sql("l1", "l0")}, {local_fit_sql("l2", "l1")}, {local_fit_sql("l3", "l2")}
    SELECT video_id, t AS frame_index, round(x, 6) AS x, round(CASE WHEN n < 4 THEN x ELSE fit END, 6) AS fit,
      round(CASE WHEN n < 4 THEN 0 ELSE abs(x - fit) END, 6) AS residual FROM l3""",
)
def _(spark, sf):
    out = C.lowess(first(spark, sf).select(*FRAME, "x"), KEY, "x")
    return pick(out, *FRAME, "x", "fit", "residual")


@query(
    "anomaly_flags",
    "T27 T32",
    f"""WITH {PREDS}, {FIRST}, a AS (SELECT video_id, frame_index, NOT is_fallback AS seen, greatest(w - 30, h - 20, coalesce(score * 10, 0)) AS a FROM pf),
    b AS (SELECT *, a / max(a) OVER (PARTITION BY video_id) AS anomaly FROM a), q AS (SELECT video_id, quantile_cont(anomaly, 0.8) AS q FROM b WHERE seen GROUP BY 1)
    SELECT video_id, frame_index, round(anomaly, 6) AS anomaly, (seen AND anomaly >= q) OR NOT seen AS flagged FROM b LEFT JOIN q USING (video_id)""",
)
def _(spark, sf):
    df = first(spark, sf).select(
        *FRAME, (~F.col("is_fallback")).alias("seen"), (F.col("w") - 30).alias("r1"), (F.col("h") - 20).alias("r2"), (F.col("score") * 10).alias("r3")
    )
    return pick(C.anomaly_flags(df, KEY, ["r1", "r2", "r3"], "seen"), *FRAME, "anomaly", "flagged")


@query(
    "regression_features",
    "T28",
    f"""WITH {PREDS}, {FIRST}, {SHAPE}, a AS (SELECT video_id, frame_index, w, h, coalesce(cx - lag(cx) OVER v, 0) AS dx_prev, coalesce(cy - lag(cy) OVER v, 0) AS dy_prev,
      coalesce(frame_index - lag(frame_index) OVER v, 1)::DOUBLE AS dt_prev FROM sh WINDOW v AS (PARTITION BY video_id ORDER BY frame_index)),
    b AS (SELECT *, dx_prev / greatest(dt_prev, 1) AS vx, dy_prev / greatest(dt_prev, 1) AS vy FROM a)
    SELECT video_id, frame_index, round(dx_prev, 6) AS dx_prev, round(dy_prev, 6) AS dy_prev, dt_prev, round(vx, 6) AS vx, round(vy, 6) AS vy,
      round(coalesce((vx - lag(vx) OVER v) / greatest(dt_prev, 1), 0), 6) AS ax, round(coalesce((vy - lag(vy) OVER v) / greatest(dt_prev, 1), 0), 6) AS ay,
      round(cos(atan2(vy, vx + 1e-12)), 6) AS heading_cos, round(sin(atan2(vy, vx + 1e-12)), 6) AS heading_sin, w, h FROM b WINDOW v AS (PARTITION BY video_id ORDER BY frame_index)""",
)
def _(spark, sf):
    out = C.regression_features(centers(spark, sf).select(*FRAME, "cx", "cy", "w", "h"), KEY)
    return pick(out, *FRAME, *C.MOTION)


@query(
    "positions_from_increments",
    "T29",
    f"""WITH RECURSIVE {PREDS}, {FIRST}, r AS (SELECT video_id, frame_index, x + w / 2 AS cx, (pos * 13) % 21 - 10 AS move, pos % 4 = 0 AS trusted FROM pf),
    q AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY video_id) AS last, lead(move) OVER o AS ahead,
      frame_index = coalesce(min(frame_index) FILTER (WHERE trusted) OVER (PARTITION BY video_id), min(frame_index) OVER (PARTITION BY video_id)) AS anchor
      FROM r WINDOW o AS (PARTITION BY video_id ORDER BY frame_index)),
    e AS MATERIALIZED (SELECT video_id, frame_index, cx, move, trusted, k, last, CASE WHEN k > 1 THEN -1 ELSE 0 END AS lo, CASE WHEN k < last THEN -1 ELSE 0 END AS up,
      (CASE WHEN k > 1 THEN 1 ELSE 0 END + CASE WHEN k < last THEN 1 ELSE 0 END + CASE WHEN trusted THEN 4 ELSE 0 END + CASE WHEN anchor THEN 1 ELSE 0 END)::DOUBLE AS di,
      CASE WHEN k > 1 THEN move ELSE 0 END - CASE WHEN k < last THEN ahead ELSE 0 END + (CASE WHEN trusted THEN 4 ELSE 0 END + CASE WHEN anchor THEN 1 ELSE 0 END) * cx AS rhs FROM q),
    {tridiagonal_sql("sol", "e", "video_id")}
    SELECT video_id, frame_index, round(cx, 6) AS cx, move::DOUBLE AS move, trusted, round(m, 6) AS out FROM e JOIN sol USING (video_id, k)""",
)
def _(spark, sf):
    """The whole least squares system of every row against the solution on trusted rows only."""
    df = centers(spark, sf).withColumn("move", ((F.col("pos") * 13) % 21 - 10).cast("double"))
    df = df.withColumn("trusted", F.col("pos") % 4 == 0)
    out = C.from_increments(df.select(*FRAME, "cx", "move", "trusted"), KEY, "cx", "move", "trusted", "out")
    return pick(out, *FRAME, "cx", "move", "trusted", "out")


def _filled(c: str, empty: str) -> str:
    return f"""coalesce(last_value(t{c} IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(t{c} IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), {empty}) AS {c}"""


@query(
    "local_repair",
    "T31",
    f"""WITH RECURSIVE {PREDS}, {FIRST},
    rw AS (SELECT video_id, frame_index, CASE WHEN pos % 11 <> 0 THEN x + w / 2 END AS cx, CASE WHEN pos % 11 <> 0 THEN y + h / 2 END AS cy,
      CASE WHEN pos % 11 <> 0 THEN w END AS w, CASE WHEN pos % 11 <> 0 THEN h END AS h, pos % 11 <> 0 AND NOT is_fallback AS seen FROM pf),
    un AS (SELECT video_id * 4 + CASE ch WHEN 'cx' THEN 0 WHEN 'cy' THEN 1 WHEN 'w' THEN 2 ELSE 3 END AS video_id, frame_index AS t, x FROM rw UNPIVOT (x FOR ch IN (cx, cy, w, h))),
    r AS (SELECT *, count(*) OVER v AS n, avg(x) OVER v AS mean FROM un WINDOW v AS (PARTITION BY video_id)),
    hs AS (SELECT a.video_id, a.t, abs(b.t - a.t) AS h, least(a.n, greatest(4, CAST(ceil(a.n * 0.5) AS BIGINT))) AS reach,
      row_number() OVER (PARTITION BY a.video_id, a.t ORDER BY abs(b.t - a.t)) AS place FROM r a JOIN r b USING (video_id)),
    l0 AS MATERIALIZED (SELECT r.*, CASE WHEN h > 1e-12 THEN h ELSE 1 END AS h, 1::DOUBLE AS rw FROM r JOIN hs USING (video_id, t) WHERE place = reach),
    {local_fit_sql("l1", "l0")}, {local_fit_sql("l2", "l1")}, {local_fit_sql("l3", "l2")},
    rs AS (SELECT video_id // 4 AS video_id, t AS frame_index, max(CASE WHEN n < 4 THEN 0 ELSE abs(x - fit) END) AS a FROM l3 GROUP BY 1, 2),
    an AS (SELECT rw.*, coalesce(a, 0) / greatest(max(coalesce(a, 0)) OVER (PARTITION BY rw.video_id), 1e-300) AS anomaly FROM rw LEFT JOIN rs USING (video_id, frame_index)),
    qs AS (SELECT video_id, quantile_cont(anomaly, 0.8) AS q, max(anomaly) AS top FROM an WHERE seen GROUP BY 1),
    fl AS (SELECT an.*, NOT seen OR coalesce(top > 0 AND anomaly >= q, false) AS flagged FROM an LEFT JOIN qs USING (video_id)),
    ta AS (SELECT video_id, frame_index, anomaly, flagged, CASE WHEN NOT flagged THEN cx END AS tcx, CASE WHEN NOT flagged THEN cy END AS tcy,
      CASE WHEN NOT flagged THEN w END AS tw, CASE WHEN NOT flagged THEN h END AS th FROM fl),
    ct AS (SELECT video_id, frame_index, anomaly, flagged, tcx, tcy, {_filled("cx", "0.5")}, {_filled("cy", "0.5")}, {_filled("w", "1")}, {_filled("h", "1")} FROM ta),
    mv AS (SELECT video_id * 2 AS id, frame_index, flagged, coalesce(tcx, 0) AS v, coalesce(cx - lag(cx) OVER o, 0) AS move FROM ct WINDOW o AS (PARTITION BY video_id ORDER BY frame_index)
      UNION ALL SELECT video_id * 2 + 1, frame_index, flagged, coalesce(tcy, 0), coalesce(cy - lag(cy) OVER o, 0) FROM ct WINDOW o AS (PARTITION BY video_id ORDER BY frame_index)),
    q0 AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY id) AS last, lead(move) OVER o AS ahead,
      frame_index = coalesce(min(frame_index) FILTER (WHERE NOT flagged) OVER (PARTITION BY id), min(frame_index) OVER (PARTITION BY id)) AS anchor
      FROM mv WINDOW o AS (PARTITION BY id ORDER BY frame_index)),
    e AS MATERIALIZED (SELECT id, frame_index, k, last, CASE WHEN k > 1 THEN -1 ELSE 0 END AS lo, CASE WHEN k < last THEN -1 ELSE 0 END AS up,
      (CASE WHEN k > 1 THEN 1 ELSE 0 END + CASE WHEN k < last THEN 1 ELSE 0 END + CASE WHEN flagged THEN 0 ELSE 4 END + CASE WHEN anchor THEN 1 ELSE 0 END)::DOUBLE AS di,
      CASE WHEN k > 1 THEN move ELSE 0 END - CASE WHEN k < last THEN ahead ELSE 0 END + (CASE WHEN flagged THEN 0 ELSE 4 END + CASE WHEN anchor THEN 1 ELSE 0 END) * v AS rhs FROM q0),
    {tridiagonal_sql("sol", "e", "id")},
    po AS (SELECT id // 2 AS video_id, frame_index, max(m) FILTER (WHERE id % 2 = 0) AS cx, max(m) FILTER (WHERE id % 2 = 1) AS cy FROM e JOIN sol USING (id, k) GROUP BY 1, 2),
    sm AS MATERIALIZED (SELECT po.video_id, po.frame_index, po.cx, po.cy, greatest(w, 1) AS w, greatest(h, 1) AS h FROM po JOIN ct USING (video_id, frame_index)),
    {adaptive_sql("o", "sm", ("cx", "cy", "w", "h"), 5)}
    SELECT o.video_id, o.frame_index, round(o.cx + {TIE}, 6) AS cx, round(o.cy + {TIE}, 6) AS cy, round(greatest(o.w, 1) + {TIE}, 6) AS w,
      round(greatest(o.h, 1) + {TIE}, 6) AS h, round(anomaly + {TIE}, 6) AS anomaly, flagged FROM o JOIN ct USING (video_id, frame_index)""",
)
def _(spark, sf):
    """Motion learnt on the annotations; a linear model reproduces a context row's own step and size, as the SQL states."""
    box = ["cx", "cy", "w", "h"]
    truth = D.first_per_frame(gt(spark, sf), FRAME)
    truth = truth.select(*FRAME, (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), "w", "h")
    rows = centers(spark, sf).withColumns({c: F.when(F.col("pos") % 11 != 0, F.col(c)) for c in box})
    out = C.local_repair(rows, KEY, C.fit_motion(truth, KEY), ~F.col("is_fallback"))
    return pick(out, *FRAME, *box, "anomaly", "flagged", tie=TIE)
