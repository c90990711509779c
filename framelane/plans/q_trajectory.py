"""Ordered work per trajectory: missing values, runs, samples, gap filling, repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.operators import dedup as D
from framelane.operators import frames as R
from framelane.operators import interpolate as I
from framelane.plans.fixtures import (
    BEST,
    DETECT,
    FIRST,
    GT,
    GT1,
    KEY,
    PREDS,
    dedup_sql,
    gt,
    pchip_sql,
    preds,
)
from framelane.plans.registry import TIE, pick, query

FRAME = ["video_id", "frame_index"]
BOX = ("x", "y", "w", "h")
_W = "(PARTITION BY video_id ORDER BY frame_index)"
_R = ", ".join(f"round({c} + {TIE}, 6) AS {c}" for c in BOX)


def first(spark, sf):
    return D.first_per_frame(preds(spark, sf), FRAME)


@query(
    "mask_unobserved",
    "D6 P21",
    f"""WITH {PREDS}, {FIRST} SELECT video_id, frame_index, CASE WHEN NOT is_fallback AND w > 0 AND h > 0 THEN round(x, 6) END AS x,
    CASE WHEN NOT is_fallback AND w > 0 AND h > 0 THEN round(y, 6) END AS y FROM pf""",
)
def _(spark, sf):
    from framelane.functions import geometry as G

    df = first(spark, sf)
    seen = G.observed(*[F.col(c) for c in BOX]) & ~F.col("is_fallback")
    return pick(R.mask_unobserved(df, ["x", "y"], seen), *FRAME, "x", "y")


@query(
    "fill_edges",
    "D7",
    f"""WITH {PREDS}, {FIRST} SELECT video_id, frame_index, round(coalesce(score, lag(score IGNORE NULLS) OVER w,
      lead(score IGNORE NULLS) OVER w, 0), 6) AS score FROM pf WINDOW w AS {_W}""",
)
def _(spark, sf):
    return pick(R.fill_edges(first(spark, sf), KEY, ["score"]), *FRAME, "score")


@query(
    "hold_last_box",
    "D8 ST3",
    f"""WITH {PREDS}, {FIRST}, b AS (SELECT *, CASE WHEN NOT is_fallback THEN x END AS bx FROM pf)
    SELECT video_id, frame_index, round(coalesce(bx, lag(bx IGNORE NULLS) OVER w), 6) AS x,
      bx IS NULL AND lag(bx IGNORE NULLS) OVER w IS NOT NULL AS held FROM b WINDOW w AS {_W}""",
)
def _(spark, sf):
    df = first(spark, sf).withColumn("box", F.when(~F.col("is_fallback"), F.struct(*BOX)))
    out = R.hold_last(df, KEY, "box")
    return pick(out.select(*FRAME, F.col("box.x").alias("x"), "held"), *FRAME, "x", "held")


@query(
    "split_chunks",
    "D9",
    f"""WITH {PREDS}, f AS (SELECT *, lag(fr) OVER (PARTITION BY video_id ORDER BY pos) AS pf FROM
      (SELECT video_id, pos, (frame_index * 7) % 40 AS fr FROM preds))
    SELECT video_id, pos, CAST(sum(CASE WHEN fr < pf THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY pos) AS BIGINT)
      AS chunk FROM f""",
)
def _(spark, sf):
    df = preds(spark, sf).select("video_id", "pos", ((F.col("frame_index") * 7) % 40).alias("frame_index"))
    return R.chunks(df, KEY).select("video_id", "pos", "chunk")


_LOW = f"""f AS (SELECT *, row_number() OVER {_W} - 1 AS p, coalesce(score, 1) < 0.5 AS low FROM pf),
  s AS (SELECT *, p - row_number() OVER (PARTITION BY video_id, low ORDER BY frame_index) AS island FROM f)"""


@query(
    "low_score_runs",
    "D10",
    f"""WITH {PREDS}, {FIRST}, {_LOW} SELECT video_id, min(p) AS start, max(p) + 1 AS stop FROM s WHERE low
    GROUP BY video_id, island""",
)
def _(spark, sf):
    return R.runs(first(spark, sf), KEY, F.coalesce("score", F.lit(1.0)) < 0.5)


@query(
    "drop_long_runs",
    "D11",
    f"""WITH {PREDS}, {FIRST}, {_LOW} SELECT video_id, frame_index,
      low AND count(*) OVER (PARTITION BY video_id, low, island) <= 2 AS low FROM s""",
)
def _(spark, sf):
    df = first(spark, sf).select(*FRAME, (F.coalesce("score", F.lit(1.0)) < 0.5).alias("low"))
    return R.drop_long_runs(df, KEY, "low", 2)


@query(
    "longest_low_streak",
    "A30",
    f"""WITH {PREDS}, {FIRST}, {_LOW}, r AS (SELECT video_id, low, count(*) AS n FROM s GROUP BY video_id, low, island)
    SELECT video_id, coalesce(max(n) FILTER (WHERE low), 0) AS longest_run FROM r GROUP BY video_id""",
)
def _(spark, sf):
    return R.longest_run(first(spark, sf), KEY, F.coalesce("score", F.lit(1.0)) < 0.5)


@query(
    "even_sample",
    "D12",
    f"""WITH {PREDS}, {FIRST}, f AS (SELECT video_id, frame_index, row_number() OVER {_W} - 1 AS p,
      count(*) OVER (PARTITION BY video_id) AS n FROM pf)
    SELECT video_id, frame_index FROM f WHERE n <= 8 OR p = n - 1 OR p IN (
      SELECT CAST(round_even(i * ((n - 1) / CAST(7 AS DOUBLE)), 0) AS BIGINT) FROM range(8) t(i))""",
)
def _(spark, sf):
    return R.even_sample(first(spark, sf), KEY, 8).select(*FRAME)


@query(
    "top_scored_frames",
    "D13 O2",
    f"""WITH {PREDS}, {FIRST} SELECT video_id, frame_index, round(score, 6) AS score FROM pf
    QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC NULLS LAST, frame_index) <= 5""",
)
def _(spark, sf):
    out = R.top_k(first(spark, sf), KEY, [F.col("score").desc_nulls_last(), F.col("frame_index")], 5)
    return pick(out, *FRAME, "score")


_SPINE = """sp AS (SELECT video_id, CAST(unnest(range(a, b + 1)) AS INTEGER) AS frame_index FROM
  (SELECT video_id, min(frame_index) AS a, max(frame_index) AS b FROM pf GROUP BY video_id))"""


@query(
    "dense_spine",
    "J10",
    f"""WITH {PREDS}, {FIRST}, {_SPINE} SELECT video_id, frame_index, round(x, 6) AS x
    FROM sp LEFT JOIN pf USING (video_id, frame_index)""",
)
def _(spark, sf):
    return pick(R.on_spine(first(spark, sf).select(*FRAME, "x"), KEY), *FRAME, "x")


@query(
    "asof_known_frames",
    "J11",
    f"""WITH {PREDS}, {FIRST}, {_SPINE}, k AS (SELECT video_id, frame_index, CASE WHEN x IS NOT NULL THEN frame_index END AS kf
      FROM sp LEFT JOIN pf USING (video_id, frame_index)),
    b AS (SELECT *, lag(kf IGNORE NULLS) OVER w AS left_known, lead(kf IGNORE NULLS) OVER w AS right_known
      FROM k WINDOW w AS {_W})
    SELECT video_id, frame_index, left_known, right_known, coalesce(right_known - left_known <= 3, false) AS fillable
    FROM b WHERE kf IS NULL""",
)
def _(spark, sf):
    rows = R.on_spine(first(spark, sf).select(*FRAME, "x"), KEY)
    out = I.bracket(rows, KEY, F.col("x").isNotNull(), 3)
    return out.select(*FRAME, "left_known", "right_known", "fillable")


@query(
    "rolling_window",
    "J12",
    f"""WITH {PREDS}, {FIRST} SELECT video_id, frame_index, round(avg(x) OVER w, 6) AS mean_x, min(y) OVER w AS min_y,
      count(score) OVER w AS n FROM pf
    WINDOW w AS (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def _(spark, sf):
    out = R.rolling(
        first(spark, sf), KEY, 3,
        {"mean_x": F.avg("x"), "min_y": F.min("y"), "n": F.count("score")},
    )
    return out.select(*FRAME, F.round("mean_x", 6).alias("mean_x"), "min_y", "n")


_NULLED = "nz AS (SELECT * FROM pf WHERE score IS NULL OR score < 0.3), kz AS (SELECT * FROM pf WHERE score >= 0.3)"


@query(
    "pchip_fill_nulls",
    "T1 T5 T16",
    f"""WITH {PREDS}, {FIRST}, {_NULLED}, {pchip_sql('f', 'kz', 'nz', ('x',))}
    SELECT video_id, frame_index, round(x + {TIE}, 6) AS x FROM f UNION ALL
    SELECT video_id, frame_index, round(x + {TIE}, 6) AS x FROM kz""",
)
def _(spark, sf):
    df = first(spark, sf).withColumn("x", F.when(F.col("score") >= 0.3, F.col("x")))
    return pick(I.fill_nulls(df, KEY, "x"), *FRAME, "x", tie=TIE)


@query(
    "linear_fill_nulls",
    "T3 T4",
    f"""WITH {PREDS}, {FIRST}, {_NULLED}, b AS (
      SELECT z.video_id, z.frame_index, l.frame_index AS t0, l.y AS y0 FROM nz z ASOF LEFT JOIN kz l
        ON z.video_id = l.video_id AND z.frame_index >= l.frame_index),
    c AS (SELECT b.*, r.frame_index AS t1, r.y AS y1 FROM b ASOF LEFT JOIN kz r
        ON b.video_id = r.video_id AND b.frame_index <= r.frame_index)
    SELECT video_id, frame_index, round(CASE WHEN t0 IS NULL AND t1 IS NULL THEN 0 WHEN t0 IS NULL THEN y1
      WHEN t1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (frame_index - t0) / (t1 - t0) END, 6) AS y FROM c
    UNION ALL SELECT video_id, frame_index, round(y, 6) FROM kz""",
)
def _(spark, sf):
    df = first(spark, sf).withColumn("y", F.when(F.col("score") >= 0.3, F.col("y")))
    return pick(I.fill_nulls(df, KEY, "y", kind="linear"), *FRAME, "y")


@query(
    "fill_gaps",
    "T19 D2 J11 O3",
    f"""WITH {PREDS}, {DETECT}, g AS (SELECT video_id, frame_index, lead(frame_index) OVER {_W} AS nx FROM pd),
    q AS (SELECT video_id, CAST(unnest(range(frame_index + 1, nx)) AS INTEGER) AS frame_index FROM g
          WHERE nx - frame_index > 1 AND nx - frame_index <= 4),
    {pchip_sql('f', 'pd', 'q', BOX)}
    SELECT video_id, frame_index, {_R}, CAST(NULL AS DOUBLE) AS score, true AS is_fallback,
      'interpolated_pchip' AS bbox_source FROM f
    UNION ALL SELECT video_id, frame_index, {_R}, round(score + {TIE}, 6), is_fallback, 'detector' FROM pd""",
)
def _(spark, sf):
    out = I.fill_gaps(preds(spark, sf), KEY, max_gap=4)
    return pick(out, *out.columns, tie=TIE)


_ANCHORS = f"""a AS (SELECT * FROM pb WHERE NOT is_fallback AND score >= {{thr}}),
  q0 AS (SELECT DISTINCT video_id, frame_index FROM gt),
  q AS (SELECT * FROM q0 WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.video_id = q0.video_id AND a.frame_index = q0.frame_index))"""


@query(
    "repair_query_frames",
    "T20 D3 P5 P6 P22 J10",
    f"""WITH {PREDS}, {GT}, {BEST}, {_ANCHORS.format(thr=0.9)}, {pchip_sql('f', 'a', 'q', BOX)},
    ok AS (SELECT *, coalesce(nk, 0) >= 3 AND w >= 2 AND h >= 2 AS ok FROM f)
    SELECT o.video_id, o.frame_index, {', '.join(f'round({TIE} + CASE WHEN ok THEN o.{c} ELSE 0 END, 6) AS {c}' for c in BOX)},
      round(pb.score + {TIE}, 6) AS score, true AS is_fallback,
      CASE WHEN ok THEN 'interpolated_pchip' ELSE 'missing' END AS bbox_source
    FROM ok o LEFT JOIN pb USING (video_id, frame_index)
    UNION ALL SELECT video_id, frame_index, {_R}, round(score + {TIE}, 6), false, 'detector' FROM a
      WHERE (video_id, frame_index) IN (SELECT (video_id, frame_index) FROM q0)""",
)
def _(spark, sf):
    out = I.repair(preds(spark, sf), gt(spark, sf), KEY, confidence_threshold=0.9)
    return pick(out, *out.columns, tie=TIE)


@query(
    "ground_truth_trajectory",
    "T22",
    f"""WITH {PREDS}, {GT}, {GT1}, q0 AS (SELECT DISTINCT video_id, frame_index FROM preds),
    q AS (SELECT * FROM q0 WHERE (video_id, frame_index) NOT IN (SELECT (video_id, frame_index) FROM g1)),
    {pchip_sql('f', 'g1', 'q', BOX)}, ok AS (SELECT *, coalesce(nk, 0) >= 3 AS ok FROM f)
    SELECT video_id, frame_index, {', '.join(f'round({TIE} + CASE WHEN ok THEN {c} ELSE 0 END, 6) AS {c}' for c in BOX)},
      CASE WHEN ok THEN 'ground_truth_interpolated_pchip' ELSE 'ground_truth_missing' END AS bbox_source FROM ok
    UNION ALL SELECT video_id, frame_index, {_R}, 'ground_truth' FROM g1
      WHERE (video_id, frame_index) IN (SELECT (video_id, frame_index) FROM q0)""",
)
def _(spark, sf):
    out = I.ground_truth_trajectory(gt(spark, sf), preds(spark, sf), KEY)
    return pick(out, *FRAME, *BOX, "bbox_source", tie=TIE)


@query(
    "backoff_fill",
    "T21 T3",
    f"""WITH {PREDS}, {GT}, {BEST}, {_ANCHORS.format(thr=0.97)}, {pchip_sql('f', 'a', 'q', BOX)}
    SELECT video_id, frame_index, {_R}, CASE WHEN nk >= 3 THEN 'interpolated_pchip' WHEN nk = 2 THEN 'interpolated_linear'
      ELSE 'interpolated_hold' END AS bbox_source FROM f WHERE nk > 0
    UNION ALL SELECT video_id, frame_index, {_R}, 'detector' FROM a""",
)
def _(spark, sf):
    best = D.most_confident(preds(spark, sf), FRAME)
    known = best.where(~F.col("is_fallback") & (F.col("score") >= 0.97))
    out = I.fill_with_backoff(known, gt(spark, sf), KEY)
    return pick(out, *FRAME, *BOX, "bbox_source", tie=TIE)


@query(
    "closest_window",
    "T35",
    f"""WITH {PREDS}, {FIRST}, a AS (SELECT video_id, frame_index, row_number() OVER {_W} - 1 AS p, count(*) OVER (PARTITION BY video_id) AS n,
      avg(CASE WHEN coalesce(score, 0) < 0.4 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS r FROM pf)
    SELECT video_id, p AS start, frame_index AS start_frame, round(r, 6) AS ratio FROM a WHERE p <= n - 10
    QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY abs(r - 0.3), p) = 1""",
)
def _(spark, sf):
    out = R.closest_window(first(spark, sf), KEY, F.coalesce("score", F.lit(0.0)) < 0.4, 10, 0.3)
    return pick(out, *KEY, "start", "start_frame", "ratio")
