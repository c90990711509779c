"""Engine views over the driver tables, once as DataFrames and once as SQL text.

FIXTURES.md section C lists them; every view reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["video_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dbl(sql: str):
    return F.expr(sql).cast("double")


def _frame():
    # The parquet column carries no zone; casting through the session zone (UTC) gives epoch seconds.
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return F.floor((micros / F.lit(1e6) - F.lit(1704067200.0)) / F.lit(21600.0)).cast("int")


def preds(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 12).alias("subject_id"),
        F.col("user_id").alias("video_id"),
        F.col("event_type").alias("modality"),
        _frame().alias("frame_index"),
        F.col("event_id").alias("pos"),
        (F.lit(100.0) + F.col("value")).alias("x"),
        (F.lit(50.0) + (F.col("value") * F.lit(7.0)) % F.lit(40.0)).alias("y"),
        (F.lit(30.0) + (F.col("event_id") % 11).cast("double")).alias("w"),
        (F.lit(20.0) + (F.col("event_id") % 7).cast("double")).alias("h"),
        F.when(F.col("event_id") % 13 != 0, ((F.col("event_id") * 37) % 100).cast("double") / F.lit(100.0)).alias(
            "score"
        ),
        (F.col("event_id") % 17 == 0).alias("is_fallback"),
    )


def gt(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_id") % 5 != 0)
    return e.select(
        F.col("user_id").alias("video_id"),
        _frame().alias("frame_index"),
        F.col("event_id").alias("pos"),
        (F.lit(100.0) + F.col("value") + (F.col("event_id") % 9).cast("double") - F.lit(4.0)).alias("x"),
        (
            F.lit(50.0) + (F.col("value") * F.lit(7.0)) % F.lit(40.0) + (F.col("event_id") % 5).cast("double")
            - F.lit(2.0)
        ).alias("y"),
        (F.lit(30.0) + (F.col("event_id") % 11).cast("double")).alias("w"),
        (F.lit(20.0) + (F.col("event_id") % 7).cast("double")).alias("h"),
    )


def clf(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    cents = F.sum(F.round(F.col("value") * F.lit(100.0)).cast("long"))
    out = e.groupBy("user_id", "event_type").agg(((cents * 7) % 997).alias("_p"))
    out = out.select(
        F.col("user_id").alias("subject_id"),
        F.col("event_type").alias("modality"),
        (F.col("user_id") % 5).cast("int").alias("fold"),
        F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("label_true"),
        (F.col("_p").cast("double") / F.lit(997.0)).alias("prob"),
    )
    return out.withColumn("label_pred", (F.col("prob") >= 0.5).cast("int"))


def px(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("patch_id"), F.posexplode("embedding").alias("i", "e")
    )
    v = F.floor((F.col("e").cast("double") + F.lit(0.5)) * F.lit(255.0))
    return e.select(
        "patch_id",
        F.floor(F.col("i") / 8).cast("int").alias("y"),
        (F.col("i") % 8).cast("int").alias("x"),
        F.greatest(F.lit(0), F.least(F.lit(255), v.cast("int"))).alias("v"),
    )


def shapes(df: DataFrame) -> DataFrame:
    """Mask statistics of a box: an ellipse of the box's extent."""
    return df.withColumns(
        {
            "area": F.col("w") * F.col("h") * F.lit(0.785),
            "perimeter": F.lit(2.0) * (F.col("w") + F.col("h")),
            "eq_diam": F.sqrt(F.col("w") * F.col("h")),
        }
    )


_FRAME = "CAST(floor((epoch(ts) - 1704067200) / CAST(21600 AS DOUBLE)) AS INTEGER)"

PREDS = f"""preds AS (
  SELECT user_id % 12 AS subject_id, user_id AS video_id, event_type AS modality, {_FRAME} AS frame_index,
         event_id AS pos, CAST(100 AS DOUBLE) + value AS x,
         CAST(50 AS DOUBLE) + (value * CAST(7 AS DOUBLE)) % CAST(40 AS DOUBLE) AS y,
         CAST(30 AS DOUBLE) + CAST(event_id % 11 AS DOUBLE) AS w,
         CAST(20 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) AS h,
         CASE WHEN event_id % 13 <> 0 THEN CAST((event_id * 37) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS score,
         event_id % 17 = 0 AS is_fallback
  FROM events)"""

GT = f"""gt AS (
  SELECT user_id AS video_id, {_FRAME} AS frame_index, event_id AS pos,
         CAST(100 AS DOUBLE) + value + CAST(event_id % 9 AS DOUBLE) - CAST(4 AS DOUBLE) AS x,
         CAST(50 AS DOUBLE) + (value * CAST(7 AS DOUBLE)) % CAST(40 AS DOUBLE) + CAST(event_id % 5 AS DOUBLE)
           - CAST(2 AS DOUBLE) AS y,
         CAST(30 AS DOUBLE) + CAST(event_id % 11 AS DOUBLE) AS w,
         CAST(20 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) AS h
  FROM events WHERE event_id % 5 <> 0)"""

CLF = """clf AS (
  SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS label_pred FROM (
    SELECT user_id AS subject_id, event_type AS modality, CAST(user_id % 5 AS INTEGER) AS fold,
           CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS label_true,
           CAST((sum(CAST(round(value * 100) AS BIGINT)) * 7) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS prob
    FROM events GROUP BY user_id, event_type))"""

PX = """px AS (
  SELECT patch_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
         CAST(greatest(0, least(255, floor((CAST(embedding[i] AS DOUBLE) + CAST(0.5 AS DOUBLE)) * 255))) AS INTEGER) AS v
  FROM (SELECT vec_id AS patch_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""


def dedup_sql(name: str, source: str, order: str, key: str = "video_id, frame_index") -> str:
    """CTE that keeps the first row per key."""
    return f"{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"


FIRST = dedup_sql("pf", "preds", "pos")
BEST = dedup_sql(
    "pb", "preds", "coalesce(score, CAST('-infinity' AS DOUBLE)) DESC, NOT (w >= 2 AND h >= 2), is_fallback, pos"
)
DETECT = dedup_sql("pd", "preds", "is_fallback, coalesce(score, CAST('-infinity' AS DOUBLE)) DESC, pos")
GT1 = dedup_sql("g1", "gt", "pos")


def sq_iou(a: str, b: str) -> str:
    """IoU of two xywh aliases in SQL."""
    iw = f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    ih = f"greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"({iw} * {ih}) / ({a}.w * {a}.h + {b}.w * {b}.h - {iw} * {ih})"


def sq_ce(a: str, b: str) -> str:
    dx = f"({a}.x + {a}.w / 2 - {b}.x - {b}.w / 2)"
    dy = f"({a}.y + {a}.h / 2 - {b}.y - {b}.h / 2)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


MATCH = f"""m AS (
  SELECT g1.video_id, g1.frame_index, pf.score, {sq_iou('pf', 'g1')} AS iou, {sq_ce('pf', 'g1')} AS ce
  FROM g1 JOIN pf USING (video_id, frame_index))"""

MATCHED = f"WITH {PREDS}, {GT}, {FIRST}, {GT1}, {MATCH}"


def _slope_inner(h0: str, h1: str, m0: str, m1: str) -> str:
    return (
        f"CASE WHEN sign({m0}) <> sign({m1}) OR {m0} = 0 OR {m1} = 0 THEN 0 ELSE (3 * ({h0} + {h1})) / "
        f"((2 * {h1} + {h0}) / ({m0}) + ({h1} + 2 * {h0}) / ({m1})) END"
    )


def _slope_end(h0: str, h1: str, m0: str, m1: str) -> str:
    s = f"(((2 * {h0} + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1}))"
    return (
        f"CASE WHEN sign({s}) <> sign({m0}) THEN 0 WHEN sign({m0}) <> sign({m1}) AND abs({s}) > 3 * abs({m0}) "
        f"THEN 3 * {m0} ELSE {s} END"
    )


def pchip_sql(prefix: str, knots: str, queries: str, vals: tuple[str, ...], order: str = "frame_index") -> str:
    """CTE ``{prefix}`` = the query rows with the values of ``knots`` interpolated (Hermite basis form).

    ``queries`` holds video_id and ``order``; the output adds ``nk`` (number of knots).
    """
    cols, secs, slopes, evals = [], [], [], []
    for v in vals:
        cols += [f"lag({v}) OVER w AS {v}p", f"lead({v}) OVER w AS {v}1", f"lead({v}, 2) OVER w AS {v}2"]
        secs += [f"({v} - {v}p) / gap_p AS {v}_a", f"({v}1 - {v}) / gap_0 AS {v}_m", f"({v}2 - {v}1) / gap_1 AS {v}_z"]
        slopes += [
            f"CASE WHEN gap_p IS NOT NULL THEN {_slope_inner('gap_p', 'gap_0', f'{v}_a', f'{v}_m')} WHEN gap_1 IS NOT NULL "
            f"THEN {_slope_end('gap_0', 'gap_1', f'{v}_m', f'{v}_z')} ELSE {v}_m END AS {v}_d0",
            f"CASE WHEN gap_1 IS NOT NULL THEN {_slope_inner('gap_0', 'gap_1', f'{v}_m', f'{v}_z')} WHEN gap_p IS NOT NULL "
            f"THEN {_slope_end('gap_0', 'gap_p', f'{v}_m', f'{v}_a')} ELSE {v}_m END AS {v}_d1",
        ]
        u = "u"
        herm = (
            f"(2*{u}*{u}*{u} - 3*{u}*{u} + 1) * pc.{v} + ({u}*{u}*{u} - 2*{u}*{u} + {u}) * pc.gap_0 * pc.{v}_d0 + "
            f"(3*{u}*{u} - 2*{u}*{u}*{u}) * pc.{v}1 + ({u}*{u}*{u} - {u}*{u}) * pc.gap_0 * pc.{v}_d1"
        )
        evals.append(
            f"CASE WHEN nk IS NULL THEN 0 WHEN nk = 1 THEN lo_{v} ELSE greatest(lo_{v}, least(hi_{v}, {herm})) END AS {v}"
        )
    lohi = ", ".join(f"min({v}) AS lo_{v}, max({v}) AS hi_{v}" for v in vals)
    los = ", ".join(f"lo_{v}, hi_{v}" for v in vals)
    t = f"CAST({order} AS DOUBLE)"
    return f"""{prefix}_1 AS (SELECT video_id, {t} AS t, lag({t}) OVER w AS tp, lead({t}) OVER w AS t1,
    lead({t}, 2) OVER w AS t2, {', '.join(vals)}, {', '.join(cols)} FROM {knots}
    WINDOW w AS (PARTITION BY video_id ORDER BY {order})),
  {prefix}_2 AS (SELECT *, t - tp AS gap_p, t1 - t AS gap_0, t2 - t1 AS gap_1 FROM {prefix}_1),
  {prefix}_3 AS (SELECT *, {', '.join(secs)} FROM {prefix}_2 WHERE t1 IS NOT NULL),
  {prefix}_4 AS (SELECT *, {', '.join(slopes)} FROM {prefix}_3),
  {prefix}_r AS (SELECT video_id, count(*) AS nk, min({t}) AS tf, {lohi} FROM {knots} GROUP BY video_id),
  {prefix}_q AS (SELECT q.video_id, q.{order}, greatest(CAST(q.{order} AS DOUBLE), tf) AS tq, nk, {los}
    FROM {queries} q LEFT JOIN {prefix}_r USING (video_id)),
  {prefix} AS (SELECT video_id, {order}, nk, {', '.join(evals)} FROM (
    SELECT z.*, pc, (CAST(z.{order} AS DOUBLE) - pc.t) / pc.gap_0 AS u FROM {prefix}_q z
    ASOF LEFT JOIN {prefix}_4 pc ON z.video_id = pc.video_id AND z.tq >= pc.t))"""
