"""Confidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.operators import confidence as C
from framelane.operators import dedup as D
from framelane.plans.fixtures import FIRST, KEY, PREDS, preds, sq_ce, table
from framelane.plans.registry import pick, query
from framelane.session import cut

FRAME = ["video_id", "frame_index"]

_EST = f"""an AS (SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_index) = 1),
  dr AS (SELECT pf.*, {sq_ce('pf', 'an')} AS drift_pixels,
    greatest(0, 1 - {sq_ce('pf', 'an')} / (sqrt(an.w * an.w + an.h * an.h) * 2.5)) AS drift FROM pf JOIN an USING (video_id)),
  bl AS (SELECT *, 1 / (1 + exp(-0.8 * drift)) AS blended FROM dr),
  es AS (SELECT *, list_reduce(list(blended) OVER (PARTITION BY video_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING),
    lambda s, x: CAST(0.3 AS DOUBLE) * s + CAST(0.7 AS DOUBLE) * x) AS estimated FROM bl)"""
EST = f"WITH {PREDS}, {FIRST}, {_EST}"

# every third frame carries stored components, every sixth a stored confidence
_ST = """st AS (SELECT *, pos % 3 = 0 AS stored, CASE WHEN pos % 3 = 0 AND pos % 2 = 0 THEN h / 40 END AS conf FROM es),
  c AS (SELECT video_id, frame_index, score, drift_pixels, CASE WHEN stored THEN coalesce(conf, estimated) ELSE estimated END AS confidence,
    CASE WHEN stored THEN w / 50 ELSE drift END AS drift, CASE WHEN stored THEN CAST(0.25 AS DOUBLE) END AS attention,
    coalesce(CASE WHEN stored THEN h / 30 END, score) AS score_component FROM st)"""


def frames(spark, sf):
    df = D.first_per_frame(preds(spark, sf), FRAME)
    est = C.estimate(df, KEY)
    third = F.col("pos") % 3 == 0
    comp = F.create_map(
        F.lit("drift"), F.col("w") / 50, F.lit("attention"), F.lit(0.25), F.lit("score"), F.col("h") / 30
    )
    est = est.withColumns(
        {
            "components": F.when(third, comp),
            "confidence": F.when(third & (F.col("pos") % 2 == 0), F.col("h") / 40),
        }
    )
    return C.with_stored(est)


@query(
    "confidence_estimate",
    "ST1 ST2",
    f"{EST} SELECT video_id, frame_index, round(drift, 6) AS drift, round(blended, 6) AS blended, round(estimated, 6) AS estimated FROM es",
)
def _(spark, sf):
    out = C.estimate(D.first_per_frame(preds(spark, sf), FRAME), KEY)
    return pick(out, *FRAME, "drift", "blended", "estimated")


@query(
    "stored_confidence",
    "ST5",
    f"{EST}, {_ST} SELECT video_id, frame_index, round(confidence, 6) AS confidence, round(drift, 6) AS drift, attention, round(score_component, 6) AS score_component FROM c",
)
def _(spark, sf):
    return pick(frames(spark, sf), *FRAME, "confidence", "drift", "attention", "score_component")


_SUM = f"""{EST}, {_ST}, lo AS (SELECT *, confidence < 0.6 AS low, row_number() OVER (PARTITION BY video_id ORDER BY frame_index)
    - row_number() OVER (PARTITION BY video_id, confidence < 0.6 ORDER BY frame_index) AS isl FROM c),
  ru AS (SELECT video_id, low, count(*) AS n FROM lo GROUP BY video_id, low, isl),
  sk AS (SELECT video_id, coalesce(max(n) FILTER (WHERE low), 0) AS longest_low_streak FROM ru GROUP BY video_id),
  su AS (SELECT video_id, count(*) AS total_frames, avg(confidence) AS confidence_mean, stddev_pop(confidence) AS confidence_std,
    min(confidence) AS confidence_min, count(*) FILTER (WHERE confidence < 0.6) AS below_threshold,
    avg(CASE WHEN confidence < 0.6 THEN 1 ELSE 0 END) AS below_threshold_ratio, avg(score_component) AS score_component_mean,
    avg(attention) AS attention_mean, avg(drift) AS drift_mean, avg(drift_pixels) AS drift_pixels_mean, avg(score) AS raw_score_mean,
    quantile_cont(confidence, 0.1) AS confidence_p10, quantile_cont(confidence, 0.05) AS confidence_p05,
    quantile_cont(drift_pixels, 0.95) AS drift_pixels_p95, quantile_cont(score, 0.1) AS raw_score_p10 FROM c GROUP BY video_id)"""
_SC = ["confidence_mean", "confidence_std", "confidence_min", "below_threshold_ratio", "score_component_mean", "attention_mean",
       "drift_mean", "drift_pixels_mean", "raw_score_mean", "confidence_p10", "confidence_p05", "drift_pixels_p95", "raw_score_p10"]


@query(
    "confidence_summary",
    "A29 A30 A32",
    f"""{_SUM} SELECT video_id, total_frames, below_threshold, longest_low_streak, {', '.join(f'round({c}, 6) AS {c}' for c in _SC)}
    FROM su JOIN sk USING (video_id)""",
)
def _(spark, sf):
    s = C.summarise(cut(frames(spark, sf)), KEY, 0.6)
    out = C.scan_report(s, "video_id")
    return pick(out, *KEY, "total_frames", "below_threshold", "longest_low_streak", *_SC)


@query(
    "confidence_csv",
    "S9 A29",
    f"""{_SUM} SELECT CAST(video_id AS VARCHAR) AS tracker, CAST(total_frames AS VARCHAR) AS total_frames,
      printf('%.6f', confidence_mean) AS confidence_mean, printf('%.6f', confidence_p10) AS confidence_p10,
      CAST(longest_low_streak AS VARCHAR) AS longest_low_streak, '' AS token_component_mean,
      coalesce(printf('%.6f', attention_mean), '') AS attention_component_mean FROM su JOIN sk USING (video_id)""",
)
def _(spark, sf):
    from framelane.sources.sinks import confidence_csv

    s = C.summarise(cut(frames(spark, sf)), KEY, 0.6)
    out = confidence_csv(s.withColumnRenamed("video_id", "tracker"))
    return out.select(
        "tracker", "total_frames", "confidence_mean", "confidence_p10", "longest_low_streak", "token_component_mean",
        "attention_component_mean",
    )


@query(
    "worst_frames",
    "A31 O1 O2",
    f"""{EST} SELECT video_id, frame_index, round(round(estimated, 9), 6) AS confidence, CAST(row_number() OVER (PARTITION BY video_id
      ORDER BY round(estimated, 9), frame_index) AS INTEGER) AS rank FROM es
    QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(estimated, 9), frame_index) <= 3""",
)
def _(spark, sf):
    est = C.estimate(D.first_per_frame(preds(spark, sf), FRAME), KEY)
    est = est.select(*FRAME, F.round("estimated", 9).alias("confidence"))
    return pick(C.worst_frames(est, KEY, 3), *FRAME, "confidence", "rank")


# embeddings stand in for tracker signals: 4 tokens of 16 channels, two edge distributions of 8 bins
_TOK = """t AS (SELECT vec_id, r, embedding[r * 16 + ch + 1]::DOUBLE AS v FROM embeddings, range(4) a(r), range(16) b(ch)),
  e AS (SELECT vec_id, sum(v * v) / 4 AS me FROM t GROUP BY 1),
  m AS (SELECT vec_id, embedding, ch, avg(embedding[r * 16 + ch + 1]::DOUBLE) AS mu FROM embeddings, range(4) a(r), range(16) b(ch) GROUP BY ALL),
  d AS (SELECT m.vec_id, sum(power(m.embedding[r * 16 + m.ch + 1]::DOUBLE - mu, 2)) / 4 / 16 AS va FROM m, range(4) a(r) GROUP BY 1),
  tk AS (SELECT vec_id, exp(-1.2 * va / (me / 16)) AS token FROM d JOIN e USING (vec_id)),
  p AS (SELECT vec_id, k, greatest(abs(embedding[k * 8 + i + 1]::DOUBLE), 1e-8) AS p FROM embeddings, range(2) x(k), range(8) y(i)),
  q AS (SELECT vec_id, k, p / sum(p) OVER (PARTITION BY vec_id, k) AS q FROM p),
  h AS (SELECT vec_id, k, -sum(q * ln(q)) / ln(8) AS h FROM q GROUP BY 1, 2), ds AS (SELECT vec_id, exp(-2 * avg(h)) AS distribution FROM h GROUP BY 1)"""


@query(
    "signal_components",
    "F33",
    f"WITH {_TOK} SELECT vec_id, round(token, 6) AS token, round(distribution, 6) AS distribution FROM tk JOIN ds USING (vec_id)",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    tokens = F.array(*[F.slice("e", 1 + 16 * i, 16) for i in range(4)])
    edges = F.create_map(
        *[x for i in range(2) for x in (F.lit(f"edge{i}"), F.transform(F.slice("e", 1 + 8 * i, 8), lambda v: F.abs(v)))]
    )
    out = e.select("vec_id", C.token_component(tokens).alias("token"), C.distribution_component(edges).alias("distribution"))
    return pick(out, *out.columns)
