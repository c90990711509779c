"""Online operators fed from files in frame order, next to the batch result they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.operators import dedup as D
from framelane.plans.fixtures import FIRST, PREDS, preds, sq_ce, sq_iou
from framelane.plans.q_sources import scratch
from framelane.plans.registry import pick, query
from framelane.session import cut
from framelane.streaming import online

FRAME = ["video_id", "frame_index"]
#: Frames of one run of files; a video's rows of a run are in one file, so its frames never go backwards.
RUN = 32
#: Rows of a file, about.
FILE_ROWS = 65536


def feed(spark, rows, run: int = RUN, files: int = 4):
    """Write the rows in runs of rising frames, each spread over files by video, and open them as a stream of a batch per run.

    More rows of a run are more files of it, read at once, so batches get wider and not more.
    """
    path = scratch(spark)
    rows = cut(rows)
    top, count = rows.agg(F.max("frame_index"), F.count(F.lit(1))).first()
    top = top or 0
    files = max(files, count * run // (top + 1) // FILE_ROWS)
    for lo in range(0, top + 1, run):
        rows.where(F.col("frame_index").between(lo, lo + run - 1)).repartition(files, "video_id").write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query(
    "confidence_stream",
    "ST1 ST2 ST3",
    f"""WITH {PREDS}, {FIRST}, an AS (SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_index) = 1),
    dr AS (SELECT pf.*, greatest(0, 1 - {sq_ce('pf', 'an')} / (sqrt(an.w * an.w + an.h * an.h) * 2.5)) AS drift,
      CASE WHEN pf.pos % 3 = 0 THEN (pf.pos % 7) / 7::DOUBLE END AS distribution, CASE WHEN pf.pos % 4 < 3 THEN (pf.pos % 11) / 10::DOUBLE END AS token FROM pf JOIN an USING (video_id)),
    bl AS (SELECT *, 1 / (1 + exp(-(0.8::DOUBLE * drift + coalesce(distribution, 0) + coalesce(0.4::DOUBLE * token, 0)))) AS blended FROM dr),
    es AS (SELECT *, list_reduce(list(blended) OVER (PARTITION BY video_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING),
      lambda s, x: CAST(0.3 AS DOUBLE) * s + CAST(0.7 AS DOUBLE) * x) AS estimated FROM bl),
    lo AS (SELECT *, estimated < 0.75 AS low, count(*) FILTER (WHERE NOT (estimated < 0.75)) OVER (PARTITION BY video_id ORDER BY frame_index) AS g FROM es),
    bx AS (SELECT video_id, frame_index, CASE WHEN NOT is_fallback THEN x END AS bx FROM pf)
    SELECT video_id, frame_index, round(drift, 6) AS drift, round(distribution, 6) AS distribution, round(token, 6) AS token, round(estimated, 6) AS confidence,
      CAST(count(*) FILTER (WHERE low) OVER (PARTITION BY video_id, g ORDER BY frame_index) AS INTEGER) * CASE WHEN low THEN 1 ELSE 0 END AS low_streak,
      round(coalesce(bx, lag(bx IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_index)), 6) AS x FROM lo JOIN bx USING (video_id, frame_index)""",
)
def _(spark, sf):
    """Boxes, distribution signals and token signals as three streams in batches of their own."""
    rows = preds(spark, sf).select(*FRAME, "pos", "x", "y", "w", "h", "is_fallback")
    first = cut(D.first_per_frame(rows, FRAME))
    distribution = first.select(*FRAME, "pos", F.when(F.col("pos") % 3 == 0, (F.col("pos") % 7) / 7.0).alias("value"))
    token = first.select(*FRAME, "pos", F.when(F.col("pos") % 4 < 3, (F.col("pos") % 11) / 10.0).alias("value"))
    stream = online.confidence_stream(feed(spark, rows), 0.75, feed(spark, distribution, 2 * RUN), feed(spark, token, RUN // 2, 2))
    out = online.run_available(stream, scratch(spark), scratch(spark))
    nan = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("distribution", "token")]
    return pick(out.select(*FRAME, "drift", *nan, "confidence", "low_streak", "x"), *FRAME, "drift", "distribution", "token", "confidence", "low_streak", "x")


_CHOICE = f"""WITH RECURSIVE {PREDS}, c AS (SELECT video_id, frame_index, pos, CAST(pos % 4 AS BIGINT) AS track_id, x, y, w, h, coalesce(score, 0) AS score,
    dense_rank() OVER (PARTITION BY video_id ORDER BY frame_index) AS k FROM preds),
  st AS (SELECT *, 'score' AS reason FROM c WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) = 1
    UNION ALL SELECT * FROM (SELECT c.*, CASE WHEN c.track_id = st.track_id THEN 'sticky' WHEN {sq_iou('c', 'st')} > 0 THEN 'overlap' ELSE 'score' END AS reason
      FROM st JOIN c ON c.video_id = st.video_id AND c.k = st.k + 1
      QUALIFY row_number() OVER (PARTITION BY c.video_id ORDER BY c.track_id = st.track_id DESC, CASE WHEN c.track_id = st.track_id THEN 0 ELSE {sq_iou('c', 'st')} END DESC,
        CASE WHEN c.track_id <> st.track_id AND NOT {sq_iou('c', 'st')} > 0 THEN c.score END DESC NULLS LAST, c.pos) = 1))
  SELECT video_id, CAST(frame_index AS INTEGER) AS frame_index, track_id, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, round(score, 6) AS score, reason FROM st"""


@query("candidate_stream", "ST4 P3", _CHOICE)
def _(spark, sf):
    rows = preds(spark, sf).select(
        *FRAME, "pos", (F.col("pos") % 4).alias("track_id"), "x", "y", "w", "h", F.coalesce("score", F.lit(0.0)).alias("score")
    )
    stream = online.candidate_stream(feed(spark, rows))
    out = online.run_available(stream, scratch(spark), scratch(spark))
    return pick(out, *out.columns)
