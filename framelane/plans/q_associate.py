"""Score-versus-outcome queries on matched frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.operators import associate as A
from framelane.operators import dedup as D
from framelane.operators import evaluate as E
from framelane.plans.fixtures import FIRST, GT, KEY, MATCHED, PREDS, gt, preds
from framelane.plans.registry import pick, query
from framelane.session import cut

ROUNDED = f"{MATCHED}, mr AS (SELECT video_id, frame_index, score, round(iou, 9) AS iou, round(ce, 9) AS ce FROM m)"
SC = f"{ROUNDED}, s AS (SELECT *, video_id || ':' || frame_index AS id FROM mr WHERE score IS NOT NULL)"


def matched(spark, sf):
    m = E.matched(preds(spark, sf), gt(spark, sf), KEY)
    # Centre errors repeat; rounding makes equal ones equal to the last bit, as ranks need.
    return m.select("video_id", "frame_index", "score", *[F.round(c, 9).alias(c) for c in ("iou", "ce")])


def scored(spark, sf):
    m = matched(spark, sf).where(F.col("score").isNotNull())
    return m.withColumn("id", F.concat_ws(":", F.col("video_id").cast("string"), F.col("frame_index").cast("string")))


def rank_sql(v: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {v}" if part else f"PARTITION BY {v}"
    return f"(rank() OVER ({p}ORDER BY {v}) + (count(*) OVER ({q}) - 1) / CAST(2 AS DOUBLE))"


@query(
    "score_correlation",
    "A20 A21 A22",
    f"""{SC}, r AS (SELECT *, {rank_sql('score')} AS rs, {rank_sql('iou')} AS ri FROM s)
    SELECT count(*) AS n, round(corr(score, iou), 6) AS pearson, round(regr_slope(iou, score), 6) AS slope,
      round(regr_intercept(iou, score), 6) AS intercept, round(corr(rs, ri), 6) AS spearman FROM r""",
)
def _(spark, sf):
    out = A.correlations(scored(spark, sf), [], "score", "iou")
    return pick(out, *out.columns)


@query(
    "score_correlation_by_video",
    "A20 A21 A22 A28",
    f"""{SC}, r AS (SELECT *, {rank_sql('score', 'video_id')} AS rs, {rank_sql('ce', 'video_id')} AS ri FROM s)
    SELECT video_id, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(score, ce) END, 6) AS pearson,
      round(CASE WHEN count(*) >= 3 THEN regr_slope(ce, score) END, 6) AS slope,
      round(CASE WHEN count(*) >= 3 THEN regr_intercept(ce, score) END, 6) AS intercept,
      round(CASE WHEN count(*) >= 3 THEN corr(rs, ri) END, 6) AS spearman FROM r GROUP BY video_id""",
)
def _(spark, sf):
    out = A.correlations(scored(spark, sf), KEY, "score", "ce")
    return pick(out, *out.columns)


_EDGES = """q AS (SELECT unnest(list_distinct(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM s),
  w AS (SELECT row_number() OVER (ORDER BY e) - 1 AS bin, e AS lo, lead(e) OVER (ORDER BY e) AS hi, max(e) OVER () AS top FROM q),
  g AS (SELECT CAST(bin AS INTEGER) AS bin, lo, CASE WHEN hi = top THEN hi + 1e-12 ELSE hi END AS hi FROM w WHERE hi IS NOT NULL)"""


@query(
    "iou_by_score_bin",
    "A23",
    f"""{SC}, {_EDGES} SELECT bin, count(*) AS n, round(avg(iou), 6) AS mean, round(median(iou), 6) AS median,
      round(stddev_pop(iou), 6) AS std, round(avg(CASE WHEN iou < 0.5 THEN 1 ELSE 0 END), 6) AS bad_rate,
      round(any_value(lo), 6) AS score_lo, round(any_value(hi), 6) AS score_hi
    FROM s JOIN g ON score >= lo AND score < hi GROUP BY bin""",
)
def _(spark, sf):
    out = A.binned(scored(spark, sf), "score", "iou", 10, {"bad_rate": F.col("iou") < 0.5})
    return pick(out, *out.columns)


@query(
    "ce_by_score_bin",
    "A24",
    f"""{SC}, {_EDGES}, md AS (SELECT median(ce) AS md FROM s)
    SELECT bin, count(*) AS n, round(avg(ce), 6) AS mean, round(median(ce), 6) AS median, round(stddev_pop(ce), 6) AS std,
      round(quantile_cont(ce, 0.9), 6) AS p90, round(avg(CASE WHEN ce > md THEN 1 ELSE 0 END), 6) AS high_rate,
      round(any_value(lo), 6) AS score_lo, round(any_value(hi), 6) AS score_hi
    FROM s JOIN g ON score >= lo AND score < hi, md GROUP BY bin""",
)
def _(spark, sf):
    from framelane.operators.ranked import percentiles

    df = cut(scored(spark, sf))
    mid = percentiles(df, [], "ce", {"m": 0.5}).first()["m"]
    out = A.binned(df, "score", "ce", 10, {"high_rate": F.col("ce") > mid}, {"p90": 0.9})
    return pick(out, *out.columns)


@query(
    "low_high_contrast",
    "A25",
    f"""{SC}, q AS (SELECT quantile_cont(score, 0.2) AS q_low, quantile_cont(score, 0.8) AS q_high FROM s),
    a AS (SELECT any_value(q_low) AS q_low, any_value(q_high) AS q_high, count(*) FILTER (WHERE score <= q_low) AS n_low,
      count(*) FILTER (WHERE score >= q_high) AS n_high, avg(iou) FILTER (WHERE score <= q_low) AS iou_low,
      avg(iou) FILTER (WHERE score >= q_high) AS iou_high FROM s, q)
    SELECT round(q_low, 6) AS q_low, round(q_high, 6) AS q_high, n_low, n_high, round(iou_low, 6) AS iou_low,
      round(iou_high, 6) AS iou_high, round(iou_high - iou_low, 6) AS iou_delta FROM a""",
)
def _(spark, sf):
    out = A.low_high(scored(spark, sf), [], "score", ["iou"])
    return pick(out, *out.columns)


_POIS = " + ".join(f"CASE WHEN u >= {e} THEN 1 ELSE 0 END" for e in A.POISSON_1)


def hex_sql(digest: str, i: int) -> str:
    return f"CAST('0x' || substr({digest}, {1 + 8 * i}, 8) AS BIGINT)"


@query(
    "bootstrap_contrast",
    "A26",
    f"""{SC}, q AS (SELECT quantile_cont(score, 0.2) AS ql, quantile_cont(score, 0.8) AS qh FROM s),
    h AS (SELECT iou, score, b, md5(id || '-' || b) AS d FROM s, range(1250) t(b)),
    x AS (SELECT iou, score, b * 4 + i AS draw, CAST('0x' || substr(d, CAST(1 + 8 * i AS BIGINT), 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
      FROM h, range(4) r(i)),
    w AS (SELECT iou, score, draw, {_POIS} AS w FROM x),
    mm AS (SELECT draw, sum(iou * w) FILTER (WHERE score >= qh) / sum(w) FILTER (WHERE score >= qh)
        - sum(iou * w) FILTER (WHERE score <= ql) / sum(w) FILTER (WHERE score <= ql) AS d FROM w, q GROUP BY draw)
    SELECT round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high, round(avg(d), 6) AS boot_mean FROM mm""",
)
def _(spark, sf):
    df = cut(scored(spark, sf))
    q = A.low_high(df, [], "score", ["iou"]).first()
    low = F.when(F.col("score") <= q["q_low"], F.col("iou"))
    high = F.when(F.col("score") >= q["q_high"], F.col("iou"))
    means = A.bootstrap_means(df, "id", {"low": low, "high": high}, 5000)
    out = A.bootstrap_interval(means, F.col("high") - F.col("low"))
    return pick(out, *out.columns)


@query(
    "permutation_mean_difference",
    "A27",
    f"""{SC}, f AS (SELECT id, ce AS v, score >= 0.5 AS a FROM s), o AS (SELECT count(*) FILTER (WHERE a) AS na, count(*) AS n, sum(v) AS sv,
      avg(v) FILTER (WHERE a) - avg(v) FILTER (WHERE NOT a) AS d FROM f),
    p AS (SELECT perm, v, row_number() OVER (PARTITION BY perm ORDER BY md5(id || '-' || perm)) - 1 AS k FROM f, range(999) t(perm)),
    r AS (SELECT perm, sum(v) FILTER (WHERE k < na) AS sa FROM p, o GROUP BY perm)
    SELECT round(any_value(d), 6) AS observed, (count(*) FILTER (WHERE abs(sa / na - (sv - sa) / (n - na)) >= abs(d)) + 1) / CAST(1000 AS DOUBLE) AS p_value
    FROM r, o""",
)
def _(spark, sf):
    out = A.permutation_p_mean_diff(scored(spark, sf), "id", "ce", F.col("score") >= 0.5, 999)
    return pick(out, *out.columns)


@query(
    "permutation_correlation",
    "A27",
    f"""{SC}, f AS (SELECT id, score AS x, iou AS y, row_number() OVER (ORDER BY md5(id || '--1')) - 1 AS i FROM s),
    p AS (SELECT perm, y, row_number() OVER (PARTITION BY perm ORDER BY md5(id || '-' || perm)) - 1 AS i FROM f, range(199) t(perm)),
    r AS (SELECT perm, corr(x, p.y) AS r FROM p JOIN f USING (i) GROUP BY perm), o AS (SELECT corr(x, y) AS obs FROM f)
    SELECT round(any_value(obs), 6) AS observed, (count(*) FILTER (WHERE abs(r) >= abs(obs)) + 1) / CAST(200 AS DOUBLE) AS p_value FROM r, o""",
)
def _(spark, sf):
    out = A.permutation_p_corr(scored(spark, sf), "id", "score", "iou", 199)
    return pick(out, *out.columns)


_EXP = f"""{ROUNDED}, e AS (SELECT *, video_id % 10 AS experiment FROM mr), s AS (SELECT * FROM e WHERE score IS NOT NULL),
  q AS (SELECT experiment, quantile_cont(score, 0.2) AS ql, quantile_cont(score, 0.8) AS qh FROM s GROUP BY 1),
  rk AS (SELECT *, {rank_sql('score', 'experiment')} AS rs, {rank_sql('iou', 'experiment')} AS ri, {rank_sql('ce', 'experiment')} AS rc FROM s),
  x AS (SELECT experiment, count(*) AS n_scored, avg(iou) AS iou_mean, avg(ce) AS ce_mean, corr(score, iou) AS pearson_iou,
    corr(score, ce) AS pearson_ce, corr(rs, ri) AS spearman_iou, corr(rs, rc) AS spearman_ce,
    avg(iou) FILTER (WHERE score >= qh) - avg(iou) FILTER (WHERE score <= ql) AS delta_iou_high_minus_low,
    avg(ce) FILTER (WHERE score <= ql) - avg(ce) FILTER (WHERE score >= qh) AS delta_ce_low_minus_high FROM rk JOIN q USING (experiment) GROUP BY 1),
  n AS (SELECT experiment, count(*) AS n_rows FROM e GROUP BY 1), t AS (SELECT * FROM n JOIN x USING (experiment))"""
_EC = ["iou_mean", "ce_mean", "pearson_iou", "pearson_ce", "spearman_iou", "spearman_ce", "delta_iou_high_minus_low", "delta_ce_low_minus_high"]


@query(
    "experiment_relations",
    "A28 J8",
    f"{_EXP} SELECT experiment, n_rows, n_scored, {', '.join(f'round({c}, 6) AS {c}' for c in _EC)} FROM t",
)
def _(spark, sf):
    df = cut(matched(spark, sf).withColumn("experiment", F.col("video_id") % 10))
    out = A.experiment_table(df, ["experiment"])
    return pick(out, *out.columns)


_QT = ", ".join(
    f"round(quantile_cont({v}, {p}), 6) AS {v}_{k}" for v in ("pearson_iou", "pearson_ce") for k, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))
)


@query(
    "relation_distribution",
    "A28",
    f"""{_EXP} SELECT count(pearson_iou) AS n_experiments, count(*) FILTER (WHERE pearson_iou > 0 AND pearson_ce < 0) AS n_support,
      round(count(*) FILTER (WHERE pearson_iou > 0 AND pearson_ce < 0) / CAST(count(pearson_iou) AS DOUBLE), 6) AS support_ratio, {_QT} FROM t""",
)
def _(spark, sf):
    df = cut(matched(spark, sf).withColumn("experiment", F.col("video_id") % 10))
    out = A.relation_distribution(A.experiment_table(df, ["experiment"]))
    return pick(out, *out.columns)


_CLIP = f"""{PREDS}, {GT}, {FIRST}, k AS (SELECT video_id * 1000 + frame_index // 4 AS experiment, pf.frame_index, EXISTS (SELECT 1 FROM gt WHERE gt.video_id = pf.video_id
    AND gt.frame_index = pf.frame_index) AS hit FROM pf)"""


@query(
    "skipped_experiments",
    "J8",
    f"WITH {_CLIP} SELECT experiment, count(*) AS n_predictions FROM k GROUP BY experiment HAVING NOT bool_or(hit)",
)
def _(spark, sf):
    """Clips of four frames as experiments: those without an annotated frame."""
    clip = (F.col("video_id") * 1000 + F.floor(F.col("frame_index") / 4)).cast("long").alias("experiment")
    first = D.first_per_frame(preds(spark, sf), ["video_id", "frame_index"]).select(clip)
    hits = E.matched(preds(spark, sf), gt(spark, sf), ["video_id"]).select(clip)
    return A.skipped_experiments(first, hits, ["experiment"])
