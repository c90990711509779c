"""Pixel table queries: texture and masks of 8 x 8 patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.operators import pixels as P
from framelane.plans.fixtures import PX, px
from framelane.plans.registry import TIE, pick, query
from framelane.session import cut

IMG = ["patch_id"]

_GL = """gp AS (SELECT patch_id, y, x, least(CAST(floor(v * 15 / 255.0::DOUBLE) AS INTEGER), 15) AS g FROM px),
  pr AS (SELECT a.patch_id, a.g AS i, b.g AS j FROM gp a JOIN gp b ON a.patch_id = b.patch_id AND a.y = b.y AND b.x = a.x + 1),
  pp AS (SELECT * FROM pr UNION ALL SELECT patch_id, j, i FROM pr), ce AS (SELECT patch_id, i, j, count(*) / CAST(112 AS DOUBLE) AS p FROM pp GROUP BY ALL),
  mu AS (SELECT patch_id, sum(i * p) AS m FROM ce GROUP BY 1), vr AS (SELECT patch_id, any_value(m) AS m, sqrt(sum((i - m) * (i - m) * p)) + 1e-9 AS s FROM ce JOIN mu USING (patch_id) GROUP BY 1),
  gl AS (SELECT patch_id, sum((i - j) * (i - j) * p) AS glcm_contrast, sum(abs(i - j) * p) AS glcm_dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS glcm_homogeneity,
    sum(p * p) AS glcm_energy, sum((i - m) * (j - m) * p / (s * s)) AS glcm_correlation FROM ce JOIN vr USING (patch_id) GROUP BY 1)"""
_GC = ["glcm_contrast", "glcm_dissimilarity", "glcm_homogeneity", "glcm_energy", "glcm_correlation"]


@query("grey_cooccurrence", "F28", f"WITH {PX}, {_GL} SELECT patch_id, {', '.join(f'round({c} + {TIE}, 6) AS {c}' for c in _GC)} FROM gl")
def _(spark, sf):
    out = P.cooccurrence(px(spark, sf), IMG)
    return pick(out, *out.columns, tie=TIE)


_NB = ["(-1, -1)", "(-1, 0)", "(-1, 1)", "(0, 1)", "(1, 1)", "(1, 0)", "(1, -1)", "(0, -1)"]
_LBP = f"""nb AS (SELECT * FROM (VALUES {', '.join(f'({b}, {n[1:-1]})' for b, n in enumerate(_NB))}) t(b, dy, dx)),
  cd AS (SELECT a.patch_id, a.y, a.x, CAST(sum(CASE WHEN q.v >= a.v THEN 1 << b ELSE 0 END) AS INTEGER) AS code FROM px a, nb, px q
    WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 AND q.patch_id = a.patch_id AND q.y = a.y + dy AND q.x = a.x + dx GROUP BY ALL)"""


@query(
    "binary_patterns",
    "F29",
    f"WITH {PX}, {_LBP} SELECT patch_id, {', '.join(f'round(count(*) FILTER (WHERE floor(code * 10 / 256.0::DOUBLE) = {i}) / 36.0::DOUBLE, 6) AS lbp_{i:02d}' for i in range(10))} FROM cd GROUP BY patch_id",
)
def _(spark, sf):
    out = P.binary_pattern(px(spark, sf), IMG)
    return pick(out, *out.columns)


_GR = """rf AS (SELECT a.patch_id, a.y, a.x, a.v, sum(q.v * dx * (CASE WHEN dy = 0 THEN 2 ELSE 1 END)) AS gx, sum(q.v * dy * (CASE WHEN dx = 0 THEN 2 ELSE 1 END)) AS gy
    FROM px a, range(-1, 2) r(dy), range(-1, 2) s(dx), px q WHERE q.patch_id = a.patch_id
      AND q.y = CASE a.y + dy WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE a.y + dy END AND q.x = CASE a.x + dx WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE a.x + dx END GROUP BY ALL),
  ms AS (SELECT patch_id, avg(v) AS m, stddev_pop(v) AS sd FROM px GROUP BY 1),
  gs AS (SELECT patch_id, any_value(m) AS gray_mean, any_value(sd) AS gray_std, avg(power((v - m) / sd, 3)) AS gray_skewness, avg(power((v - m) / sd, 4)) - 3 AS gray_kurtosis,
    avg(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS grad_mean, stddev_pop(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS grad_std FROM rf JOIN ms USING (patch_id) GROUP BY 1)"""
_GSC = ["gray_mean", "gray_std", "gray_skewness", "gray_kurtosis", "grad_mean", "grad_std"]


@query("grey_statistics", "F30", f"WITH {PX}, {_GR} SELECT patch_id, {', '.join(f'round({c}, 6) AS {c}' for c in _GSC)} FROM gs")
def _(spark, sf):
    out = P.grey_stats(px(spark, sf), IMG)
    return pick(out, *out.columns)


_VT = ["glcm_contrast", "glcm_homogeneity"]


@query(
    "video_texture",
    "F32 D13 F28 F30",
    f"""WITH {PX}, {_GL}, {_GR}, fr AS (SELECT vec_id AS patch_id, vec_id % 50 AS video_id, ((vec_id * 37) % 100) / 100.0::DOUBLE AS score FROM embeddings),
    bs AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, patch_id) <= 5)
    SELECT video_id, {', '.join(f'round(avg({c}), 6) AS tex_{c}_mean, round(stddev_pop({c}), 6) AS tex_{c}_std' for c in _VT)},
      round(avg(glcm_energy), 6) AS tex_glcm_energy_mean, round(avg(glcm_correlation), 6) AS tex_glcm_correlation_mean,
      {', '.join(f'round(avg({c}), 6) AS tex_{c}' for c in ('gray_mean', 'gray_std', 'grad_mean', 'grad_std'))}
    FROM bs JOIN gl USING (patch_id) JOIN gs USING (patch_id) GROUP BY video_id""",
)
def _(spark, sf):
    p = cut(px(spark, sf))
    frames = p.select("patch_id").distinct().select(
        "patch_id", (F.col("patch_id") % 50).alias("video_id"),
        (((F.col("patch_id") * 37) % 100).cast("double") / 100.0).alias("score"),
    )
    out = P.video_texture(p, frames, ["video_id"], "patch_id")
    return pick(out, *out.columns)


@query(
    "range_compression",
    "F31",
    f"""WITH {PX}, q AS (SELECT patch_id, quantile_cont(v::DOUBLE, 0.9) AS hi FROM px GROUP BY 1),
    c AS (SELECT patch_id, y, x, CASE WHEN hi > 0 THEN greatest(0, least(v, hi)) ELSE v::DOUBLE END AS v FROM px JOIN q USING (patch_id)),
    d AS (SELECT *, max(v) OVER (PARTITION BY patch_id) AS mx FROM c)
    SELECT patch_id, y, x, CAST(least(greatest(floor(round(ln(1 + v / (CASE WHEN mx <= 0 THEN 1e-6 ELSE mx END) * (exp(1.0::DOUBLE) - 1)) * 255, 9)), 0), 255) AS INTEGER) AS v FROM d""",
)
def _(spark, sf):
    return P.compress_range(px(spark, sf), IMG, clip=90.0).select("patch_id", "y", "x", "v")


@query(
    "depth_gain",
    "F31",
    f"""WITH {PX} SELECT patch_id, y, x, CAST(least(greatest(floor(round(v * CASE WHEN y / 7.0::DOUBLE <= 0.5 THEN 1.0::DOUBLE + y / 7.0::DOUBLE ELSE 1.5::DOUBLE + (y / 7.0::DOUBLE - 0.5) * 0.5 END, 9)), 0), 255) AS INTEGER) AS v FROM px""",
)
def _(spark, sf):
    out = P.depth_gain(px(spark, sf), IMG, mode="custom", points=[(0.0, 1.0), (0.5, 1.5), (1.0, 1.75)])
    return out.select("patch_id", "y", "x", "v")


@query(
    "mask_statistics",
    "A46",
    f"""WITH {PX}, f AS (SELECT * FROM px WHERE v > 127), s AS (SELECT patch_id, count(*)::DOUBLE AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS cx, avg(y) AS cy FROM f GROUP BY 1)
    SELECT p.patch_id, coalesce(area, 0) AS area, coalesce(x0, 0)::DOUBLE AS x, coalesce(y0, 0)::DOUBLE AS y, coalesce(x1 - x0 + 1, 0)::DOUBLE AS w, coalesce(y1 - y0 + 1, 0)::DOUBLE AS h,
      round(coalesce(cx, 0), 6) AS cx, round(coalesce(cy, 0), 6) AS cy, round(sqrt(4 * coalesce(area, 0) / pi()), 6) AS eq_diam FROM (SELECT DISTINCT patch_id FROM px) p LEFT JOIN s USING (patch_id)""",
)
def _(spark, sf):
    out = P.mask_stats(px(spark, sf), IMG, F.col("v") > 127)
    return pick(out, *out.columns)


@query(
    "mask_overlap",
    "A45",
    f"""WITH {PX}, c AS (SELECT patch_id, count(*) FILTER (WHERE v > 127) AS a, count(*) FILTER (WHERE v BETWEEN 110 AND 150) AS b, count(*) FILTER (WHERE v BETWEEN 128 AND 150) AS i,
      count(*) FILTER (WHERE v >= 110) AS u, avg(x) FILTER (WHERE v > 127) - avg(x) FILTER (WHERE v BETWEEN 110 AND 150) AS dx,
      avg(y) FILTER (WHERE v > 127) - avg(y) FILTER (WHERE v BETWEEN 110 AND 150) AS dy FROM px GROUP BY 1)
    SELECT patch_id, round(CASE WHEN u = 0 THEN 1 ELSE 2 * i / (a + b + 1e-6) END, 6) AS dice, round(CASE WHEN u = 0 THEN 1 ELSE i / (u + 1e-6) END, 6) AS iou,
      round(sqrt(dx * dx + dy * dy), 6) AS centroid_distance FROM c""",
)
def _(spark, sf):
    out = P.mask_overlap(px(spark, sf), IMG, F.col("v") > 127, F.col("v").between(110, 150))
    return pick(out, *out.columns)
