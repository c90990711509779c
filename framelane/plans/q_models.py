"""Split and model queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framelane.operators import modelling as M
from framelane.operators import splits as S
from framelane.plans.fixtures import PREDS, preds, table
from framelane.plans.registry import pick, query
from framelane.session import cut

VID = f"{PREDS}, v AS (SELECT video_id, subject_id FROM preds GROUP BY ALL)"


def videos(spark, sf):
    return preds(spark, sf).select("video_id", "subject_id").distinct()


def emb(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(
        "vec_id", (F.col("vec_id") % 50).alias("video_id"), (F.col("vec_id") % 25).alias("subject_id"),
        F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") % 2).cast("int").alias("label"),
        (((F.col("vec_id") * 37) % 100).cast("double") / 100.0).alias("weight"),
    )


def ord_sql(name: str, src: str, ids: str, seed: int, part: str = "") -> str:
    p = f"PARTITION BY {part}" if part else ""
    return f"""{name} AS (SELECT *, row_number() OVER ({p} ORDER BY md5('{seed}-' || {ids})) - 1 AS pos0, count(*) OVER ({p}) AS n FROM {src})"""


@query(
    "video_split",
    "M1",
    f"""WITH {VID}, {ord_sql('o', 'v', 'video_id', 7)} SELECT video_id, subject_id, CASE WHEN pos0 < floor(n * 0.7::DOUBLE) THEN 'train'
      WHEN pos0 < floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS role FROM o""",
)
def _(spark, sf):
    return S.video_split(videos(spark, sf), 7)


@query(
    "subject_split",
    "M2 J6",
    f"""WITH {VID}, s AS (SELECT DISTINCT subject_id FROM v), {ord_sql('o', 's', 'subject_id', 7)}
    SELECT video_id, subject_id, CASE WHEN pos0 < greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train'
      WHEN pos0 < greatest(1, floor(n * 0.7::DOUBLE)) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS role FROM v JOIN o USING (subject_id)""",
)
def _(spark, sf):
    return S.subject_split(videos(spark, sf), 7)


@query(
    "loso_folds",
    "M3",
    f"""WITH {VID} SELECT subject_id, (SELECT count(*) FROM v) - count(*) AS train_videos, count(*) AS test_videos,
      (SELECT count(DISTINCT subject_id) FROM v) - 1 AS train_subjects FROM v GROUP BY subject_id""",
)
def _(spark, sf):
    return S.loso_folds(videos(spark, sf))


@query(
    "limited_loso_fold",
    "M4 M3",
    f"""WITH {VID} SELECT video_id, subject_id, 'train' AS role FROM v WHERE subject_id <> 3 QUALIFY row_number() OVER (ORDER BY video_id) <= 20
    UNION ALL SELECT video_id, subject_id, 'test' FROM v WHERE subject_id = 3 QUALIFY row_number() OVER (ORDER BY video_id) <= 5""",
)
def _(spark, sf):
    return S.limit_fold_videos(S.loso_fold(videos(spark, sf), 3), max_train=20, max_test=5)


@query(
    "k_folds",
    "M5",
    f"WITH {VID}, {ord_sql('o', 'v', 'video_id', 11)} SELECT video_id, subject_id, CAST(pos0 % 5 AS INTEGER) AS fold FROM o",
)
def _(spark, sf):
    return S.k_folds(videos(spark, sf), 5, 11, "video_id")


@query(
    "stratified_split",
    "M6",
    f"""WITH {VID}, l AS (SELECT video_id, CASE WHEN video_id % 3 = 0 THEN 1 ELSE 0 END AS label FROM v), {ord_sql('o', 'l', 'video_id', 5, 'label')},
    t AS (SELECT *, least(greatest(1, round(n * 0.6::DOUBLE)), greatest(n - 1, 1)) AS nt FROM o)
    SELECT video_id, label, CASE WHEN pos0 < nt THEN 'train' WHEN pos0 < nt + least(round(n * 0.2::DOUBLE), greatest(n - nt - 1, 0)) THEN 'val' ELSE 'test' END AS role FROM t""",
)
def _(spark, sf):
    v = videos(spark, sf).select("video_id", F.when(F.col("video_id") % 3 == 0, 1).otherwise(0).alias("label"))
    return S.stratified_split(v, 5, 0.6, 0.2, ids="video_id")


@query(
    "subject_holdout",
    "M7",
    f"""WITH {VID}, s AS (SELECT DISTINCT subject_id FROM v), {ord_sql('o', 's', 'subject_id', 3)}
    SELECT subject_id, CASE WHEN pos0 < greatest(1, least(n - 1, round_even(n * 0.25::DOUBLE, 0))) THEN 'val' ELSE 'train' END AS role FROM o""",
)
def _(spark, sf):
    return S.holdout(videos(spark, sf).select("subject_id").distinct(), 3, 0.25)


@query(
    "leakage_guard",
    "J7 O5",
    f"WITH {VID} SELECT video_id, subject_id FROM v WHERE subject_id NOT IN (SELECT subject_id FROM v WHERE subject_id % 4 = 1)",
)
def _(spark, sf):
    v = videos(spark, sf)
    return S.without_held_out(v, v.where(F.col("subject_id") % 4 == 1))


@query(
    "labelled_entities",
    "J6 J9",
    """SELECT n_chars, quality AS label, d.doc_id AS subject_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("subject_id"), "n_chars")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("subject_id"), F.col("quality").alias("label"))
    wanted = docs.join(labels.select("subject_id").distinct(), "subject_id", "left_semi")
    return S.require_match(S.labelled(wanted, labels, how="left"), "label", "label")


@query(
    "run_signatures",
    "M19 M20",
    f"""WITH {VID}, r AS (SELECT video_id, subject_id, sha256('{{"subject_id":' || subject_id || ',"video_id":' || video_id || '}}') AS run_key FROM v)
    SELECT * FROM r WHERE video_id % 3 <> 0""",
)
def _(spark, sf):
    runs = S.run_key(videos(spark, sf), ["video_id", "subject_id"])
    return S.not_yet_run(runs, runs.where(F.col("video_id") % 3 == 0)).select("video_id", "subject_id", "run_key")


@query(
    "run_queue",
    "M20",
    f"""WITH {VID}, q AS (SELECT video_id, 's' || subject_id AS label, row_number() OVER (ORDER BY video_id) - 1 AS idx FROM v)
    SELECT idx AS index, video_id, label FROM q WHERE label IN ('s3', 's7') OR idx IN (0, 2)""",
)
def _(spark, sf):
    """Queue entries chosen by label or by place."""
    from framelane.operators.ordered import row_position, scan

    v = videos(spark, sf).select("video_id", F.concat(F.lit("s"), F.col("subject_id").cast("string")).alias("label"), F.lit(0).alias("queue"))
    queue = scan(v, ["queue"], "video_id", row_position("index")).select(F.col("index").cast("long").alias("index"), "video_id", "label")
    return S.select_runs(queue, ["s3", "s7"], [0, 2])


@query(
    "embedding_pooling",
    "F22",
    """WITH e AS (SELECT vec_id % 50 AS video_id, i, embedding[i]::DOUBLE AS v, CASE WHEN vec_id % 50 = 7 THEN 0 ELSE ((vec_id * 37) % 100) / 100.0::DOUBLE END AS w
      FROM embeddings, range(1, 65) t(i)), p AS (SELECT video_id, i, CASE WHEN sum(w) > 1e-9 THEN sum(w * v) / sum(w) ELSE avg(v) END AS v FROM e GROUP BY ALL)
    SELECT video_id, round(sum(v), 6) AS total, round(max(v), 6) AS top, round(min(v), 6) AS low FROM p GROUP BY video_id""",
)
def _(spark, sf):
    e = emb(spark, sf).withColumn("weight", F.when(F.col("video_id") == 7, 0.0).otherwise(F.col("weight")))
    out = M.pool(e, ["video_id"], "embedding", "weight")
    s = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)
    out = out.select("video_id", s.alias("total"), F.array_max("embedding").alias("top"), F.array_min("embedding").alias("low"))
    return pick(out, *out.columns)


_DIMS = 64
_COLS = [f"f{i}" for i in range(_DIMS)] + ["copy", "mix"]


def columns(spark, sf):
    e = M.spread(emb(spark, sf), "vec_id")
    e = e.select("vec_id", "label", "subject_id", *[F.col("embedding")[i].alias(f"f{i}") for i in range(_DIMS)])
    return e.withColumns({"copy": F.col("f1") * 2 + 1, "mix": F.col("f0") * 0.5 + F.col("f3") * 0.001})


_CSQL = f"""c AS (SELECT vec_id, {', '.join(f'embedding[{i + 1}]::DOUBLE AS f{i}' for i in range(_DIMS))}, embedding[2]::DOUBLE * 2 + 1 AS copy, embedding[1]::DOUBLE * 0.5 + embedding[4]::DOUBLE * 0.001 AS mix FROM embeddings)"""


@query(
    "correlation_filter",
    "F24",
    f"""WITH {_CSQL}, l AS (SELECT * FROM c UNPIVOT (v FOR feature IN ({', '.join(_COLS)}))),
    o AS (SELECT unnest([{', '.join(f"'{c}'" for c in _COLS)}]) AS feature, unnest(range({_DIMS + 2})) AS at),
    r AS (SELECT a.feature AS f, abs(corr(a.v, b.v)) AS r FROM l a JOIN l b USING (vec_id) JOIN o p ON p.feature = a.feature JOIN o q ON q.feature = b.feature
      WHERE q.at < p.at GROUP BY a.feature, b.feature)
    SELECT DISTINCT feature FROM l WHERE feature NOT IN (SELECT f FROM r WHERE r >= 0.98)""",
)
def _(spark, sf):
    df = columns(spark, sf)
    kept = M.correlation_keep(df, _COLS)
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in kept]))).groupBy(
        "feature"
    ).agg(F.count("v").alias("n")).select("feature")


@query(
    "imputation",
    "F25",
    f"""WITH {_CSQL}, l AS (SELECT vec_id, feature, v FROM c UNPIVOT (v FOR feature IN ({', '.join(_COLS[:_DIMS])}))),
    k AS (SELECT vec_id, feature, CAST(substr(feature, 2) AS INTEGER) AS place, round(v, 1) AS v FROM l),
    h AS (SELECT *, CASE WHEN (vec_id + place) % 5 <> 0 THEN v END AS seen FROM k),
    n AS (SELECT feature, seen, count(*) AS n FROM h WHERE seen IS NOT NULL GROUP BY ALL),
    m AS (SELECT feature, seen AS mode FROM n QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, seen) = 1),
    s AS (SELECT feature, any_value(place) AS place, median(seen) AS med, avg(seen) AS mean FROM h GROUP BY feature),
    f AS (SELECT feature, CASE place % 4 WHEN 0 THEN med WHEN 1 THEN mean WHEN 2 THEN mode ELSE 0.25::DOUBLE END AS value FROM s JOIN m USING (feature))
    SELECT vec_id, round(sum(coalesce(seen, value)), 6) AS total, round(max(coalesce(seen, value)), 6) AS top FROM h JOIN f USING (feature) GROUP BY vec_id""",
)
def _(spark, sf):
    """All four ways to fill, each on a quarter of the columns."""
    names = _COLS[:_DIMS]
    holes = [F.when((F.col("vec_id") + i) % 5 != 0, F.round(n, 1)).alias(n) for i, n in enumerate(names)]
    df = cut(columns(spark, sf).select("vec_id", *holes))
    values = {}
    for k, how in enumerate(("median", "mean", "mode", "constant")):
        values |= M.impute_values(df, names[k::4], how, 0.25)
    row = F.array(*[F.col(n) for n in names])
    out = M.impute(df, values).select("vec_id", F.aggregate(row, F.lit(0.0), lambda a, v: a + v).alias("total"), F.array_max(row).alias("top"))
    return pick(out, *out.columns)


def pca_sql(base: str, k: int, steps: int = 14) -> str:
    """CTEs a0 .. a(k-1): principal axes (i, v) of e(id, i, v), by squaring the covariance matrix again and again.

    ``steps`` squarings leave the leading axis alone, which is then taken out of the matrix. Each
    axis points to where its largest loading is positive.
    """
    out = [
        base, "mu AS (SELECT i, avg(v) AS m FROM e GROUP BY i)", "z AS (SELECT id, i, v - m AS v FROM e JOIN mu USING (i))",
        "nn AS (SELECT count(DISTINCT id) - 1 AS n FROM e)",
        "m0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / any_value(n) AS v FROM z a JOIN z b USING (id), nn GROUP BY a.i, b.i)",
    ]
    for c in range(k):
        out.append(f"p{c}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM m{c} WHERE i = j) AS v FROM m{c})")
        for s in range(steps):
            out.append(f"q{c}_{s} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{c}_{s} a JOIN p{c}_{s} b ON a.j = b.i GROUP BY a.i, b.j)")
            out.append(f"p{c}_{s + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{c}_{s} WHERE i = j) AS v FROM q{c}_{s})")
        f = f"p{c}_{steps}"
        out.append(f"a{c} AS MATERIALIZED (SELECT f.i, f.v / sqrt(t.v) AS v FROM {f} f JOIN (SELECT j, v FROM {f} WHERE i = j ORDER BY v DESC, j LIMIT 1) t ON f.j = t.j)")
        out.append(f"l{c} AS (SELECT sum(m.v * f.v) AS l FROM m{c} m JOIN {f} f ON m.i = f.j AND m.j = f.i)")
        if c < k - 1:
            out.append(f"m{c + 1} AS MATERIALIZED (SELECT m.i, m.j, m.v - l * f.v AS v FROM m{c} m JOIN {f} f USING (i, j), l{c})")
    return ", ".join(out)


def _scores(k: int) -> str:
    return ", ".join(f"round(sum(z.v * a{c}.v), 6) AS p{c}" for c in range(k)) + " FROM z " + " ".join(f"JOIN a{c} USING (i)" for c in range(k))


def parts(df, name: str, k: int, *keep: str):
    out = df.select(*keep, *[F.col(name)[j].alias(f"p{j}") for j in range(k)])
    return pick(out, *out.columns)


@query(
    "pca_embeddings",
    "F18",
    f"WITH {pca_sql('e AS (SELECT vec_id AS id, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i))', 8)} SELECT id AS vec_id, {_scores(8)} GROUP BY id",
)
def _(spark, sf):
    e = emb(spark, sf)
    return parts(M.apply_pca(e, "embedding", M.fit_pca(e, "embedding", 8)), "embedding", 8, "vec_id")


_PSQL = """WITH u AS (SELECT i, j, md5('42-' || i || '-' || j) AS h FROM range(64) a(i), range(8) b(j)),
  g AS (SELECT i, j, sqrt(-2 * ln((CAST('0x' || substr(h, 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))
    * cos((CAST('0x' || substr(h, 9, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE * 6.283185307179586::DOUBLE) AS g FROM u),
  w AS (SELECT i, j, g / sqrt(sum(g * g) OVER (PARTITION BY j)) AS w FROM g),
  p AS (SELECT vec_id, j, sum(embedding[i + 1]::DOUBLE * w) AS v FROM embeddings, w GROUP BY ALL)
  SELECT vec_id, """ + ", ".join(f"round(max(v) FILTER (WHERE j = {j}), 6) AS p{j}" for j in range(8)) + " FROM p GROUP BY vec_id"


@query("random_projection", "F19", _PSQL)
def _(spark, sf):
    out = M.random_projection(emb(spark, sf), "embedding", 8)
    out = out.select("vec_id", *[F.col("embedding")[j].alias(f"p{j}") for j in range(8)])
    return pick(out, *out.columns)


@query(
    "channel_pca",
    "F20",
    f"""WITH {pca_sql('e AS (SELECT vec_id * 8 + (i - 1) // 8 AS id, (i - 1) % 8 AS i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i))', 3)}
    SELECT id // 8 % 50 AS video_id, id AS step, {_scores(3)} GROUP BY id""",
)
def _(spark, sf):
    e = emb(spark, sf).select("video_id", "vec_id", F.posexplode("embedding").alias("i", "value"))
    series = e.select(
        "video_id", (F.col("vec_id") * 8 + F.floor(F.col("i") / 8)).alias("step"),
        F.concat(F.lit("c"), (F.col("i") % 8).cast("string")).alias("channel"), "value",
    )
    m = cut(M.channel_matrix(series, ["video_id"], [f"c{i}" for i in range(8)]))
    return parts(M.apply_pca(m, "vector", M.fit_pca(m, "vector", 3)), "vector", 3, "video_id", "step")


@query("lda_axes", "F21")
def _(spark, sf):
    e = emb(spark, sf)
    return M.project(e, "embedding", M.fit_lda(e, "embedding", "label", 1)).select("vec_id", "label", "embedding")


@query("pls_axes", "F21")
def _(spark, sf):
    e = emb(spark, sf)
    return M.project(e, "embedding", M.fit_pls(e, "embedding", "label", 2)).select("vec_id", "label", "embedding")


@query(
    "embedding_pipeline",
    "F23 F16 F22",
    f"""WITH w AS (SELECT vec_id AS id, vec_id % 25 AS subject_id, vec_id % 50 AS video_id, ((vec_id * 37) % 100) / 100.0::DOUBLE AS w, i, embedding[i]::DOUBLE AS v
      FROM embeddings, range(1, 65) t(i)), {pca_sql('e AS (SELECT id, i, v FROM w WHERE subject_id % 5 <> 0)', 6)},
    ax AS ({' UNION ALL '.join(f'SELECT {c} AS c, * FROM a{c}' for c in range(6))}),
    s AS (SELECT id, subject_id, video_id, any_value(w) AS w, c, sum((w.v - m) * ax.v) AS v FROM w JOIN mu USING (i) JOIN ax USING (i) GROUP BY ALL),
    p AS (SELECT subject_id, video_id, c, CASE WHEN sum(w) > 1e-9 THEN sum(w * v) / sum(w) ELSE avg(v) END AS v FROM s GROUP BY ALL),
    k AS (SELECT c, avg(v) AS m, stddev_pop(v) AS sd FROM p WHERE subject_id % 5 <> 0 GROUP BY c)
    SELECT subject_id, video_id, CASE WHEN subject_id % 5 <> 0 THEN 'train' ELSE 'test' END AS role,
      {', '.join(f"round(max((v - m) / sd) FILTER (WHERE c = {c}), 6) AS e{c}" for c in range(6))} FROM p JOIN k USING (c) GROUP BY ALL""",
)
def _(spark, sf):
    e = cut(emb(spark, sf))
    train, test = M.embedding_pipeline(
        e.where(F.col("subject_id") % 5 != 0), e.where(F.col("subject_id") % 5 == 0), ["subject_id", "video_id"], "embedding", 6, "weight"
    )
    out = train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))
    return pick(out, *out.columns)


@query("out_of_fold_probabilities", "M8 M9 M14")
def _(spark, sf):
    """One fold per subject."""
    df = M.vectorise(columns(spark, sf), _COLS)
    return M.out_of_fold(df, "subject_id", "logistic_regression").select("vec_id", "label", "subject_id", "prob")


@query("classifier_kinds", "M8 M14")
def _(spark, sf):
    """Every kind with its own settings, fitted on four fifths of the subjects and scored on the others."""
    df = cut(M.vectorise(columns(spark, sf), _COLS).select("vec_id", "label", "subject_id", "features"))
    held = F.col("subject_id") % 5 == 0
    train, test = df.where(~held), df.where(held)
    out = None
    for kind in M.CLASSIFIERS:
        part = M.positive_probability(M.fit(train, kind, balanced=True), test)
        part = part.select("vec_id", "label", "prob", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query("permutation_importance", "M15 M16")
def _(spark, sf):
    """Fitted on four fifths of the subjects, importances measured on the others."""
    df = cut(columns(spark, sf))
    held = F.col("subject_id") % 5 == 0
    train = cut(df.where(~held))
    kept = M.correlation_keep(train, _COLS)
    model = M.fit(M.vectorise(train, kept), "logistic_regression")
    return M.restore_importances(M.permutation_importance(model, df.where(held), kept, "vec_id").drop("base_accuracy"), _COLS)


@query("embedding_loso_benchmark", "M17")
def _(spark, sf):
    """Fold-wise PCA, standardisation, subject means and a balanced logistic model, all folds from one pass over the vectors."""
    from framelane.operators import folds

    e = emb(spark, sf).withColumn("label", (F.col("subject_id") % 2).cast("int"))
    out = folds.embedding_leave_one_out(e, "subject_id", "label", "embedding", 4)
    return out.select("subject_id", "label", "prob", F.col("subject_id").alias("fold"))


_LOO = f"""{_CSQL}, s AS (SELECT *, vec_id % 25 AS subject_id, (label % 2)::DOUBLE AS y FROM c JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id)),
  l AS (SELECT subject_id, y, feature, v FROM (SELECT *, 1::DOUBLE AS bias FROM s) UNPIVOT (v FOR feature IN ({', '.join(_COLS)}, bias))),
  o AS (SELECT subject_id, feature, sum(y * v) AS yv, count(*) AS n FROM l GROUP BY ALL),
  a AS (SELECT feature, sum(yv) AS yv, sum(n) AS n FROM o GROUP BY feature)"""


@query(
    "leave_one_out_conditions",
    "M8 M9 M14",
    f"""WITH {_LOO} SELECT subject_id, feature, round((a.yv - o.yv) / (a.n - o.n), 6) AS matched FROM o JOIN a USING (feature)""",
)
def _(spark, sf):
    """At the minimum of a fold's loss, fitted and given labels have the same mean product with every feature, penalty included."""
    from framelane.operators import folds

    df = cut(M.vectorise(columns(spark, sf), _COLS))
    out = folds.fold_averages(df, folds.leave_one_out(df, "subject_id"), "subject_id")
    name = F.element_at(F.array(*[F.lit(c) for c in (*_COLS, "bias")]), F.col("j") + 1)
    return pick(out.select("subject_id", name.alias("feature"), "matched"), "subject_id", "feature", "matched")


@query(
    "embedding_fold_variance",
    "M17 F18",
    """WITH e AS (SELECT vec_id % 25 AS s, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
      o AS (SELECT s, i, sum(v) AS t, sum(v * v) AS q, count(*) AS n FROM e GROUP BY ALL), a AS (SELECT i, sum(t) AS t, sum(q) AS q, sum(n) AS n FROM o GROUP BY i)
    SELECT s AS subject_id, CAST(any_value(s % 2) AS INTEGER) AS label, round(sum((a.q - o.q - (a.t - o.t) * (a.t - o.t) / (a.n - o.n)) / (a.n - o.n - 1)), 6) AS total FROM o JOIN a USING (i) GROUP BY s""",
)
def _(spark, sf):
    """All variance of a fold's training vectors, of which its axes explain a part."""
    from framelane.operators import folds

    out = folds.embedding_leave_one_out(emb(spark, sf).withColumn("label", (F.col("subject_id") % 2).cast("int")), "subject_id", "label", "embedding", 4)
    out = out.where((F.col("explained") > 0) & (F.col("explained") <= F.col("total")) & (F.col("prob").between(0, 1)))
    return pick(out, "subject_id", "label", "total")


@query(
    "lda_conditions",
    "F21",
    """WITH e AS (SELECT vec_id, label % 2 AS y, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
      d AS (SELECT i, avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0) AS d FROM e GROUP BY i)
    SELECT i, round(d / sqrt(sum(d * d) OVER ()), 6) AS direction FROM d""",
)
def _(spark, sf):
    """The pooled scatter takes the axis of two classes to the direction between their means."""
    e = cut(emb(spark, sf))
    axis = M.fit_lda(e, "embedding", "label", 1)[:, 0]
    mean, cov, n = M.second_moments(e, "embedding")
    means = {r["label"]: r["m"] for r in M.pool(e, ["label"], "embedding").select("label", F.col("embedding").alias("m")).collect()}
    sizes = {r["label"]: r["count"] for r in e.groupBy("label").count().collect()}
    between = sum(sizes[c] * np.outer(np.array(m) - mean, np.array(m) - mean) for c, m in means.items())
    within = cov * (n - 1) - between
    within += np.eye(len(mean)) * 1e-6 * max(1.0, np.trace(within) / len(mean))
    to = within @ axis
    to = to / np.linalg.norm(to) * np.sign(to @ (np.array(means[1]) - np.array(means[0])))
    return pick(spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(to)], "i long, direction double"), "i", "direction")


@query("channel_lda", "F21")
def _(spark, sf):
    """Two discriminant axes of eight channels, each series being a video's steps."""
    e = emb(spark, sf).select("vec_id", "label", F.posexplode("embedding").alias("i", "value"))
    series = e.select("vec_id", "label", F.floor(F.col("i") / 8).alias("step"), F.concat(F.lit("c"), (F.col("i") % 8).cast("string")).alias("channel"), "value")
    m = cut(M.channel_matrix(series, ["vec_id", "label"], [f"c{i}" for i in range(8)]))
    return M.project(m, "vector", M.fit_channel_lda(m, ["vec_id"], "vector", "label", 2)).select("vec_id", "label", "step", "vector")


@query(
    "stratified_subjects",
    "M6",
    f"""WITH {VID}, l AS (SELECT DISTINCT subject_id, CASE WHEN subject_id % 3 = 0 THEN 1 ELSE 0 END AS label FROM v), {ord_sql('o', 'l', 'subject_id', 5, 'label')},
    t AS (SELECT *, least(greatest(1, round(n * 0.6::DOUBLE)), greatest(n - 1, 1)) AS nt FROM o)
    SELECT subject_id, label, CASE WHEN pos0 < nt THEN 'train' WHEN pos0 < nt + least(round(n * 0.2::DOUBLE), greatest(n - nt - 1, 0)) THEN 'val' ELSE 'test' END AS role FROM t""",
)
def _(spark, sf):
    v = videos(spark, sf).select("subject_id", F.when(F.col("subject_id") % 3 == 0, 1).otherwise(0).alias("label")).distinct()
    return S.stratified_split(v, 5, 0.6, 0.2)


@query(
    "stratified_lone_class",
    "M6",
    f"""WITH {VID}, l AS (SELECT DISTINCT subject_id, CASE WHEN subject_id = 3 THEN 1 ELSE 0 END AS label FROM v), {ord_sql('o', 'l', 'subject_id', 5)},
    t AS (SELECT *, greatest(1, round_even(n * 0.6::DOUBLE, 0)) AS nt FROM o)
    SELECT subject_id, label, CASE WHEN pos0 < nt THEN 'train' WHEN pos0 < nt + least(round_even((n - nt) * 0.5::DOUBLE, 0), n - nt - 1) THEN 'val' ELSE 'test' END AS role FROM t""",
)
def _(spark, sf):
    """A class of one subject cannot be split, so all are shuffled together."""
    v = videos(spark, sf).select("subject_id", F.when(F.col("subject_id") == 3, 1).otherwise(0).alias("label")).distinct()
    return S.stratified_split(v, 5, 0.6, 0.2)
