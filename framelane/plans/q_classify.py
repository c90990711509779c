"""Classification result queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.operators import classify as C
from framelane.plans.fixtures import CLF, PREDS, clf, preds
from framelane.plans.registry import pick, query

_CONF = """count(*) FILTER (WHERE label_true = 1 AND label_pred = 1) AS tp, count(*) FILTER (WHERE label_true = 0 AND label_pred = 1) AS fp,
  count(*) FILTER (WHERE label_true = 1 AND label_pred = 0) AS fn, count(*) FILTER (WHERE label_true = 0 AND label_pred = 0) AS tn"""


def rates_sql(src: str, extra: str = "") -> str:
    p, r, s = ("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END",
               "CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END")
    return f"""SELECT *, {extra} round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
      round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN ({r} + {s}) / 2 WHEN tp + fn > 0 THEN {r} ELSE {s} END, 6) AS balanced_accuracy,
      round({p}, 6) AS precision_positive, round({r}, 6) AS recall_positive, round({s}, 6) AS specificity,
      round(CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0 END, 6) AS f1_positive,
      tp + fn AS support_positive FROM {src}"""


def auc_sql(p: str, src: str, key: str) -> str:
    return f"""{p} AS (SELECT {key}, sum(CASE WHEN a.prob > b.prob THEN 1 WHEN a.prob = b.prob THEN 0.5 ELSE 0 END)
      / CAST(count(*) AS DOUBLE) AS auc FROM (SELECT * FROM {src} WHERE label_true = 1) a
      JOIN (SELECT * FROM {src} WHERE label_true = 0) b USING ({key}) GROUP BY {key})"""


def brier_sql(p: str, src: str, key: str) -> str:
    return f"""{p}_b AS (SELECT {key}, least(CAST(floor(prob * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(prob) AS f,
      avg(CAST(label_true AS DOUBLE)) AS o FROM {src} GROUP BY ALL),
    {p}_o AS (SELECT {key}, avg((prob - label_true) * (prob - label_true)) AS bs, avg(CAST(label_true AS DOUBLE)) AS ob, count(*) AS nn FROM {src} GROUP BY ALL),
    {p} AS (SELECT {key}, any_value(bs) AS brier_score, sum(n * (f - o) * (f - o)) / any_value(nn) AS reliability,
      sum(n * (o - ob) * (o - ob)) / any_value(nn) AS resolution, any_value(ob * (1 - ob)) AS uncertainty
      FROM {p}_b JOIN {p}_o USING ({key}) GROUP BY {key})"""


def youden_sql(p: str, src: str, key: str) -> str:
    return f"""{p}_u AS (SELECT DISTINCT {key}, prob FROM {src}),
    {p}_c AS (SELECT {key}, prob AS t FROM {p}_u UNION SELECT {key}, (prob + lead(prob) OVER (PARTITION BY {key} ORDER BY prob)) / 2 FROM {p}_u
      UNION SELECT DISTINCT {key}, CAST(0 AS DOUBLE) FROM {p}_u UNION SELECT DISTINCT {key}, CAST(0.5 AS DOUBLE) FROM {p}_u),
    {p}_j AS (SELECT {key}, t, count(*) FILTER (WHERE prob >= t AND label_true = 1) / CAST(count(*) FILTER (WHERE label_true = 1) AS DOUBLE)
        + count(*) FILTER (WHERE prob < t AND label_true = 0) / CAST(count(*) FILTER (WHERE label_true = 0) AS DOUBLE) - 1 AS j
      FROM {src} JOIN {p}_c USING ({key}) WHERE t IS NOT NULL GROUP BY {key}, t),
    {p} AS (SELECT {key}, t AS threshold, j AS youden_j FROM {p}_j
      QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY j DESC, abs(t - 0.5), t) = 1)"""


@query("confusion_metrics", "A11", f"WITH {CLF}, c AS (SELECT fold, {_CONF} FROM clf GROUP BY fold) {rates_sql('c')}")
def _(spark, sf):
    m = C.metrics(clf(spark, sf), ["fold"])
    return pick(m, *m.columns)


@query(
    "roc_auc",
    "A12 J13",
    f"""WITH {CLF}, {auc_sql('a', 'clf', 'fold')} SELECT fold, count(*) FILTER (WHERE label_true = 1) AS n_pos,
      count(*) FILTER (WHERE label_true = 0) AS n_neg, round(any_value(auc), 6) AS auc FROM clf JOIN a USING (fold) GROUP BY fold""",
)
def _(spark, sf):
    m = C.auc(clf(spark, sf), ["fold"])
    return pick(m, *m.columns)


@query(
    "brier_decomposition",
    "A13 A14 P18",
    f"""WITH {CLF}, {brier_sql('b', 'clf', 'modality')} SELECT modality, round(brier_score, 6) AS brier_score,
      round(reliability, 6) AS reliability, round(resolution, 6) AS resolution, round(uncertainty, 6) AS uncertainty FROM b""",
)
def _(spark, sf):
    m = C.brier(clf(spark, sf), ["modality"])
    return pick(m, *m.columns)


@query(
    "youden_threshold",
    "M10",
    f"WITH {CLF}, {youden_sql('y', 'clf', 'fold')} SELECT fold, round(threshold, 6) AS threshold, round(youden_j, 6) AS youden_j FROM y",
)
def _(spark, sf):
    m = C.best_threshold(clf(spark, sf), ["fold"])
    return pick(m, *m.columns)


@query(
    "youden_grid_threshold",
    "M11",
    f"""WITH {CLF}, j AS (SELECT modality, i, 0.05::DOUBLE + 0.9::DOUBLE * i / 90 AS t,
        count(*) FILTER (WHERE prob >= 0.05::DOUBLE + 0.9::DOUBLE * i / 90 AND label_true = 1) / CAST(count(*) FILTER (WHERE label_true = 1) AS DOUBLE)
        + count(*) FILTER (WHERE prob < 0.05::DOUBLE + 0.9::DOUBLE * i / 90 AND label_true = 0) / CAST(count(*) FILTER (WHERE label_true = 0) AS DOUBLE) - 1 AS j
      FROM clf, range(91) g(i) GROUP BY modality, i)
    SELECT modality, round(t, 6) AS threshold, round(j, 6) AS youden_j FROM j
    QUALIFY row_number() OVER (PARTITION BY modality ORDER BY j DESC, i) = 1""",
)
def _(spark, sf):
    m = C.best_grid_threshold(clf(spark, sf), ["modality"])
    return pick(m, *m.columns)


@query(
    "apply_threshold",
    "M12",
    f"""WITH {CLF}, {youden_sql('y', 'clf', 'fold')}
    SELECT subject_id, modality, CASE WHEN prob >= threshold THEN 1 ELSE 0 END AS label_pred FROM clf JOIN y USING (fold)""",
)
def _(spark, sf):
    df = clf(spark, sf)
    t = C.best_threshold(df, ["fold"])
    out = C.apply_threshold(df.join(t, "fold"), F.col("threshold"), default=F.lit(0))
    return out.select("subject_id", "modality", "label_pred")


@query(
    "pooled_reversal",
    "M13 A11",
    f"""WITH {CLF}, e AS (SELECT *, subject_id % 2 AS exp FROM clf), {auc_sql('a', 'e', 'exp')},
    ef AS (SELECT *, exp * 10 + fold AS ef FROM e), {youden_sql('y', 'ef', 'ef')},
    r AS (SELECT exp, fold, label_true, auc < 0.5 AS rev, CASE WHEN (CASE WHEN auc < 0.5 THEN 1 - prob ELSE prob END) >= threshold
      THEN 1 ELSE 0 END AS label_pred FROM ef JOIN a USING (exp) JOIN y USING (ef)),
    c AS (SELECT exp, fold, bool_or(rev) AS reversed, {_CONF} FROM r GROUP BY exp, fold) {rates_sql('c')}""",
)
def _(spark, sf):
    df = clf(spark, sf).withColumn("exp", F.col("subject_id") % 2)
    t = C.best_threshold(df, ["exp", "fold"])
    out = C.reverse_pooled(df, t, ["exp"])
    m = C.rates(
        C.confusion(out, ["exp", "fold", "reversed"])
    )
    return pick(m, *m.columns)


@query(
    "loso_pooling",
    "A15 A12 A13",
    f"""WITH {CLF}, mf AS (SELECT *, modality || fold AS mf FROM clf), {youden_sql('y', 'mf', 'mf')},
    f AS (SELECT modality, mf, {_CONF} FROM mf GROUP BY modality, mf),
    s AS (SELECT modality, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
      CAST(sum(tn) AS BIGINT) AS tn, round(avg(threshold), 6) AS threshold_used, round(avg(youden_j), 6) AS youden_j FROM f JOIN y USING (mf) GROUP BY modality),
    {auc_sql('a', 'clf', 'modality')}, {brier_sql('b', 'clf', 'modality')}
    SELECT r.*, round(auc, 6) AS roc_auc, round(brier_score, 6) AS brier_score, round(reliability, 6) AS reliability,
      round(resolution, 6) AS resolution, round(uncertainty, 6) AS uncertainty FROM ({rates_sql('s')}) r JOIN a USING (modality) JOIN b USING (modality)""",
)
def _(spark, sf):
    df = clf(spark, sf)
    key = ["modality", "fold"]
    folds = C.confusion(df, key).join(C.best_threshold(df, key), key)
    m = C.pool_folds(folds, df, ["modality"])
    return pick(m, *m.columns)


@query(
    "modality_accuracy",
    "A16 P14",
    f"""WITH {CLF} SELECT modality, count(*) FILTER (WHERE label_true = label_pred) AS correct, count(*) AS total,
      round(count(*) FILTER (WHERE label_true = label_pred) / count(*), 6) AS accuracy FROM clf GROUP BY modality""",
)
def _(spark, sf):
    df = clf(spark, sf).withColumn("modality", C.canonical_modality(F.col("modality")))
    m = C.modality_accuracy(df)
    return pick(m, *m.columns)


_VOTE = """min_by(label_true, modality) AS true_label, CAST(sum(label_pred) AS BIGINT) AS votes_for_positive, count(*) AS total_votes,
  avg(prob) AS mean_prob"""


@query(
    "subject_votes",
    "A17 A18 A47",
    f"""WITH {CLF}, v AS (SELECT subject_id, {_VOTE} FROM clf GROUP BY subject_id)
    SELECT subject_id, true_label, votes_for_positive, total_votes, round(mean_prob, 6) AS mean_prob,
      CASE WHEN votes_for_positive > total_votes / 2 THEN 1 ELSE 0 END AS vote,
      (CASE WHEN votes_for_positive > total_votes / 2 THEN 1 ELSE 0 END) = true_label AS correct,
      CASE WHEN mean_prob >= 0.5 THEN 1 ELSE 0 END AS soft_vote, (CASE WHEN mean_prob >= 0.5 THEN 1 ELSE 0 END) = true_label AS soft_correct FROM v""",
)
def _(spark, sf):
    m = C.vote(clf(spark, sf), ["subject_id"])
    return pick(m, *m.columns)


@query(
    "modality_triples",
    "A19 O2",
    f"""WITH {CLF}, m AS (SELECT DISTINCT modality FROM clf),
    t AS (SELECT a.modality || '+' || b.modality || '+' || c.modality AS combo, unnest([a.modality, b.modality, c.modality]) AS modality
      FROM m a, m b, m c WHERE a.modality < b.modality AND b.modality < c.modality),
    v AS (SELECT combo, subject_id, {_VOTE} FROM clf JOIN t USING (modality) GROUP BY combo, subject_id),
    w AS (SELECT combo, (votes_for_positive > total_votes / 2) = (true_label = 1) AS ok, (mean_prob >= 0.5) = (true_label = 1) AS sok FROM v)
    SELECT combo, count(*) FILTER (WHERE ok) AS correct, count(*) AS total, round(count(*) FILTER (WHERE ok) / count(*), 6) AS accuracy,
      count(*) FILTER (WHERE sok) AS soft_correct, round(count(*) FILTER (WHERE sok) / count(*), 6) AS soft_accuracy
    FROM w GROUP BY combo ORDER BY accuracy DESC, correct DESC, combo LIMIT 10""",
)
def _(spark, sf):
    m = C.modality_triples(clf(spark, sf))
    return pick(m, *m.columns)


@query(
    "subject_mean_probability",
    "A47 M14",
    f"WITH {CLF} SELECT subject_id, round(avg(prob), 6) AS prob FROM clf GROUP BY subject_id",
)
def _(spark, sf):
    return pick(C.subject_probability(clf(spark, sf)), "subject_id", "prob")


@query(
    "canonical_modalities",
    "P14",
    f"""WITH {PREDS}, r AS (SELECT CASE pos % 7 WHEN 0 THEN 'Rest post' WHEN 1 THEN 'D' WHEN 2 THEN 'G-R' WHEN 3 THEN 'R1' WHEN 4 THEN 'doppler' WHEN 5 THEN 'rest' ELSE modality END AS name FROM preds)
    SELECT name, CASE name WHEN 'Rest post' THEN 'rest_post' WHEN 'D' THEN 'doppler' WHEN 'G-R' THEN 'relax' WHEN 'R1' THEN 'rest' ELSE name END AS modality, count(*) AS n FROM r GROUP BY ALL""",
)
def _(spark, sf):
    """Names of both recording schemes, common names and unknown ones."""
    names, other = ("Rest post", "D", "G-R", "R1", "doppler", "rest"), F.col("modality")
    for i, n in enumerate(names):
        other = F.when(F.col("pos") % 7 == i, n).otherwise(other)
    rows = preds(spark, sf).select(other.alias("name"))
    return rows.groupBy("name", C.canonical_modality(F.col("name")).alias("modality")).agg(F.count(F.lit(1)).alias("n"))
