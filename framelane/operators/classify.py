"""Classification results: confusion metrics, AUC, Brier, votes, thresholds, pooled reversal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane.functions import geometry as G
from framelane.operators.ordered import previous_known, running_sum, total
from framelane.operators.ranked import average_rank, ranked

# 91 candidate thresholds from 0.05 to 0.95.
GRID = [0.05 + 0.9 * i / 90 for i in range(91)]


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion(df: DataFrame, key: Sequence[str], truth: str = "label_true", pred: str = "label_pred") -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return df.groupBy(*key).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Metrics from tp / fp / fn / tn; balanced accuracy averages over the classes that occur."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec, rec, spec = _safe(tp, tp + fp), _safe(tp, tp + fn), _safe(tn, tn + fp)
    balanced = (
        F.when((tp + fn > 0) & (tn + fp > 0), (rec + spec) / 2).when(tp + fn > 0, rec).otherwise(spec)
    )
    return counts.withColumns(
        {
            "accuracy": _safe(tp + tn, tp + fp + fn + tn),
            "balanced_accuracy": balanced,
            "precision_positive": prec,
            "recall_positive": rec,
            "specificity": spec,
            "f1_positive": F.when(prec + rec > 0, prec * rec * 2 / (prec + rec)).otherwise(F.lit(0.0)),
            "support_positive": tp + fn,
        }
    )


def metrics(df: DataFrame, key: Sequence[str], truth: str = "label_true", pred: str = "label_pred") -> DataFrame:
    return rates(confusion(df, key, truth, pred))


def auc(df: DataFrame, key: Sequence[str], score: str = "prob", truth: str = "label_true") -> DataFrame:
    """Area under the ROC curve by mean ranks (ties count half); null for a single class."""
    rows = df.where(G.finite(F.col(score)) & F.col(truth).isNotNull())
    r = ranked(rows, key, score, {"pos": F.count_if(F.col(truth) == 1)})
    out = r.groupBy(*key).agg(
        F.sum("pos").alias("n_pos"),
        (F.sum("n") - F.sum("pos")).alias("n_neg"),
        F.sum(average_rank(F.col("before"), F.col("n")) * F.col("pos")).alias("_s"),
    )
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return out.select(
        *key, "n_pos", "n_neg", F.when((p > 0) & (n > 0), (F.col("_s") - p * (p + 1) / 2) / (p * n)).alias("auc")
    )


def brier(df: DataFrame, key: Sequence[str], prob: str = "prob", truth: str = "label_true", bins: int = 10) -> DataFrame:
    """Brier score and its reliability / resolution / uncertainty parts over ``bins`` equal bins."""
    p = G.unit_clip(F.col(prob))
    o = (F.col(truth) == 1).cast("double")
    b = F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1))
    cells = df.groupBy(*key, b.alias("bin")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(p).alias("sp"),
        F.sum(o).alias("so"),
        F.sum(F.pow(p - o, 2)).alias("sq"),
    )
    n, sp, so = F.col("n"), F.col("sp"), F.col("so")
    out = cells.groupBy(*key).agg(
        F.sum("n").alias("_n"),
        F.sum("sq").alias("_sq"),
        F.sum("so").alias("_so"),
        F.sum(F.pow(sp / n - so / n, 2) * n).alias("_rel"),
        F.sum(F.pow(so / n, 2) * n).alias("_res"),
    )
    base = F.col("_so") / F.col("_n")
    return out.select(
        *key,
        (F.col("_sq") / F.col("_n")).alias("brier_score"),
        (F.col("_rel") / F.col("_n")).alias("reliability"),
        (F.col("_res") / F.col("_n") - base * base).alias("resolution"),
        (base * (F.lit(1.0) - base)).alias("uncertainty"),
    )


def best_threshold(df: DataFrame, key: Sequence[str], prob: str = "prob", truth: str = "label_true") -> DataFrame:
    """Threshold with the largest J = sensitivity + specificity - 1; ties go to the one nearest 0.5.

    Candidates are 0, 0.5, every probability and every midpoint. What a
    candidate classifies follows from running counts over distinct values.
    """
    pos = F.count_if(F.col(truth) == 1)
    r = ranked(
        df.where(F.col(truth).isNotNull()), key, prob, {"pos": pos},
        [
            previous_known("prev", F.col(prob), prob),
            running_sum("pos_before", F.col("pos"), inclusive=False),
            total("pos_all", F.sum("pos")),
            total("below", F.sum(F.when(F.col(prob) < 0.5, F.col("n")).otherwise(0))),
            total("pos_below", F.sum(F.when(F.col(prob) < 0.5, F.col("pos")).otherwise(0))),
        ],
    )
    neg_all = F.col("rows") - F.col("pos_all")
    here = (F.col("pos_all") - F.col("pos_before"), F.col("before") - F.col("pos_before"))
    half = (F.col("pos_all") - F.col("pos_below"), F.col("below") - F.col("pos_below"))

    def cand(t: Column, counts: tuple[Column, Column]) -> Column:
        j = counts[0] / F.col("pos_all") + counts[1] / neg_all - 1.0
        t = G.unit_clip(t)
        return F.struct((-j).alias("worse"), F.abs(t - 0.5).alias("far"), t.alias("t"))

    v = F.col(prob)
    first = F.col("prev").isNull()
    rows = F.when(
        first, F.array(cand(v, here), cand(F.lit(0.0), (F.col("pos_all"), F.lit(0))), cand(F.lit(0.5), half))
    ).otherwise(F.array(cand(v, here), cand((F.col("prev") + v) / 2.0, here)))
    two = (F.col("pos_all") > 0) & (neg_all > 0)
    best = r.groupBy(*key).agg(F.min(F.when(two, F.array_min(rows))).alias("b"))
    return best.select(
        *key,
        F.coalesce(F.col("b.t"), F.lit(0.5)).alias("threshold"),
        F.coalesce(-F.col("b.worse"), F.lit(0.0)).alias("youden_j"),
    )


def best_grid_threshold(df: DataFrame, key: Sequence[str], prob: str = "prob", truth: str = "label_true") -> DataFrame:
    """Same statistic on the fixed grid 0.05 .. 0.95 (91 steps); the first best wins."""
    grid = F.array(*[F.lit(t) for t in GRID])
    level = F.size(F.filter(grid, lambda t: t <= F.col(prob)))
    cells = df.groupBy(*key, level.alias("level")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")
    )
    steps = cells.select("*", F.posexplode(grid).alias("i", "t"))
    above = F.col("level") > F.col("i")
    j = steps.groupBy(*key, "i", "t").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(~above, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("q"),
    )
    score = _safe(F.col("tp"), F.col("p")) + _safe(F.col("tn"), F.col("q")) - 1.0
    best = j.groupBy(*key).agg(F.min(F.struct((-score).alias("worse"), F.col("i"), F.col("t"))).alias("b"))
    return best.select(*key, F.col("b.t").alias("threshold"), (-F.col("b.worse")).alias("youden_j"))


def apply_threshold(df: DataFrame, threshold: Column, prob: str = "prob", default: Column | None = None) -> DataFrame:
    """``label_pred`` from the probability; where a model gives no probability at all (0 everywhere), ``default``."""
    pred = (F.col(prob) >= threshold).cast("int")
    if default is not None:
        top = df.agg(F.max(prob).alias("m")).first()["m"]
        if not top:
            pred = default.cast("int")
    return df.withColumn("label_pred", pred)


def reverse_pooled(
    df: DataFrame, thresholds: DataFrame, experiment: Sequence[str], fold: str = "fold", force: bool = False
) -> DataFrame:
    """Turn probabilities round where the pooled AUC of an experiment is below 0.5; keep each fold's threshold."""
    rows = df.where(F.col("label_true").isin(0, 1) & G.finite(F.col("prob")))
    rows = rows.withColumn("prob", G.unit_clip(F.col("prob")))
    if force:
        rows = rows.withColumn("reversed", F.lit(True))
    else:
        pooled = auc(rows, experiment).select(*experiment, "auc")
        if experiment:
            rows = rows.join(pooled, list(experiment))
        else:
            rows = rows.withColumn("auc", F.lit(pooled.first()["auc"]).cast("double"))
        rows = rows.withColumn("reversed", F.coalesce(F.col("auc") < 0.5, F.lit(False))).drop("auc")
    rows = rows.join(thresholds.select(*experiment, fold, "threshold"), [*experiment, fold], "left")
    p = G.unit_clip(F.when(F.col("reversed"), F.lit(1.0) - F.col("prob")).otherwise(F.col("prob")))
    rows = rows.withColumn("prob", p)
    t = G.finite_or(F.col("threshold"), 0.5)
    return rows.withColumn("label_pred", (F.col("prob") >= t).cast("int")).drop("threshold")


def pool_folds(folds: DataFrame, preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Leave-one-out pooling: summed counts and their metrics, pooled AUC / Brier, mean threshold and J."""
    s = folds.groupBy(*by).agg(
        *[F.sum(F.bround(c).cast("long")).alias(c) for c in ("tp", "fp", "fn", "tn")],
        F.avg("threshold").alias("threshold_used"),
        F.avg("youden_j").alias("youden_j"),
    )
    s = rates(s.where(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") > 0))
    return s.join(auc(preds, by).select(*by, F.col("auc").alias("roc_auc")), list(by), "left").join(
        brier(preds, by), list(by), "left"
    )


# ---- votes over modalities -------------------------------------------------

# Modality names of the two recording schemes and their common names.
MODALITY_NAMES = {
    "doppler": "doppler",
    "Grasp": "grasp",
    "Relax": "relax",
    "Rest": "rest",
    "Rest post": "rest_post",
    "D": "doppler",
    "G-R": "relax",
    "R-G": "grasp",
    "R1": "rest",
    "R2": "rest_post",
}
# Order in which modalities are listed.
MODALITY_ORDER = ["doppler", "grasp", "relax", "rest", "rest_post"]


def canonical_modality(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MODALITY_NAMES.items() for x in kv])
    return F.coalesce(table[name], name)


def modality_rank(name: Column) -> Column:
    """Sort key: known modalities in their order, others by name."""
    known = F.array(*[F.lit(m) for m in MODALITY_ORDER])
    at = F.array_position(known, name)
    return F.struct(F.when(at > 0, at).otherwise(F.lit(len(MODALITY_ORDER) + 1)).alias("k"), name.alias("n"))


def modality_accuracy(df: DataFrame, by: str = "modality") -> DataFrame:
    hit = F.count_if(F.col("label_pred") == F.col("label_true"))
    return df.groupBy(by).agg(
        hit.alias("correct"), F.count(F.lit(1)).alias("total"), (hit / F.count(F.lit(1))).alias("accuracy")
    )


def _vote_sums(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a vote needs per key: the leading modality's label, positive votes, rows, probabilities."""
    return df.groupBy(*key).agg(
        F.min(F.struct(modality_rank(F.col("modality")).alias("rank"), F.col("label_true").alias("label"))).alias("_lead"),
        F.sum(F.coalesce("label_pred", F.lit(0))).cast("long").alias("_votes"),
        F.count(F.lit(1)).alias("_rows"),
        F.sum("prob").alias("_prob"),
        F.count("prob").alias("_probs"),
    )


def _vote(sums: DataFrame, key: Sequence[str]) -> DataFrame:
    out = sums.groupBy(*key).agg(
        F.min("_lead")["label"].alias("true_label"),
        F.sum("_votes").alias("votes_for_positive"),
        F.sum("_rows").alias("total_votes"),
        F.try_divide(F.sum("_prob"), F.sum("_probs")).alias("mean_prob"),
    )
    hard = (F.col("votes_for_positive") > F.col("total_votes") / 2).cast("int")
    soft = (F.col("mean_prob") >= 0.5).cast("int")
    return out.withColumns(
        {
            "vote": hard,
            "correct": hard == F.col("true_label"),
            "soft_vote": soft,
            "soft_correct": soft == F.col("true_label"),
        }
    )


def vote(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Hard vote (strictly more than half) and soft vote (mean probability of at least 0.5) per key."""
    return _vote(_vote_sums(df, key), key)


def modality_triples(df: DataFrame, limit: int = 10) -> DataFrame:
    """Every choice of three modalities, voted and ranked; none when there are three or fewer.

    Rows shrink to one per subject and modality before the triples multiply
    them; the distinct modality names form one small array.
    """
    sums = _vote_sums(df, ["subject_id", "modality"])
    names = sums.agg(F.array_sort(F.collect_set("modality")).alias("m")).where(F.size("m") > 3)
    t = names.select("m", F.explode("m").alias("a"))
    t = t.select("m", "a", F.explode(F.filter("m", lambda x: x > F.col("a"))).alias("b"))
    t = t.select("a", "b", F.explode(F.filter("m", lambda x: x > F.col("b"))).alias("c"))
    t = t.select(F.concat_ws("+", "a", "b", "c").alias("combo"), F.explode(F.array("a", "b", "c")).alias("modality"))
    voted = _vote(sums.join(t, "modality"), ["combo", "subject_id"])
    out = voted.groupBy("combo").agg(
        F.count_if("correct").alias("correct"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if("correct") / F.count(F.lit(1))).alias("accuracy"),
        F.count_if("soft_correct").alias("soft_correct"),
        (F.count_if("soft_correct") / F.count(F.lit(1))).alias("soft_accuracy"),
    )
    return out.orderBy(F.col("accuracy").desc(), F.col("correct").desc(), F.col("combo")).limit(limit)


def subject_probability(df: DataFrame, key: Sequence[str] = ("subject_id",)) -> DataFrame:
    return df.groupBy(*key).agg(F.avg("prob").alias("prob"))
