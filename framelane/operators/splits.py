"""Subject-safe splits. Random order is the order of md5(seed-id): repeatable and independent of partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane.operators.ordered import row_position, scan, total


def shuffled(df: DataFrame, ids: str, seed: int, key: Sequence[str] = ()) -> DataFrame:
    """Add ``pos0`` (place in the random order of the key) and ``n`` (rows of the key)."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(ids).cast("string")))
    rows = df.withColumns({"_h": h, "_hb": F.conv(F.substring(h, 1, 3), 16, 10).cast("int"), "_one": F.lit(0)})
    by = list(key) or ["_one"]
    out = scan(rows, by, "_h", row_position("pos0"), total("n", F.count(F.lit(1))), block="_hb")
    return out.drop("_h", "_hb", "_one")


def _role(pos: Column, n_train: Column, n_val: Column) -> Column:
    return F.when(pos < n_train, "train").when(pos < n_train + n_val, "val").otherwise("test")


def video_split(videos: DataFrame, seed: int, ratios: tuple[float, float, float] = (0.7, 0.2, 0.1), ids: str = "video_id") -> DataFrame:
    out = shuffled(videos, ids, seed)
    n = F.col("n")
    role = _role(F.col("pos0"), F.floor(n * ratios[0]), F.floor(n * ratios[1]))
    return out.withColumn("role", role).drop("pos0", "n")


def subject_split(
    videos: DataFrame, seed: int, ratios: tuple[float, float, float] = (0.7, 0.2, 0.1), subject: str = "subject_id"
) -> DataFrame:
    """Split by number of subjects; every video follows its subject."""
    out = shuffled(videos.select(subject).distinct(), subject, seed)
    n = F.col("n")
    n_train = F.greatest(F.lit(1), F.floor(n * max(0.0, ratios[0])))
    role = _role(F.col("pos0"), n_train, F.floor(n * max(0.0, ratios[1])))
    return videos.join(out.select(subject, role.alias("role")), subject)


def loso_folds(videos: DataFrame, subject: str = "subject_id") -> DataFrame:
    """One row per fold: videos and subjects on either side, from totals minus the fold's own (no fold x row product)."""
    per = videos.groupBy(subject).agg(F.count(F.lit(1)).alias("test_videos"))
    whole = per.agg(F.sum("test_videos").alias("v"), F.count(F.lit(1)).alias("s")).first()
    return per.select(
        subject,
        (F.lit(whole["v"]) - F.col("test_videos")).alias("train_videos"),
        "test_videos",
        F.lit(whole["s"] - 1).cast("long").alias("train_subjects"),
    )


def loso_fold(videos: DataFrame, held_out: str | int, subject: str = "subject_id") -> DataFrame:
    """Roles of one fold: a column, not a copy of the data."""
    return videos.withColumn("role", F.when(F.col(subject) == F.lit(held_out), "test").otherwise("train"))


def limit_folds(
    folds: DataFrame, subject: str = "subject_id", subjects: Sequence | None = None, max_folds: int = 0
) -> DataFrame:
    """Only the listed subjects, and of those the first ``max_folds`` in subject order."""
    out = folds if subjects is None else folds.where(F.col(subject).isin(list(subjects)))
    return out.orderBy(subject).limit(max_folds) if max_folds > 0 else out


def limit_fold_videos(fold: DataFrame, ids: str = "video_id", max_train: int = 0, max_test: int = 0) -> DataFrame:
    """The first videos of each side in id order."""
    parts = []
    for role, cap in (("train", max_train), ("test", max_test)):
        part = fold.where(F.col("role") == role)
        parts.append(part.orderBy(ids).limit(cap) if cap > 0 else part)
    return parts[0].unionByName(parts[1])


def k_folds(df: DataFrame, k: int, seed: int, ids: str) -> DataFrame:
    """Round robin over the random order; give the distinct subjects for subject-wise folds."""
    return shuffled(df, ids, seed).withColumn("fold", (F.col("pos0") % k).cast("int")).drop("pos0", "n")


def stratified_split(
    subjects: DataFrame, seed: int, train: float, val: float, label: str = "label", ids: str = "subject_id"
) -> DataFrame:
    """Shares of every label class go to train / val / test, each class keeping at least one test subject.

    Fewer than four subjects, or a class of one, cannot be split by class: then all are
    shuffled together (:func:`plain_split`).
    """
    sizes = [r["count"] for r in subjects.groupBy(label).count().collect()]  # one row per class
    if sum(sizes) < 4 or min(sizes, default=0) < 2:
        return plain_split(subjects, seed, train, val, sum(sizes), ids)
    out = shuffled(subjects, ids, seed, [label])
    n = F.col("n")
    n_train = F.least(F.greatest(F.lit(1), F.round(n * train)), F.greatest(n - 1, F.lit(1)))
    n_val = F.least(F.round(n * val), F.greatest(n - n_train - 1, F.lit(0)))
    return out.withColumn("role", _role(F.col("pos0"), n_train, n_val)).drop("pos0", "n")


def plain_split(subjects: DataFrame, seed: int, train: float, val: float, n: int, ids: str = "subject_id") -> DataFrame:
    """Train / val / test over one random order of ``n`` subjects; the last one is tested if nothing else is left to test."""
    n_train = max(1, round(n * train))
    if n < 4:
        n_val = max(0, round(n * val))
        if n_train + n_val >= n:
            n_val = max(0, n - n_train - 1)
    else:
        share, rest = min(0.9, max(0.0, val / max(1e-6, 1.0 - train))), n - n_train
        n_val = max(0, min(round(rest * share), rest - 1)) if rest >= 2 and share > 0 else 0
    if n_train + n_val >= n:
        n_train, n_val = max(0, n - 1 - n_val), n_val
    return shuffled(subjects, ids, seed).withColumn("role", _role(F.col("pos0"), F.lit(n_train), F.lit(n_val))).drop("pos0", "n")


def holdout(subjects: DataFrame, seed: int, share: float, ids: str = "subject_id") -> DataFrame:
    """Validation subjects: the rounded share, at least one and never all."""
    out = shuffled(subjects, ids, seed)
    n_val = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.col("n") * min(0.9, max(0.0, share)))))
    return out.withColumn("role", F.when((F.col("n") > 1) & (F.col("pos0") < n_val), "val").otherwise("train")).drop(
        "pos0", "n"
    )


def without_held_out(train: DataFrame, held_out: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Leakage guard: rows of held-out subjects leave the training side."""
    token = F.lower(F.trim(F.col(subject).cast("string")))
    h = held_out.select(F.lower(F.trim(F.col(subject).cast("string"))).alias("_t")).distinct()
    return train.withColumn("_t", token).join(h, "_t", "left_anti").drop("_t")


def assert_disjoint(train: DataFrame, test: DataFrame, subject: str = "subject_id") -> None:
    """Raise if a subject is on both sides."""
    both = train.select(subject).distinct().join(test.select(subject).distinct(), subject, "left_semi")
    leaked = [r[0] for r in both.limit(5).collect()]
    if leaked:
        raise ValueError(f"held-out subjects in the training side: {leaked}")


def labelled(entities: DataFrame, labels: DataFrame, subject: str = "subject_id", how: str = "inner") -> DataFrame:
    """Entities with their subject's label; those without one are dropped, or kept with ``how="left"`` for a guard to find."""
    return entities.join(labels.select(subject, "label"), subject, how)


def require_match(df: DataFrame, column: str, what: str) -> DataFrame:
    """Fail the job on a row without a partner."""
    return df.where(F.assert_true(F.col(column).isNotNull(), F.lit(f"missing {what}")).isNull())


def run_key(runs: DataFrame, cols: Sequence[str], name: str = "run_key") -> DataFrame:
    """SHA-256 of the settings as JSON with sorted names; equal settings share a key."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})
    return runs.withColumn(name, F.sha2(body, 256))


def not_yet_run(runs: DataFrame, done: DataFrame, name: str = "run_key") -> DataFrame:
    return runs.join(done.select(name).distinct(), name, "left_anti")


def select_runs(runs: DataFrame, labels: Sequence[str] = (), indexes: Sequence[int] = ()) -> DataFrame:
    """Queue entries chosen by label or 0-based index, in queue order; all when nothing is named."""
    out = runs
    if labels or indexes:
        out = runs.where(F.col("label").isin(list(labels)) | F.col("index").isin(list(indexes)))
    return out.orderBy("index")
