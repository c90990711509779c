"""One prediction per frame.

All rules are a lexicographic minimum, so they run as a partial + final
aggregate: copies of a frame collapse map-side and no frame is ever sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane.functions import geometry as G


def pick(df: DataFrame, key: Sequence[str], priority: Sequence[Column]) -> DataFrame:
    """Row with the smallest ``priority`` tuple for every ``key``; ``priority`` must be total."""
    rest = [c for c in df.columns if c not in key]
    ranks = F.struct(*[p.alias(f"k{i}") for i, p in enumerate(priority)])
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), ranks).alias("_r"))
    return best.select(*[F.col(c) if c in key else F.col("_r")[c].alias(c) for c in df.columns])


def _descending(c: Column) -> Column:
    """Rank key that puts large first and null / NaN last."""
    return F.coalesce(-F.nanvl(c, F.lit(float("-inf"))), F.lit(float("inf")))


def first_per_frame(df: DataFrame, key: Sequence[str], pos: str = "pos") -> DataFrame:
    return pick(df, key, [F.col(pos)])


def last_per_frame(df: DataFrame, key: Sequence[str], pos: str = "pos") -> DataFrame:
    return pick(df, key, [-F.col(pos)])


def detector_first(df: DataFrame, key: Sequence[str], pos: str = "pos") -> DataFrame:
    """Detections beat fallbacks, then the higher score, then input order."""
    return pick(df, key, [F.coalesce("is_fallback", F.lit(False)), _descending(F.col("score")), F.col(pos)])


def most_confident(df: DataFrame, key: Sequence[str], pos: str = "pos", min_wh: float = 2.0) -> DataFrame:
    """Confidence (else score), then a usable box, then a detection, then input order."""
    return pick(
        df,
        key,
        [
            -G.prediction_confidence(*[F.col(c) for c in ("confidence", "score") if c in df.columns]),
            ~G.valid_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), min_wh),
            F.coalesce("is_fallback", F.lit(False)),
            F.col(pos),
        ],
    )


def highest_score(df: DataFrame, key: Sequence[str], pos: str = "pos") -> DataFrame:
    return pick(df, key, [_descending(F.col("score")), F.col(pos)])
