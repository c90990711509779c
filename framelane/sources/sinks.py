"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane.functions import geometry as G

# Column order of the confidence summary file.
CONFIDENCE_COLUMNS = [
    "experiment",
    "tracker",
    "total_frames",
    "confidence_mean",
    "confidence_p10",
    "confidence_p05",
    "confidence_min",
    "below_threshold",
    "below_threshold_ratio",
    "longest_low_streak",
    "score_component_mean",
    "token_component_mean",
    "distribution_component_mean",
    "attention_component_mean",
    "short_iou_component_mean",
    "drift_component_mean",
    "drift_pixels_mean",
    "drift_pixels_p95",
    "raw_score_mean",
    "raw_score_p10",
    "source_path",
]


def fixed6(c: Column) -> Column:
    """Six decimals; missing and NaN become an empty string."""
    return F.when(c.isNull() | F.isnan(c), F.lit("")).otherwise(F.format_string("%.6f", c))


def confidence_csv(summary: DataFrame) -> DataFrame:
    """The summary as the text columns of the report, in their fixed order."""
    kinds = dict(summary.dtypes)
    out = []
    for name in CONFIDENCE_COLUMNS:
        src = name if name in kinds else name.replace("_component_mean", "_mean")
        if src not in kinds:
            out.append(F.lit("").alias(name))
        elif kinds[src] == "double":
            out.append(fixed6(F.col(src)).alias(name))
        else:
            out.append(F.coalesce(F.col(src).cast("string"), F.lit("")).alias(name))
    return summary.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").json(path)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, also inside structs, arrays and maps."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _safe(c: Column, kind) -> Column:
    from pyspark.sql import types as T

    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return G.finite_or(c)
    if isinstance(kind, T.StructType):
        made = F.struct(*[_safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _safe(v, kind.valueType))
    return c


def write_evaluation(frames: DataFrame, curve: DataFrame, summary: DataFrame, folder: str) -> None:
    """Per-frame IoU and centre error and the success curve as csv, the summary as JSON without NaN, one folder each."""
    write_csv(frames, f"{folder}/frames")
    write_csv(curve, f"{folder}/success_curve")
    write_json(summary, f"{folder}/summary")


def write_predictions(df: DataFrame, path: str, by: Sequence[str] = ("model", "subject_id", "video_id"), within: Sequence[str] = ()) -> None:
    """One folder per value of ``by``. Rows of a video may fill several files, so a long one is no bottleneck.

    A folder per video is a file for a few rows: with many videos name it in ``within`` instead. Rows are then dealt and
    sorted by range of both lists, so folders stay few, files large, and the rows of a video lie side by side in them.
    """
    if within:
        df = df.repartitionByRange(*by, *within).sortWithinPartitions(*by, *within)
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
