"""Exact ranks and percentiles without sorting a group in one task.

Equal values are counted first. The distinct values are then cut into ranges at
sampled split points (a bounded sketch on the driver), and ranks follow from a
prefix sum over range totals plus a prefix sum inside each range. A single
group, or a single key with most rows, is spread over all ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane.operators.ordered import Step, is_short, running_sum, scan, total
from framelane.session import cut

def range_count(df: DataFrame) -> int:
    """Ranges to cut into: as many as shuffle partitions, within what a driver-side sketch holds easily."""
    return min(4096, max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def value_ranges(df: DataFrame, value: str, ranges: int | None = None, out: str = "_range") -> DataFrame:
    """Monotone range number per row. Split points affect balance only, never the result."""
    ranges = ranges or range_count(df)
    probs = [i / ranges for i in range(1, ranges)]
    points = sorted(set(df.approxQuantile(value, probs, 1.0 / (4 * ranges))))
    splits = [float("-inf"), *points, float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep").transform(df)


def value_table(
    df: DataFrame, key: Sequence[str], value: str, extra: dict[str, Column] | None = None, ranges: int | None = None
) -> DataFrame:
    """Distinct non-null values per key with ``n`` rows each (and ``extra`` aggregates), range-numbered."""
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    t = clean.groupBy(*key, F.col(value)).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (extra or {}).items()]
    )
    if is_short(key):  # few values per key: no ranges
        return t.withColumn("_range", F.lit(0.0))
    # read three times below (sketch, range totals, rows), so it is written once
    return value_ranges(cut(t), value, ranges)


def ranked(
    df: DataFrame,
    key: Sequence[str],
    value: str,
    extra: dict[str, Column] | None = None,
    steps: Sequence[Step] = (),
    ranges: int | None = None,
) -> DataFrame:
    """One row per (key, value) in value order: ``n``, ``before`` (rows with a smaller value), ``rows`` (rows of the key)."""
    t = value_table(df, key, value, extra, ranges)
    return scan(
        t, key, value,
        running_sum("before", F.col("n"), inclusive=False),
        total("rows", F.sum("n")),
        *steps,
        block="_range",
    ).drop("_range")


def average_rank(before: Column, n: Column) -> Column:
    """1-based rank with ties sharing their mean rank."""
    return before.cast("double") + (n.cast("double") + 1.0) / 2.0


def percentiles(df: DataFrame, key: Sequence[str], value: str, probs: dict[str, float], ranges: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation between the two neighbouring order statistics."""
    r = ranked(df, key, value, ranges=ranges)
    aggs = [F.max("rows").alias("_rows")]
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("rows") - 1).cast("double")
        for side, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("before") <= idx) & (idx < F.col("before") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{name}"))
    out = r.groupBy(*key).agg(*aggs)
    cols = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_rows") - 1).cast("double")
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*key, *cols)


def percentiles_of(df: DataFrame, key: Sequence[str], wanted: dict[str, dict[str, float]], ranges: int | None = None) -> DataFrame:
    """Percentiles of several columns (column -> name -> share) in one pass: columns become rows, names become columns again."""
    shares = {p: f"_p{i}" for i, p in enumerate(sorted({p for probs in wanted.values() for p in probs.values()}))}
    long = df.select(*key, *[F.col(c).cast("double").alias(c) for c in wanted]).unpivot(list(key), list(wanted), "_name", "_v")
    got = percentiles(long, [*key, "_name"], "_v", {name: p for p, name in shares.items()}, ranges)
    return got.groupBy(*key).agg(
        *[F.max(F.when(F.col("_name") == c, F.col(shares[p]))).alias(name) for c, probs in wanted.items() for name, p in probs.items()]
    )
