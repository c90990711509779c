"""Frame-level helpers: missing values, runs, chunks, spines, samples, rolling windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelane.operators.ordered import (
    BLOCK,
    SPAN,
    halo,
    next_known,
    previous_known,
    row_position,
    running_sum,
    scan,
    total,
)


def mask_unobserved(df: DataFrame, cols: Sequence[str], seen: Column) -> DataFrame:
    return df.withColumns({c: F.when(seen, F.col(c)) for c in cols})


def fill_edges(df: DataFrame, key: Sequence[str], cols: Sequence[str], order: str = "frame_index") -> DataFrame:
    """Forward fill, then back fill of the head, then 0."""
    steps = []
    for c in cols:
        v = F.when(~F.isnan(c), F.col(c))
        steps += [previous_known(f"_p_{c}", v, order, True), next_known(f"_n_{c}", v, order)]
    out = scan(df, key, order, *steps)
    return out.select(
        *[
            F.coalesce(f"_p_{c}", f"_n_{c}", F.lit(0.0)).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )


def hold_last(df: DataFrame, key: Sequence[str], box: str, order: str = "frame_index") -> DataFrame:
    """Frames without a box take the previous one; ``held`` marks them."""
    out = scan(df, key, order, previous_known("_last", F.col(box), order))
    return out.select(
        *[c for c in df.columns if c != box],
        F.coalesce(box, "_last").alias(box),
        (F.col(box).isNull() & F.col("_last").isNotNull()).alias("held"),
    )


def chunks(df: DataFrame, key: Sequence[str], pos: str = "pos", frame: str = "frame_index") -> DataFrame:
    """0-based ``chunk``: a new one starts where the frame number falls against the previous input row."""
    out = scan(df, key, pos, previous_known("_pf", F.col(frame), pos))
    out = out.withColumn("_cut", F.coalesce(F.col(frame) < F.col("_pf"), F.lit(False)).cast("long"))
    return scan(out, key, pos, running_sum("chunk", F.col("_cut"))).drop("_pf", "_cut")


def run_bounds(df: DataFrame, key: Sequence[str], flag: Column, order: str = "frame_index") -> DataFrame:
    """Add ``pos0``, ``run_first`` and ``run_last`` (positions) of the run of true flags a row lies in."""
    out = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    out = scan(
        out, key, order, row_position(),
        previous_known("_pf", F.col("_f"), order), next_known("_nf", F.col("_f"), order),
    )
    opens = F.col("_f") & ~F.coalesce("_pf", F.lit(False))
    closes = F.col("_f") & ~F.coalesce("_nf", F.lit(False))
    out = scan(
        out, key, order,
        previous_known("run_first", F.when(opens, F.col("pos0")), order, True),
        next_known("run_last", F.when(closes, F.col("pos0")), order, True),
    )
    return out.withColumns({c: F.when(F.col("_f"), F.col(c)) for c in ("run_first", "run_last")}).drop(
        "_f", "_pf", "_nf"
    )


def runs(df: DataFrame, key: Sequence[str], flag: Column, order: str = "frame_index") -> DataFrame:
    """Half-open position ranges ``[start, stop)`` of true flags."""
    out = run_bounds(df, key, flag, order).where(F.col("pos0") == F.col("run_first"))
    return out.select(*key, F.col("run_first").alias("start"), (F.col("run_last") + 1).alias("stop"))


def drop_long_runs(
    df: DataFrame, key: Sequence[str], flag: str, max_run: int, order: str = "frame_index"
) -> DataFrame:
    """Clear ``flag`` inside runs longer than ``max_run``; shorter bursts stay."""
    if max_run < 1:
        return df
    out = run_bounds(df, key, F.col(flag), order)
    short = F.col("run_last") - F.col("run_first") + 1 <= max_run
    out = out.withColumn(flag, F.col(flag) & F.coalesce(short, F.lit(False)))
    return out.select(*df.columns)


def longest_run(df: DataFrame, key: Sequence[str], flag: Column, order: str = "frame_index") -> DataFrame:
    out = run_bounds(df, key, flag, order)
    return out.groupBy(*key).agg(
        F.coalesce(F.max(F.col("run_last") - F.col("run_first") + 1), F.lit(0)).cast("long").alias("longest_run")
    )


def even_sample(df: DataFrame, key: Sequence[str], k: int, order: str = "frame_index") -> DataFrame:
    """About ``k`` evenly spaced rows, first and last included (positions ``round(i * (n-1)/(k-1))``, half to even).

    Whether a row is taken follows from its own position, so nothing is joined.
    """
    if k < 1:
        raise ValueError("k must be positive")
    out = scan(df, key, order, row_position(), total("_n", F.count(F.lit(1))))
    n, p = F.col("_n"), F.col("pos0")
    if k == 1:
        hit = p == 0
    else:
        step = (n - 1).cast("double") / F.lit(float(k - 1))
        i = F.floor(p / step)
        hit = F.lit(False)
        for j in (-1, 0, 1, 2):
            c = i + j
            hit = hit | ((c >= 0) & (c <= k - 1) & (F.bround(c * step) == p))
        hit = F.when(n <= k, F.lit(True)).otherwise(hit | (p == n - 1))
    return out.where(hit).select(*df.columns)


def top_k(df: DataFrame, key: Sequence[str], priority: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key; Spark limits each group before the shuffle, so hot keys stay small."""
    w = Window.partitionBy(*key).orderBy(*priority)
    out = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out


def spine(df: DataFrame, key: Sequence[str], frame: str = "frame_index") -> DataFrame:
    """Every frame from the first to the last of each key; made per block, so a long key is many rows of work."""
    ends = df.groupBy(*key).agg(F.min(frame).alias("_a"), F.max(frame).alias("_b"))
    cells = ends.withColumn(
        BLOCK, F.explode(F.sequence(F.floor(F.col("_a") / SPAN), F.floor(F.col("_b") / SPAN)))
    )
    lo = F.greatest(F.col("_a"), (F.col(BLOCK) * SPAN).cast("int"))
    hi = F.least(F.col("_b"), (F.col(BLOCK) * SPAN + (SPAN - 1)).cast("int"))
    return cells.select(*key, F.explode(F.sequence(lo, hi)).alias(frame))


def on_spine(df: DataFrame, key: Sequence[str], frame: str = "frame_index") -> DataFrame:
    return spine(df, key, frame).join(df, [*key, frame], "left")


def rolling(
    df: DataFrame, key: Sequence[str], half: int, aggs: dict[str, Column], order: str = "frame_index"
) -> DataFrame:
    """Aggregates over the window of ``half`` rows either side of each row."""
    out = scan(df, key, order, row_position())
    out = halo(out, "pos0", half, half, SPAN)
    w = Window.partitionBy(*key, BLOCK).orderBy("pos0").rowsBetween(-half, half)
    out = out.select("*", *[c.over(w).alias(n) for n, c in aggs.items()])
    return out.where("_core").drop(BLOCK, "_core", "pos0")


def closest_window(
    df: DataFrame, key: Sequence[str], flag: Column, size: int, target: float, order: str = "frame_index"
) -> DataFrame:
    """Window of ``size`` rows whose share of true flags is closest to ``target``; the earliest of equal ones."""
    out = scan(df.withColumn("_f", flag.cast("double")), key, order, row_position(), total("_n", F.count(F.lit(1))))
    out = halo(out, "pos0", 0, size - 1, SPAN)
    w = Window.partitionBy(*key, BLOCK).orderBy("pos0").rowsBetween(0, size - 1)
    out = out.withColumn("ratio", F.avg("_f").over(w)).where(F.col("_core") & (F.col("pos0") <= F.col("_n") - size))
    best = F.min(F.struct(F.abs(F.col("ratio") - target).alias("d"), F.col("pos0"), F.col(order).alias("f"), F.col("ratio")))
    return out.groupBy(*key).agg(best.alias("b")).select(
        *key, F.col("b.pos0").alias("start"), F.col("b.f").alias("start_frame"), F.col("b.ratio").alias("ratio")
    )
