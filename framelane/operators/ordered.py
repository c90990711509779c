"""Ordered work inside a trajectory without putting a trajectory into one task.

A plain ``Window.partitionBy(video).orderBy(frame)`` sends every row of a video
to one task. Here a trajectory is cut into *blocks* of ``SPAN`` frames and
windows run inside ``(key, block)``. What has to cross a block border travels in
a summary table with one row per block. Frame numbers are 32-bit, so a key has
at most 2**31 / SPAN = 524,288 blocks: the window over the summary is bounded
whatever the share of one key in the data.

Where no trajectory is longer than one block (:func:`short_at_once` looks once), a window over the
key is bounded as it is: no summary, no join, and steps in a row share one shuffle and one sort.

Input rows must be unique per (key, order); use :mod:`framelane.operators.dedup`
first.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framelane.session import cut

SPAN = 4096
BLOCK = "_blk"
_SHORT: ContextVar[frozenset[str] | None] = ContextVar("short", default=None)


def is_short(key: Sequence[str]) -> bool:
    """Whether rows of ``key`` are known to fit into one block each."""
    short = _SHORT.get()
    return short is not None and short <= set(key)


def short_at_once(fn: Callable | None = None, *, from_zero: bool = False) -> Callable:
    """For operators (df, key, ...): write the input once and look whether its frames span a block at most, so that no key has more rows.

    ``from_zero``: for operators that make rows of all frames from 0 on.
    """
    if fn is None:
        return functools.partial(short_at_once, from_zero=from_zero)

    @functools.wraps(fn)
    def run(df: DataFrame, key: Sequence[str], *args, **more):
        if is_short(key) and not from_zero:
            return fn(df, key, *args, **more)
        df = cut(df)
        order = more.get("order", "frame_index")
        lo, hi = df.agg(F.min(order), F.max(order)).first()
        fits = lo is not None and (hi < SPAN and lo >= 0 if from_zero else hi - lo < SPAN)
        token = _SHORT.set(frozenset(key) if fits else None)
        try:
            return fn(df, key, *args, **more)
        finally:
            _SHORT.reset(token)

    return run


def with_block(df: DataFrame, order: str, span: int = SPAN, block: str = BLOCK) -> DataFrame:
    return df.withColumn(block, F.floor(F.col(order) / F.lit(span)).cast("long"))


@dataclass(frozen=True)
class Step:
    """One ordered quantity: how a block is summarised, what crosses blocks, how a row uses it; ``single``: what crosses where a key is one block.

    ``up`` / ``down`` are the same window in rising / falling order. Falling
    order is used to look ahead, as a frame that ends at "unbounded following"
    is re-read for every row.
    """

    name: str
    summary: Column
    across: Callable[[Column, WindowSpec, WindowSpec], Column]
    combine: Callable[[Column, WindowSpec, WindowSpec], Column]
    single: Callable[[WindowSpec], Column]


START = Window.unboundedPreceding
END = Window.unboundedFollowing


def total(name: str, agg: Column, merge: Callable[[Column], Column] = F.sum) -> Step:
    """Per-key aggregate delivered to every row (``merge`` folds block results)."""
    return Step(name, agg, lambda c, up, down: merge(c).over(up.rowsBetween(START, END)), lambda c, up, down: c, agg.over)


def running_sum(name: str, value: Column, inclusive: bool = True) -> Step:
    """Cumulative sum from the start of the key."""
    stop = Window.currentRow if inclusive else -1
    zero = F.lit(0)
    return Step(
        name,
        F.sum(value),
        lambda c, up, down: F.coalesce(F.sum(c).over(up.rowsBetween(START, -1)), zero),
        lambda c, up, down: c + F.coalesce(F.sum(value).over(up.rowsBetween(START, stop)), zero),
        lambda whole: zero,
    )


def row_position(name: str = "pos0") -> Step:
    """0-based rank of a row in its key."""
    return Step(
        name,
        F.count(F.lit(1)),
        lambda c, up, down: F.coalesce(F.sum(c).over(up.rowsBetween(START, -1)), F.lit(0)),
        lambda c, up, down: (c + F.row_number().over(up) - 1).cast("long"),
        lambda whole: F.lit(0),
    )


def previous_known(name: str, value: Column, order: str, inclusive: bool = False) -> Step:
    """Latest non-null ``value`` before (or at) the row."""
    stop = Window.currentRow if inclusive else -1
    return Step(
        name,
        F.max_by(value, F.when(value.isNotNull(), F.col(order))),
        lambda c, up, down: F.last(c, ignorenulls=True).over(up.rowsBetween(START, -1)),
        lambda c, up, down: F.coalesce(F.last(value, ignorenulls=True).over(up.rowsBetween(START, stop)), c),
        lambda whole: F.lit(None),
    )


def next_known(name: str, value: Column, order: str, inclusive: bool = False) -> Step:
    """Earliest non-null ``value`` after (or at) the row."""
    stop = Window.currentRow if inclusive else -1
    return Step(
        name,
        F.min_by(value, F.when(value.isNotNull(), F.col(order))),
        lambda c, up, down: F.last(c, ignorenulls=True).over(down.rowsBetween(START, -1)),
        lambda c, up, down: F.coalesce(F.last(value, ignorenulls=True).over(down.rowsBetween(START, stop)), c),
        lambda whole: F.lit(None),
    )


def first_known(name: str, value: Column, order: str) -> Step:
    """Earliest non-null ``value`` of the whole key."""
    return Step(
        name,
        F.min_by(value, F.when(value.isNotNull(), F.col(order))),
        lambda c, up, down: F.first(c, ignorenulls=True).over(up.rowsBetween(START, END)),
        lambda c, up, down: c,
        F.min_by(value, F.when(value.isNotNull(), F.col(order))).over,
    )


def apart(df: DataFrame) -> DataFrame:
    """Side of a join that must not be broadcast, nor the side it meets.

    Spark takes an exploded table for no larger than what it was made from, and a written one for its
    compressed size, so its size checks would send either through the driver. The windows that
    follow such a join need both sides dealt by its key anyhow.
    """
    return df.hint("merge")


def _known(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that a join by these columns keeps."""
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def scan(
    df: DataFrame,
    key: Sequence[str],
    order: str,
    *steps: Step,
    span: int = SPAN,
    block: str | None = None,
) -> DataFrame:
    """Add the steps' columns. ``block`` names an existing monotone block column, else frames are cut by ``span``."""
    def windows(by: Sequence[str], col: str):
        w = Window.partitionBy(*by)
        return w.orderBy(F.col(col).asc()), w.orderBy(F.col(col).desc())

    if is_short(key):
        inside, whole = windows(key, order), Window.partitionBy(*key)
        return _known(df, [*key, order]).select(*df.columns, *[s.combine(s.single(whole), *inside).alias(s.name) for s in steps])
    own = block is None
    block = block or BLOCK
    rows = with_block(df, order, span, block) if own else df

    edges = rows.groupBy(*key, block).agg(*[s.summary.alias(f"_s_{s.name}") for s in steps])
    across = windows(key, block)
    edges = edges.select(
        *key, block, *[s.across(F.col(f"_s_{s.name}"), *across).alias(f"_c_{s.name}") for s in steps]
    )
    inside = windows([*key, block], order)
    out = rows.join(apart(edges), [*key, block], "inner")
    out = out.select(*rows.columns, *[s.combine(F.col(f"_c_{s.name}"), *inside).alias(s.name) for s in steps])
    return out.drop(block) if own else out


def neighbours(
    df: DataFrame,
    key: Sequence[str],
    order: str,
    cols: Sequence[str],
    back: int = 0,
    ahead: int = 0,
    span: int = SPAN,
) -> DataFrame:
    """Add ``{col}_lag{j}`` / ``{col}_lead{j}`` of the j-th previous / next row of the key.

    The last ``back`` (first ``ahead``) rows of the preceding (following) blocks
    arrive through the summary table; a block always holds a row, so that many
    blocks are enough.
    """
    if is_short(key):
        w, rec = Window.partitionBy(*key).orderBy(order), F.struct(*[F.col(c) for c in cols])
        near = {f"_lag{j}": F.lag(rec, j).over(w) for j in range(1, back + 1)} | {f"_lead{j}": F.lead(rec, j).over(w) for j in range(1, ahead + 1)}
        out = _known(df, [*key, order]).withColumns(near)
        return out.select(*df.columns, *[F.col(n)[c].alias(f"{c}{n}") for n in near for c in cols])
    rows = with_block(df, order, span)
    inside = Window.partitionBy(*key, BLOCK).orderBy(order)
    inside_all = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rec = F.struct(*[F.col(c) for c in cols])
    rows = rows.withColumns(
        {"_i": F.row_number().over(inside), "_m": F.count(F.lit(1)).over(inside_all), "_r": rec}
    )
    entry = F.struct(F.col(order).alias("o"), F.col("_r").alias("r"))
    edges = (
        rows.where((F.col("_i") <= ahead) | (F.col("_i") > F.col("_m") - back))
        .groupBy(*key, BLOCK)
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("_i") > F.col("_m") - back, entry))).alias("tail"),
            F.sort_array(F.collect_list(F.when(F.col("_i") <= ahead, entry))).alias("head"),
        )
    )
    across = Window.partitionBy(*key).orderBy(BLOCK)
    picked = []
    if back:
        picked.append(F.flatten(F.collect_list("tail").over(across.rowsBetween(-back, -1))).alias("_tail"))
    if ahead:
        picked.append(F.flatten(F.collect_list("head").over(across.rowsBetween(1, ahead))).alias("_head"))
    out = rows.join(apart(edges.select(*key, BLOCK, *picked)), [*key, BLOCK], "inner")
    recs = {}
    for j in range(1, back + 1):
        idx = F.col("_i") - F.lit(j) - F.lit(1)
        recs[f"_lag{j}"] = F.when(F.col("_i") > j, F.lag("_r", j).over(inside)).otherwise(
            F.try_element_at(F.col("_tail"), idx.cast("int"))["r"]
        )
    for j in range(1, ahead + 1):
        idx = F.lit(j) - (F.col("_m") - F.col("_i"))
        recs[f"_lead{j}"] = F.when(F.col("_i") + j <= F.col("_m"), F.lead("_r", j).over(inside)).otherwise(
            F.try_element_at(F.col("_head"), F.greatest(idx, F.lit(1)).cast("int"))["r"]
        )
    out = out.withColumns(recs)
    return out.select(
        *df.columns,
        *[F.col(n)[c].alias(f"{c}{n}") for n in recs for c in cols],
    )


def halo(
    df: DataFrame,
    pos: str,
    before: Column | int,
    after: Column | int,
    span: Column | int,
    block: str = BLOCK,
) -> DataFrame:
    """Copy rows into every block whose core rows look at them.

    A core row at ``q`` sees ``q - before .. q + after``; ``_core`` marks the copy
    in the row's own block. Rows away from block borders are not copied.
    """
    before, after, span = (F.lit(x) if isinstance(x, int) else x for x in (before, after, span))
    p = F.col(pos)
    lo = F.floor(F.greatest(p - after, F.lit(0)) / span).cast("long")
    hi = F.floor((p + before) / span).cast("long")
    own = F.floor(p / span).cast("long")
    out = df.withColumn(block, F.explode(F.sequence(lo, hi)))
    return out.withColumn("_core", F.col(block) == own)
