"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelane import session
from framelane.llm.common import fresh, row_identity

#: Words of a document; its size in the mix.
WORDS = r"[^\x20\x09-\x0D]+"
#: No source is taken more often than this.
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Weight schedules over the run, one per entry of WEIGHTS: (time in [0, 1], weight), linear in between.
#: Light sources lead, heavy ones trail.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Hex digits of a document's digest that name its range inside a source.
RANGE_DIGITS = 3


def invert_demand(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """Time at which a source has consumed ``share`` of its tokens.

    The schedule is integrated piece by piece (a quadratic inside a piece), scaled to
    a total of one, and the integral is inverted at ``share``.
    """
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        if t1 <= t0 or w0 < 0 or w1 < 0:
            raise ValueError("a schedule needs rising times and weights of 0 or more")
        pieces.append((t0, t1 - t0, w0, w1 - w0, total))
        total += (t1 - t0) * (w0 + w1) / 2
    if not pieces or total <= 0:
        raise ValueError("a schedule needs two knots and a positive integral")
    out = None
    for t0, span, w0, rise, done in reversed(pieces):
        y = share * F.lit(total) - F.lit(done)
        if rise:
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * rise / span) * y))
            at = (root - F.lit(w0)) / F.lit(rise / span)
        else:
            at = y / F.lit(w0) if w0 else F.lit(0.0)
        at = F.lit(t0) + at
        out = at if out is None else F.when(share * F.lit(total) >= F.lit(done + span * (w0 + w0 + rise) / 2), out).otherwise(at)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, source_size)`` to targets that share the total by weight, none above ``max_epochs`` sizes.

    Sources in code point order, null last, take the weights in turn. The excess of a
    source at its limit goes to the others by weight until none is above: in order of
    limit / weight, the first source that the level reached so far does not fill, and
    all after it, share what is left. One row per source; only this summary is windowed
    as a whole.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("place", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("decimal(38,0)"))
    s = s.withColumn("limit", F.col("source_size").cast("decimal(38,0)") * max_epochs)
    by_level = W.orderBy(F.col("limit").cast("double") / F.col("weight").cast("double"), "place")
    every = W.partitionBy()
    s = (
        s.withColumn("step", F.row_number().over(by_level))
        .withColumn("filled", F.coalesce(F.sum("limit").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)"))
        .withColumn("weights_left", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)).cast("decimal(38,0)"))
        .withColumn("left", (F.sum("source_size").over(every).cast("decimal(38,0)") - F.col("filled")).cast("decimal(38,0)"))
    )
    fits = F.col("left").cast("double") * F.col("weight").cast("double") <= F.col("limit").cast("double") * F.col("weights_left").cast("double")
    s = s.withColumn("first", F.min(F.when(fits, F.struct("step", "left", "weights_left"))).over(every))
    level = F.col("first.left").cast("double") * F.col("weight").cast("double") / F.col("first.weights_left").cast("double")
    target = F.when(F.col("step") < F.col("first.step"), F.col("limit").cast("double")).otherwise(level)
    return s.select("source", "source_size", F.col("place").cast("int").alias("place"), target.alias("target"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    max_epochs: int = MAX_EPOCHS,
    carry: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: key, size, source_size, target, taken, positions.

    A source hands out its documents in the order of their keys' digests, from the
    start again when all are used, until its target is reached; the last one may be
    taken in part. ``positions`` has the time in [0, 1] at which each copy is due,
    the inverse of the source's cumulative demand at the copy's first word, at most
    ``max_epochs`` + 1 entries. Prefix sums go by (source, digest range), so a source
    with a third of all rows is spread over 4,096 ranges.

    Edge cases: null text has size 0; documents of size 0 take nothing; null sources
    are one source, last in order; a null key has the digest of the empty string;
    rows with equal keys are ordered by size. An empty table gives an empty table.
    Other columns are not read. ``carry`` is one more column to hand through, and to order
    rows with equal keys by.
    """
    more = [] if carry is None else ["carry"]
    rows = session.cut(
        docs.select(
            F.col(key).alias("id"), F.col(source).alias("source"),
            F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORDS))).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("digest"), *([] if carry is None else [carry.alias("carry")]),
        ).withColumn("range", F.substring("digest", 1, RANGE_DIGITS))
    )
    ranges = session.cut(rows.groupBy("source", "range").agg(F.sum("size").alias("words")))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    targets = session.cut(
        targets.withColumn("quota", F.floor("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0).cast("long"))
        .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("source_size"))
    )
    upto = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    starts = starts.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source")).select(
        F.col("r.source").alias("source"), "range", "start", "place", "source_size", "target", "quota", "epochs", "rest"
    )
    placed = rows.alias("d").join(starts.alias("s"), F.expr("d.source <=> s.source and d.range = s.range"))
    inside = W.partitionBy("place", "s.range").orderBy("digest", "id", "size", *more).rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset")))
    placed = placed.withColumn("part", part).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    copies = (F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")
    copies = F.when(F.col("taken") > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))

    def due(epoch: Column) -> Column:
        share = (epoch * F.col("source_size") + F.col("offset")).cast("double") / F.col("quota").cast("double")
        kind, out = F.col("place") % len(schedules), None
        for k in reversed(range(len(schedules))):
            at = invert_demand(share, schedules[k])
            out = at if out is None else F.when(kind == k, at).otherwise(out)
        return out

    return placed.select(
        F.col("id").alias(key), "size", "source_size", "target", "taken", F.transform(copies, due).alias("positions"), *more
    )


def training_order(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents as the run meets them: repeated for each copy taken, range-sorted by position, columns as in ``docs``.

    A document taken in part is emitted whole (at most one per source). Rows are told
    apart by key, text and all columns: a null key is a key like any other, rows that share a
    key are taken on their own, and equal rows are one row taken as often as they are together.
    """
    own = row_identity(docs, key, text)
    copies = mix(docs, key, text, source, carry=own).select(F.col("carry").alias("__id"), F.explode("positions").alias("__at"))
    row = fresh(docs, "__row")
    once = docs.withColumn(row, own).dropDuplicates([row])
    out = once.join(copies, once[row] == copies["__id"])
    order = (copies["__at"], once[row]["none"], once[row]["key"], once[row]["digest"])
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*[once[c] for c in docs.columns])
