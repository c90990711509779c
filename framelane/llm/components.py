"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelane import session


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, component)``; component is the smallest node reachable.

    Nodes without a link are not in the result. Rows with a null end and loops are
    ignored; an empty table gives an empty table. Each round is two aggregations
    and two joins (no window over a hub's neighbours) and is written to the shared
    folder, so a lost executor costs a re-read. The number of rounds grows with the
    logarithm of the longest path; beyond ``rounds`` the job fails instead of
    returning a partial answer.
    """
    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = session.cut(e.where("a is not null and b is not null and a <> b").distinct())
    before = _signature(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pulled = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = session.cut(pulled.union(least.select("a", F.col("m").alias("b"))).distinct())
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
