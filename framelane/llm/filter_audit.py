"""Filter interaction audit: count-weighted decision diagrams of failure masks, reordered by adjacent level swaps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelane import session

#: The filters in the order of their bits, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
SYMBOLS = r"[#$%&*|]"
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


class Diagram:
    """Ordered decision diagram over filters whose nodes carry (documents, good, toxic) counts.

    A node of a level is a pair (passes, fails) of nodes of the next level; below the
    last filter stand the counts themselves. Equal nodes of a level are one node, and
    a part without documents is node 0 everywhere. ``weight`` of a node is the sum over
    its documents, which no reordering below it changes.
    """

    def __init__(self, masks: dict[int, tuple[int, ...]], filters: str = FILTERS):
        self.order = list(filters)
        self.weight: list[tuple[int, ...]] = [(0, 0, 0)]
        self.children: list[tuple[int, int]] = [(0, 0)]
        self.unique: list[dict[tuple, int]] = [{} for _ in range(len(filters) + 1)]
        nodes = [self._leaf(masks.get(m, (0, 0, 0))) for m in range(1 << len(filters))]
        for level in range(len(filters) - 1, -1, -1):  # the last filter holds the highest bit that is left
            half = len(nodes) // 2
            nodes = [self._node(level, nodes[m], nodes[m + half]) for m in range(half)]
        self.root = nodes[0]

    def _leaf(self, counts: tuple[int, ...]) -> int:
        return 0 if not any(counts) else self._add(len(self.order), counts, (0, 0), counts)

    def _node(self, level: int, passes: int, fails: int) -> int:
        if not passes and not fails:
            return 0
        both = tuple(a + b for a, b in zip(self.weight[passes], self.weight[fails]))
        return self._add(level, (passes, fails), (passes, fails), both)

    def _add(self, level: int, key: tuple, children: tuple[int, int], weight: tuple[int, ...]) -> int:
        found = self.unique[level].get(key)
        if found is None:
            found = self.unique[level][key] = len(self.weight)
            self.weight.append(weight)
            self.children.append(children)
        return found

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one; nodes of ``level`` keep their number, so nothing above changes."""
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        upper, self.unique[level], self.unique[level + 1] = self.unique[level], {}, {}
        for (passes, fails), node in upper.items():
            (pp, pf), (fp, ff) = self.children[passes], self.children[fails]
            pair = (self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
            self.children[node] = pair
            self.unique[level][pair] = node

    def steps(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """(kept, removed) counts of each level on the path where everything passes."""
        out, node = [], self.root
        for _ in self.order:
            node, fails = self.children[node]
            out.append((self.weight[node], self.weight[fails]))
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after the other, so that all n! orders are met once (plain changes)."""
    places, ways = list(range(n)), [-1] * n
    while True:
        for item in range(n - 1, -1, -1):
            at = places.index(item)
            to = at + ways[item]
            if 0 <= to < n and places[to] < item:
                break
        else:
            return
        places[at], places[to] = places[to], places[at]
        for larger in range(item + 1, n):
            ways[larger] = -ways[larger]
        yield min(at, to)


def orders(masks: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders.

    What fails a filter at all is removed where it comes first; what fails only this filter is removed where it comes last.
    """
    diagram = Diagram(masks, filters)
    found = [("".join(diagram.order), diagram.steps())]
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        found.append(("".join(diagram.order), diagram.steps()))
    fails, alone, shapley = {}, {}, dict.fromkeys(filters, 0)
    for order, steps in found:
        fails[order[0]], alone[order[-1]] = steps[0][1][0], steps[-1][1][0]
        for name, (_, removed) in zip(order, steps):
            shapley[name] += removed[0]
    return [
        (order, k, kept[0], gone[0], fails[name] - gone[0], alone[name], gone[1], gone[2], shapley[name])
        for order, steps in sorted(found)
        for k, (name, (kept, gone)) in enumerate(zip(order, steps), start=1)
    ]


def failure_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail; bit k is filter k.

    A row fails E if a smaller key has the same text (by SHA-256), so of each text the
    rows with its smallest key pass, and rows with a null key, than which none is
    smaller. Rows are counted by (key, digest, part) first, so repeated rows are one; smallest keys
    are found with partial aggregation and meet their rows by (digest, key), so a text
    that a third of all rows share is not one task's.

    Null texts are empty: no words, A fails only. A null part is the empty string. Of
    repeated labels any quality 1 and any toxic 1 count; rows without label and null
    labels are neither. Empty tables give empty tables; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), body.alias("body"))
    words = F.regexp_extract_all("body", F.lit(_WORD), F.lit(0))
    rows = rows.select("id", "part", "body", words.alias("words")).select(
        "id", "part", F.unhex(F.sha2("body", 256)).alias("digest"),
        (
            (F.size("words") < LEAST_WORDS).cast("int")
            + (F.size(F.array_distinct("words")) * F.lit(100).cast("long") < F.size("words") * F.lit(DISTINCT_PERCENT).cast("long")).cast("int") * 2
            + ((F.length("body") - F.length(F.translate("body", _UPPER, ""))) * F.lit(100).cast("long") > F.length("body") * F.lit(UPPER_PERCENT).cast("long")).cast("int") * 4
            + F.col("body").rlike(SYMBOLS).cast("int") * 8
        ).alias("mask"),
    )
    rows = session.cut(rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n")))
    first = rows.groupBy("digest").agg(F.min("id").alias("id"))
    marked = rows.join(first.withColumn("first", F.lit(True)), ["digest", "id"], "left")
    marked = marked.withColumn("mask", F.col("mask") + F.when(F.col("first") | F.col("id").isNull(), 0).otherwise(16))
    wanted = labels.select(F.col(key).alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    wanted = wanted.where("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    return marked.join(wanted, "id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def audit(masks: DataFrame) -> DataFrame:
    """All orders of the filters for every part, 600 rows each; at most 32 rows of a part meet in one task.

    An empty table gives an empty table.
    """
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in STEPS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        for b in batches:
            for part, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = orders({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in found})
                columns = [[part] * len(rows), *zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return parts.mapInArrow(go, STEPS)
