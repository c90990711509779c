"""Embedding near-dedup: exact all-pairs cosine by tiles whose dimensions are ordered by variance."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelane import session
from framelane.llm.common import bounded_batches
from framelane.llm.components import components

THRESHOLD = 0.9
#: Vectors of a block (about; more of them if there are more than ``MANY`` blocks, up to ``WIDE`` or ``BLOCK_BYTES``) and of a row of tiles inside it.
BLOCK = 4096
MANY = 32
WIDE = 16384
BLOCK_BYTES = 16 << 20
TILE = 1024
#: What a round of block pairs sends, about; rounds whose results are read as tables of their own.
ROUND_BYTES = 512 << 20
ROUNDS = 16
#: Pairs whose components are settled at once.
PAIRS = 1 << 20
#: Dimensions after which residuals are bounded, as shares of all; up to ``WHOLE`` dimensions the whole product costs less than the bounds.
STAGES = (0.25, 0.5)
WHOLE = 256
#: The basis is fitted on at most this many vectors (and numbers), chosen by digest; it orders
#: dimensions and blocks and so decides how much is pruned, never what is linked.
SAMPLE = 4096
SAMPLE_NUMBERS = 1 << 22
_SLACK = 1e-9


def valid(v):
    """Not null, nothing null or non-finite in it, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal_axes(m: np.ndarray) -> np.ndarray:
    """Orthonormal basis, the direction of most energy first."""
    _, axes = np.linalg.eigh(m.T @ m)
    return axes[:, ::-1].copy()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def compare(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit matrices a and b, in principal axes, whose cosine reaches the threshold.

    Products are accumulated over leading dimensions; the rest of a product is at most
    the product of the suffix norms. Rows and columns without a pair that can still reach
    the threshold leave the tile; once few pairs are left they are finished one by one.
    """
    d = a.shape[1]
    if d <= WHOLE:
        return np.nonzero(a @ b.T >= threshold)
    i, j = np.arange(len(a)), np.arange(len(b))
    done, sums = 0, np.zeros((len(a), len(b)))
    for stop in [max(1, math.ceil(d * s)) for s in STAGES] + [d]:
        if stop <= done:
            continue
        sums += a[i, done:stop] @ b[j, done:stop].T
        done = stop
        if done == d:
            x, y = np.nonzero(sums >= threshold)
            return i[x], j[y]
        left = np.sqrt((a[i, done:] ** 2).sum(axis=1))[:, None] * np.sqrt((b[j, done:] ** 2).sum(axis=1))
        can = sums + left >= threshold - _SLACK
        x, y = np.nonzero(can)
        if len(x) * 16 <= can.size:
            good = []
            for lo in range(0, len(x), 1 << 15):
                p, q = x[lo: lo + (1 << 15)], y[lo: lo + (1 << 15)]
                good.append(sums[p, q] + np.einsum("ij,ij->i", a[i[p], done:], b[j[q], done:]) >= threshold)
            good = np.concatenate(good) if good else np.zeros(0, bool)
            return i[x[good]], j[y[good]]
        rows, cols = np.flatnonzero(can.any(axis=1)), np.flatnonzero(can.any(axis=0))
        sums, i, j = sums[np.ix_(rows, cols)], i[rows], j[cols]
    return i[:0], j[:0]


def _settle(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest label reachable over links x, y and over the links to their roots that ``label`` stands for."""
    if not len(x):
        return label
    # The roots so far are links too: who moves to a lower root must take along all that had the old one.
    x, y = np.concatenate([x, np.arange(len(label))]), np.concatenate([y, label])
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        for ends in (x, y, label[x], label[y]):
            np.minimum.at(new, ends, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _tiles_of(rows: pa.Table, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mine = [k for k, x in enumerate(rows["block"].to_pylist()) if x == block]
    parts = [(rows["ids"][k].as_py(), rows["copies"][k].as_py(), rows["vectors"][k].as_py()) for k in mine]
    ids = np.concatenate([np.frombuffer(p[0], np.int64) for p in parts])
    copies = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts])
    return ids, copies, np.concatenate([np.frombuffer(p[2], np.float64) for p in parts]).reshape(len(ids), -1)


def _compare_blocks(rows: pa.Table) -> pa.Table:
    """All tiles of one pair of blocks: links of each vector, and a link to its component in here."""
    one, two = rows["one"][0].as_py(), rows["two"][0].as_py()
    ids, copies, m = _tiles_of(rows, one)
    if two != one:
        more = _tiles_of(rows, two)
        start = len(ids)
        ids, copies, m = (np.concatenate(p) for p in zip((ids, copies, m), more))
    else:
        start = 0
    links, label, order = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.argsort(np.argsort(ids))
    label = order.copy()  # labels are places in the order of ids
    back = np.argsort(ids)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, start or len(ids), TILE):
        hi = min(lo + TILE, start or len(ids))
        for from_ in range(start or lo, len(ids), TILE):
            to = min(from_ + TILE, len(ids))
            x, y = compare(m[lo:hi], m[from_:to])
            x, y = x + lo, y + from_
            if start == 0 and from_ == lo:
                x, y = x[x < y], y[x < y]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            if len(x):
                held.append((order[x], order[y]))
            if held and (to == len(ids) or sum(len(x) for x, _ in held) >= PAIRS):
                by_place = _settle(label[back], *(np.concatenate(e) for e in zip(*held)))
                label, held = by_place[order], []
    hit = np.flatnonzero(links)
    return pa.table({"id": ids[hit], "links": links[hit], "root": ids[back[label[hit]]]})


def _project(axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = unit(_matrix(b.column(2))) @ axes
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(m[:, 0]), pa.array([r.tobytes() for r in m], pa.binary())],
                    names=["id", "copies", "first", "vector"],
                )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId()
    for b in batches:
        for lo in range(0, b.num_rows, TILE):
            part = b.slice(lo, TILE)
            raw = b"".join(part.column(3).to_pylist())
            m = np.frombuffer(raw, np.float64).reshape(part.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int32()), pa.array([part.column(0).to_numpy().tobytes()], pa.binary()),
                    pa.array([part.column(1).to_numpy().tobytes()], pa.binary()), pa.array([raw], pa.binary()),
                    pa.array([m.min(axis=0)], pa.list_(pa.float64())), pa.array([m.max(axis=0)], pa.list_(pa.float64())),
                ],
                names=["block", "ids", "copies", "vectors", "low", "high"],
            )


def block_rows(count: int, size: int) -> int:
    """Vectors of a block. Each block meets all others, so what is sent grows with their number."""
    return max(64, min(WIDE, max(BLOCK, math.ceil(count / MANY)), BLOCK_BYTES // (8 * max(1, size))))


def _links(reps: DataFrame, size: int, count: int, threshold: float) -> DataFrame:
    """(id, links, root) inside the vectors of one length.

    Pairs of blocks go in rounds of about ``ROUND_BYTES`` whose shuffle is deleted with their end: disk grows with the
    vectors and their links, not with the pairs.
    """
    spark = reps.sparkSession
    few = max(64, min(SAMPLE, SAMPLE_NUMBERS // max(1, size)))
    sample = reps.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(few).select("v").toArrow()["v"].combine_chunks()
    axes = principal_axes(unit(_matrix(sample)))
    rows = reps.mapInArrow(_project(axes), "id long, copies long, first double, vector binary")
    per = block_rows(count, size)
    blocks = max(1, math.ceil(count / per))
    tiles = session.cut(
        rows.repartitionByRange(blocks, "first", "id").sortWithinPartitions("first", "id")
        .mapInArrow(_pack, "block int, ids binary, copies binary, vectors binary, low array<double>, high array<double>")
    )
    boxes: dict[int, list] = {}
    weights: dict[int, int] = {}
    for r in tiles.select("block", "low", "high", F.length("vectors").alias("bytes")).toLocalIterator():
        weights[r["block"]] = weights.get(r["block"], 0) + r["bytes"]
        low, high = np.array(r["low"]), np.array(r["high"])
        if r["block"] in boxes:
            low, high = np.minimum(low, boxes[r["block"]][0]), np.maximum(high, boxes[r["block"]][1])
        boxes[r["block"]] = [low, high]
    names = sorted(boxes)
    pairs = []
    for k, one in enumerate(names):
        for two in names[k:]:
            gap = np.maximum(0, np.maximum(boxes[one][0] - boxes[two][1], boxes[two][0] - boxes[one][1]))
            if (gap * gap).sum() <= 2 - 2 * threshold + _SLACK:  # squared distance of unit vectors at the threshold
                pairs.append((one, two))
    rounds: list[list[tuple[int, int]]] = [[]]
    filled, least = 0, 2 * spark.sparkContext.defaultParallelism
    for one, two in pairs:
        if filled >= ROUND_BYTES and len(rounds[-1]) >= least:
            rounds.append([])
            filled = 0
        rounds[-1].append((one, two))
        filled += weights[one] + (weights[two] if two != one else 0)
    found: list[DataFrame] = []
    for now in rounds:
        sides = sorted({(one, two, block) for one, two in now for block in (one, two)})
        sent = tiles.drop("low", "high").join(spark.createDataFrame(sides, "one int, two int, block int"), "block")
        found.append(session.cut(sent.groupBy("one", "two").applyInArrow(_compare_blocks, "id long, links long, root long")))
        if len(found) >= ROUNDS:
            found = [session.cut(functools.reduce(DataFrame.union, found), spent=found)]
    return session.cut(functools.reduce(DataFrame.union, found), spent=[*found, tiles])


def _digest(v):
    """Of a whole vector; zeros are equal whatever their sign."""
    return F.unhex(F.sha2(F.array_join(F.transform(v, lambda x: (x + F.lit(0.0)).cast("string")), ","), 256))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id (smallest key reachable), kept.

    Equal vectors are compared once and count with their number, so a group of copies
    costs no pairs. Blocks along the first principal axis are compared with those that
    their bounding boxes let come near enough; the work stays quadratic in what cannot be
    pruned, as every pair of rows is to be decided. Vectors of different length are never
    linked; null, zero and non-finite vectors are linked with nothing. A null key is
    counted by others and names no component. Empty tables give empty tables; other
    columns (labels too) are not read.
    """
    bounded_batches(vectors.sparkSession, rows=TILE * 4)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(T.ArrayType(T.DoubleType())).alias("v"))
    rows = rows.withColumn("d", F.when(valid(F.col("v")), _digest(F.col("v"))))
    good = rows.where("d is not null")
    reps = session.cut(good.groupBy("d").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")))
    named = reps.where("id is not null")
    sizes = {r["size"]: r["count"] for r in named.groupBy(F.size("v").alias("size")).count().collect()}
    found = None
    for size, count in sorted(sizes.items()):
        part = _links(named.where(F.size("v") == size).select("id", "copies", "v"), size, count, threshold)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "id long, links long, root long")
    label = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = (
        reps.select("d", "id", "copies").join(totals, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
        .select("d", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    out = rows.select("id", "d").join(known, "d", "left")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
