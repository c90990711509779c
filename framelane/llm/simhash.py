"""SimHash near-dedup over an inverted index of positional bytes with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelane import session
from framelane.llm.common import NOT_SPACE, bounded_batches, fresh, keep_ids, row_identity, word_spans
from framelane.llm.components import components

SHINGLE = 3
SEED = 42
BYTES = 8
#: Differing bits of a link. Each can spoil one byte, so a linked pair shares at least BYTES - RADIUS of them.
RADIUS = 2
MATCHES = BYTES - RADIUS
#: Postings up to this length are tallied pair by pair; longer ones by their free bytes. Both are exact.
SHORT = 16
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 without a word."""
    joined, starts, ends = word_spans((text or "").encode("utf-8", "surrogatepass").lower(), NOT_SPACE)
    n = len(starts)
    if not n:
        return 0
    if n >= shingle:
        starts, ends = starts[: n - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, digest, ones = len(starts), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, _SLICE):
        spans = zip(starts[lo: lo + _SLICE].tolist(), ends[lo: lo + _SLICE].tolist())
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=["id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) for every row; fp holds the 64 bits as a signed long."""
    bounded_batches(docs.sparkSession)
    own = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("body")).mapInArrow(_fingerprint_batches, f"id {own}, fp long")


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Tally of equal positional bytes, from the exclusive or of two fingerprints."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, BYTES) == 0).sum(axis=-1)


def _long_posting(prints: np.ndarray) -> np.ndarray:
    """Component label (an index) of each fingerprint of a posting that shares MATCHES bytes: 16 free bits."""
    free = np.bitwise_or.reduce(prints ^ prints[0])
    bits = [1 << i for i in range(64) if int(free) >> i & 1]
    near = [a for a in bits] + [a | b for a, b in combinations(bits, 2)]
    order = np.argsort(prints)
    sorted_prints = prints[order]
    left, right = [], []
    for mask in near:
        other = prints ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(sorted_prints, other), len(prints) - 1)
        hit = np.flatnonzero(sorted_prints[at] == other)
        left.append(hit)
        right.append(order[at[hit]])
    left, right, label = np.concatenate(left), np.concatenate(right), np.arange(len(prints))
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def posting_links(prints: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside postings of equal length, arrays of shape (postings, members).

    A short posting tallies the shared bytes of each of its at most SHORT * (SHORT - 1) / 2
    pairs, retains those that reach MATCHES and verifies their differing bits. A long one
    (at most 65,536 members, as only two bytes are free) gives one link per member to its
    component inside the posting.
    """
    m = prints.shape[1]
    if m <= SHORT:
        i, j = np.triu_indices(m, 1)
        x = prints[:, i] ^ prints[:, j]
        at, pair = np.nonzero(shared_bytes(x) >= MATCHES)
        good = _ones(x[at, pair]) <= RADIUS
        at, pair = at[good], pair[good]
        return ids[at, i[pair]], ids[at, j[pair]]
    a, b = [], []
    for row, own in zip(prints, ids):
        label = _long_posting(row)
        linked = np.flatnonzero(label != np.arange(m))
        a.append(own[linked])
        b.append(own[label[linked]])
    return np.concatenate(a), np.concatenate(b)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        posts, left, right = b.column(0), [], []
        sizes = posts.value_lengths().to_numpy(zero_copy_only=False)
        flat = posts.flatten()
        prints = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        ids = flat.field("rep").to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        for m in np.unique(sizes):
            at = starts[sizes == m][:, None] + np.arange(m)
            x, y = posting_links(prints[at], ids[at])
            left.append(x)
            right.append(y)
        if left:
            found = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def links(reps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints at RADIUS or fewer differing bits; ``reps(fp, rep)`` are distinct.

    A posting list of one byte at one position holds a 256th of all fingerprints, and
    tallying its pairs would be quadratic work. So the tally is done by the shuffle: a
    posting is keyed by MATCHES positions and their bytes, and two fingerprints meet in
    one exactly if they reach the guaranteed minimum of matches.
    """
    keys = []
    for k, positions in enumerate(combinations(range(BYTES), MATCHES)):
        mask = sum(0xFF << 8 * p for p in positions)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")))
    posts = reps.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    posts = posts.groupBy("key").agg(F.collect_list(F.struct("fp", "rep")).alias("post")).where(F.size("post") > 1)
    bounded_batches(reps.sparkSession, rows=4096)
    return posts.select("post").mapInArrow(_link_batches, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id (smallest key reachable).

    Edge cases: a null or blank text has fingerprint zero and is linked like any other;
    rows with equal fingerprints are one node, so copies are never paired with each
    other; a null key takes part but cannot name a component. Empty tables give empty
    tables; other columns are not read.
    """
    prints = session.cut(fingerprints(docs, key, text))
    reps = session.cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    label = components(links(reps.where("rep is not null")))
    named = reps.join(label, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays, all columns as they are: one with the smallest key.

    Rows are told apart by key, text and all columns, not by the key alone: texts that share a
    key are judged on their own, rows with a null key stay where their component has no
    other, and of rows that are equal altogether one stays.
    """
    row = fresh(docs, "__row")
    named = docs.withColumn(row, row_identity(docs, key, text))
    prints = session.cut(fingerprints(named, row, text))
    nodes = session.cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    label = components(links(nodes.select("fp", F.col("fp").alias("rep"))))
    chosen = nodes.join(label, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("component"))
    stays = chosen.agg(F.min("first").alias(row))
    return keep_ids(named, stays, row).dropDuplicates([row]).drop(row)
