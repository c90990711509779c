"""Ranked lexical search by hashed max-sketches: upper bounds by batched lookup, exact scores in descending bounds."""

from __future__ import annotations

import math
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framelane import session
from framelane.llm.common import bounded_batches

#: Coordinates of a sketch; a document stores those its terms fall on, three bytes each.
WIDTH = 1 << 16
#: A stored maximum of this value stands for "this often or more".
MANY = 255
#: Items are searched in blocks of about this many bytes; what tasks get of a block is bounded by it.
ITEM_BYTES = 8 << 20
#: Documents of highest bound per item whose exact scores give the first threshold, as a multiple of k.
SEEDS = 3
#: Documents to score exactly are sent to every executor up to this size, so that no text is shuffled; beyond, texts go to them.
BROADCAST_BYTES = 32 << 20
#: Looked-up values that a task holds at once.
_CELLS = 1 << 19
_SALTS = 64
#: ASCII letters in lower case, digits and all bytes of longer characters belong to terms; all else separates.
_TERMS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(body: bytes | None) -> list[bytes]:
    return (body or b"").lower().translate(_TERMS).split()


def coordinate(term: bytes) -> int:
    return zlib.crc32(term) % WIDTH


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def fold(counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates that a document's terms fall on, ascending, and the largest count on each, at most MANY.

    A document's impact of a term grows with the count and depends on nothing else of the
    term but its corpus weight, so the largest count on a coordinate stands for the largest
    impact there, whatever the weights will be.
    """
    at = np.fromiter((zlib.crc32(t) for t in counts), np.uint32, len(counts)) % np.uint32(WIDTH)
    tf = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), MANY)
    order = np.argsort((at.astype(np.int64) << 8) | (MANY - tf), kind="stable")
    at, tf = at[order], tf[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    return at[first].astype(np.uint16), tf[first].astype(np.uint8)


class Queries:
    """A block of items: their distinct terms, and per item the terms with their number."""

    def __init__(self, texts: list[str | None]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[int] = []  # places of the texts with a term; an item's number is its place here
        flat, times, starts = [], [], []
        for i, text in enumerate(texts):
            counts = Counter(terms((text or "").encode("utf-8", "surrogatepass")))
            if not counts:
                continue
            self.items.append(i)
            starts.append(len(flat))
            for term, n in sorted(counts.items()):
                flat.append(self.vocabulary.setdefault(term, len(self.vocabulary)))
                times.append(n)
        self.flat, self.times, self.starts = np.array(flat, np.int64), np.array(times, np.int64), np.array(starts, np.int64)
        self.weights = np.zeros(len(flat), np.int64)
        self.at = np.array([coordinate(t) for t in self.vocabulary], np.int64)[self.flat]
        self.n_docs = self.n_terms = 0

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        own = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(self.vocabulary))], np.int64)
        self.weights = own[self.flat] * self.times

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 75 + (25 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)

    def bounds(self, sketches: list[tuple[bytes, bytes]], n: np.ndarray) -> np.ndarray:
        """(documents, items) upper bounds of the scores."""
        dense = np.zeros((len(sketches), WIDTH), np.uint8)
        for row, (at, tf) in zip(dense, sketches):
            row[np.frombuffer(at, np.uint16)] = np.frombuffer(tf, np.uint8)
        by_count = self.impacts(np.arange(MANY + 1), n[:, None])
        by_count[:, MANY] = 1_000_000
        found = np.take_along_axis(by_count, dense[:, self.at].astype(np.intp), axis=1)
        return np.add.reduceat(found * self.weights, self.starts, axis=1)

    def scores(self, counts: dict[bytes, int]) -> np.ndarray:
        """Exact score of one document for every item."""
        held = self.vocabulary.keys() & counts.keys()
        impact = np.zeros(len(self.vocabulary), np.int64)
        if held:
            n = sum(counts.values())
            impact[[self.vocabulary[t] for t in held]] = self.impacts(np.array([counts[t] for t in held], np.int64), np.int64(n))
        return np.add.reduceat(impact[self.flat] * self.weights, self.starts)


def sketches(docs: DataFrame, queries: Queries, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, n, at, tf) of every row with a term, and rows (term, df) of each task's share of the counts.

    Term -1 counts the documents with a term, term -2 all terms; the others are those of ``queries``.
    """
    own = docs.schema[key].dataType
    schema = f"id {own.simpleString()}, digest long, n long, at binary, tf binary, term int, df long"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        vocabulary, names = queries.vocabulary, [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
        id_kind = None
        for b in batches:
            id_kind, rows, kept = b.schema.field(0).type, [], []
            for i, (digest, body) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                counts = Counter(terms(body.as_py()))
                if not counts:
                    continue
                n = counts.total()
                seen[-1] += 1
                seen[-2] += n
                for t in vocabulary.keys() & counts.keys():
                    seen[vocabulary[t]] += 1
                at, tf = fold(counts)
                rows.append((digest, n, at.tobytes(), tf.tobytes(), None, None))
                kept.append(i)
            if rows:
                columns = [b.column(0).take(pa.array(kept, pa.int64())), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if seen:
            blank = [pa.nulls(len(seen), k) for k in (id_kind, *kinds[:4])]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(seen.keys(), pa.int32()), pa.array(seen.values(), pa.int64())], names=names)

    bounded_batches(docs.sparkSession)
    return _rows(docs, key, text).mapInArrow(go, schema)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("digest"), body.cast("binary").alias("body"))


def _lookup(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[tuple[list, list, np.ndarray]]:
    """(ids, digests, bounds) of a bounded number of sketches at a time."""
    size = max(1, min(64, _CELLS // max(1, len(queries.flat))))
    for b in batches:
        for lo in range(0, b.num_rows, size):
            ids, digests, n, at, tf = [c.to_pylist() for c in b.slice(lo, size).columns]
            yield ids, digests, queries.bounds(list(zip(at, tf)), np.array(n, np.int64))


def highest_bounds(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(item, id, digest, bound): the k sketches of highest bound per item."""
    own = index.schema["id"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(queries.items)
        best, refs = np.zeros((many, 0), np.int64), np.zeros((many, 0), np.int64)
        held: dict[int, tuple] = {}
        met = 0
        for ids, digests, bounds in _lookup(batches, queries):
            if best.shape[1] == k and not (bounds.T > best.min(axis=1)[:, None]).any():
                continue
            held |= {met + i: pair for i, pair in enumerate(zip(ids, digests))}
            both = np.concatenate([best, bounds.T], axis=1)
            where = np.concatenate([refs, np.broadcast_to(np.arange(met, met + len(ids)), (many, len(ids)))], axis=1)
            met += len(ids)
            if both.shape[1] > k:
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                both, where = np.take_along_axis(both, top, axis=1), np.take_along_axis(where, top, axis=1)
            best, refs = both, where
            if len(held) > 2 * many * k + 1000:
                held = {r: held[r] for r in np.unique(refs).tolist()}
        item, rank = np.nonzero(best)
        for lo in range(0, len(item), 10_000):
            i, r = item[lo: lo + 10_000], rank[lo: lo + 10_000]
            pairs = [held[x] for x in refs[i, r].tolist()]
            yield pa.RecordBatch.from_pydict(
                {"item": i.astype(np.int32), "id": [p[0] for p in pairs],
                 "digest": pa.array([p[1] for p in pairs], pa.int64()), "bound": best[i, r]}
            ).cast(pa.schema([("item", pa.int32()), ("id", id_kind), ("digest", pa.int64()), ("bound", pa.int64())]))

    id_kind = to_arrow_type(index.schema["id"].dataType)
    found = index.mapInArrow(go, f"item int, id {own}, digest long, bound long")
    return _best(found, k, "bound", "digest")


def _best(rows: DataFrame, k: int, by: str, then: str) -> DataFrame:
    """Top k rows of each item with their rank; rows meet by (item, salt) first, so no task gets an item's rows of all tasks."""
    order = [F.desc(by), F.asc_nulls_last(then)]
    salted = rows.withColumn("_s", F.spark_partition_id() % _SALTS)
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_s").orderBy(*order))).where(F.col("_r") <= k).drop("_s", "_r")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def within_reach(index: DataFrame, queries: Queries, least: np.ndarray) -> DataFrame:
    """(id, digest, items, bounds, margin): sketches whose bound reaches the threshold of some item, and of which."""
    own = index.schema["id"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digests, bounds in _lookup(batches, queries):
            reach = bounds >= least
            rows = np.flatnonzero(reach.any(axis=1))
            if not len(rows):
                continue
            items = [np.flatnonzero(reach[r]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[r] for r in rows], id_kind), pa.array([digests[r] for r in rows], pa.int64()),
                    pa.array([i.astype(np.int32) for i in items], pa.list_(pa.int32())),
                    pa.array([bounds[r][i] for r, i in zip(rows, items)], pa.list_(pa.int64())),
                    pa.array([float((bounds[r][i] / least[i]).max()) for r, i in zip(rows, items)], pa.float64()),
                ],
                names=["id", "digest", "items", "bounds", "margin"],
            )

    id_kind = to_arrow_type(index.schema["id"].dataType)
    return index.mapInArrow(go, f"id {own}, digest long, items array<int>, bounds array<long>, margin double")


def rescore(docs: DataFrame, reach: DataFrame, queries: Queries, least: np.ndarray, k: int, key: str, text: str) -> DataFrame:
    """(item, id, score): exact scores in descending bounds, each task's best k per item.

    Few documents to score are broadcast, behind a check of their size; many are joined by key
    and digest. A task's rows come in order of how far their bounds reach beyond the thresholds; its own
    k-th best scores raise them, and a document all of whose bounds are below is not scored.
    """
    own = docs.schema[key].dataType.simpleString()
    once = reach.groupBy("id", "digest").agg(F.first("items").alias("items"), F.first("bounds").alias("bounds"), F.first("margin").alias("margin"))
    once = session.cut(once)
    size = once.agg(F.coalesce(F.sum(F.size("items") * 12 + 48), F.lit(0))).first()[0]
    once = F.broadcast(once) if size <= BROADCAST_BYTES else once
    rows = _rows(docs, key, text).alias("d").join(
        once.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.digest") == F.col("c.digest"))
    ).select("d.id", "d.body", "c.items", "c.bounds", "c.margin").sortWithinPartitions(F.desc("margin"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = least.copy()
        best: dict[int, list] = {}
        for b in batches:
            for name, body, items, bounds in zip(b.column(0).to_pylist(), *[b.column(c) for c in (1, 2, 3)]):
                items, bounds = np.array(items.as_py(), np.int64), np.array(bounds.as_py(), np.int64)
                items = items[bounds >= limit[items]]
                if not len(items):
                    continue
                score = queries.scores(Counter(terms(body.as_py())))
                for i in items[score[items] >= limit[items]].tolist():
                    mine = best.setdefault(i, [])
                    insort(mine, (-int(score[i]), name is None, name if name is not None else 0))
                    if len(mine) >= k:
                        del mine[k:]
                        limit[i] = max(limit[i], -mine[-1][0])
        for i, mine in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(mine), pa.int32()), pa.array([None if x[1] else x[2] for x in mine], id_kind),
                 pa.array([-x[0] for x in mine], pa.int64())],
                names=["item", "id", "score"],
            )

    id_kind = to_arrow_type(docs.schema[key].dataType)
    return rows.drop("margin").mapInArrow(go, f"item int, id {own}, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(item, rank, key, score): the k documents of highest score above 0 for every item, equal scores by ascending key.

    1. One pass over the texts folds every document's term counts into a sketch (table in
       the shared folder) and counts documents, terms and the documents of the items' terms.
    2. Batched lookups bound every document's score for every item. The exact scores of
       the documents of highest bound give each item's first threshold.
    3. Documents with a bound that reaches the threshold are read again and scored
       exactly, in descending bounds, until no bound reaches the k-th best score.

    A bound never is below its score, so the answer equals scoring all documents. Items
    are taken in blocks of ``item_bytes``; tasks and driver hold one block.

    Null texts have no terms; documents without a term are not counted and never
    ranked, items without a term have no rows. Repeated rows are documents of their own;
    rows with a null key come last among equal scores. Repeated items repeat their
    answer. Empty tables give empty tables. Other columns are not read.
    """
    wanted = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / item_bytes))
    block = F.pmod(F.xxhash64(F.col("item_id").cast("string"), F.col("text")), F.lit(blocks))
    out = None
    for b in range(blocks):
        some = wanted if blocks == 1 else wanted.where(block == b)
        rows = sorted(some.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] if r["item_id"] is not None else 0, r["text"] or ""))
        part = _search_block(docs, rows, k, key, text, wanted.schema["item_id"].dataType.simpleString())
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("item_id").alias(item), "rank", F.col("id").alias(key), "score")


def _search_block(docs: DataFrame, rows: list, k: int, key: str, text: str, item_kind: str) -> DataFrame:
    spark = docs.sparkSession
    queries = Queries([r["text"] for r in rows])
    empty = spark.createDataFrame([], f"item_id {item_kind}, rank int, id {docs.schema[key].dataType.simpleString()}, score long")
    if not queries.items:
        return empty
    table = session.cut(sketches(docs, queries, key, text))
    counts = {r["term"]: r["df"] for r in table.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # terms of one block
    if not counts:
        return empty
    queries.weigh(counts[-1], counts[-2], counts)
    index = table.where("term is null").select("id", "digest", "n", "at", "tf")
    least = np.ones(len(queries.items), np.int64)
    seeds = highest_bounds(index, queries, k * SEEDS).groupBy("id", "digest").agg(F.collect_list("item").alias("items"))
    seeds = seeds.select("id", "digest", "items", F.transform("items", lambda i: F.lit((1 << 63) - 1)).alias("bounds"), F.lit(0.0).alias("margin"))
    first = _best(rescore(docs, seeds, queries, least, k, key, text), k, "score", "id")
    for r in first.where(F.col("rank") == k).select("item", "score").collect():  # one row per item of the block
        least[r["item"]] = r["score"]
    best = _best(rescore(docs, within_reach(index, queries, least), queries, least, k, key, text), k, "score", "id")
    names = spark.createDataFrame([(p, rows[i]["item_id"]) for p, i in enumerate(queries.items)], f"item int, item_id {item_kind}")
    return best.join(names, "item").select("item_id", "rank", "id", "score")
