"""Suffix-array dedup of repeated byte strings: sampled suffixes, range-partitioned by leading tokens, sorted in buckets.

A string of LENGTH bytes holds LENGTH - TOKEN + 1 suffixes that start with TOKEN of its
bytes. The one whose token has the smallest digest is its anchor: equal strings have
equal anchors at equal offsets, so only anchored suffixes (one in 17 or so) are sorted.

1. Documents are dealt to batches by digest. A batch sends the distinct tokens of its
   anchors, sorted and cut at sampled splitters, to the buckets of their ranges.
2. A bucket merges them and tells each batch which of its tokens other documents have.
3. A batch sends, for anchors with such tokens, the distinct contexts: all bytes that a
   string with this anchor can have, and the smallest document id.
4. A bucket sorts contexts by the suffix right of the anchor and by the reversed prefix
   left of it (multikey quicksort over 8-byte tokens). The common prefix lengths of
   neighbours, compared across the whole bucket, give classes of equal strings for each
   of the offsets, and the smallest document of each class. Splitters fall between
   tokens, so no class reaches over a bucket's boundary. A token of more than HOT batches
   is split further: strings with 8 or more bytes before the anchor go by token and those
   8 bytes, the others by token and the 8 bytes after it.
5. A batch marks the bytes of strings found in a smaller document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelane.llm.common import bounded_batches

LENGTH = 50
TOKEN = 16
OFFSETS = LENGTH - TOKEN + 1
LEFT = LENGTH - TOKEN
CONTEXT = LEFT + LENGTH
#: Bytes of text of a batch and of a bucket's share, about; and of a slice of sampling work.
BATCH = 12 << 20
BUCKET = 24 << 20
_SLICE = 1 << 20
#: Tokens of more batches than this are split by 8 more bytes of their strings.
HOT = 32
NEAR = 8
#: Splitters come from at most about SAMPLE_DOCS documents, SAMPLE_TOKENS of each; they only balance buckets.
SAMPLE_DOCS, SAMPLE_TOKENS = 2000, 64
_LAST = np.iinfo(np.int64).max
_CODES = np.random.default_rng(42).integers(1, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)


def _windowed(a: np.ndarray, width: int, op) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        a = op(a[:-n], a[n:])
        n *= 2
    return op(a[: len(a) - (width - n)], a[width - n:]) if n < width else a


def _digests(a: np.ndarray) -> np.ndarray:
    """32-bit digest of the TOKEN bytes at each place, never 0."""
    h, n, factor = _CODES[a], 1, np.uint32(0x01000193)
    while n < TOKEN:
        h = h[:-n] * factor + h[n:]
        n, factor = n * 2, np.uint32(int(factor) ** 2 & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return np.maximum(h, np.uint32(1))


def anchors(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted places of the anchors of all strings of LENGTH bytes inside the documents that end at ``ends``."""
    found = []
    for lo in range(0, len(text), _SLICE):
        part = text[lo: lo + _SLICE + LENGTH - 1]
        if len(part) < LENGTH:
            break
        h = _digests(part)
        low = _windowed(h, OFFSETS, np.minimum)
        first = int(np.searchsorted(ends, lo, side="right"))
        last = int(np.searchsorted(ends, lo + len(low), side="left")) + 1
        own = ends[first:last]
        spans = np.diff(np.concatenate([[lo], np.minimum(own, lo + len(low))]))
        stop = np.repeat(own, spans) - lo
        low = np.where(np.arange(len(low)) + LENGTH <= stop, low, np.uint32(0))
        edge = np.zeros(OFFSETS - 1, np.uint32)
        high = _windowed(np.concatenate([edge, low, edge]), OFFSETS, np.maximum)
        found.append(np.flatnonzero(h == high) + lo)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def tokens_at(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(n, 2) big-endian 8-byte tokens."""
    return text[places[:, None] + np.arange(TOKEN)].view(">u8").astype(np.uint64)


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of 8-byte tokens, and for each row in it whether it equals the one before.

    Multikey quicksort: sort by the first token, then only groups of equal rows by the next.
    """
    order, group = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    active = np.arange(len(rows))
    for t in range(rows.shape[1]):
        if len(active) < 2:
            break
        key = rows[order[active], t]
        by = np.lexsort((key, group[active])) if t else np.argsort(key, kind="stable")
        order[active], key = order[active][by], key[by]
        new = np.ones(len(active), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[active][1:] != group[active][:-1])
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        single = new & np.concatenate([new[1:], [True]])
        active = active[~single]
    same = np.zeros(len(rows), bool)
    same[1:] = group[1:] == group[:-1]
    return order, same


def _squeeze(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _spread(blob: bytes, kind) -> np.ndarray:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, kind)


def _cuts(tokens: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Where sorted tokens pass from one bucket to the next."""
    hi, lo = tokens[:, 0], tokens[:, 1]
    at = []
    for s_hi, s_lo in splitters:
        a, b = np.searchsorted(hi, s_hi, side="left"), np.searchsorted(hi, s_hi, side="right")
        at.append(a + np.searchsorted(lo[a:b], s_lo, side="left"))
    return np.concatenate([[0], np.array(at, np.int64), [len(tokens)]])


def _mix(tokens: np.ndarray) -> np.ndarray:
    """One number per token; used to look tokens up, a clash only costs work."""
    x = tokens[:, 0] * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ x >> np.uint64(32)) + tokens[:, 1]) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


class _Batch:
    """Documents of a batch as one byte array."""

    def __init__(self, docs: pa.Table):
        body = docs["body"].combine_chunks() if docs.num_rows else pa.array([], pa.binary())
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        self.ids = docs["id"].combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array([len(x) for x in body.to_pylist()], np.int64) if len(body) else np.zeros(0, np.int64)
        self.text = np.frombuffer(b"".join(body.to_pylist()), np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.anchors = anchors(self.text, self.ends)
        self.tokens = tokens_at(self.text, self.anchors)

    def owners(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


class _Contexts:
    """Distinct contexts of the anchors whose tokens are shared, bucket by bucket; columns: see CONTEXT and the flags.

    A row holds LENGTH bytes right of the anchor, LEFT bytes left of it backwards, then how
    many of both there are, and the least number of bytes left of the anchor that its
    strings have (for hot tokens).
    """

    def __init__(self, batch: _Batch, shared: list[tuple[bytes, bytes]], splitters: np.ndarray):
        tokens = np.concatenate([_spread(x, np.uint64) for x, _ in shared]).reshape(-1, 2) if shared else np.zeros((0, 2), np.uint64)
        hot = [np.unpackbits(_spread(y, np.uint8))[: int.from_bytes(x[:8], "little") // TOKEN] for x, y in shared]
        hot = np.concatenate(hot).astype(bool) if hot else np.zeros(0, bool)
        known, number = np.unique(_mix(tokens), return_inverse=True)  # whatever the order in which buckets answer
        hot = np.bincount(number, weights=hot, minlength=len(known)) > 0
        mine = _mix(batch.tokens)
        at = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
        hit = known[at] == mine if len(known) else np.zeros(len(mine), bool)
        places, hot = batch.anchors[hit], hot[at[hit]] if len(known) else np.zeros(0, bool)
        doc = batch.owners(places)
        left = np.minimum(LEFT, places - batch.starts[doc])
        right = np.minimum(LENGTH, batch.ends[doc] - places)
        near, far = np.flatnonzero(hot), np.flatnonzero(hot & (left >= NEAR))
        which = np.concatenate([np.flatnonzero(~hot), near, far])
        kind = np.repeat([0, 1, 2], [len(which) - len(near) - len(far), len(near), len(far)])
        self.places, self.doc = places[which], doc[which]
        left = np.where(kind == 1, np.minimum(left[which], NEAR - 1), left[which])
        right = np.where(kind == 2, np.minimum(right[which], LENGTH - NEAR), right[which])
        rows = np.zeros((len(which), CONTEXT + 4), np.uint8)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), batch.text, np.zeros(LENGTH, np.uint8)])
        step = 1 << 16
        for lo in range(0, len(rows), step):
            p, some = self.places[lo: lo + step], slice(lo, lo + step)
            view = padded[p[:, None] + np.arange(CONTEXT)]
            rows[some, :LENGTH] = np.where(np.arange(LENGTH) < right[some, None], view[:, LEFT:], 0)
            rows[some, LENGTH:CONTEXT] = np.where(np.arange(LEFT) < left[some, None], view[:, LEFT - 1:: -1][:, :LEFT], 0)
        rows[:, CONTEXT], rows[:, CONTEXT + 1] = right, left
        rows[:, CONTEXT + 2], rows[:, CONTEXT + 3] = np.where(kind == 2, NEAR, 0), kind
        words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
        words[:, : rows.shape[1]] = rows
        order, same = multikey_order(words.view(">u8").astype(np.uint64))
        number = np.empty(len(rows), np.int64)
        number[order] = np.cumsum(~same) - 1
        rows = rows[order[~same]]
        cuts = _cuts(_eights(rows[:, :TOKEN]), splitters)
        bucket, ranges = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), len(cuts) - 1
        for k, extra in ((1, rows[:, TOKEN: TOKEN + 8]), (2, rows[:, LENGTH: LENGTH + 8])):
            some = np.flatnonzero(rows[:, CONTEXT + 3] == k)
            seed = _mix(_eights(rows[some, :TOKEN])) + np.uint64(k)
            bucket[some] = ranges + (_mix(np.stack([seed, _eights(extra[some])[:, 0]], axis=1)) >> np.uint64(33)) % np.uint64(ranges)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.rows, self.number = rows[by], place[number]
        self.least = np.full(len(by), _LAST, np.int64)
        np.minimum.at(self.least, self.number, batch.ids[self.doc])
        self.cuts = np.searchsorted(bucket[by], np.arange(2 * ranges + 1))


def _eights(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def fitting(rows: np.ndarray, back: int) -> np.ndarray:
    """Rows whose context holds the string that starts ``back`` bytes before the anchor."""
    return (rows[:, CONTEXT + 1] >= back) & (rows[:, CONTEXT] >= LENGTH - back) & (rows[:, CONTEXT + 2] <= back)


def _token_rows(splitters: np.ndarray):
    def run(docs: pa.Table) -> pa.Table:
        batch = _Batch(docs)
        order, same = multikey_order(batch.tokens)
        number = np.cumsum(~same) - 1
        doc = batch.owners(batch.anchors)[order]
        firsts = np.flatnonzero(~same)
        several = np.zeros(len(firsts), np.uint8)
        other = np.flatnonzero(same & (doc != np.concatenate([doc[:1], doc[:-1]])))
        several[number[other]] = 1
        tokens = batch.tokens[order[firsts]]
        cuts = _cuts(tokens, splitters)
        used = [k for k in range(len(cuts) - 1) if cuts[k + 1] > cuts[k]]
        name = docs["batch"][0].as_py()
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "batch": pa.array([name] * len(used), pa.int32()),
            "tokens": pa.array([_squeeze(tokens[cuts[k]: cuts[k + 1]]) for k in used], pa.binary()),
            "several": pa.array([_squeeze(np.packbits(several[cuts[k]: cuts[k + 1]])) for k in used], pa.binary()),
        })

    return run


def _shared_rows(many_batches: int):
    def run(rows: pa.Table) -> pa.Table:
        """Of each batch's tokens in a bucket, those that more than one document has."""
        parts = [_spread(x.as_py(), np.uint64).reshape(-1, 2) for x in rows["tokens"]]
        several = [np.unpackbits(_spread(x.as_py(), np.uint8))[: len(p)] for x, p in zip(rows["several"], parts)]
        tokens, sizes = np.concatenate(parts), [len(p) for p in parts]
        order, same = multikey_order(tokens)
        number = np.cumsum(~same) - 1
        many = np.bincount(number, weights=1.0 + np.concatenate(several)[order]) > 1
        keep, hot = np.empty(len(tokens), bool), np.empty(len(tokens), bool)
        keep[order], hot[order] = many[number], (np.bincount(number) > many_batches)[number]
        ends = np.cumsum(sizes)[:-1]
        out = [p[k] for p, k in zip(parts, np.split(keep, ends))]
        hots = [h[k] for h, k in zip(np.split(hot, ends), np.split(keep, ends))]
        some = [k for k, x in enumerate(out) if len(x)]
        batches = rows["batch"].to_pylist()
        return pa.table({
            "batch": pa.array([batches[k] for k in some], pa.int32()), "bucket": pa.array([-1] * len(some), pa.int32()),
            "blob": pa.array([_squeeze(out[k]) for k in some], pa.binary()),
            "hot": pa.array([_squeeze(np.packbits(hots[k])) for k in some], pa.binary()),
        })

    return run


def _context_rows(splitters: np.ndarray):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows or not shared.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "batch": pa.array([], pa.int32()), "rows": pa.array([], pa.binary()), "least": pa.array([], pa.binary())})
        c = _Contexts(_Batch(docs), list(zip(shared["blob"].to_pylist(), shared["hot"].to_pylist())), splitters)
        used = [k for k in range(len(c.cuts) - 1) if c.cuts[k + 1] > c.cuts[k]]
        name = docs["batch"][0].as_py()
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "batch": pa.array([name] * len(used), pa.int32()),
            "rows": pa.array([_squeeze(c.rows[c.cuts[k]: c.cuts[k + 1]]) for k in used], pa.binary()),
            "least": pa.array([_squeeze(c.least[c.cuts[k]: c.cuts[k + 1]]) for k in used], pa.binary()),
        })

    return run


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sorted row with the one before."""
    out = np.zeros(len(rows), np.int64)
    for lo in range(1, len(rows), 1 << 16):
        hi = min(len(rows), lo + (1 << 16))
        differ = rows[lo:hi] != rows[lo - 1: hi - 1]
        out[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _sorted_side(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    order, _ = multikey_order(words.view(">u8").astype(np.uint64))
    return order, _common(rows[order])


def smaller_owner(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each context a bit per offset: the string there also starts in a document smaller than the context's smallest."""
    by_id = np.argsort(least, kind="stable")
    rows, ids = rows[by_id], least[by_id]
    n = len(rows)
    right_order, right_common = _sorted_side(rows[:, :LENGTH])
    left_order, left_common = _sorted_side(rows[:, LENGTH:CONTEXT])
    mask, r_class, l_class = np.zeros(n, np.uint64), np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(OFFSETS):  # bytes left of the anchor
        fits = np.flatnonzero(fitting(rows, back))
        if not len(fits):
            continue
        r_class[right_order] = np.cumsum(right_common < LENGTH - back)
        l_class[left_order] = np.cumsum(left_common < back) if back else 0
        key = r_class[fits] * (n + 1) + l_class[fits]
        order = np.argsort(key, kind="stable")  # ids rise within equal keys
        key = key[order]
        first = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key)), 0))
        own = fits[order]
        smaller = ids[own[first]] < ids[own]
        mask[own[smaller]] |= np.uint64(1 << back)
    out = np.empty(n, np.uint64)
    out[by_id] = mask
    return out


def _mask_rows(rows: pa.Table) -> pa.Table:
    parts = [_spread(x.as_py(), np.uint8).reshape(-1, CONTEXT + 4) for x in rows["rows"]]
    least = [_spread(x.as_py(), np.int64) for x in rows["least"]]
    masks = np.split(smaller_owner(np.concatenate(parts), np.concatenate(least)), np.cumsum([len(p) for p in parts])[:-1])
    return pa.table({
        "batch": rows["batch"].combine_chunks().cast(pa.int32()), "bucket": rows["bucket"].combine_chunks().cast(pa.int32()),
        "blob": pa.array([_squeeze(m) for m in masks], pa.binary()), "hot": pa.array([None] * len(masks), pa.binary()),
    })


def _removal_rows(splitters: np.ndarray):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], pa.list_(pa.int64())), "kept": pa.array([], pa.binary())})
        batch = _Batch(docs)
        starts = np.zeros(len(batch.text) + 1, bool)
        if answers.num_rows:
            buckets, blobs, hots = (answers[n].to_pylist() for n in ("bucket", "blob", "hot"))
            c = _Contexts(batch, [(x, y) for k, x, y in zip(buckets, blobs, hots) if k < 0], splitters)
            mask = np.zeros(len(c.rows), np.uint64)
            for k, x in zip(buckets, blobs):
                if k >= 0:
                    mask[c.cuts[k]: c.cuts[k + 1]] = _spread(x, np.uint64)
            mine = mask[c.number]
            later = batch.ids[c.doc] > c.least[c.number]
            for back in range(OFFSETS):
                gone = fitting(c.rows, back)[c.number] & (later | (mine >> np.uint64(back) & np.uint64(1)).astype(bool))
                starts[c.places[gone] - back] = True
        upto = np.concatenate([[0], np.cumsum(starts[:-1], dtype=np.int32)])
        covered = upto[1:] > 0
        covered[LENGTH:] = upto[LENGTH + 1:] > upto[1:-LENGTH]
        kept, spans = [], []
        for s, e in zip(batch.starts.tolist(), batch.ends.tolist()):
            part = covered[s:e]
            if part.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], part.view(np.int8), [0]])))
                spans.append(edge.tolist())
                kept.append(batch.text[s:e][~part].tobytes())
            else:
                spans.append([])
                kept.append(batch.text[s:e].tobytes())
        ids = docs["id"].combine_chunks().cast(pa.int64())
        return pa.table({"id": ids, "n_bytes": pa.array(batch.ends - batch.starts), "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})

    return run


def _sample_tokens(batches):
    for b in batches:
        out = []
        for x in b.column(0).to_pylist():
            text = np.frombuffer(x, np.uint8)
            at = anchors(text, np.array([len(text)]))
            out.append(tokens_at(text, at[:: max(1, -(-len(at) // SAMPLE_TOKENS))]).tobytes() if len(at) else b"")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["tokens"])


def _splitters(docs: DataFrame, rows: int, buckets: int) -> np.ndarray:
    share = min(1.0, SAMPLE_DOCS / max(1, rows))
    some = docs.where(F.pmod(F.xxhash64("body"), F.lit(1 << 30)) < int(share * (1 << 30))).select("body")
    raw = b"".join(r["tokens"] for r in some.mapInArrow(_sample_tokens, "tokens binary").collect())
    tokens = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    tokens = tokens[multikey_order(tokens)[0]]
    at = (np.arange(1, buckets) * len(tokens)) // buckets
    return tokens[at] if len(tokens) else tokens


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, spans array<long> (start, end, start, end, ... of removed bytes), kept binary; a row per row.

    Removed is each byte covered by a string of LENGTH bytes that also starts in a row
    with a smaller key. Rows with equal keys do not remove from each other; a null key
    counts as larger than all others. Null text is empty; texts shorter than LENGTH
    lose nothing. Empty tables give empty tables; other columns are not read. A batch
    holds about BATCH bytes of text, or one longer document.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    splitters = _splitters(rows, count, max(4, math.ceil(size / BUCKET)))
    batches = max(4, math.ceil(size / BATCH))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("id", "body"), F.lit(batches)).cast("int"))
    tokens = dealt.groupBy("batch").applyInArrow(_token_rows(splitters), "bucket int, batch int, tokens binary, several binary")
    shared = tokens.groupBy("bucket").applyInArrow(_shared_rows(HOT), "batch int, bucket int, blob binary, hot binary")
    contexts = dealt.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(
        _context_rows(splitters), "bucket int, batch int, rows binary, least binary"
    )
    masks = contexts.groupBy("bucket").applyInArrow(_mask_rows, "batch int, bucket int, blob binary, hot binary")
    out = dealt.groupBy("batch").cogroup(shared.union(masks).groupBy("batch")).applyInArrow(
        _removal_rows(splitters), "id long, n_bytes long, spans array<long>, kept binary"
    )
    return out.withColumnRenamed("id", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: bytes, removed bytes and runs, digest of what is kept."""
    return found.select(
        key, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
