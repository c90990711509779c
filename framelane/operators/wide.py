"""Two-scale outlier filter of long trajectories, in blocks that do not grow with the wide window.

The wide window is a share of the trajectory, so no block can hold it. Values are
cut into ranges by rank, rows into blocks by position, and prefix counts per (block,
range) say how many rows of every range lie in the part that the windows of all rows of a
block have in common. From these counts follows which few ranges can hold a median or a
median deviation; only their rows are fetched, all others take part as counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelane.operators import kernels as K
from framelane.operators.ranked import ranked
from framelane.session import cut

#: Shortest block. Blocks and ranges hold the square root of the trajectory's rows beyond that.
SIDE = 1024
#: Trajectories up to this length fit into a block with their windows (see kernels).
LONG = 32 * SIDE
CHUNK = 64


def side(n: int) -> int:
    return max(SIDE, int(np.ceil(np.sqrt(n))))


class Geometry:
    """Which blocks the windows of block ``b`` see in part (raw), and which all of them see whole.

    Beyond its ends a trajectory is reflected, so a row may stand at three places: its
    own, and mirrored at either end (the end rows themselves are not mirrored).
    """

    def __init__(self, n: int, b: int, ratio: float, micro: int, size: int | None = None):
        self.n, self.size = n, size or side(n)
        self.blocks = -(-n // self.size)
        self.k = K.hampel_macro_half(n, ratio)
        pad = min(max(self.k, micro), n - 1)
        self.first, self.stop = b * self.size, min(n, (b + 1) * self.size)
        self.targets = np.arange(max(-micro, self.first - micro), min(n + micro, self.stop + micro))
        self.lo = np.maximum(-pad, self.targets - self.k)
        self.hi = np.minimum(n - 1 + pad, self.targets + self.k) + 1
        self.raw: list[tuple[int, int]] = []
        self.whole: list[tuple[int, int]] = []
        for image in range(3):
            out, inner = self.rows(self.lo[0], self.hi[-1], image), self.rows(self.lo[-1], self.hi[0], image)
            if out[0] > out[1]:
                continue
            blocks = range(out[0] // self.size, out[1] // self.size + 1)
            start = -(-inner[0] // self.size)
            stop = self.blocks if inner[1] == n - 1 else (inner[1] + 1) // self.size
            if start < stop:
                self.whole.append((start, stop))
            self.raw += [(image, e) for e in (*range(blocks.start, min(start, blocks.stop)), *range(max(stop, start), blocks.stop))]

    def rows(self, lo: int, hi: int, image: int) -> tuple[int, int]:
        """First and last row that stands in places [lo, hi) of an image; the last is smaller if none does."""
        if image == 0:
            return max(0, int(lo)), min(self.n - 1, int(hi) - 1)
        if image == 1:
            return max(1, 1 - int(hi)), min(self.n - 1, -int(lo))
        return max(0, 2 * self.n - 1 - int(hi)), min(self.n - 2, 2 * (self.n - 1) - int(lo))

    def place(self, p: np.ndarray, image: int) -> np.ndarray:
        return p if image == 0 else -p if image == 1 else 2 * (self.n - 1) - p

    def source(self, q: np.ndarray) -> np.ndarray:
        """Rows that stand at places ``q``."""
        q = np.abs(q)
        return np.where(q > self.n - 1, 2 * (self.n - 1) - q, q)

    def own(self) -> list[int]:
        """Blocks with the rows of the targets."""
        return np.unique(self.source(self.targets) // self.size).tolist()


class _Block:
    """One block's windows: rows of raw blocks by place, and what all windows share."""

    def __init__(self, g: Geometry, arrays: dict[int, np.ndarray]):
        places, values = [], []
        for image, e in g.raw:
            v = arrays[e]
            p = np.arange(e * g.size, e * g.size + len(v))
            keep = ~np.isnan(v)
            if image == 1:
                keep &= p > 0
            if image == 2:
                keep &= p < g.n - 1
            places.append(g.place(p[keep], image))
            values.append(v[keep])
        q = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.argsort(q, kind="stable")
        q, self.values = q[order], (np.concatenate(values) if values else np.zeros(0))[order]
        self.a, self.b = np.searchsorted(q, g.lo), np.searchsorted(q, g.hi)


def needed_ranges(block: _Block, low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranges whose rows must be known one by one: all that can hold a median, or a median deviation, of any window."""
    raw, shared = np.sort(block.values), int(counts.sum())
    count = shared + block.b - block.a
    some = count[count > 0]
    several = (low < high) & (counts > 0)
    if not len(some):
        return np.flatnonzero(several & False)
    lower, upper = int((some.min() - 1) // 2), int(some.max() // 2)
    if upper >= shared:
        return np.flatnonzero(several)
    one = np.ones(len(raw), np.int64)

    def at(values: np.ndarray, weights: np.ndarray, k: int) -> float:
        order = np.argsort(values, kind="stable")
        return values[order][np.searchsorted(np.cumsum(weights[order]), k, side="right")]

    m_lo = at(np.concatenate([low, raw]), np.concatenate([counts, one]), lower)
    m_hi = at(high, counts, upper)
    near = np.concatenate([np.maximum(0.0, np.maximum(low - m_hi, m_lo - high)), np.maximum(0.0, np.maximum(raw - m_hi, m_lo - raw))])
    d_lo = at(near, np.concatenate([counts, one]), lower)
    d_hi = at(np.maximum(high - m_lo, m_hi - low), counts, upper)

    def meets(a: float, b: float) -> np.ndarray:
        slack = 1e-12 * (abs(a) + abs(b))
        return (high >= a - slack) & (low <= b + slack)

    return np.flatnonzero(several & (meets(m_lo, m_hi) | meets(m_lo - d_hi, m_hi - d_lo) | meets(m_lo + d_lo, m_hi + d_hi)))


def windowed_medians(block: _Block, low: np.ndarray, counts: np.ndarray, fetched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and median absolute deviation of every window (NaN where empty).

    ``fetched`` holds single rows that all windows share; ``counts`` the others, each range by its
    lowest value, which lies on the same side of every median and deviation as the rows do.
    """
    some = counts > 0
    shared = np.concatenate([low[some], fetched])
    weights = np.concatenate([counts[some], np.ones(len(fetched), np.int64)])
    values = np.unique(np.concatenate([shared, block.values]))
    total = np.zeros(len(values) + 1, np.int64)
    np.add.at(total, np.searchsorted(values, shared) + 1, weights)
    total = np.cumsum(total)
    ranks = np.concatenate([[0], np.searchsorted(np.sort(block.values), values, side="right")])
    tree = K.RankedWindows(block.values) if len(block.values) else None
    a, b = block.a, block.b

    def upto(i: np.ndarray) -> np.ndarray:
        """Rows of each window among the ``i`` smallest distinct values."""
        return total[i] + (tree.below(a, b, ranks[i]) if tree else 0)

    size = upto(np.full(len(a), len(values)))
    live = size > 0

    def kth(k: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), len(values) - 1)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            enough = upto(mid + 1) > k
            lo, hi = np.where(enough, lo, np.minimum(mid + 1, hi)), np.where(enough, mid, hi)
        return values[lo]

    if not len(values):
        return np.full(len(a), np.nan), np.full(len(a), np.nan)
    half, upper = np.maximum(size - 1, 0) // 2, size // 2
    upper = np.minimum(upper, np.maximum(size - 1, 0))
    med = (kth(half) + kth(upper)) / 2.0
    middle = np.searchsorted(values, med, side="left")  # values below stand left of the median

    def within(d: np.ndarray) -> np.ndarray:
        """Rows of each window at most ``d`` from its median, by the deviations as they round."""
        right, left = np.searchsorted(values, med + d, side="right"), np.searchsorted(values, med - d, side="left")
        for _ in range(4):
            right = right + ((right < len(values)) & (np.abs(values[np.minimum(right, len(values) - 1)] - med) <= d))
            right = right - ((right > 0) & (values[np.maximum(right - 1, 0)] >= med) & (np.abs(values[np.maximum(right - 1, 0)] - med) > d))
            left = left - ((left > 0) & (np.abs(values[np.maximum(left - 1, 0)] - med) <= d))
            left = left + ((left < len(values)) & (values[np.minimum(left, len(values) - 1)] < med) & (np.abs(values[np.minimum(left, len(values) - 1)] - med) > d))
        return upto(np.maximum(right, left)) - upto(left)

    def deviation(k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest deviation: the nearest value on either side that has enough rows within."""
        lo, hi = np.full(len(a), -1), middle - 1  # largest index left of the median with enough rows within, -1 for none
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            enough = within(np.abs(values[np.maximum(mid, 0)] - med)) > k
            go = lo < hi
            lo, hi = np.where(go & enough, mid, lo), np.where(go & ~enough, mid - 1, hi)
        below = np.where(lo >= 0, np.abs(values[np.maximum(lo, 0)] - med), np.inf)
        lo, hi = middle.copy(), np.full(len(a), len(values))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            enough = within(np.abs(values[np.minimum(mid, len(values) - 1)] - med)) > k
            go = lo < hi
            lo, hi = np.where(go & ~enough, mid + 1, lo), np.where(go & enough, mid, hi)
        above = np.where(lo < len(values), np.abs(values[np.minimum(lo, len(values) - 1)] - med), np.inf)
        return np.minimum(below, above)

    mad = deviation(half)
    even = upper != half
    if even.any():
        mad = np.where(even, (mad + deviation(upper)) / 2.0, mad)
    return np.where(live, med, np.nan), np.where(live, mad, np.nan)


def _filtered(g: Geometry, arrays: dict[int, np.ndarray], low, counts, fetched, s1: float, micro: int, s2: float) -> tuple[np.ndarray, np.ndarray]:
    """Wide pass at the targets, then the narrow pass, for the block's own rows."""
    med, mad = windowed_medians(_Block(g, arrays), low, counts, fetched)
    src = g.source(g.targets)
    v = np.array([arrays[p // g.size][p % g.size] for p in src.tolist()])
    with np.errstate(invalid="ignore"):
        m1 = np.isfinite(v) & (np.abs(v - med) > s1 * 1.4826 * (mad + 1e-12))
    w1 = np.where(m1, med, v)
    w2, m2 = K.hampel_pass(w1, min(micro, (g.n - 1) // 2), s2)
    core = slice(g.first - int(g.targets[0]), g.stop - int(g.targets[0]))
    return w2[core], (m1 | m2)[core]


def row_by_row(df: DataFrame, go, fields: str) -> DataFrame:
    """``go(row) -> dict`` for every row; key columns stay as they are."""
    schema = T._parse_datatype_string(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.fieldNames()
        for b in batches:
            for i in range(b.num_rows):  # one block at a time
                row = {n: b.column(k).slice(i, 1) for k, n in enumerate(b.schema.names)}
                made = go(row)
                for out in made if isinstance(made, list) else [made]:
                    cols = [row[n] if n not in out else pa.array([out[n]], to_arrow[n]) for n in names]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    to_arrow = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
    return df.mapInArrow(run, schema)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def two_scale_hampel_long(rows: DataFrame, key: Sequence[str], macro_ratio: float, macro_sigma: float, micro: int, micro_sigma: float) -> DataFrame:
    """(key, _pos, v, m) for ``rows(key, _pos, _n, v)`` with positions 0 .. _n - 1: cleaned value and outlier flag.

    Same values as the block kernel at every length. Blocks, ranges, and lists of blocks and
    ranges are bounded by the square root of the trajectory; how many ranges a block fetches
    depends on how far its windows' medians spread, not on their length.
    """
    key = list(key)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = ", ".join(f"{k} {kinds[k]}" for k in key)
    rows = cut(rows.withColumns({"_n": F.col("_n").cast("long"), "_side": F.greatest(F.lit(SIDE), F.ceil(F.sqrt("_n"))).cast("long"), "v": F.when(~F.isnan("v"), F.col("v"))}))
    sizes = rows.groupBy(*key).agg(F.first("_side").alias("_side"))
    values = ranked(rows, key, "v").join(sizes, key)
    at = F.floor(F.col("before") / F.col("_side")).cast("long") * 2 + (F.col("n") >= F.col("_side")).cast("long")
    ranges = values.groupBy(*key, at.alias("_r")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    ranges = ranges.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("_x"))
    ranges = cut(ranges.select(*key, F.col("_x.low").alias("low"), F.col("_x.high").alias("high")))
    e = F.floor(F.col("_pos") / F.col("_side")).cast("long").alias("e")
    blocks = rows.groupBy(*key, "_n", e).agg(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("v", F.lit(float("nan"))).alias("v")))).alias("_x"))
    blocks = blocks.select(*key, "_n", "e", F.col("_x.v").alias("vals"))
    blocks = cut(blocks.join(ranges, key, "left").withColumns({c: F.coalesce(c, F.array().cast("array<double>")) for c in ("low", "high")}))

    def count(row):
        v, low = _numbers(row["vals"]), _numbers(row["low"])
        r = np.searchsorted(low, v, side="right") - 1
        r[np.isnan(v)] = -1
        return {"r": r.astype(np.int32), "counts": np.bincount(r[r >= 0], minlength=len(low)).astype(np.int32)}

    counted = cut(row_by_row(blocks.select(*key, "_n", "e", "vals", "low"), count, f"{head}, _n bigint, e bigint, vals array<double>, r array<int>, counts array<int>"))
    # prefix counts over blocks, a chunk of ranges at a time
    chunks = counted.select(*key, "e", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("counts") - 1), F.lit(CHUNK)), lambda i: F.slice("counts", i + 1, F.lit(CHUNK)))).alias("chunk", "part"))
    chunks = chunks.groupBy(*key, "chunk").agg(F.sort_array(F.collect_list(F.struct("e", "part"))).alias("_x")).select(*key, "chunk", F.col("_x.part").alias("parts"))

    def add_up(row):
        parts = row["parts"].flatten()
        table = parts.flatten().to_numpy().reshape(len(parts), -1)
        return {"prefix": np.cumsum(table, axis=0, dtype=np.int64).tolist()}

    prefix = row_by_row(chunks, add_up, f"{head}, chunk int, prefix array<array<bigint>>")
    prefix = prefix.select(*key, "chunk", F.posexplode("prefix").alias("e", "part"))
    prefix = prefix.groupBy(*key, (F.col("e") + 1).cast("long").alias("e")).agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("_x"))
    prefix = prefix.select(*key, "e", F.flatten(F.col("_x.part")).alias("prefix"))

    def look(row):
        g = Geometry(row["_n"][0].as_py(), row["e"][0].as_py(), macro_ratio, micro)
        edges = [(sign, at) for a, b in g.whole for sign, at in ((-1, a), (1, b)) if at > 0]
        return {"seen": sorted({e for _, e in g.raw} | set(g.own())), "signs": [s for s, _ in edges], "edges": [x for _, x in edges], "starts": [a for a, _ in g.whole], "stops": [b for _, b in g.whole]}

    views = cut(row_by_row(counted.select(*key, "_n", "e"), look, f"{head}, _n bigint, e bigint, seen array<bigint>, signs array<int>, edges array<bigint>, starts array<bigint>, stops array<bigint>").withColumnRenamed("e", "_b"))
    raw = views.select(*key, "_b", F.explode("seen").alias("e")).join(counted.select(*key, "e", "vals"), [*key, "e"])
    raw = raw.groupBy(*key, "_b").agg(F.sort_array(F.collect_list(F.struct("e", "vals"))).alias("raw"))
    edges = views.select(*key, "_b", F.explode(F.arrays_zip("signs", "edges")).alias("x")).select(*key, "_b", F.col("x.signs").alias("sign"), F.col("x.edges").alias("e"))
    edges = edges.join(prefix, [*key, "e"]).groupBy(*key, "_b").agg(F.collect_list(F.struct("sign", "prefix")).alias("edges"))
    whole = views.select(*key, "_n", "_b", "starts", "stops").join(raw, [*key, "_b"]).join(edges, [*key, "_b"], "left").join(ranges, key, "left")

    def unpack(row):
        g = Geometry(row["_n"][0].as_py(), row["_b"][0].as_py(), macro_ratio, micro)
        arrays = {x["e"]: np.array(x["vals"], float) for x in row["raw"][0].as_py()}
        low = np.array(row["low"][0].as_py() or [], float)
        counts = np.zeros(len(low), np.int64)
        for x in row["edges"][0].as_py() or []:
            counts += x["sign"] * np.array(x["prefix"], np.int64)
        return g, arrays, low, counts

    def choose(row):
        g, arrays, low, counts = unpack(row)
        return {"need": needed_ranges(_Block(g, arrays), low, np.array(row["high"][0].as_py() or [], float), counts).tolist()}

    chosen = cut(row_by_row(whole.select(*key, "_n", "_b", "raw", "edges", "low", "high"), choose, f"{head}, _b bigint, need array<bigint>"))
    asked = chosen.select(*key, F.explode("need").alias("r"))  # never a range of one value, however many rows have it
    members = counted.select(*key, F.col("e").alias("_e"), F.inline(F.arrays_zip(F.col("r").cast("array<bigint>").alias("r"), "vals")))
    members = members.join(asked.distinct(), [*key, "r"], "left_semi").groupBy(*key, "r").agg(F.collect_list(F.struct(F.col("_e"), F.col("vals").alias("v"))).alias("rows"))
    spans = F.arrays_zip("starts", "stops")
    wanted = chosen.join(views.select(*key, "_b", "starts", "stops"), [*key, "_b"]).select(*key, "_b", "starts", "stops", F.explode("need").alias("r")).join(members, [*key, "r"])
    times = F.transform("rows", lambda m: F.struct(m["v"].alias("v"), F.size(F.filter(spans, lambda s: (m["_e"] >= s["starts"]) & (m["_e"] < s["stops"]))).alias("k")))
    wanted = wanted.select(*key, "_b", F.flatten(F.transform(times, lambda m: F.array_repeat(m["v"], m["k"]))).alias("v"))
    wanted = wanted.groupBy(*key, "_b").agg(F.flatten(F.collect_list("v")).alias("fetched"))
    ready = whole.join(chosen, [*key, "_b"]).join(wanted, [*key, "_b"], "left")

    def clean(row):
        g, arrays, low, counts = unpack(row)
        counts[np.array(row["need"][0].as_py(), int)] = 0
        v, m = _filtered(g, arrays, low, counts, np.array(row["fetched"][0].as_py() or [], float), macro_sigma, micro, micro_sigma)
        return {"first": g.first, "v": [None if x != x else x for x in v.tolist()], "m": m.tolist()}

    out = row_by_row(
        ready.select(*key, "_n", "_b", "raw", "edges", "low", "need", "fetched"), clean, f"{head}, first bigint, v array<double>, m array<boolean>"
    )
    return out.select(*key, "first", F.posexplode(F.arrays_zip("v", "m")).alias("_i", "_x")).select(
        *key, (F.col("first") + F.col("_i")).alias("_pos"), F.col("_x.v").alias("v"), F.col("_x.m").alias("m")
    )
