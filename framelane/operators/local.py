"""Local regression of long trajectories from windowed power moments, in blocks that do not grow with the window.

A tricube weight is a polynomial of the distance on either side of a row, so its sums
over a window are sums of powers. Blocks that lie whole in the windows of all rows of
another block send eleven powers about their own centre, which are moved to a nearby
origin; only blocks with an end of a window, and the block itself, are read row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelane.operators.wide import SIDE, row_by_row, side
from framelane.session import cut

#: Trajectories up to this length are fitted from one array.
LONG = 8 * SIDE
POWERS = 12
_BINOMIAL = np.array([[comb(k, j) for j in range(POWERS)] for k in range(POWERS)], float)
_TRICUBE = ((0, 1.0), (3, -3.0), (6, 3.0), (9, -1.0))
#: Rows share an origin while they are this share of their reach away from it.
NEAR = 0.5


def powers(z: np.ndarray, n: int = POWERS) -> np.ndarray:
    return np.vander(z, n, increasing=True)


def block_moments(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Centre, half width, and sums of w t^k and w y t^k of a block, t being -1 .. 1 across it; last, rows with a weight."""
    c, s = (x[0] + x[-1]) / 2, max((x[-1] - x[0]) / 2, 1.0)
    t = powers((x - c) / s)
    return c, s, np.concatenate([w @ t, (w * y) @ t, [np.count_nonzero(w > 1e-12)]])


def moved(c: np.ndarray, s: np.ndarray, sums: np.ndarray, origin: float, scale: float) -> np.ndarray:
    """Sums of w z^k and w y z^k of all given blocks together, z = (x - origin) / scale."""
    out = np.zeros(2 * POWERS + 1)
    if not len(c):
        return out
    a, d = powers(s / scale), powers((c - origin) / scale)
    for k in range(POWERS):
        part = _BINOMIAL[k, : k + 1] * a[:, : k + 1] * d[:, k::-1]
        out[k] = (part * sums[:, : k + 1]).sum()
        out[POWERS + k] = (part * sums[:, POWERS: POWERS + k + 1]).sum()
    out[-1] = sums[:, -1].sum()
    return out


def first_of_nearest(x0: float, i: int, lo: int, hi: int, r: int, at: np.ndarray, ends: tuple[np.ndarray, np.ndarray], size: int) -> tuple[int, int]:
    """Bounds of where the ``r`` rows nearest to row ``i`` begin, from the first and last x of every block only."""
    first, last = ends
    starts = at[(at > lo) & (at <= hi)]
    there = starts + r
    known = there < size * len(first)
    e = np.minimum(there // size, len(first) - 1)
    near = x0 - first[starts // size]
    never = near <= first[e] - x0  # the next row on the right is no nearer, whichever it is
    always = known & (near > last[e] - x0)
    return int(starts[always].max(initial=lo)), int(starts[never].min(initial=hi))


def view(b: int, n: int, r: int, size: int, first: np.ndarray, last: np.ndarray) -> tuple[int, int, list[int], tuple[int, int], tuple[int, int]]:
    """For block ``b``: bounds of its windows' first rows, blocks to read, ranges of blocks that are whole on the left and right."""
    at = np.arange(len(first), dtype=np.int64) * size
    i0, i1 = b * size, min(n, (b + 1) * size) - 1
    a0, _ = first_of_nearest(first[b], i0, max(0, i0 - r + 1), min(i0, n - r), r, at, (first, last), size)
    _, a1 = first_of_nearest(last[b], i1, max(0, i1 - r + 1), min(i1, n - r), r, at, (first, last), size)
    top = len(first) - 1
    left, right = (a0 // size, a1 // size), ((a0 + r - 1) // size, min(top, (a1 + r) // size))
    wl, wr = (left[1] + 1, b), (b + 1, right[0])
    read = sorted({*range(left[0], left[1] + 1), b, *range(right[0], right[1] + 1)})
    read = [e for e in read if not (wl[0] <= e < wl[1] or wr[0] <= e < wr[1])]
    return a0, a1, read, wl if wl[0] < wl[1] else (0, 0), wr if wr[0] < wr[1] else (0, 0)


def lines(
    target: np.ndarray, index: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, bounds: tuple[int, int], r: int, n: int, mean: float,
    left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray],
) -> np.ndarray:
    """Locally weighted line at each target row: tricube weights over its ``r`` nearest rows times ``w``.

    ``index`` (ascending) numbers the rows given by x, y, w; ``left`` and ``right`` are the blocks between them that all windows hold.
    """
    place = np.searchsorted(index, target)
    x0 = x[place]
    a, b = np.maximum(np.maximum(0, target - r + 1), bounds[0]), np.minimum(np.minimum(target, n - r), bounds[1])
    while (a < b).any():
        mid = (a + b) // 2
        nxt = np.minimum(np.searchsorted(index, mid + r), len(x) - 1)
        go = (a < b) & (x0 - x[np.searchsorted(index, mid)] > x[nxt] - x0)
        a, b = np.where(go, mid + 1, a), np.where(go, b, np.where(a < b, mid, b))
    start, stop = np.searchsorted(index, a), np.searchsorted(index, a + r)
    h = np.maximum(x0 - x[start], x[stop - 1] - x0)
    out = np.empty(len(target))
    lo = 0
    while lo < len(target):
        ok = (x0[lo:] - x0[lo] <= NEAR * h[lo:]) & (x0[lo:] - x0[lo] <= NEAR * h[lo])
        hi = lo + (int(np.argmin(ok)) if not ok.all() else len(ok))
        part = slice(lo, max(hi, lo + 1))
        out[part] = _group(x0[part], h[part], place[part], start[part], stop[part], x, y, w, mean, left, right)
        lo = part.stop
    return out


def _group(x0, h, place, start, stop, x, y, w, mean, left, right) -> np.ndarray:
    origin, scale = float(x0[0]), float(h[0])
    used = slice(int(start.min()), int(stop.max()))
    z = powers((x[used] - origin) / scale)
    each = np.hstack([z * w[used, None], z * (w[used] * y[used])[:, None], (w[used, None] > 1e-12).astype(float)])
    run = np.vstack([np.zeros(each.shape[1]), np.cumsum(each, axis=0)])
    place, start, stop = place - used.start, start - used.start, stop - used.start
    sides = (
        (-1.0, run[place] - run[start] + moved(*left, origin, scale)),
        (1.0, run[stop] - run[place] + moved(*right, origin, scale)),
    )
    xi = (x0 - origin) / scale
    back = powers(-xi)
    s0 = s1 = s2 = b0 = b1 = count = 0.0
    for sign, sums in sides:
        f = sign * scale / h
        up = powers(f)

        def moment(k: int, shift: int) -> np.ndarray:
            return up[:, k] * (_BINOMIAL[k, : k + 1] * sums[:, shift: shift + k + 1] * back[:, k::-1]).sum(axis=1)

        m = [moment(k, 0) for k in range(POWERS)]
        v = [moment(k, POWERS) for k in range(POWERS - 1)]
        s0 = s0 + sum(c * m[k] for k, c in _TRICUBE)
        s1 = s1 + sign * h * sum(c * m[k + 1] for k, c in _TRICUBE)
        s2 = s2 + h * h * sum(c * m[k + 2] for k, c in _TRICUBE)
        b0 = b0 + sum(c * v[k] for k, c in _TRICUBE)
        b1 = b1 + sign * h * sum(c * v[k + 1] for k, c in _TRICUBE)
        count = count + sums[:, -1]
    det = s0 * s2 - s1 * s1
    with np.errstate(divide="ignore", invalid="ignore"):
        line = np.where(det > 1e-14 * s0 * s2, (s2 * b0 - s1 * b1) / det, b0 / s0)
    return np.where(np.rint(count) < 2, mean, line)


def local_fit_long(rows: DataFrame, key: Sequence[str], x: str, value: str, weight: str, share: float) -> DataFrame:
    """(key, _pos, fit) for ``rows(key, _pos, _n, x, value, weight, _mean)`` with positions 0 .. _n - 1."""
    key = list(key)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = ", ".join(f"{k} {kinds[k]}" for k in key)
    size = F.greatest(F.lit(SIDE), F.ceil(F.sqrt("_n"))).cast("long")
    e = F.floor(F.col("_pos") / size).cast("long").alias("e")
    entry = F.struct("_pos", F.col(x).cast("double").alias("x"), F.col(value).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    blocks = rows.groupBy(*key, F.col("_n").cast("long").alias("_n"), e).agg(F.first("_mean").alias("mean"), F.sort_array(F.collect_list(entry)).alias("_x"))
    blocks = cut(blocks.select(*key, "_n", "e", "mean", *[F.col(f"_x.{c}").alias(c) for c in "xyw"]))

    def numbers(row, name):
        return row[name].flatten().to_numpy(zero_copy_only=False).astype(float)

    def summary(row):
        a = numbers(row, "x")
        c, s, sums = block_moments(a, numbers(row, "y"), numbers(row, "w"))
        return {"first": float(a[0]), "last": float(a[-1]), "c": float(c), "s": float(s), "sums": sums.tolist()}

    parts = row_by_row(blocks, summary, f"{head}, e bigint, first double, last double, c double, s double, sums array<double>")
    whole = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("e", "first", "last", "c", "s", "sums"))).alias("_x"))
    whole = cut(whole.select(*key, *[F.col(f"_x.{c}").alias(c) for c in ("first", "last", "c", "s")], F.flatten(F.col("_x.sums")).alias("sums")))

    def reach(n: int) -> int:
        return max(4, min(n, int(np.ceil(n * share))))

    def look(row):
        n = row["_n"][0].as_py()
        a0, a1, read, wl, wr = view(row["e"][0].as_py(), n, reach(n), side(n), numbers(row, "first"), numbers(row, "last"))
        return {"read": read, "at": [a0, a1, *wl, *wr]}

    views = cut(
        row_by_row(blocks.select(*key, "_n", "e", "mean").join(whole.select(*key, "first", "last"), key), look, f"{head}, _n bigint, e bigint, mean double, read array<bigint>, at array<bigint>")
        .withColumnRenamed("e", "_b")
    )
    raw = views.select(*key, "_b", F.explode("read").alias("e")).join(blocks.select(*key, "e", *"xyw"), [*key, "e"])
    raw = raw.groupBy(*key, "_b").agg(F.sort_array(F.collect_list(F.struct("e", *"xyw"))).alias("raw"))
    ready = views.drop("read").join(raw, [*key, "_b"]).join(whole.select(*key, "c", "s", "sums"), key)

    def fit(row):
        n, b, mean = row["_n"][0].as_py(), row["_b"][0].as_py(), row["mean"][0].as_py()
        a0, a1, l0, l1, r0, r1 = row["at"][0].as_py()
        c, s, sums = numbers(row, "c"), numbers(row, "s"), numbers(row, "sums")
        sums = sums.reshape(len(c), -1)
        raw, length = row["raw"][0].as_py(), side(n)
        index = np.concatenate([np.arange(q["e"] * length, q["e"] * length + len(q["x"])) for q in raw])
        a, y, w = (np.concatenate([np.array(q[k], float) for q in raw]) for k in "xyw")
        target = np.arange(b * length, min(n, (b + 1) * length))
        got = lines(target, index, a, y, w, (a0, a1), reach(n), n, mean, (c[l0:l1], s[l0:l1], sums[l0:l1]), (c[r0:r1], s[r0:r1], sums[r0:r1]))
        return {"start": int(target[0]), "fit": got.tolist()}

    out = row_by_row(ready, fit, f"{head}, start bigint, fit array<double>")
    return out.select(*key, "start", F.posexplode("fit").alias("_i", "fit")).select(*key, (F.col("start") + F.col("_i")).alias("_pos"), "fit")
