"""Small numpy kernels over one block of a trajectory (core rows plus the rows they look at).

Spark builds the blocks (:func:`blocks`) and spreads them; a kernel sees one
array per block and returns one array for the block's core rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelane.operators.ordered import BLOCK, halo

CORE = 1024

_CLEANED = T.StructType(
    [T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("m", T.ArrayType(T.BooleanType()))]
)


def blocks(
    df: DataFrame, key: Sequence[str], pos: str, n: str, reach: Column, cols: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per block: arrays of ``cols`` and ``keep`` over positions ``lo ..``, core range ``[first, stop)``.

    ``pos`` runs 0..n-1 without holes. ``reach`` rows on either side are added;
    blocks grow with ``reach``, so a row is copied at most twice.
    """
    span = F.greatest(F.lit(CORE), reach).cast("long")
    out = df.withColumns({"_reach": reach.cast("long"), "_span": span})
    out = halo(out, pos, F.col("_reach"), F.col("_reach"), F.col("_span"))
    # rows near the end also reach for a block behind the last one, which has no core
    out = out.where(F.col(BLOCK) * F.col("_span") < F.col(n))
    rec = F.struct(F.col(pos).alias("_p"), *[F.col(c) for c in dict.fromkeys([*cols, *keep])])
    out = out.groupBy(*key, BLOCK, n, "_span").agg(F.sort_array(F.collect_list(rec)).alias("_rows"))
    first = F.col(BLOCK) * F.col("_span")
    out = out.withColumns(
        {
            "lo": F.col("_rows")[0]["_p"],
            "first": first,
            "stop": F.least(first + F.col("_span"), F.col(n)),
        }
    )
    core = F.slice("_rows", (F.col("first") - F.col("lo") + 1).cast("int"), (F.col("stop") - F.col("first")).cast("int"))
    return out.select(
        *key,
        n,
        "lo",
        "first",
        "stop",
        *[F.col(f"_rows.{c}").alias(c) for c in cols],
        *[core[c].alias(f"_core_{c}") for c in keep],
    )


def unblock(df: DataFrame, key: Sequence[str], arrays: dict[str, str]) -> DataFrame:
    """Rows again: ``arrays`` maps array columns (same length) to output names."""
    zipped = F.arrays_zip(*[F.col(a).alias(b) for a, b in arrays.items()])
    return df.select(*key, F.inline(zipped))


def _median_rows(w: np.ndarray) -> np.ndarray:
    """Row medians ignoring NaN (NaN where a row has none)."""
    s = np.sort(w, axis=1)
    cnt = (~np.isnan(s)).sum(axis=1)
    i = np.maximum(cnt - 1, 0)
    rows = np.arange(len(s))
    med = (s[rows, i // 2] + s[rows, (i + 1) // 2]) / 2.0
    return np.where(cnt > 0, med, np.nan)


# Windows beyond this half width are searched by rank instead of sorted one by one; both give the same medians.
WIDE = 32


class RankedWindows:
    """Order statistics of any window of an array, for many windows at once.

    The ranks are split bit by bit from the top, zeros before ones, with counts
    of zeros at every level. A lookup narrows its window once per bit, so it
    costs the logarithm of the array, whatever the width of the window.
    """

    def __init__(self, v: np.ndarray):
        order = np.argsort(v, kind="stable")
        self.sorted = v[order]
        rank = np.empty(len(v), dtype=np.int64)
        rank[order] = np.arange(len(v))
        self.levels = []
        for bit in range(max(1, (len(v) - 1).bit_length()) - 1, -1, -1):
            zero = (rank >> bit) & 1 == 0
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero)])))
            rank = np.concatenate([rank[zero], rank[~zero]])

    def value(self, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ``at``-th smallest value (from 0) of each window ``[lo, hi)``."""
        rank = np.zeros(len(at), dtype=np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            low = at < b - a
            at = np.where(low, at, at - (b - a))
            rank += np.where(low, 0, 1 << bit)
            lo, hi = np.where(low, a, zeros[-1] + lo - a), np.where(low, b, zeros[-1] + hi - b)
        return self.sorted[rank]


    def below(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Values of each window ``[lo, hi)`` among the ``rank`` smallest of the array."""
        all_, out = rank >= len(self.sorted), np.zeros(len(rank), dtype=np.int64)
        size = hi - lo
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            one = (rank >> bit) & 1 == 1
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return np.where(all_, size, out)


def wide_medians(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and median absolute deviation of ``k`` rows either side, ignoring NaN (NaN where a window has none)."""
    seen = ~np.isnan(v)
    i = np.arange(len(v))
    place = np.concatenate([[0], np.cumsum(seen)])
    lo, hi = place[np.maximum(i - k, 0)], place[np.minimum(i + k + 1, len(v))]
    med, mad = np.full(len(v), np.nan), np.full(len(v), np.nan)
    some = hi > lo
    if not some.any():
        return med, mad
    lo, hi = lo[some], hi[some]
    ranks, count = RankedWindows(v[seen]), hi - lo
    half = (count - 1) // 2
    m = (ranks.value(lo, hi, half) + ranks.value(lo, hi, count // 2)) / 2.0
    below, above = half + 1, count - half - 1

    def left(j):
        ok = (j >= 0) & (j < below)
        return np.where(ok, np.abs(ranks.value(lo, hi, np.where(ok, half - j, 0)) - m), np.where(j < 0, -np.inf, np.inf))

    def right(j):
        ok = (j >= 0) & (j < above)
        return np.where(ok, np.abs(ranks.value(lo, hi, np.where(ok, below + j, 0)) - m), np.where(j < 0, -np.inf, np.inf))

    # deviations rise away from the median on both sides: find how many of the half + 1 smallest lie below it
    a, b = np.maximum(0, half + 1 - above), np.minimum(half + 1, below)
    while (a < b).any():
        mid = (a + b) // 2
        enough = left(mid) >= right(half - mid)
        a, b = np.where(enough, a, np.minimum(mid + 1, b)), np.where(enough, mid, b)
    lower = np.maximum(left(a - 1), right(half - a))
    upper = np.where(count % 2 == 0, np.minimum(left(a), right(half + 1 - a)), lower)
    med[some], mad[some] = m, (lower + upper) / 2.0
    return med, mad


def hampel_pass(v: np.ndarray, k: int, sigma: float, chunk: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Median filter of outliers in windows of ``k`` either side; windows end where the array ends."""
    out, mask = v.copy(), np.zeros(len(v), dtype=bool)
    if len(v) < 3 or k < 1:
        return out, mask
    if k > WIDE:
        med, mad = wide_medians(v, k)
        with np.errstate(invalid="ignore"):
            mask = np.isfinite(v) & (np.abs(v - med) > sigma * 1.4826 * (mad + 1e-12))
        out[mask] = med[mask]
        return out, mask
    padded = np.concatenate([np.full(k, np.nan), v, np.full(k, np.nan)])
    win = np.lib.stride_tricks.sliding_window_view(padded, 2 * k + 1)
    step = max(1, chunk // (2 * k + 1))
    for a in range(0, len(v), step):
        w, x = win[a : a + step], v[a : a + step]
        med = _median_rows(w)
        mad = _median_rows(np.abs(w - med[:, None]))
        with np.errstate(invalid="ignore"):
            hit = np.isfinite(x) & (np.abs(x - med) > sigma * 1.4826 * (mad + 1e-12))
        out[a : a + step][hit] = med[hit]
        mask[a : a + step] = hit
    return out, mask


def hampel_macro_half(n, ratio: float):
    """Half width of the wide window of a trajectory of ``n`` rows."""
    return np.maximum(5, (n * ratio / 2.0).astype(int)) if isinstance(n, np.ndarray) else max(5, int(n * ratio / 2.0))


def _two_scale(v, lo, first, stop, n, ratio, s1, micro, s2):
    """Wide then narrow pass for core rows of a block, with reflected ends."""
    size = stop - first
    if n < 3:
        return v[first - lo : stop - lo], np.zeros(size, dtype=bool)
    wide = hampel_macro_half(n, ratio)
    pad = min(max(wide, micro), n - 1)
    total = n + 2 * pad
    k1, k2 = min(wide, (total - 1) // 2), min(micro, (total - 1) // 2)
    a = max(-pad, first - k1 - k2)
    b = min(n - 1 + pad, stop - 1 + k1 + k2)
    idx = np.arange(a, b + 1)
    src = np.where(idx < 0, -idx, np.where(idx > n - 1, 2 * (n - 1) - idx, idx)) - lo
    seg = v[src]
    w1, m1 = hampel_pass(seg, k1, s1)
    w2, m2 = hampel_pass(w1, k2, s2)
    c = slice(first - a, stop - a)
    return w2[c], (m1 | m2)[c]


def two_scale_hampel(ratio: float, s1: float, micro: int, s2: float):
    @F.pandas_udf(_CLEANED)
    def run(v: pd.Series, lo: pd.Series, first: pd.Series, stop: pd.Series, n: pd.Series) -> pd.DataFrame:
        res = [
            _two_scale(np.asarray(a, dtype=float), l, f, s, m, ratio, s1, micro, s2)
            for a, l, f, s, m in zip(v, lo, first, stop, n)
        ]
        clean = [[None if x != x else x for x in r[0].tolist()] for r in res]
        return pd.DataFrame({"v": clean, "m": [r[1].tolist() for r in res]})

    return run


def fit_matrix(wl: int, po: int) -> np.ndarray:
    """Projection of a window of ``wl`` values onto polynomials of order ``po``, evaluated at every position."""
    u = np.linspace(-1.0, 1.0, wl)
    q, _ = np.linalg.qr(np.vander(u, po + 1, increasing=True))
    return q @ q.T


def _poly_smooth(v, lo, first, stop, n, wl, po, cache):
    core = v[first - lo : stop - lo]
    if wl < 3 or po < 1:
        return core
    key = (wl, po)
    if key not in cache:
        cache[key] = fit_matrix(wl, po)
    h = cache[key]
    half = wl // 2
    out = np.empty(stop - first)
    mid_a, mid_b = max(first, half), min(stop, n - half)
    if mid_b > mid_a:
        seg = v[mid_a - half - lo : mid_b + half - lo]
        out[mid_a - first : mid_b - first] = np.convolve(seg, h[half][::-1], mode="valid")
    for i in range(first, min(stop, half)):
        out[i - first] = h[i] @ v[0 - lo : wl - lo]
    for i in range(max(first, n - half), stop):
        out[i - first] = h[i - (n - wl)] @ v[n - wl - lo : n - lo]
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def poly_smooth(
    v: pd.Series, lo: pd.Series, first: pd.Series, stop: pd.Series, n: pd.Series, wl: pd.Series, po: pd.Series
) -> pd.Series:
    cache: dict = {}
    return pd.Series(
        [
            _poly_smooth(np.asarray(a, dtype=float), l, f, s, m, w, p, cache)
            for a, l, f, s, m, w, p in zip(v, lo, first, stop, n, wl, po)
        ]
    )


def solve_tridiagonal(lower: np.ndarray, diag: np.ndarray, upper: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solve many diagonally dominant systems at once, one per row; each step runs over all systems."""
    n = diag.shape[1]
    c, d = np.empty_like(diag), np.empty_like(rhs)
    c[:, 0], d[:, 0] = upper[:, 0] / diag[:, 0], rhs[:, 0] / diag[:, 0]
    for i in range(1, n):
        pivot = diag[:, i] - lower[:, i] * c[:, i - 1]
        c[:, i] = upper[:, i] / pivot
        d[:, i] = (rhs[:, i] - lower[:, i] * d[:, i - 1]) / pivot
    for i in range(n - 2, -1, -1):
        d[:, i] -= c[:, i] * d[:, i + 1]
    return d


def solve_each(systems: list[tuple[np.ndarray, ...]], together: int = 256) -> list[np.ndarray]:
    """Solutions of (lower, diagonal, upper, right side) of any lengths, ``together`` systems per sweep."""
    out = []
    for at in range(0, len(systems), together):
        part = systems[at : at + together]
        width = max((len(s[1]) for s in part), default=0)
        full = [np.zeros((len(part), width)) for _ in range(4)]
        full[1][:] = 1.0
        for i, s in enumerate(part):
            for whole, x in zip(full, s):
                whole[i, : len(x)] = x
        solved = solve_tridiagonal(*full) if width else full[3]
        out.extend(solved[i, : len(s[1])] for i, s in enumerate(part))
    return out


def _spline_system(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """System of the inner second derivatives; the first two and the last two pieces are one cubic each."""
    h = np.diff(t)
    lower, diag, upper = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    diag[0] += h[0] * (1 + h[0] / h[1])
    upper[0] -= h[0] * h[0] / h[1]
    diag[-1] += h[-1] * (1 + h[-1] / h[-2])
    lower[-1] -= h[-1] * h[-1] / h[-2]
    lower[0] = upper[-1] = 0.0
    return lower, diag, upper, 6 * np.diff(np.diff(y) / h)


def spline_moments(curves: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Second derivatives at the knots of each curve (zero below four knots)."""
    inner = iter(solve_each([_spline_system(t, y) for t, y in curves if len(t) >= 4]))
    out = []
    for t, _ in curves:
        if len(t) < 4:
            out.append(np.zeros(len(t)))
            continue
        m, h = next(inner), np.diff(t)
        first = m[0] + (m[0] - m[1]) * h[0] / h[1]
        last = m[-1] + (m[-1] - m[-2]) * h[-1] / h[-2]
        out.append(np.concatenate([[first], m, [last]]))
    return out


# A spline forgets a border condition by at least a factor 2 per knot.
SPLINE_REACH = 64


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in "dcb"]))
def spline_pieces(t: pd.Series, y: pd.Series, lo: pd.Series, first: pd.Series, stop: pd.Series) -> pd.DataFrame:
    """Polynomial of the interval after each core knot (linear below four knots)."""
    out = {c: [] for c in "dcb"}
    curves = [(np.asarray(tt, dtype=float), np.asarray(yy, dtype=float)) for tt, yy in zip(t, y)]
    for (tt, yy), m, l, f, s in zip(curves, spline_moments(curves), lo, first, stop):
        h, d = np.diff(tt), np.diff(yy) / np.diff(tt)
        coef = {"d": d - h * (2 * m[:-1] + m[1:]) / 6, "c": m[:-1] / 2, "b": np.diff(m) / (6 * h)}
        for c in "dcb":
            # the last knot of a trajectory has no piece
            out[c].append(np.append(coef[c], 0.0)[f - l : s - l])
    return pd.DataFrame(out)


def nearest_reach(x: np.ndarray, core: np.ndarray, r: int) -> np.ndarray:
    """Distance of each core row of ascending ``x`` to its ``r``-th nearest row, itself included."""
    r = min(r, len(x))
    a, b = np.maximum(0, core - r + 1), np.minimum(core, len(x) - r)
    while (a < b).any():  # leftmost window of r rows whose next row on the right is no nearer than its first
        mid = (a + b) // 2
        go = (a < b) & (x[core] - x[mid] > x[np.minimum(mid + r, len(x) - 1)] - x[core])
        a, b = np.where(go, mid + 1, a), np.where(go, b, np.where(a < b, mid, b))
    return np.maximum(x[core] - x[a], x[a + r - 1] - x[core])


def local_lines(
    x: np.ndarray, y: np.ndarray, robust: np.ndarray, core: range, r: int, n: int, mean: float, chunk: int = 1 << 20
) -> np.ndarray:
    """Locally weighted line at each core row: tricube weights over the ``r`` nearest rows times ``robust``."""
    rows = np.asarray(core)
    out = np.empty(len(rows))
    h = nearest_reach(x, rows, r)
    far = np.maximum(x[rows] - x[0], x[-1] - x[rows])
    h = np.where(h > 1e-12, h, np.maximum(far, 1.0))
    lo, hi = np.searchsorted(x, x[rows] - h, "left"), np.searchsorted(x, x[rows] + h, "right")
    step = max(1, chunk // max(1, int((hi - lo).max(initial=1))))
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        span = slice(lo[part].min(), hi[part].max())
        u = x[None, span] - x[rows[part], None]
        w = (1.0 - np.clip(np.abs(u) / h[part, None], 0.0, 1.0) ** 3) ** 3 * robust[None, span]
        yy = y[span]
        s0, s1, s2 = w.sum(axis=1), (w * u).sum(axis=1), (w * u * u).sum(axis=1)
        b0, b1 = w @ yy, (w * u) @ yy
        det = s0 * s2 - s1 * s1
        with np.errstate(divide="ignore", invalid="ignore"):
            line = np.where(det > 1e-14 * s0 * s2, (s2 * b0 - s1 * b1) / det, b0 / s0)
        out[part] = np.where((w > 1e-12).sum(axis=1) < 2, mean, line)
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def lowess_pass(
    x: pd.Series, y: pd.Series, w: pd.Series, lo: pd.Series, first: pd.Series, stop: pd.Series, n: pd.Series,
    r: pd.Series, mean: pd.Series,
) -> pd.Series:
    return pd.Series(
        [
            local_lines(np.asarray(a, float), np.asarray(b, float), np.asarray(c, float), range(f - l, s - l), k, m, mu)
            for a, b, c, l, f, s, m, k, mu in zip(x, y, w, lo, first, stop, n, r, mean)
        ]
    )


# Weight 4 on trusted rows damps a border condition by more than 5 per row.
TRUST_REACH = 40


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def trusted_positions(
    v: pd.Series, move: pd.Series, steps: pd.Series, anchor: pd.Series, lo: pd.Series, first: pd.Series, stop: pd.Series
) -> pd.Series:
    """Least squares positions of trusted rows: own value (weight 2 squared), increments between them, one anchor."""
    systems = []
    for vv, mv, st, an in zip(v, move, steps, anchor):
        vv, an = np.asarray(vv, float), np.asarray(an, float)
        k = 1.0 / np.asarray(st, float)[:-1]
        pull = k * np.asarray(mv, float)[:-1]
        before, after = np.append(0.0, k), np.append(k, 0.0)
        rhs = 4.0 * vv + an * vv + np.append(0.0, pull) - np.append(pull, 0.0)
        systems.append((-before, 4.0 + an + before + after, -after, rhs))
    return pd.Series([x[f - l : s - l] for x, l, f, s in zip(solve_each(systems), lo, first, stop)])
