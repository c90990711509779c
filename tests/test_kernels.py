"""Kernels against brute force, and splines cut into blocks against one dense solve."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelane.operators import kernels as K
from framelane.operators import local, reconstruct, smooth, wide


def _middle(w):
    s = np.sort(w)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 200), st.integers(1, 90), st.sampled_from([2, 9, 5000]), st.sampled_from([0.0, 0.4, 0.95]))
def test_wide_medians_equal_sorted_windows(seed, n, k, kinds, holes):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, kinds, n) * 0.37
    v[rng.random(n) < holes] = np.nan
    med, mad = K.wide_medians(v, k)
    for i in range(n):
        w = v[max(0, i - k) : i + k + 1]
        w = w[~np.isnan(w)]
        if not len(w):
            assert np.isnan(med[i]) and np.isnan(mad[i])
            continue
        assert med[i] == _middle(w)
        assert mad[i] == _middle(np.abs(w - med[i]))


def test_wide_and_narrow_windows_agree(monkeypatch):
    v = np.random.default_rng(5).normal(size=700)
    v[::31] += 40
    v[::17] = np.nan
    wide = K.hampel_pass(v, 60, 3.0)
    monkeypatch.setattr(K, "WIDE", 1000)
    narrow = K.hampel_pass(v, 60, 3.0)
    assert np.array_equal(wide[0], narrow[0], equal_nan=True) and np.array_equal(wide[1], narrow[1])


def _dense_moments(t, y):
    h, bend, n = np.diff(t), np.diff(np.diff(y) / np.diff(t)), len(t)
    a, rhs = np.zeros((n, n)), np.append(np.append(0.0, 6 * bend), 0.0)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
    a[0, :3] = h[1], -h[0] - h[1], h[0]
    a[-1, -3:] = h[-1], -h[-2] - h[-1], h[-2]
    return np.linalg.solve(a, rhs)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.integers(1, 70), min_size=1, max_size=6))
def test_spline_moments_equal_a_dense_solve(seed, sizes):
    rng = np.random.default_rng(seed)
    curves = [(np.cumsum(rng.choice([1.0, 3.0, 900.0], n)), rng.normal(size=n)) for n in sizes]
    for (t, y), m in zip(curves, K.spline_moments(curves)):
        want = _dense_moments(t, y) if len(t) >= 4 else np.zeros(len(t))
        assert np.allclose(m, want, rtol=1e-9, atol=1e-9 * np.abs(want).max(initial=1.0))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 120), st.integers(4, 120))
def test_local_lines_equal_row_by_row(seed, n, r):
    rng = np.random.default_rng(seed)
    x, y = np.cumsum(rng.choice([1.0, 2.0, 50.0], n)), rng.normal(size=n)
    robust = rng.random(n) * (rng.random(n) < 0.7)
    got = K.local_lines(x, y, robust, range(n), r, n, 0.5, chunk=300)
    for i in range(n):
        u = x - x[i]
        h = np.sort(np.abs(u))[min(r, n) - 1] or 1.0
        w = (1 - np.minimum(np.abs(u) / h, 1) ** 3) ** 3 * robust
        if (w > 1e-12).sum() < 2:
            want = 0.5
        else:
            root = np.sqrt(w)
            want = np.linalg.lstsq(np.stack([root, root * u], 1), root * y, rcond=None)[0][0]
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_uneven_spline_over_several_blocks(spark):
    rng = np.random.default_rng(8)
    t = np.cumsum(rng.choice([1, 2, 5000], 3500))
    y = rng.normal(size=len(t))
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(t, y)], "video_id long, frame_index int, v double")
    got = reconstruct.cubic_pieces(df, ["video_id"], ["v"]).orderBy("frame_index").toPandas()
    want = _dense_moments(t.astype(float), y)
    c = np.array([2 * p["v_c"] for p in got["piece"][:-1]])
    assert np.allclose(c, want[:-1], rtol=1e-8, atol=1e-12)


def test_wide_windows_by_ranges_equal_the_block_kernel():
    rng = np.random.default_rng(3)
    for trial in range(12):
        n, side = int(rng.integers(300, 1500)), int(rng.choice([16, 64]))
        v = [np.cumsum(rng.normal(size=n)), rng.normal(size=n), rng.integers(0, 5, n) * 1.0, np.where(rng.random(n) < 0.5, 0.0, 100.0) + rng.normal(size=n) * (rng.random(n) < 0.3)][trial % 4]
        v[rng.random(n) < 0.02] += 50
        if trial % 3 == 0:
            v[rng.random(n) < 0.3] = np.nan
        want, flags = K._two_scale(v, 0, 0, n, n, 0.15, 3.0, 7, 3.0)
        arrays = {e: v[e * side : (e + 1) * side] for e in range(-(-n // side))}
        distinct, times = np.unique(v[~np.isnan(v)], return_counts=True)
        number = (np.cumsum(times) - times) // side * 2 + (times >= side)
        low, high = (np.array([f(distinct[number == r]) for r in np.unique(number)]) for f in (np.min, np.max))
        for b in arrays:
            g = wide.Geometry(n, b, 0.15, 7, side)
            shared = np.concatenate([v[s * side : e * side] for s, e in g.whole] or [np.zeros(0)])
            shared = shared[~np.isnan(shared)]
            of = np.searchsorted(low, shared, side="right") - 1
            counts = np.bincount(of, minlength=len(low))
            need = wide.needed_ranges(wide._Block(g, arrays), low, high, counts)
            counts[need] = 0
            got, hit = wide._filtered(g, arrays, low, counts, shared[np.isin(of, need)], 3.0, 7, 3.0)
            assert np.array_equal(got, want[g.first : g.stop], equal_nan=True) and np.array_equal(hit, flags[g.first : g.stop])


def test_long_trajectories_take_the_ranged_way_with_equal_values(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for vid, n in ((1, 40_000), (2, 5_000), (3, 700)):
        v = np.sin(np.arange(n) / 900) * 40 + rng.normal(size=n).round(1)
        v[rng.random(n) < 0.01] += 60
        v[rng.random(n) < 0.05] = np.nan
        for c, x in (("a", v), ("b", rng.integers(0, 4, n) * 1.0)):
            want[vid, c] = K._two_scale(x, 0, 0, n, n, 0.15, 3.0, 7, 3.0)
        rows.append(pd.DataFrame({"vid": vid, "frame_index": np.arange(n) * 3, "a": v, "b": want[vid, "b"][0] * 0 + x}))
    df = spark.createDataFrame(pd.concat(rows)).selectExpr("vid", "frame_index", "CASE WHEN NOT isnan(a) THEN a END AS a", "b")
    monkeypatch.setattr(smooth.wide, "LONG", 3_000)
    got = smooth.two_scale_hampel(df, ["vid"], ["a", "b"]).toPandas().sort_values(["vid", "frame_index"])
    assert len(got) == 45_700
    for (vid, c), (clean, flag) in want.items():
        part = got[got.vid == vid]
        assert np.array_equal(part[f"{c}_clean"].to_numpy(float), clean, equal_nan=True)
        assert np.array_equal(part[f"{c}_outlier"].to_numpy(bool), flag)


def test_moments_equal_weighting_every_row():
    rng = np.random.default_rng(1)
    for trial in range(12):
        n, size, frac = int(rng.integers(200, 1500)), int(rng.choice([16, 32, 100])), float(rng.choice([0.1, 0.5, 0.95]))
        x = [np.arange(n), np.sort(rng.choice(n * 5, n, replace=False)), np.cumsum(np.where(rng.random(n) < 0.01, rng.integers(1000, 100000, n), 1))][trial % 3] * 1.0
        y = np.sin(x / 300) * 50 + rng.normal(size=n)
        w = np.where(rng.random(n) < 0.1, 0, rng.random(n)) if trial % 2 else np.ones(n)
        r = max(4, min(n, int(np.ceil(n * frac))))
        cuts = [slice(e * size, min(n, (e + 1) * size)) for e in range(-(-n // size))]
        c, s, sums = (np.array(q) for q in zip(*[local.block_moments(x[q], y[q], w[q]) for q in cuts]))
        first, last = (np.array([x[q][i] for q in cuts]) for i in (0, -1))
        got = []
        for b, q in enumerate(cuts):
            a0, a1, read, wl, wr = local.view(b, n, r, size, first, last)
            index = np.concatenate([np.arange(n)[cuts[e]] for e in read])
            sides = [(c[i:j], s[i:j], sums[i:j]) for i, j in (wl, wr)]
            got.append(local.lines(np.arange(n)[q], index, x[index], y[index], w[index], (a0, a1), r, n, y.mean(), *sides))
        assert np.allclose(np.concatenate(got), K.local_lines(x, y, w, range(n), r, n, y.mean()), atol=1e-6)


def test_local_regression_of_one_long_trajectory(spark):
    """300,000 rows of one trajectory against plain weighting of every row, at some of them."""
    rng = np.random.default_rng(6)
    n = 300_000
    x = np.sort(rng.choice(2 * n, n, replace=False))
    y = np.sin(x / 40_000) * 50 + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"vid": 1, "frame_index": x, "v": y}))
    got = reconstruct.lowess(df, ["vid"], "v", iterations=1).toPandas().sort_values("frame_index")
    at = np.unique(np.concatenate([[0, 1, n - 1], rng.integers(0, n, 20)]))
    want = [K.local_lines(x * 1.0, y, np.ones(n), range(i, i + 1), n // 2, n, y.mean())[0] for i in at.tolist()]
    assert np.allclose(got.fit.to_numpy()[at], want, atol=1e-6)
    assert np.allclose(got.residual.to_numpy(), np.abs(got.v - got.fit))


def test_robust_local_regression_takes_both_ways_with_equal_values(spark, monkeypatch):
    rng = np.random.default_rng(8)
    parts = []
    for vid, n in ((1, 6_000), (2, 90)):
        v = np.cos(np.arange(n) / 200) * 30 + rng.normal(size=n)
        v[rng.random(n) < 0.03] += 40
        parts.append(pd.DataFrame({"vid": vid, "frame_index": np.arange(n) * 2, "v": v}))
    df = spark.createDataFrame(pd.concat(parts))
    want = reconstruct.lowess(df, ["vid"], "v").toPandas().sort_values(["vid", "frame_index"])
    monkeypatch.setattr(reconstruct.local, "LONG", 1_000)
    got = reconstruct.lowess(df, ["vid"], "v").toPandas().sort_values(["vid", "frame_index"])
    assert len(got) == 6_090 and np.allclose(got.fit, want.fit, atol=1e-7)
