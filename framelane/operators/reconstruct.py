"""Curve reconstruction: cubic splines, local regression, increments plus trusted positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane.functions import geometry as G
from framelane.operators import dedup
from framelane.operators import kernels as K
from framelane.operators import local
from framelane.operators.frames import fill_edges
from framelane.operators.interpolate import BOX, at
from framelane.operators.modelling import second_moments
from framelane.operators.ordered import neighbours, next_known, previous_known, row_position, running_sum, scan, short_at_once, total
from framelane.operators.ranked import percentiles
from framelane.operators.smooth import adaptive_savgol, from_channels, to_channels
from framelane.session import cut

FRAME = "frame_index"


def cubic_pieces(knots: DataFrame, key: Sequence[str], values: Sequence[str], order: str = FRAME) -> DataFrame:
    """Attach the cubic spline piece after each knot (null at the last one); ``n_knots`` tells how many the key has.

    The spline is a global fit, but a border condition fades by at least half
    per knot, so blocks that see 64 more knots on either side are exact in double.
    """
    rows = scan(knots, key, order, row_position("_pos"), total("n_knots", F.count(F.lit(1))))
    rows = rows.withColumn("_t", F.col(order).cast("double"))
    keep = [c for c in knots.columns if c not in key]
    b = K.blocks(rows, key, "_pos", "n_knots", F.lit(K.SPLINE_REACH), ["_t", *values], keep)
    for v in values:
        b = b.withColumn(f"_s_{v}", K.spline_pieces("_t", v, "lo", "first", "stop"))
    parts = {f"_core_{c}": c for c in keep}
    for v in values:
        for c in "dcb":
            b = b.withColumn(f"_{c}_{v}", F.col(f"_s_{v}.{c}"))
            parts[f"_{c}_{v}"] = f"{v}_{c}"
    out = K.unblock(b, [*key, "n_knots"], parts)
    out = neighbours(out, key, order, [order], ahead=1)
    t1 = F.col(f"{order}_lead1").cast("double")
    coef = [c for v in values for c in (F.col(v).alias(f"{v}_y"), *[F.col(f"{v}_{k}") for k in "dcb"])]
    piece = F.struct(F.col(order).cast("double").alias("t0"), t1.alias("t1"), *coef)
    return out.select(*knots.columns, "n_knots", F.when(t1.isNotNull(), piece).alias("piece"))


def cubic_fill(rows: DataFrame, key: Sequence[str], values: Sequence[str], known: Column, order: str = FRAME, count: str | None = None) -> DataFrame:
    """Values on unknown rows by cubic spline, clipped to the range of the knots; straight lines below four knots."""
    rows = cut(rows.withColumn("_k", F.coalesce(known, F.lit(False))))
    knots = cubic_pieces(rows.where("_k"), key, values, order)
    both = knots.unionByName(rows.where(~F.col("_k")), allowMissingColumns=True)
    steps = [
        previous_known("_a", F.col("piece"), order, True),
        next_known("_b", F.col("piece"), order),
        total("knots", F.count_if("_k")),
    ]
    for v in values:
        c = F.when(F.col("_k"), F.col(v))
        steps += [total(f"_lo_{v}", F.min(c), F.min), total(f"_hi_{v}", F.max(c), F.max)]
    out = scan(cut(both), key, order, *steps)
    p = F.coalesce("_a", "_b")
    t = F.col(order).cast("double")
    # straight lines stay flat outside the knots
    inside = F.when(F.col("knots") < 4, F.least(F.greatest(t, p["t0"]), p["t1"])).otherwise(t)

    def value(v: str) -> Column:
        lo, hi = F.col(f"_lo_{v}"), F.col(f"_hi_{v}")
        est = F.least(F.greatest(at(p, v, inside), lo), hi)
        est = F.when(F.col("knots") == 0, F.lit(0.0)).when(F.col("knots") == 1, lo).otherwise(est)
        return F.when(F.col("_k"), F.col(v)).otherwise(est).alias(v)

    return out.select(*[value(c) if c in values else F.col(c) for c in rows.columns if c != "_k"], *([F.col("knots").alias(count)] if count else []))


def spline_gaps(
    preds: DataFrame, key: Sequence[str], max_gap: int = 20, score_fill: float = 0.6, clip: tuple[float, float] = (0.0, 1.0)
) -> DataFrame:
    """Box and score in gaps of at most ``max_gap`` frames by cubic spline; scores are clipped, boxes are not."""
    best = dedup.highest_score(preds, [*key, FRAME]).select(*key, FRAME, *BOX, "score")
    best = cut(best.withColumn("_s", F.coalesce("score", F.lit(score_fill))))
    scored = best.groupBy(*key).agg((F.count("score") > 0).alias("_any"))
    p = F.col("piece")
    gap = p["t1"] - p["t0"]
    new = cubic_pieces(best, key, [*BOX, "_s"]).where((gap > 1) & (gap <= max_gap))
    new = new.select(*key, "piece", F.explode(F.sequence(F.col(FRAME) + 1, p["t1"].cast("int") - 1)).alias(FRAME))
    new = new.join(scored, list(key))
    s = F.least(F.greatest(at(p, "_s", F.col(FRAME)), F.lit(clip[0])), F.lit(clip[1]))
    new = new.select(
        *key, FRAME, *[at(p, v, F.col(FRAME)).alias(v) for v in BOX], F.when(F.col("_any"), s).alias("score"),
        F.lit(True).alias("filled"),
    )
    return best.drop("_s").withColumn("filled", F.lit(False)).unionByName(new)


@short_at_once
def lowess(
    df: DataFrame, key: Sequence[str], value: str, frac: float = 0.5, iterations: int = 3, order: str = FRAME
) -> DataFrame:
    """Robust local regression: adds ``fit`` and ``residual`` (absolute) on rows with a value.

    A pass is symmetric, so it stands for the mean of a forward and a backward
    one. Up to ``local.LONG`` rows a pass works on blocks that hold the ``r`` nearest rows of
    their core, beyond on power moments (:mod:`framelane.operators.local`); the scale of the
    residuals between passes is an exact distributed median. Below four values the fit is
    the value itself.
    """
    share = max(0.05, min(0.95, frac))
    rows = df.where(G.finite(F.col(value)))
    rows = scan(
        rows, key, order, row_position("_pos"), total("_n", F.count(F.lit(1))), total("_sum", F.sum(value))
    )
    rows = rows.withColumns({"_x": F.col(order).cast("double"), "_w": F.lit(1.0), "_mean": F.col("_sum") / F.col("_n")})
    rows = cut(rows.drop("_sum"))
    keep = [c for c in rows.columns if c not in (*key, "_n")]
    longest = rows.agg(F.max("_n")).first()[0] or 0
    for step in range(max(1, iterations)):
        out = _local_fit_blocks(rows if longest <= local.LONG else rows.where(F.col("_n") <= local.LONG), key, value, share, keep)
        if longest > local.LONG:
            far = rows.where(F.col("_n") > local.LONG)
            fits = local.local_fit_long(far, key, "_x", value, "_w", share)
            out = out.unionByName(far.join(fits, [*key, "_pos"]).select(*out.columns))
        rows = cut(out.withColumn("_r", F.col(value) - F.col("fit")))
        if step + 1 == max(1, iterations):
            break
        mid = percentiles(rows, key, "_r", {"_m": 0.5})
        dev = cut(rows.join(mid, list(key)).withColumn("_d", F.abs(F.col("_r") - F.col("_m"))))
        scale = percentiles(dev, key, "_d", {"_mad": 0.5})
        u = F.col("_r") / ((F.col("_mad") * 1.4826 + 1e-6) * 6.0)
        rows = dev.join(scale, list(key)).withColumn("_w", F.when(F.abs(u) < 1, F.pow(F.lit(1.0) - u * u, 2)).otherwise(0.0))
        rows = cut(rows.drop("_m", "_d", "_mad", "_r", "fit"))
    few = F.col("_n") < 4
    return rows.select(
        *df.columns,
        F.when(few, F.col(value)).otherwise(F.col("fit")).alias("fit"),
        F.when(few, F.lit(0.0)).otherwise(F.abs("_r")).alias("residual"),
    )


def _local_fit_blocks(rows: DataFrame, key: Sequence[str], value: str, share: float, keep: Sequence[str]) -> DataFrame:
    r = F.greatest(F.lit(4), F.least(F.col("_n"), F.ceil(F.col("_n") * share)))
    b = K.blocks(rows, key, "_pos", "_n", r.cast("long"), ["_x", value, "_w"], keep)
    fit = K.lowess_pass("_x", value, "_w", "lo", "first", "stop", "_n", r.cast("int"), F.col("_core__mean")[0])
    return K.unblock(b.withColumn("_fit", fit), [*key, "_n"], {**{f"_core_{c}": c for c in keep}, "_fit": "fit"})


def anomaly_flags(
    df: DataFrame, key: Sequence[str], residuals: Sequence[str], seen: str, quantile: float = 0.8
) -> DataFrame:
    """``anomaly`` (largest residual, scaled to 1 per trajectory) and ``flagged`` (upper quantile of observed rows, or unseen)."""
    raw = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in residuals])
    rows = scan(df.withColumn("_a", raw), key, FRAME, total("_top", F.max("_a"), F.max))
    rows = cut(rows.withColumn("anomaly", F.when(F.col("_top") > 0, F.col("_a") / F.col("_top")).otherwise(F.col("_a"))))
    q = percentiles(rows.where(F.col(seen)), key, "anomaly", {"_q": quantile})
    hot = rows.where(F.col(seen)).groupBy(*key).agg(F.max("anomaly").alias("_max"))
    rows = rows.join(q, list(key), "left").join(hot, list(key), "left")
    flag = F.coalesce((F.col("_max") > 0) & (F.col("anomaly") >= F.col("_q")), F.lit(False)) & F.col(seen)
    return rows.select(*df.columns, "anomaly", (flag | ~F.col(seen)).alias("flagged"))


MOTION = ("dx_prev", "dy_prev", "vx", "vy", "ax", "ay", "heading_cos", "heading_sin", "dt_prev", "w", "h")


def regression_features(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Step features of complete trajectories (cx, cy, w, h)."""
    rows = neighbours(df, key, FRAME, [FRAME, "cx", "cy"], back=2)
    first = F.col(f"{FRAME}_lag1").isNull()

    def step(c: str, a: str, b: str) -> Column:
        return F.coalesce(F.col(a) - F.col(b), F.lit(0.0))

    dt = F.when(first, F.lit(1.0)).otherwise((F.col(FRAME) - F.col(f"{FRAME}_lag1")).cast("double"))
    dt1 = F.when(F.col(f"{FRAME}_lag2").isNull(), F.lit(1.0)).otherwise((F.col(f"{FRAME}_lag1") - F.col(f"{FRAME}_lag2")).cast("double"))
    rows = rows.withColumns(
        {
            "dx_prev": step("cx", "cx", "cx_lag1"), "dy_prev": step("cy", "cy", "cy_lag1"), "dt_prev": dt,
            "_px": step("cx", "cx_lag1", "cx_lag2"), "_py": step("cy", "cy_lag1", "cy_lag2"), "_pt": dt1,
        }
    )
    t, pt = F.greatest("dt_prev", F.lit(1.0)), F.greatest("_pt", F.lit(1.0))
    rows = rows.withColumns({"vx": F.col("dx_prev") / t, "vy": F.col("dy_prev") / t})
    head = F.atan2(F.col("vy"), F.col("vx") + 1e-12)
    acc = {f"a{c}": F.when(first, F.lit(0.0)).otherwise((F.col(f"v{c}") - F.col(f"_p{c}") / pt) / t) for c in "xy"}
    rows = rows.withColumns({**acc, "heading_cos": F.cos(head), "heading_sin": F.sin(head)})
    return rows.select(*df.columns, *[c for c in MOTION if c not in df.columns])


def from_increments(
    df: DataFrame, key: Sequence[str], value: str, move: str, trusted: str, out: str, order: str = FRAME
) -> DataFrame:
    """Least squares of increments (``move``: to this row from the one before) and trusted positions.

    Between two trusted rows the misfit spreads evenly over the steps; before
    the first and after the last, positions follow the increments. So only
    trusted rows need solving, and there the influence of a row dies out fast:
    blocks of trusted rows with 40 more on either side are exact in double.
    Without any trusted row the first value is the anchor.
    """
    ok = F.col(trusted) & G.finite(F.col(value))
    rows = df.withColumns({"_ok": F.coalesce(ok, F.lit(False)), "_mv": F.coalesce(F.col(move), F.lit(0.0))})
    any_value = F.when(G.finite(F.col(value)), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    rows = scan(
        rows, key, order,
        row_position("_p"), running_sum("_s", F.col("_mv")), total("_trusted", F.count_if("_ok")), total("_first", F.min(any_value), F.min),
    )
    rows = cut(rows)
    base = rows.where("_ok").select(*key, order, F.col(value).alias("_v"), "_p", "_s")
    base = neighbours(base, key, order, ["_p", "_s"], ahead=1)
    base = scan(base, key, order, row_position("_k"), total("_m", F.count(F.lit(1))))
    base = base.withColumns(
        {
            "_move": F.coalesce(F.col("_s_lead1") - F.col("_s"), F.lit(0.0)),
            "_steps": F.coalesce((F.col("_p_lead1") - F.col("_p")).cast("double"), F.lit(1.0)),
            "_anchor": F.when(F.col("_k") == 0, 1.0).otherwise(0.0),
        }
    )
    b = K.blocks(base, key, "_k", "_m", F.lit(K.TRUST_REACH), ["_v", "_move", "_steps", "_anchor"], [order])
    b = b.withColumn("_x", K.trusted_positions("_v", "_move", "_steps", "_anchor", "lo", "first", "stop"))
    solved = K.unblock(b, key, {f"_core_{order}": order, "_x": "_x"})
    rows = rows.join(solved, [*key, order], "left")
    knot = F.when(F.col("_ok"), F.struct(F.col("_p").alias("p"), F.col("_s").alias("s"), F.col("_x").alias("x")))
    rows = scan(
        cut(rows), key, order, previous_known("_l", knot, order, True), next_known("_r", knot, order),
        first_running("_s0", order),
    )
    l, r, s, p = F.col("_l"), F.col("_r"), F.col("_s"), F.col("_p")
    lean = (p - l["p"]) / (r["p"] - l["p"]).cast("double")
    mid = l["x"] + (s - l["s"]) + lean * (r["x"] - l["x"] - (r["s"] - l["s"]))
    est = (
        F.when(F.col("_ok"), F.col("_x"))
        .when(l.isNotNull() & r.isNotNull(), mid)
        .when(l.isNotNull(), l["x"] + s - l["s"])
        .when(r.isNotNull(), r["x"] - (r["s"] - s))
        .otherwise(F.coalesce(F.col("_first.v"), F.lit(0.0)) + s - F.col("_s0"))
    )
    return rows.select(*df.columns, est.alias(out))


def first_running(name: str, order: str):
    """Running increment at the row that anchors a trajectory without trusted rows."""
    from framelane.operators.ordered import first_known

    at_anchor = F.when(F.coalesce(F.col("_first.o") == F.col(order), F.col("_p") == 0), F.col("_s"))
    return first_known(name, at_anchor, order)


SHAPE = ("cx", "cy", "w", "h")
TARGETS = {"dx": "dx_prev", "dy": "dy_prev", "w": "w", "h": "h"}


@short_at_once
def fit_motion(df: DataFrame, key: Sequence[str]) -> dict[str, Column]:
    """Linear predictions of a row's step (dx, dy) and size (w, h) from its step features.

    Learnt on complete trajectories (cx, cy, w, h) of at least two rows, from
    second moments: one pass, a matrix of 15 x 15 on the driver.
    """
    rows = scan(df, key, FRAME, total("_n", F.count(F.lit(1)))).where("_n > 1").drop("_n")
    rows = cut(regression_features(rows, key))
    z = F.array(*[F.col(c).cast("double") for c in (*MOTION, *TARGETS.values())])
    mean, cov, _ = second_moments(rows.select(z.alias("z")), "z")
    d = len(MOTION)
    used = np.flatnonzero(np.diag(cov)[:d] > 1e-12)
    scale = np.sqrt(np.diag(cov)[used])
    out = {}
    for j, name in enumerate(TARGETS):
        fit = np.linalg.lstsq(cov[np.ix_(used, used)] / np.outer(scale, scale), cov[used, d + j] / scale, rcond=1e-10)[0] / scale
        start = F.lit(float(mean[d + j] - fit @ mean[used]))
        out[name] = sum((F.col(MOTION[i]) * float(a) for i, a in zip(used, fit)), start)
    return out


@short_at_once
def local_repair(
    df: DataFrame,
    key: Sequence[str],
    model: Mapping[str, Column],
    seen: Column,
    frac: float = 0.5,
    iterations: int = 3,
    quantile: float = 0.8,
    window: int = 5,
    polyorder: int = 2,
) -> DataFrame:
    """Repair trajectories (cx, cy, w, h) by local regression; adds ``anomaly`` and ``flagged``.

    Rows far from the local fit of any channel, and unseen or incomplete rows,
    are deleted. Their surroundings fill in, ``model`` (see :func:`fit_motion`)
    predicts their steps and sizes, steps and trusted positions are balanced by
    least squares, and all four channels are smoothed lightly.
    """
    whole = F.coalesce(seen, F.lit(False))
    for c in SHAPE:
        whole = whole & F.coalesce(G.finite(F.col(c)), F.lit(False))
    rows = cut(df.select(*key, FRAME, *SHAPE, whole.alias("_seen")))
    by = [*key, "channel"]
    fits = lowess(to_channels(rows, key, SHAPE), by, "v", frac, iterations)
    residuals = from_channels(fits.select(*by, FRAME, F.col("residual").alias("v")), key, SHAPE)
    residuals = residuals.select(*key, FRAME, *[F.col(c).alias(f"_r_{c}") for c in SHAPE])
    rows = anomaly_flags(rows.join(residuals, [*key, FRAME], "left"), key, [f"_r_{c}" for c in SHAPE], "_seen", quantile)
    rows = cut(rows.withColumns({f"_{c}": F.when(~F.col("flagged"), F.col(c)) for c in SHAPE}))
    context = rows.withColumns({c: F.col(f"_{c}") for c in SHAPE})
    context = scan(fill_edges(context, key, SHAPE), key, FRAME, total("_kept", F.count_if(~F.col("flagged"))))
    # without any trusted row the context is the unit box at the origin
    context = context.withColumns({c: F.when(F.col("_kept") > 0, F.col(c)).otherwise(0.5) for c in ("cx", "cy")})
    context = context.withColumns({c: F.greatest(F.col(c), F.lit(1.0)) for c in ("w", "h")})
    rows = cut(regression_features(cut(context), key))
    rows = scan(rows, key, FRAME, previous_known("_before", F.col("flagged"), FRAME))
    rows = rows.withColumn("_ok", ~F.col("flagged"))
    both = F.col("_ok") & ~F.coalesce("_before", F.lit(False))
    rows = rows.withColumns({f"_move_{c}": F.when(both, F.col(f"d{c}_prev")).otherwise(model[f"d{c}"]) for c in "xy"})
    rows = rows.withColumns({f"_size_{c}": F.greatest(F.coalesce(f"_{c}", model[c]), F.lit(1.0)) for c in "wh"})
    rows = cut(rows.select(*key, FRAME, "anomaly", "flagged", "_ok", "_cx", "_cy", "_move_x", "_move_y", "_size_w", "_size_h"))
    for c in "xy":
        rows = cut(from_increments(rows, key, f"_c{c}", f"_move_{c}", "_ok", f"c{c}"))
    rows = rows.select(*key, FRAME, "cx", "cy", F.col("_size_w").alias("w"), F.col("_size_h").alias("h"), "anomaly", "flagged")
    smooth = adaptive_savgol(to_channels(rows, key, SHAPE), by, ["v"], window, polyorder)
    out = from_channels(smooth, key, SHAPE).join(rows.drop(*SHAPE), [*key, FRAME])
    # boxes are never thinner than 1
    return out.withColumns({c: F.greatest(F.col(c), F.lit(1.0)) for c in ("w", "h")})
