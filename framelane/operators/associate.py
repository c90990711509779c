"""How strongly a score goes with an outcome: correlation, bins, contrasts, resampling."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane.functions import geometry as G
from framelane.operators.digests import Heads
from framelane.operators.ordered import row_position, running_sum, scan
from framelane.operators.ranked import average_rank, percentiles, ranked
from framelane.session import cut, tidy

FLAT = 1e-12


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation, null below three rows or without spread."""
    ok = (F.count(F.lit(1)) >= 3) & (F.stddev_pop(x) >= FLAT) & (F.stddev_pop(y) >= FLAT)
    return F.when(ok, F.corr(x, y))


def slope(x: Column, y: Column) -> Column:
    return F.when((F.count(F.lit(1)) >= 3) & (F.var_pop(x) >= FLAT), F.regr_slope(y, x))


def intercept(x: Column, y: Column) -> Column:
    return F.when((F.count(F.lit(1)) >= 3) & (F.var_pop(x) >= FLAT), F.regr_intercept(y, x))


def spearman(df: DataFrame, key: Sequence[str], x: str, y: str, name: str = "spearman") -> DataFrame:
    """Correlation of mean ranks. Equal pairs are counted first, so a value that fills the table is one row."""
    rows = df.where(G.finite(F.col(x)) & G.finite(F.col(y)))
    pairs = cut(rows.groupBy(*key, x, y).agg(F.count(F.lit(1)).alias("w")))
    out = pairs
    for v in (x, y):
        weights = pairs.groupBy(*key, v).agg(F.sum("w").alias("w"))
        r = _weighted_ranks(weights, key, v)
        out = out.join(r, [*key, v])
    a, b, w = F.col(f"_r_{x}"), F.col(f"_r_{y}"), F.col("w")
    s = out.groupBy(*key).agg(
        F.sum("w").alias("n"),
        F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"),
    )
    n = F.col("n")
    ok = (n >= 3) & (F.sqrt(F.col("aa") / n) >= FLAT) & (F.sqrt(F.col("bb") / n) >= FLAT)
    return s.select(*key, F.when(ok, F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias(name))


def _weighted_ranks(values: DataFrame, key: Sequence[str], v: str) -> DataFrame:
    """Mean rank of each distinct value, measured from the middle rank."""
    from framelane.operators.ordered import running_sum, total
    from framelane.operators.ranked import value_ranges

    t = value_ranges(cut(values), v)
    t = scan(
        t, key, v, running_sum("before", F.col("w"), inclusive=False), total("rows", F.sum("w")), block="_range"
    )
    mid = (F.col("rows").cast("double") + 1.0) / 2.0
    return t.select(*key, v, (average_rank(F.col("before"), F.col("w")) - mid).alias(f"_r_{v}"))


def correlations(df: DataFrame, key: Sequence[str], x: str, y: str) -> DataFrame:
    rows = df.where(G.finite(F.col(x)) & G.finite(F.col(y)))
    a, b = F.col(x), F.col(y)
    base = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        pearson(a, b).alias("pearson"),
        slope(a, b).alias("slope"),
        intercept(a, b).alias("intercept"),
    )
    s = spearman(rows, key, x, y)
    if key:
        return base.join(s, list(key), "left")
    rho = s.first()
    return base.withColumn("spearman", F.lit(rho["spearman"] if rho else None).cast("double"))


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Bin borders at even percentiles (bins + 1 numbers on the driver); repeated borders merge, the last opens a little."""
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    row = percentiles(df, [], value, probs).first()
    edges = sorted({row[k] for k in probs})
    if len(edges) < 2:
        return [edges[0], edges[0] + 1e-9]
    return [*edges[:-1], edges[-1] + 1e-12]


def binned(
    df: DataFrame, score: str, value: str, bins: int = 10, flags: dict[str, Column] | None = None,
    probs: dict[str, float] | None = None,
) -> DataFrame:
    """Per score bin: n, mean, median, spread, rates of ``flags`` and extra percentiles of ``value``."""
    rows = df.where(G.finite(F.col(score)) & F.col(value).isNotNull())
    edges = quantile_edges(rows, score, bins)
    arr = F.array(*[F.lit(e) for e in edges])
    b = (F.size(F.filter(arr, lambda e: e <= F.col(score))) - 1).cast("int")
    rows = cut(rows.select(score, value, b.alias("bin"), *[c.alias(n) for n, c in (flags or {}).items()]))
    rows = rows.where((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    agg = rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        *[F.avg(F.col(f).cast("double")).alias(f) for f in (flags or {})],
    )
    out = agg.join(percentiles(rows, ["bin"], value, {"median": 0.5, **(probs or {})}), "bin")
    at = F.col("bin").cast("int")
    return out.withColumns(
        {"score_lo": F.element_at(arr, at + 1), "score_hi": F.element_at(arr, at + 2)}
    )


def low_high(df: DataFrame, key: Sequence[str], score: str, values: Sequence[str], share: float = 0.2) -> DataFrame:
    """Means of ``values`` in the lowest and highest ``share`` of scores, and their difference (high minus low)."""
    rows = df.where(G.finite(F.col(score)))
    q = percentiles(rows, key, score, {"q_low": share, "q_high": 1.0 - share})
    if key:
        rows = rows.join(q, list(key))
    else:
        one = q.first()
        rows = rows.withColumns({c: F.lit(one[c]) for c in ("q_low", "q_high")})
    low, high = F.col(score) <= F.col("q_low"), F.col(score) >= F.col("q_high")
    aggs = [F.first("q_low").alias("q_low"), F.first("q_high").alias("q_high")]
    aggs += [F.count_if(low).alias("n_low"), F.count_if(high).alias("n_high")]
    for v in values:
        aggs += [F.avg(F.when(low, F.col(v))).alias(f"{v}_low"), F.avg(F.when(high, F.col(v))).alias(f"{v}_high")]
    out = rows.groupBy(*key).agg(*aggs)
    return out.withColumns({f"{v}_delta": F.col(f"{v}_high") - F.col(f"{v}_low") for v in values})


# ---- resampling ------------------------------------------------------------
#
# Draws come from md5 of (row id, replicate): the same on every run and engine,
# independent of partitioning, and repeatable after a lost executor.


# Cumulative distribution of a Poisson count with mean 1.
POISSON_1 = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]


def bootstrap_means(df: DataFrame, row_id: str, groups: dict[str, Column], draws: int) -> DataFrame:
    """Replicate means of each group column (null outside the group): ``draw`` and one mean per group.

    Poisson bootstrap: every row draws its own multiplicity, so replicates need
    no shuffle of rows; each task keeps one running sum per replicate. A digest of (row id, number)
    gives four draws; rows outside all groups draw nothing.
    """
    if draws % 4:
        raise ValueError("draws must be a multiple of 4")
    names = list(groups)
    values = [F.array(*[c.cast("double") for c in groups.values()]).alias("v")]
    head = F.coalesce(F.concat(F.col(row_id).cast("string"), F.lit("-")), F.lit(""))
    rows = df.select(head.alias("id"), *values)
    rows = rows.where(F.exists("v", lambda v: v.isNotNull()))
    sums = rows.mapInArrow(_poisson_sums(len(names), draws), "draw int, g int, w double, s double")
    return sums.groupBy("draw").agg(
        *[
            (F.sum(F.when(F.col("g") == i, F.col("s"))) / F.nullif(F.sum(F.when(F.col("g") == i, F.col("w"))), F.lit(0.0))).alias(n)
            for i, n in enumerate(names)
        ]
    )


def _poisson_sums(groups: int, draws: int):
    """Sums of weights and of weighted values of a task's rows: one row per draw and group."""
    edges = [math.ceil(e * 4294967296.0) for e in POISSON_1]  # u / 2**32 >= e, in whole numbers
    ends = [b"%d" % b for b in range(draws // 4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, s = np.zeros((groups, draws)), np.zeros((groups, draws))
        seen = False
        for batch in batches:
            flat = batch.column(1).flatten()
            v = np.array(flat.to_numpy(zero_copy_only=False), float).reshape(-1, groups)
            given = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, groups)
            for name, row, has in zip(batch.column(0).to_pylist(), v, given):
                seen, head = True, name.encode()
                u = np.frombuffer(b"".join([hashlib.md5(head + e).digest() for e in ends]), ">u4").astype(np.uint32)
                times = np.zeros(draws, np.int8)
                for e in edges:
                    times += u >= e
                for g in np.flatnonzero(has):
                    w[g] += times
                    s[g] += row[g] * times
        if seen:
            draw, g = np.tile(np.arange(draws, dtype=np.int32), groups), np.repeat(np.arange(groups, dtype=np.int32), draws)
            yield pa.RecordBatch.from_arrays([pa.array(draw), pa.array(g), pa.array(w.ravel()), pa.array(s.ravel())], ["draw", "g", "w", "s"])

    return run


def bootstrap_interval(means: DataFrame, value: Column, alpha: float = 0.05) -> DataFrame:
    """Percentile interval over the replicates (one row each, so as many as draws)."""
    return means.agg(
        F.percentile(value, F.lit(alpha / 2)).alias("ci_low"),
        F.percentile(value, F.lit(1 - alpha / 2)).alias("ci_high"),
        F.avg(value).alias("boot_mean"),
    )


def _order_key(row_id: Column, replicate: Column) -> Column:
    return F.md5(F.concat_ws("-", row_id.cast("string"), replicate.cast("string")))


def shuffled_positions(df: DataFrame, row_id: str, replicates: int, first: int = 0) -> DataFrame:
    """``perm`` (from ``first`` on) and ``pos0``: the place of each row in each random order.

    Digests are uniform, so their leading digits cut every order into even
    blocks; no replicate is sorted in one task.
    """
    rows = df.withColumn("perm", F.explode(F.sequence(F.lit(first), F.lit(first + replicates - 1))))
    rows = rows.withColumn("_h", _order_key(F.col(row_id), F.col("perm")))
    rows = rows.withColumn("_hb", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    return scan(rows, ["perm"], "_h", row_position(), block="_hb").drop("_h", "_hb")


def _dealt(rows: DataFrame, row_id: str, n: int, replicates: int, *cols: Column) -> DataFrame:
    """(head, cols) dealt evenly to all cores, in tasks of about ``TASK_PAIRS`` digests at most; head + replicate is digested."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rounds = max(1, math.ceil(n * replicates / TASK_PAIRS / cores))
    head = F.coalesce(F.concat(F.col(row_id).cast("string"), F.lit("-")), F.lit(""))
    return rows.select(head.alias("head"), *cols).repartition(cores * rounds)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Heads, list[np.ndarray]]]:
    """Heads and numbers (missing ones: 0; in the order of the digests) of ``PACK`` rows (about) at a time."""
    held: list[pa.RecordBatch] = []

    def pack() -> tuple[Heads, list[np.ndarray]]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        heads = Heads([x.encode() for x in table["head"].to_pylist()])
        return heads, [table[c].fill_null(0).to_numpy()[heads.order] for c in table.column_names[1:]]

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACK:
            yield pack()
    if sum(b.num_rows for b in held):
        yield pack()


#: Rows whose digests a task holds at once, digests of a task, (row, replicate) pairs of a job's shuffle and of one group of it.
PACK = 1 << 16
TASK_PAIRS = 1 << 28
JOB_PAIRS = 1 << 25
GROUP_PAIRS = 1 << 20


def first_sums(rows: DataFrame, row_id: str, value: str, take: int, replicates: int, near: float | None = None) -> DataFrame:
    """(perm, sa): sum of ``value`` over the first ``take`` rows of each random order.

    Digests are uniform, so the ``take``-th lies near that share of their range. One pass sums, per
    replicate, what lies below a narrow band around it and keeps the band's rows one by one (a
    number that grows with the root of the rows). A replicate whose place is not in its band is
    done again with the whole range as its band. ``near``: half the band, as a share of the range.
    """
    n = rows.count()
    share = take / n
    near = near if near is not None else 7.0 * math.sqrt(max(share * (1.0 - share), 1.0 / n) / n)
    got = cut(_band_sums(rows, row_id, value, take, n, range(replicates), share - near, share + near))
    rest = sorted(set(range(replicates)) - {r["perm"] for r in got.select("perm").collect()})
    if not rest:
        return got
    return got.unionByName(_band_sums(rows, row_id, value, take, n, rest, 0.0, 1.0))


def _band_sums(rows: DataFrame, row_id: str, value: str, take: int, n: int, perms: Sequence[int], low: float, high: float) -> DataFrame:
    deals = _dealt(rows, row_id, n, len(perms), F.col(value).cast("double").alias("v"))
    parts = deals.mapInArrow(_band_parts(list(perms), low, high), "perm int, _h binary, _hb int, n long, s double")
    parts = parts.groupBy("perm", "_h", "_hb").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # rows of one digest (of one id, that is) share alike if the place falls among them
    parts = scan(parts, ["perm"], "_h", running_sum("before", F.col("n"), inclusive=False), block="_hb")
    k = F.least(F.col("n"), F.lit(take) - F.col("before"))
    part = F.when(k == F.col("n"), F.col("s")).otherwise(F.col("s") * k / F.col("n"))
    below = F.col("_h").isNull() & (F.col("n") > take)
    reached = parts.where(F.col("before") < take).groupBy("perm").agg(F.sum(part).alias("sa"), F.sum(k).alias("m"), F.max(below).alias("over"))
    return reached.where((F.col("m") == take) & ~F.col("over")).select("perm", "sa")


def _band_parts(perms: list[int], low: float, high: float):
    """A task's rows: per replicate one sum below the band (no digest, block -1), and the band's rows (block: leading digits)."""
    first, stop = max(0, int(low * 2**32)), int(high * 2**32) if high < 1.0 else 2**32

    def batch(perm, h, hb, n, s) -> pa.RecordBatch:
        arrays = [pa.array(perm, pa.int32()), pa.array(h, pa.binary()), pa.array(hb, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, ["perm", "_h", "_hb", "n", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(perms), np.int64), np.zeros(len(perms))
        for heads, (v,) in _packs(batches):
            near: list[tuple] = []
            for j, perm in enumerate(perms):
                h = heads.digests(b"%d" % perm, leading=True)[0]
                below = h < first
                count[j] += np.count_nonzero(below)
                sums[j] += v[below].sum()
                at = np.flatnonzero(~below & (h < stop))
                near.append((np.full(len(at), perm), h[at] >> 20, v[at], [hashlib.md5(heads.heads[k] + b"%d" % perm).digest() for k in at]))
                if j == len(perms) - 1 or sum(len(x[0]) for x in near) >= PACK:
                    perm_, hb_, v_ = (np.concatenate(x) for x in list(zip(*near))[:3])
                    yield batch(perm_, [d for x in near for d in x[3]], hb_, np.ones(len(v_), np.int64), v_)
                    near = []
        seen = np.flatnonzero(count)
        yield batch(np.array(perms)[seen], [None] * len(seen), np.full(len(seen), -1), count[seen], sums[seen])

    return run


def permutation_p_mean_diff(df: DataFrame, row_id: str, value: str, in_a: Column, replicates: int) -> DataFrame:
    """Two-sided p of mean(A) - mean(B) when membership is shuffled: (hits + 1) / (replicates + 1)."""
    rows = cut(df.select(row_id, F.col(value).alias("v"), in_a.alias("a")))
    obs = rows.agg(
        F.count_if("a").alias("na"),
        F.count(F.lit(1)).alias("n"),
        F.sum("v").alias("s"),
        (F.avg(F.when(F.col("a"), F.col("v"))) - F.avg(F.when(~F.col("a"), F.col("v")))).alias("d"),
    ).first()
    na, n = obs["na"], obs["n"]
    if na < 2 or n - na < 2:
        return rows.sparkSession.range(1).select(
            F.lit(None).cast("double").alias("observed"), F.lit(None).cast("double").alias("p_value")
        )
    part = first_sums(rows.select(row_id, "v"), row_id, "v", na, replicates)
    d = F.col("sa") / na - (F.lit(obs["s"]) - F.col("sa")) / (n - na)
    hits = part.agg(F.count_if(F.abs(d) >= abs(obs["d"])).alias("c"))
    return hits.select(
        F.lit(obs["d"]).alias("observed"), ((F.col("c") + 1) / F.lit(float(replicates + 1))).alias("p_value")
    )


def permutation_p_corr(df: DataFrame, row_id: str, x: str, y: str, replicates: int) -> DataFrame:
    """Two-sided p of the correlation when y is dealt out anew: row i meets the y at place i of the random order.

    Means and spreads stay as they are, so a replicate is one sum of products. Orders that come out equal to the observed
    one count, whatever the last bits of their sums are.
    """
    rows = df.where(G.finite(F.col(x)) & G.finite(F.col(y))).select(row_id, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.withColumn("_one", F.lit(0))
    block = F.conv(F.substring(_order_key(F.col(row_id), F.lit(-1)), 1, 3), 16, 10).cast("int")
    rows = rows.withColumns({"_ib": block, "_ih": _order_key(F.col(row_id), F.lit(-1))})
    rows = cut(scan(rows, ["_one"], "_ih", row_position("i"), block="_ib").select(row_id, "x", "y", "i"))
    obs = rows.agg(
        pearson(F.col("x"), F.col("y")).alias("r"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        (F.stddev_pop("x") * F.stddev_pop("y")).alias("spread"),
    ).first()
    if obs["r"] is None:
        return rows.sparkSession.range(1).select(
            F.lit(None).cast("double").alias("observed"), F.lit(None).cast("double").alias("p_value")
        )
    products = dealt_products(rows.select(row_id, (F.col("x") - obs["mx"]).alias("x"), (F.col("y") - obs["my"]).alias("y"), "i"), row_id, obs["n"], replicates)
    least = abs(obs["r"]) * (1.0 - 1e-12)
    hits = sum(abs(s / obs["n"] / obs["spread"]) >= least for s in products.values())
    return rows.sparkSession.range(1).select(F.lit(obs["r"]).alias("observed"), F.lit((hits + 1) / float(replicates + 1)).alias("p_value"))


def dealt_products(rows: DataFrame, row_id: str, n: int, replicates: int, words: int = 2) -> dict[int, float]:
    """Per replicate (one number each on the driver): sum of x at place i times the y that comes i-th in the random order.

    ``rows``: id, x, y and the place ``i`` (0 .. n - 1) of x. Replicates go in jobs of about ``JOB_PAIRS`` pairs, whose
    shuffle is deleted with their end, so that disk does not grow with the replicates. Digests are uniform: their leading
    numbers cut an order into even bands. A first pass counts them, so a band knows its places and meets the x of
    these. Digests are told apart by ``words`` of their four numbers; replicates where two share these are done again with all.
    """
    each = max(1, min(replicates, JOB_PAIRS // max(1, n)))
    bands = max(1, math.ceil(n * each / GROUP_PAIRS))
    heads = cut(_dealt(rows, row_id, n, replicates, F.col("y")))
    counts = heads.mapInArrow(_band_counts(replicates, bands), "perm int, band int, n long").groupBy("perm", "band").agg(F.sum("n").alias("n"))
    starts = cut(scan(counts.withColumn("_b", F.lit(0)), ["perm"], "band", running_sum("start", F.col("n"), inclusive=False), block="_b").drop("_b"))
    places = F.struct("i", "x")
    xs = cut(
        rows.groupBy(F.floor(F.col("i") / PACK).alias("k")).agg(F.array_sort(F.collect_list(places)).alias("c"))
        .select("k", (F.col("k") * PACK).alias("start"), F.transform("c", lambda e: e["x"]).alias("xs"))
    )
    got: dict[int, float] = {}

    def job(perms: Sequence[int], words: int) -> list[int]:
        here = starts.where(F.col("perm").isin(list(perms)))
        k = F.sequence(F.floor(F.min("start") / PACK), F.floor((F.max(F.col("start") + F.col("n")) - 1) / PACK))
        wanted = here.groupBy("band").agg(k.alias("k")).select("band", F.explode("k").alias("k")).join(xs.hint("merge"), "k")
        sent = heads.mapInArrow(_band_rows(list(perms), bands, words), "band int, perm int, keys binary, ys binary")
        both = sent.unionByName(here.select("band", "perm", "start"), allowMissingColumns=True)
        both = both.unionByName(wanted.select("band", "start", "xs"), allowMissingColumns=True)
        sums = both.groupBy("band").applyInArrow(_band_products(words), "perm int, s double, same boolean")
        with tidy(rows.sparkSession):
            done = sums.groupBy("perm").agg(F.sum("s").alias("s"), F.max("same").alias("same")).collect()
        got.update({r["perm"]: r["s"] for r in done})
        return [r["perm"] for r in done if r["same"]]

    again = [p for lo in range(0, replicates, each) for p in job(range(lo, min(replicates, lo + each)), words)]
    for lo in range(0, len(again), max(1, each // 2)):
        job(again[lo: lo + max(1, each // 2)], 4)
    return got


def _band_of(leading: np.ndarray, bands: int) -> np.ndarray:
    return (leading.astype(np.uint64) * np.uint64(bands)) >> np.uint64(32)


def _band_counts(replicates: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((replicates, bands), np.int64)
        for heads, _ in _packs(batches):
            for perm in range(replicates):
                count[perm] += np.bincount(_band_of(heads.digests(b"%d" % perm, leading=True)[0], bands).astype(np.int64), minlength=bands)
        perm, band = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(perm.astype(np.int32)), pa.array(band.astype(np.int32)), pa.array(count[perm, band])], ["perm", "band", "n"])

    return run


def _band_rows(perms: list[int], bands: int, words: int):
    """Rows of each (replicate, band) in packs: leading numbers of the digests, and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for heads, (y,) in _packs(batches):
            for perm in perms:
                h = heads.digests(b"%d" % perm)
                band = _band_of(h[0], bands)
                order = np.argsort(band, kind="stable")
                mine, at = np.unique(band[order], return_index=True)
                ends = [*at[1:], len(order)]
                keys, ys = np.ascontiguousarray(h[:words, order].T), y[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mine.astype(np.int32)), pa.array(np.full(len(mine), perm, np.int32)),
                        pa.array([keys[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
                        pa.array([ys[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
                    ],
                    ["band", "perm", "keys", "ys"],
                )

    return run


def _band_products(words: int):
    """One band of some replicates beside the x of its places: per replicate the sum of products, and whether digests were the same."""

    def run(rows: pa.Table) -> pa.Table:
        packs, starts, xs = {}, {}, []
        for band, perm, keys, ys, start, x in zip(*(rows[c] for c in ("band", "perm", "keys", "ys", "start", "xs"))):
            if keys.is_valid:
                packs.setdefault(perm.as_py(), []).append((np.frombuffer(keys.as_buffer(), np.uint32).reshape(-1, words), np.frombuffer(ys.as_buffer())))
            elif perm.is_valid:
                starts[perm.as_py()] = start.as_py()
            else:
                xs.append((start.as_py(), x.values.to_numpy()))
        xs.sort(key=lambda p: p[0])
        base, x = xs[0][0], np.concatenate([p[1] for p in xs])
        out = []
        for perm, parts in packs.items():
            keys, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((y, *keys.T[::-1]))
            keys, at = keys[order], starts[perm] - base
            same = words < 4 and bool((keys[1:] == keys[:-1]).all(axis=1).any())
            out.append((perm, float(x[at: at + len(y)] @ y[order]), same))
        return pa.table({"perm": pa.array([o[0] for o in out], pa.int32()), "s": [o[1] for o in out], "same": [o[2] for o in out]})

    return run


def experiment_table(df: DataFrame, key: Sequence[str], score: str = "score") -> DataFrame:
    """One row per experiment: volumes, means, correlations with IoU and centre error, low / high contrast."""
    s = F.col(score)
    ok = G.finite(s)
    base = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(ok).alias("n_scored"),
        F.avg(F.when(ok, F.col("iou"))).alias("iou_mean"),
        F.avg(F.when(ok, F.col("ce"))).alias("ce_mean"),
    )
    scored = df.where(ok)
    corr = scored.groupBy(*key).agg(
        pearson(s, F.col("iou")).alias("pearson_iou"), pearson(s, F.col("ce")).alias("pearson_ce")
    )
    out = base.join(corr, list(key), "left")
    for v in ("iou", "ce"):
        out = out.join(spearman(scored, key, score, v, f"spearman_{v}"), list(key), "left")
    lh = low_high(scored, key, score, ["iou", "ce"])
    lh = lh.select(
        *key,
        F.col("iou_delta").alias("delta_iou_high_minus_low"),
        (-F.col("ce_delta")).alias("delta_ce_low_minus_high"),
    )
    enough = F.col("n_scored") >= 3
    out = out.join(lh, list(key), "left")
    return out.withColumns({c: F.when(enough, F.col(c)) for c in ("delta_iou_high_minus_low", "delta_ce_low_minus_high")})


def skipped_experiments(predictions: DataFrame, matched: DataFrame, key: Sequence[str]) -> DataFrame:
    """Experiments with predictions but not one matched annotation, and how many predictions they have."""
    counts = predictions.groupBy(*key).agg(F.count(F.lit(1)).alias("n_predictions"))
    return counts.join(matched.select(*key).distinct(), list(key), "left_anti")


def relation_distribution(table: DataFrame) -> DataFrame:
    """Quartiles of the per-experiment correlations and the share that supports the hypothesis."""
    a, b = F.col("pearson_iou"), F.col("pearson_ce")
    table = cut(table)
    counts = table.agg(F.count(a).alias("n"), F.count_if((a > 0) & (b < 0)).alias("support")).first()
    out = table.sparkSession.range(1).select(
        F.lit(counts["n"]).cast("long").alias("n_experiments"),
        F.lit(counts["support"]).cast("long").alias("n_support"),
        F.lit(counts["support"] / counts["n"] if counts["n"] else None).cast("double").alias("support_ratio"),
    )
    quart = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    for v in ("pearson_iou", "pearson_ce"):
        row = percentiles(table, [], v, {f"{v}_{k}": p for k, p in quart.items()}).first()
        out = out.withColumns(
            {f"{v}_{k}": F.lit(row[f"{v}_{k}"] if row else None).cast("double") for k in quart}
        )
    return out
