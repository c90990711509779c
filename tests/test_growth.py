"""Steps whose rows multiply: their joins, single passes and per-group work on larger tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from framelane.operators import associate as A
from framelane.operators import series as S
from framelane.session import cut


def broadcast_explodes(df):
    """Whether the plan sends an exploded table through the driver."""
    depth = None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if "BroadcastExchange" in line:
            depth = at
        elif depth is not None and "Generate" in line:
            return True
    return False


def test_dealt_rows_are_not_broadcast(spark):
    rows = cut(spark.range(200).select(F.col("id").cast("string").alias("id")))
    dealt = A.shuffled_positions(rows, "id", 50)
    assert not broadcast_explodes(dealt)
    assert dealt.count() == 200 * 50 and dealt.agg(F.max("pos0")).first()[0] == 199


def test_resampled_steps_are_not_broadcast(spark):
    lengths = {1: 1, 2: 2, 3: 120, 4: 700}
    full = spark.createDataFrame([(k, i, float(i)) for k, n in lengths.items() for i in range(n)], "video_id int, frame_index int, v double")
    out = S.resample(cut(full), ["video_id"], ["v"], 256)
    assert not broadcast_explodes(out)
    got = {(r["video_id"], r["step"]): r["value"] for r in out.collect()}
    assert got == {(k, s): float(min(round(s * ((n - 1) / 255)), n - 1)) for k, n in lengths.items() for s in range(256)}


def test_dense_frames_are_not_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(S, "cut", lambda df: (plans.append(broadcast_explodes(df)), cut(df))[1])
    rows = [(k, f, 1.0 * f, 2.0, 3.0 + f % 5, 4.0, 5.0, 6.0, 7.0) for k in range(3) for f in range(0, 40, 1 + k)]
    df = spark.createDataFrame(rows, "video_id int, frame_index int, cx double, cy double, w double, h double, area double, perimeter double, eq_diam double")
    assert S.timeline(cut(df), ["video_id"]).count() == sum(range(0, 40, 1 + k)[-1] + 1 for k in range(3))
    assert plans and not any(plans)


def digest(i, b):
    return hashlib.md5(f"{i}-{b}".encode()).hexdigest()


def test_bootstrap_draws_in_tasks(spark):
    rows = [(i, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v double")
    groups = {"low": F.when(F.col("v") < 2, F.col("v")), "high": F.when(F.col("v") > 4, F.col("v"))}
    means = A.bootstrap_means(df, "id", groups, 40)
    assert "Generate" not in means._jdf.queryExecution().executedPlan().toString()
    got = {r["draw"]: r for r in means.collect()}
    assert len(got) == 40
    for draw, r in got.items():
        w = {i: sum(int(digest(i, draw // 4)[8 * (draw % 4):][:8], 16) / 2**32 >= e for e in A.POISSON_1) for i, _ in rows}
        for name, keep in (("low", lambda v: v < 2), ("high", lambda v: v > 4)):
            mine = [(w[i], v) for i, v in rows if keep(v)]
            assert r[name] == pytest.approx(sum(a * v for a, v in mine) / sum(a for a, _ in mine))


@pytest.mark.parametrize("near", [None, 0.0, 1e-4, 2.0])
def test_first_sums_with_any_band(spark, near):
    rows = [(i, float(i * i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v double")
    want = {p: sum(v for _, v in sorted((digest(i, p), v) for i, v in rows)[:120]) for p in range(9)}
    assert {r["perm"]: r["sa"] for r in A.first_sums(df, "id", "v", 120, 9, near=near).collect()} == want


@pytest.mark.parametrize("name", ["threshold_sweep", "sweep_fold_rollup"])
def test_sweeps_tell_many_videos_apart(spark, tmp_path, name):
    """The SQL's key of threshold and video is ambiguous from 30,000 videos on; with keys apart it agrees."""
    import duckdb

    from framelane.plans import catalog

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.execute(
        """CREATE TABLE events AS SELECT event_id + k * 100000000 AS event_id, ts, (user_id + k * 30000)::BIGINT AS user_id, event_type, value, props
        FROM '/root/testdata/sf0.001/events.parquet', range(2) t(k)"""
    )
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    sql = catalog.ORACLES[name].replace("threshold * 100000 +", "threshold * 100000000000 +")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_thresholds_are_not_shuffled(spark):
    from framelane.operators import evaluate as E

    ious = {1: [0.0, 0.29, 0.5, 1.0], 2: [0.57], 3: [None], 4: [i / 100 for i in range(101)]}
    df = spark.createDataFrame([(k, x) for k, v in ious.items() for x in v], "video_id int, iou double")
    out = E.success_curve(df, ["video_id"])
    lines = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    above = lines[: next(n for n, x in enumerate(lines) if "Generate" in x)]
    assert not any("Aggregate" in x for x in above)
    got = {(r["video_id"], round(r["threshold"] * 100)): r["success_rate"] for r in out.collect()}
    assert got == {(k, i): sum(x >= i / 100 for x in v) / len(v) for k, v in ious.items() if v[0] is not None for i in range(101)}


def test_short_trajectories_need_no_block_summaries(spark):
    from framelane.operators import ordered as O
    from framelane.operators import reconstruct as R
    from framelane.operators import smooth

    def joins(df):
        return "Join" in df._jdf.queryExecution().sparkPlan().toString()

    def steps(df, key):
        v = F.col("v")
        out = O.scan(
            df, key, "frame_index", O.total("n", F.count(F.lit(1))), O.running_sum("s", v), O.running_sum("s0", v, False), O.row_position("p"),
            O.previous_known("b", v, "frame_index"), O.next_known("a", v, "frame_index"), O.first_known("f", v, "frame_index"),
        )
        return O.neighbours(out, key, "frame_index", ["v"], back=2, ahead=1)

    rows = [(k, f * k, None if (f + k) % 3 == 0 else float(f * f % 17)) for k in (1, 2, 5) for f in range(40)]
    schema = "video_id int, frame_index int, v double"
    near = spark.createDataFrame([*rows, (None, 1, 2.0), (1, None, 2.0)], schema)
    far = spark.createDataFrame([*rows, (7, 5000, 1.0)], schema)
    short, blocks = O.short_at_once(steps)(near, ["video_id"]), O.short_at_once(steps)(far, ["video_id"])
    assert not joins(short) and joins(blocks) and not O.is_short(["video_id"])
    assert sorted(map(str, short.collect())) == sorted(str(r) for r in blocks.collect() if r["video_id"] != 7)
    box = far.where(F.col("v").isNotNull())
    for fn, cols in ((lambda d: smooth.smooth_center(d, ["video_id"], cols=("v",)), ("v",)), (lambda d: R.lowess(d, ["video_id"], "v"), ("fit", "residual"))):
        a = {(r["video_id"], r["frame_index"]): r for r in fn(box.where("video_id <> 7")).collect()}
        b = {(r["video_id"], r["frame_index"]): r for r in fn(box).collect() if r["video_id"] != 7}
        assert a.keys() == b.keys() and len(a) == 81
        for at, r in a.items():
            assert [r[c] for c in cols] == pytest.approx([b[at][c] for c in cols], abs=1e-9)


def test_close_axes_need_more_squarings_than_the_sql_has(spark, tmp_path):
    """With variances 0.05 % apart the SQL stops before its axes settle; 20 squarings of the same matrix agree with the code."""
    import duckdb
    import numpy as np

    from framelane.plans import catalog
    from framelane.plans.q_models import pca_sql

    ids = np.arange(400)
    train = ids % 25 % 5 != 0
    x = np.random.default_rng(4).normal(size=(400, 64))
    x -= x[train].mean(axis=0)
    x = x @ np.linalg.inv(np.linalg.cholesky(np.cov(x[train].T))).T * np.sqrt(0.9995 ** np.minimum(np.arange(64), 1) * 0.9 ** np.maximum(np.arange(64) - 1, 0))
    turn, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(64, 64)))
    df = spark.createDataFrame([(int(i), [float(a) for a in v], int(i % 10)) for i, v in zip(ids, x @ turn)], "vec_id long, embedding array<double>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalog.QUERIES["embedding_pipeline"](spark, str(tmp_path))
    sql, base = catalog.ORACLES["embedding_pipeline"], "e AS (SELECT id, i, v FROM w WHERE subject_id % 5 <> 0)"
    longer = sql.replace(pca_sql(base, 6), pca_sql(base, 6, 20))
    assert longer != sql
    given, want = (sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({s})").fetchall()) for s in (sql, longer))
    rows = sorted(map(tuple, got.collect()))
    assert rows == want and rows != given


def test_fits_of_a_table_in_one_file_use_all_cores(spark, sf, monkeypatch):
    from framelane.operators import modelling as M
    from framelane.plans import catalog

    sizes, fit = [], M.fit

    def counted(df, *args, **more):
        sizes.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
        return fit(df, *args, **more)

    monkeypatch.setattr(M, "fit", counted)
    monkeypatch.setattr(M, "CLASSIFIERS", {k: M.CLASSIFIERS[k] for k in ("decision_tree", "logistic_regression")})
    out = catalog.QUERIES["classifier_kinds"](spark, sf)
    assert out.count() == 200 and len(sizes) == 2
    assert all(sum(s) == 400 and len(s) == spark.sparkContext.defaultParallelism and max(s) < 100 for s in sizes)


def test_spread_rows_do_not_depend_on_files(spark):
    from framelane.operators import modelling as M

    def parts(df):
        rows = M.spread(df, "id", rows_per_task=50).select("id", F.spark_partition_id().alias("at"), F.monotonically_increasing_id().alias("place"))
        return {(r["id"], r["at"], r["place"]) for r in rows.collect()}

    df = spark.range(0, 1000, 1, 1)
    one = parts(df)
    assert len(one) == 1000 and len({at for _, at, _ in one}) == 24 and one == parts(df.repartition(7)) == parts(df.orderBy(F.desc("id")))


def test_digests_of_many_strings_at_once():
    import numpy as np

    from framelane.operators.digests import Heads

    heads = [b"", b"x" * 53, b"y" * 54, b"z" * 70, "\u00e9-".encode()] + [f"{i * i}:{i % 120}-".encode() for i in range(500)]
    for ending in (b"0", b"17", b"-1", b"1234567"):
        want = np.array([np.frombuffer(hashlib.md5(h + ending).digest(), ">u4") for h in heads]).T
        given = Heads(heads)
        assert (given.digests(ending) == want[:, given.order]).all() and (given.digests(ending, leading=True) == want[:1, given.order]).all()


def test_first_sums_draw_in_tasks(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(A, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    df = spark.createDataFrame([(i, None if i % 7 == 0 else float(i)) for i in range(100)] + [(None, 5.0)], "id long, v double")
    rows = [(digest(i, p), i, p) for p in range(4) for i in range(100)] + [(hashlib.md5(b"%d" % p).hexdigest(), 5, p) for p in range(4)]
    want = {p: sum(float(i) for h, i, q in sorted(r for r in rows if r[2] == p)[:40] if i % 7) for p in range(4)}
    assert {r["perm"]: r["sa"] for r in A.first_sums(df, "id", "v", 40, 4).collect()} == want
    assert plans and not any("Generate" in p for p in plans)


@pytest.mark.parametrize("words", [1, 2, 4])
@pytest.mark.parametrize("pairs", [300, 2_000, 1 << 25])
def test_products_of_dealt_rows_in_jobs(spark, monkeypatch, pairs, words):
    """Replicates of several jobs, bands of few rows; leading numbers that two rows share are told apart by the others."""
    monkeypatch.setattr(A, "JOB_PAIRS", pairs)
    monkeypatch.setattr(A, "GROUP_PAIRS", 100)
    monkeypatch.setattr(A, "PACK", 64)
    rows = [(i, float(i * 7 % 31), float(i * i % 11), (i * 11) % 300) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double, i long")
    x = {i: v for _, v, _, i in rows}
    want = {p: sum(x[k] * y for k, (_, y) in enumerate(sorted((digest(i, p), y) for i, _, y, _ in rows))) for p in range(5)}
    assert A.dealt_products(df, "id", 300, 5, words) == want


def test_same_leading_numbers_are_told_apart():
    import numpy as np
    import pyarrow as pa

    def band(keys):
        n = len(keys)
        given = [(0, 3, np.array(keys, np.uint32).tobytes(), np.arange(1.0, n + 1).tobytes(), None, None), (0, 3, None, None, 0, None), (0, None, None, None, 0, [float(10**i) for i in range(n)])]
        names = ("band int32", "perm int32", "keys binary", "ys binary", "start int64", "xs list")
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.float64()))
        return pa.table({n.split()[0]: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*given))})

    two = A._band_products(2)(band([[5, 9], [5, 8], [4, 1]])).to_pylist()
    assert two == [{"perm": 3, "s": 3.0 + 20.0 + 100.0, "same": False}]
    assert A._band_products(2)(band([[5, 9], [5, 9], [4, 1]])).to_pylist()[0]["same"]
    four = A._band_products(4)(band([[5, 9, 1, 2], [5, 9, 1, 1], [4, 1, 0, 0]])).to_pylist()
    assert four == [{"perm": 3, "s": 3.0 + 20.0 + 100.0, "same": False}]


def test_cuts_leave_no_shuffle_files(spark):
    import gc

    from framelane import session

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    gc.collect()
    before = shuffled()
    one = cut(spark.range(20_000).groupBy((F.col("id") % 999).alias("k")).count())
    two = session.cut(one.groupBy("count").agg(F.count("*").alias("n")), spent=[one])
    assert not shuffled() - before and sum(r["n"] for r in two.collect()) == 999
    with pytest.raises(Exception, match="(?i)not.*exist"):
        one.collect()
    assert spark.conf.get(session.TIDY) == "false" and one.cut_path not in session._CUTS and two.cut_path in session._CUTS


def test_classifier_kinds_are_fitted_in_full(spark, sf, monkeypatch):
    from framelane.operators import modelling as M
    from framelane.plans import catalog

    asked, rounds = {}, M.CLASSIFIERS["boosted_trees"](labelCol="label", featuresCol="features").getMaxIter()

    def noted(kind):
        return lambda **p: (asked.update({kind: set(p)}), M.DecisionTreeClassifier(maxDepth=1, **{k: v for k, v in p.items() if k != "layers"}))[1]

    monkeypatch.setattr(M, "CLASSIFIERS", {k: noted(k) for k in M.CLASSIFIERS})
    assert catalog.QUERIES["classifier_kinds"](spark, sf).select("kind").distinct().count() == 7 and rounds == 200
    assert len(asked) == 7 and all(p <= {"labelCol", "featuresCol", "weightCol", "layers"} for p in asked.values())
    assert spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("name", ["geometry_series", "derived_series", "box_series", "lite_series"])
def test_series_of_short_trajectories_are_shuffled_once(spark, name):
    """Frames are made inside the tasks, no dense table is written or shuffled; values are those of the block-wise path."""
    frames = {1: range(0, 90, 3), 2: [7], 3: [5, 60], 4: [0, 1, 2, 30, 31], 5: range(11, 119)}
    rows = [
        (k, f, f * 1.5 + (f * f) % 7 + (200.0 if f == 33 else 0.0), 80.0 - f, 3.0 + f % 5, 4.0 + k, 5.0 if f % 4 else None, 6.0 if f % 4 else None, 7.0, f % 3 * 1.0)
        for k, fs in frames.items() for f in fs
    ]
    schema = "video_id int, frame_index int, cx double, cy double, w double, h double, area double, perimeter double, eq_diam double, gray_mean double"
    df = spark.createDataFrame(rows, schema)
    df = df if name == "lite_series" else df.drop("gray_mean")
    far = df.unionByName(df.where("video_id = 2").withColumns({"video_id": F.lit(9), "frame_index": F.lit(5000)}))
    short, blocks = (getattr(S, name)(d, ["video_id"], 64) for d in (df, far))
    assert short._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    a, b = ({(r["video_id"], r["step"], r["channel"]): r["value"] for r in d.collect() if r["video_id"] != 9} for d in (short, blocks))
    assert a.keys() == b.keys() and len(a) == 5 * 64 * len({c for _, _, c in a})
    assert [a[k] for k in sorted(a)] == pytest.approx([b[k] for k in sorted(a)], abs=1e-9)
