import math
import zlib

import numpy as np
import pytest

from framelane.llm import quality_rank
from tests.llm.helpers import LONG, ODD, documents

SMALL = "/root/testdata/sf0.01"


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def label_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, body string")


def test_weights_minimise_the_pair_loss():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(size=(80, 5)) + [1, 0, -1, 0, 0.2], rng.normal(size=(50, 5))
    i, j = quality_rank.preferences(good, bad, 4000)
    assert set(np.bincount(i)) == {50} and set(np.bincount(j)) == {80}
    w = quality_rank.fit_pairs(good[i] - bad[j])

    def loss(v):
        return np.mean([math.log1p(math.exp(-float(v @ (good[a] - bad[b])))) for a, b in zip(i, j)]) + quality_rank.RIDGE * (v @ v) / 2

    for step in np.concatenate([np.eye(5), -np.eye(5), rng.normal(size=(5, 5))]) * 1e-3:
        assert loss(w) < loss(w + step)


def test_cut_lies_at_the_quantile():
    bins = [(3, 4), (4, 1), (9, 5), (20, 2)]
    assert quality_rank.quantile_bin(bins, 5) == 7.0  # between bins 4 and 9
    assert quality_rank.quantile_bin(bins, 0) == 3.0
    assert quality_rank.quantile_bin(bins, 12) == 21.5
    assert quality_rank.quantile_bin(bins, 4) == 4.0


def test_features_of_odd_texts():
    assert not quality_rank.features(b"").any()
    for text in (" ", "\n\n", "a", "!", "\x00", "é", "日本語", LONG, "A" * 100_000, "a\n" * 50_000, " x"):
        got = quality_rank.features(text.encode())
        assert np.isfinite(got).all() and len(got) == len(quality_rank.FEATURES)
    counted = dict(zip(quality_rank.FEATURES, quality_rank.features(b"Ab ab x1 $$\nab ab\n")))
    assert counted["words"] == math.log1p(6) and counted["no_letter"] == 1 / 6 and counted["commonest"] == 0.5 and counted["repeat_next"] == 1 / 6
    assert counted["share_mark_24"] == math.sqrt(2 / 18) and counted["distinct_lines"] == 1.0 and counted["inner_digit"] == 1 / 6


@pytest.fixture(scope="module")
def answer(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, quality_rank.classify(docs, labels).toPandas()


def test_held_out_accuracy(answer):
    docs, labels, got = answer
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == docs.count()
    assert (got.held_out == got.doc_id.map(held_out)).all() and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    test = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert len(test) > 80 and ((test.predicted == test.quality).groupby(test.quality).mean() > 0.95).all()


def test_held_out_labels_and_other_columns_teach_nothing(spark, answer):
    docs, labels, got = answer
    from pyspark.sql import functions as F

    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    changed = labels.withColumn("quality", F.when(rest == 1, 1 - F.col("quality")).otherwise(F.col("quality"))).repartition(5)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).repartition(7)
    again = quality_rank.classify(other, changed).toPandas()
    assert sorted(zip(got.doc_id, got.score)) == sorted(zip(again.doc_id, again.score))


def test_scores_equal_a_plain_version(spark, answer):
    docs, labels, got = answer
    rows = quality_rank.measure(docs)
    model = quality_rank.fit(rows, labels)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        z = np.clip((quality_rank.features((r["text"] or "").encode()).astype(np.float32) - model["mean"]) / model["scale"], -quality_rank.REACH, quality_rank.REACH)
        want[r["doc_id"]] = 1 / (1 + math.exp(-(z @ model["weights"] - model["cut"])))
    assert np.allclose(got.score, got.doc_id.map(want), atol=1e-9)
    taught = [(r["quality"], want[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in want and not held_out(r["doc_id"])]
    below = sum(s < 0.5 for _, s in taught)
    assert abs(below - sum(q == 0 for q, _ in taught)) <= 1


def test_odd_rows(spark):
    labels = label_table(spark, [(i, i % 2, 0, None) for i in range(1, 13)] + [(6, 1, 0, None), (None, 1, 0, None), (5, None, None, None), (9, 7, 0, None)])
    docs = documents(spark, ODD)
    rows = quality_rank.classify(docs, labels).collect()
    assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((d[0] for d in ODD), key=repr)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 7}) == 1
    for none in (label_table(spark, []), label_table(spark, [(i, 1, 0, None) for i in range(1, 13)])):
        assert {(r["score"], r["predicted"]) for r in quality_rank.classify(docs, none).collect()} == {(0.5, 1)}
    assert quality_rank.classify(documents(spark, []), labels).collect() == []
