import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, connect
from framelane.llm import language_id, mixing, queries, sentencepiece
from framelane.llm.common import row_identity
from tests.llm.helpers import ODD, documents, reachable, sha, simhash


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    state, _, rows, note = compare(spark, connect(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert state == "ok" and rows, note


def test_entry_offers_all_operators_and_the_pipeline():
    names = set(entry.queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert "pipeline" in names


def mixed(spark, rows, **more):
    return {r["doc_id"]: r for r in mixing.mix(documents(spark, rows), **more).collect()}


def test_mix_fills_limits_and_reshares(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(100)] + [(200 + i, "w " * 5, "en", "b") for i in range(4)] + [(300 + i, "w " * 7, "en", None) for i in range(50)]
    got = mixed(spark, rows)
    total = 1000 + 20 + 350
    target = {s: next(r["target"] for r in got.values() if r["source_size"] == s) for s in (1000, 20, 350)}
    assert target[20] == 60 and target[1000] == pytest.approx((total - 60) / 4) and target[350] == pytest.approx(3 * (total - 60) / 4)
    for size, t in target.items():
        assert abs(sum(r["taken"] for r in got.values() if r["source_size"] == size) - t) < 1
    assert all(r["taken"] <= 3 * r["size"] for r in got.values())
    assert {k: tuple(r) for k, r in mixed(spark, rows[::-1]).items()} == {k: tuple(r) for k, r in got.items()}


def test_mix_odd_rows(spark):
    rows = mixing.mix(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert all(r["taken"] == 0 and not r["positions"] for r in rows if r["size"] == 0)
    assert mixing.mix(documents(spark, ODD).limit(0)).collect() == []
    assert {r["taken"] for r in mixing.mix(documents(spark, [(1, None, "en", "a"), (2, "", "en", None)])).collect()} == {0}


def test_positions_invert_the_integrated_schedule(spark):
    from pyspark.sql import functions as F

    schedule = ((0.0, 2.0), (0.25, 0.0), (0.5, 0.0), (1.0, 3.0))
    shares = [i / 50 for i in range(51)]
    got = [r["t"] for r in spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.invert_demand(F.col("s"), schedule).alias("t")).orderBy("s").collect()]

    def used(t):
        out = 0.0
        for (a, x), (b, y) in zip(schedule, schedule[1:]):
            u = min(max(t, a), b) - a
            out += u * x + (y - x) / (b - a) * u * u / 2
        return out / 1.0

    assert [used(t) for t in got] == pytest.approx(shares, abs=1e-9)
    assert got == sorted(got)


def test_training_order_is_by_position_and_repeats(spark):
    docs = documents(spark, ODD)
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + len(r["positions"])
    rows = [r["doc_id"] for r in out.collect()]
    assert {i: rows.count(i) for i in copies} == copies and len(rows) == sum(copies.values())


KEYS = [  # null, shared and repeated keys; what they stand for is told by the text
    (None, "alpha beta gamma delta epsilon", "en", "a"), (5, "one two three four five six", "en", "a"), (5, "uno dos tres cuatro cinco seis", "en", "a"),
    (5, "one two three four five six", "en", "a"), (None, "eins zwei drei vier fuenf sechs", "de", "b"), (None, "alpha beta gamma delta epsilon", "en", "a"), (6, "one two three four five six", "en", "b"),
]


def test_near_copies_with_null_and_shared_keys(spark):
    docs = documents(spark, KEYS).repartition(3)
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.schema == docs.schema
    got = sorted(((r["doc_id"], r["text"].split()[0]) for r in out.collect()), key=repr)
    assert got == sorted([(None, "alpha"), (5, "one"), (5, "uno"), (None, "eins")], key=repr)
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").collect() == []


def test_source_mix_with_null_and_shared_keys(spark):
    docs = documents(spark, KEYS).repartition(3)
    out = corpus_pipeline.source_mix(spark, docs, "")
    assert out.schema == docs.schema
    want = {}
    for r in mixing.mix(docs, carry=row_identity(docs)).collect():
        name = (r["doc_id"], r["carry"]["digest"])
        want[name] = want.get(name, 0) + len(r["positions"])
    got = [(r["doc_id"], sha(r["text"])) for r in out.collect()]
    assert {k: got.count(k) for k in want} == want and len(got) == sum(want.values())
    assert corpus_pipeline.source_mix(spark, docs.limit(0), "").collect() == []


def test_stages_keep_columns_with_clashing_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id AS __row", "text AS carry", "1L AS fp", "lang AS __id").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_pipeline_equals_its_stages_one_by_one(spark, sf):
    """Brute force of all but the classifier, on whole small tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if found[r["doc_id"]]["lang_pred"] != "und" and not found[r["doc_id"]]["ambiguous"]}
    last = {}
    for i, r in rows.items():
        last[r["text"]] = max(i, last.get(r["text"], i))
    ids = sorted(last.values())
    prints = [simhash(rows[i]["text"]) for i in ids]
    label = reachable(ids, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    ids = [i for i, c in zip(ids, label) if i == c]
    kept = spark.createDataFrame([rows[i] for i in ids], docs.schema)
    want = sorted(r["doc_id"] for r in mixing.mix(kept).collect() for _ in r["positions"])
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == want
    model = sentencepiece.load()
    assert all(model.decode(r["ids"]) == rows[r["doc_id"]]["text"] for r in got)


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema == docs.schema
