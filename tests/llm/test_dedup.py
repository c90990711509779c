import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelane.llm import components, embedding_dedup, exact_dedup, simhash, suffix_dedup
from tests.llm.helpers import LONG, ODD, documents, repeated, reachable, sha
from tests.llm.helpers import simhash as plain_simhash


def test_exact_dedup_odd_rows(spark):
    got = sorted(map(tuple, exact_dedup.duplicate_groups(documents(spark, ODD)).collect()), key=repr)
    want = []
    for i, text, *_ in ODD:
        group = [j for j, t, *_ in ODD if (t or "") == (text or "")]
        keep = max((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i is not None and i == keep, sha(text or "")))
    assert got == sorted(want, key=repr)


def test_exact_dedup_keeps_one_row_with_all_columns(spark):
    docs = documents(spark, ODD)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 7, 8, 9, 10, 11, 12]


def test_exact_dedup_keeps_one_row_of_every_text(spark):
    rows = [(1, "a"), (2, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "c"), (None, "d"), (3, "d"), (None, "e")]
    kept = exact_dedup.keep_one(documents(spark, [(i, t, "en", "a") for i, t in rows]).repartition(4))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(2, "a"), (1, "b"), (None, "c"), (3, "d"), (None, "e")], key=repr)


def test_languages_judge_rows_with_null_and_shared_keys(spark, monkeypatch):
    import corpus_pipeline
    from framelane.llm import language_id

    monkeypatch.setattr(corpus_pipeline.session, "ship", lambda spark: None)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    model = language_id.fit(docs)
    monkeypatch.setattr(language_id, "fit", lambda *_: model)
    text = docs.where("lang = 'en' and length(text) > 200").orderBy("doc_id").first()["text"]
    odd = documents(spark, [(None, text, "en", "a"), (1, text, "en", "a"), (1, "123 !?", "en", "a"), (None, None, "en", "a")])
    kept = corpus_pipeline.languages(spark, odd, "")
    assert kept.columns == odd.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(None, text), (1, text)], key=repr)


def test_exact_dedup_hot_group_over_many_partitions(spark):
    docs = documents(spark, [(i, "same text" if i % 3 else f"own {i}", "en", "a") for i in range(600)]).repartition(24)
    rows = exact_dedup.duplicate_groups(docs, salts=4).collect()
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] % 3} == {(599, 400)}
    assert all(r["keep_id"] == r["doc_id"] and r["group_size"] == 1 for r in rows if not r["doc_id"] % 3)


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "a b c", "one two three four", LONG, "É x\x0by\x00z\x1c w é"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_simhash(text)


def test_simhash_equals_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "x"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([5, 60, 400]))]
        for _ in range(rng.choice([1, 3])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    prints = [plain_simhash(t) for t in texts]
    label = reachable(list(range(len(texts))), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, label))}
    assert len(set(label)) < len(label)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 40), st.integers(0, 2**32 - 1))
def test_postings_connect_what_brute_force_connects(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    free = [int(b) for b in rng.permutation(16)]  # two free bytes, as in a posting
    prints = np.unique(np.array([int(base) ^ sum(1 << b for b in free if rng.random() < 0.3) for _ in range(n)], np.uint64))
    ids = np.arange(len(prints))
    a, b = simhash.posting_links(prints[None, :], ids[None, :]) if len(prints) > 1 else (np.zeros(0, int), np.zeros(0, int))
    want = reachable(ids.tolist(), lambda i, j: int(prints[i] ^ prints[j]).bit_count() <= 2)
    links = set(zip(a.tolist(), b.tolist()))
    assert reachable(ids.tolist(), lambda i, j: (i, j) in links or (j, i) in links) == want


def test_simhash_odd_rows(spark):
    rows = simhash.near_duplicates(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert sorted((r["doc_id"] for r in zero), key=str) == [1, 2, 3, None] and {r["component_id"] for r in zero} == {1}


def test_components_of_chain_hub_and_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 207), 200)}


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 3000)
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([30, 49, 50, 51, 70, 200]))) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "z" * 300), (5, "z" * 120), (6, "y" + "z" * 60)]
    for i in range(7, 60):
        rows.append((i, "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))) for _ in range(6))))
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.repeated_spans(docs)).collect()}
    assert got == repeated(rows)


def test_suffix_dedup_odd_rows(spark):
    rows = suffix_dedup.digest(suffix_dedup.repeated_spans(documents(spark, ODD))).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["n_removed"])
    assert by[6] == [0] and by[7] == [len(LONG)] * 2 and by[8] == [len(LONG)]
    assert by[4] == [0] and by[None] == [0, 0]


def test_multikey_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, same = suffix_dedup.multikey_order(rows)
    assert [tuple(x) for x in rows[order].tolist()] == sorted(map(tuple, rows.tolist()))
    assert same.tolist() == [False] + [bool((rows[order][i] == rows[order][i - 1]).all()) for i in range(1, 500)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, None) for i, v in rows], "vec_id long, embedding array<double>, label int, id long, v string")


def test_embedding_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + rng.normal(size=12) * rng.choice([0.05, 0.3])).tolist()) for i in range(260)]
    rows += [(300 + i, rows[3][1]) for i in range(5)] + [(400, [1e200] * 12), (401, [1e-200] * 12)]
    m = np.array([v for _, v in rows])
    m = m / np.abs(m).max(axis=1)[:, None]
    m /= np.linalg.norm(m, axis=1)[:, None]
    linked = m @ m.T >= 0.9
    ids = [i for i, _ in rows]
    label = reachable(ids, lambda i, j: linked[i, j])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert got == {i: (int(linked[k].sum()) - 1, label[k], label[k] == i) for k, i in enumerate(ids)}


def test_embedding_dedup_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]),
            (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()), key=repr)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)] + [(7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (None, 3, 7, False)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("run", [
    exact_dedup.duplicate_groups, exact_dedup.keep_one, simhash.near_duplicates, simhash.keep_one, suffix_dedup.repeated_spans,
])
def test_empty_documents(spark, run):
    assert run(documents(spark, ODD).limit(0)).collect() == []


def test_empty_vectors(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, [(1, [1.0])]).limit(0)).collect() == []


def test_embedding_chains_over_tiles_and_blocks(monkeypatch):
    """Chains whose smallest id turns up late keep one root, over tiles and over pairs of blocks."""
    monkeypatch.setattr(embedding_dedup, "TILE", 4)
    for seed in range(20):
        rng = np.random.default_rng(seed)
        n, width = 60, 12  # neighbours share 11 of 12 dimensions, the next but one 10
        m = embedding_dedup.unit(np.array([[float(i <= d < i + width) for d in range(n + width)] for i in range(n)]))
        m = m[[i for i in range(n) if i not in (20, 45)]]  # three chains
        m, ids = m[rng.permutation(len(m))], rng.permutation(1000)[: len(m)].astype(np.int64)
        blocks = np.array_split(np.arange(len(m)), 3)
        found = []
        for one in range(3):
            for two in range(one, 3):
                rows = [{"one": one, "two": two, "block": b, "ids": ids[blocks[b]].tobytes(), "copies": np.ones(len(blocks[b]), np.int64).tobytes(),
                         "vectors": m[blocks[b]].tobytes()} for b in sorted({one, two})]
                found += embedding_dedup._compare_blocks(pa.Table.from_pylist(rows)).to_pylist()
        linked = m @ m.T >= embedding_dedup.THRESHOLD
        want = reachable(ids.tolist(), lambda i, j: linked[i, j])
        place = {int(i): k for k, i in enumerate(ids)}
        joined = np.eye(len(m), dtype=bool)
        for r in found:
            joined[place[r["id"]], place[r["root"]]] = joined[place[r["root"]], place[r["id"]]] = True
        assert reachable(ids.tolist(), lambda i, j: joined[i, j]) == want


def test_embedding_pairs_go_in_rounds(spark, monkeypatch):
    """What a job of block pairs sends is bounded, whatever the pairs; its tables are merged and deleted on the way."""
    from framelane import session

    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "ROUND_BYTES", 1)
    monkeypatch.setattr(embedding_dedup, "ROUNDS", 2)
    rng = np.random.default_rng(8)
    m = rng.normal(size=(700, 5))
    m[3] = m[650] = np.abs(m[3])
    m[650][0] = m[3][0] = 0.0
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(m)]
    rows[650] = (650, [-0.0, *rows[650][1][1:]])
    sent, apply = [], embedding_dedup.session.cut
    monkeypatch.setattr(embedding_dedup.session, "cut", lambda df, **more: (sent.append(df), apply(df, **more))[1])
    before = len(session._CUTS)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    label = np.arange(len(m))
    while True:
        new = np.array([label[x].min() for x in linked])
        if (new == label).all():
            break
        label = new
    assert got == {i: (int(linked[i].sum()) - 1, int(label[i])) for i in range(len(m))}
    rounds = [d for d in sent if d.columns == ["id", "links", "root"]]
    assert len(rounds) > 3 and len(session._CUTS) - before == len(sent) - len(rounds)  # of rounds one table is left, of tiles none


def test_block_rows_bound_pairs_and_memory():
    assert embedding_dedup.block_rows(1_000, 64) == 4096 and embedding_dedup.block_rows(720_000, 64) == 16384
    assert embedding_dedup.block_rows(250_000, 64) == 7813 and embedding_dedup.block_rows(720_000, 4096) == 512


@pytest.mark.parametrize("whole", [0, 256])
def test_tiles_by_stages_and_whole(monkeypatch, whole):
    monkeypatch.setattr(embedding_dedup, "WHOLE", whole)
    rng = np.random.default_rng(9)
    a, b = embedding_dedup.unit(rng.normal(size=(90, 24))), embedding_dedup.unit(rng.normal(size=(70, 24)))
    b[:20] = embedding_dedup.unit(a[:20] + 0.05 * rng.normal(size=(20, 24)))
    x, y = embedding_dedup.compare(a, b)
    assert set(zip(x.tolist(), y.tolist())) == set(zip(*(e.tolist() for e in np.nonzero(a @ b.T >= 0.9)))) and len(x) >= 20
