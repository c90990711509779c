import math
import random
import re
from collections import Counter

import numpy as np

from framelane.llm import lexical_rank
from tests.llm.helpers import ODD, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in plain_terms(text) if t in c
            )
            if score > 0:
                rows.append((-score, d is None, d if d is not None else 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(rows)[:k], start=1)]
    return sorted(out, key=repr)


def corpus(rng, n, words=400):
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(words)]
    heavy = [1 / (i + 1) for i in range(words)]
    sizes = [rng.choice([0, 1, 5, 40, 200]) for _ in range(n)]
    return [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, heavy, k=size))) for i, size in enumerate(sizes)]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def run(spark, docs, items, **more):
    table = documents(spark, [(i, t, "en", "a") for i, t in docs]).repartition(5)
    got = lexical_rank.search(table, items_of(spark, items), **more)
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
    return sorted(map(tuple, got.collect()), key=repr)


def test_search_equals_scoring_everything(spark):
    rng = random.Random(16)
    docs = corpus(rng, 300)
    docs += [(1000 + i, docs[3][1]) for i in range(40)]  # more equal scores than ranks
    docs += [(None, docs[3][1]), (1001, docs[3][1]), (2000, "w9 " * 70_000), (2001, "w9 " * 300 + "w8 " * 254 + "w7 " * 255)]
    items = [(i, " ".join(rng.choices(docs, k=1)[0][1].split()[:30])) for i in range(25)]
    items += [(50, "W9 w9 w8 w7"), (51, docs[3][1]), (51, docs[3][1]), (52, "!?"), (53, None), (54, "nowhere"), (None, "w8")]
    assert run(spark, docs, items) == plain_search(docs, items, 20)


def test_search_in_blocks_and_other_k(spark):
    rng = random.Random(8)
    docs = corpus(rng, 120)
    items = [(i, " ".join(rng.choices(docs, k=1)[0][1].split()[:20])) for i in range(12)]
    assert run(spark, docs, items, k=3, item_bytes=300) == plain_search(docs, items, 3)


def test_search_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lexical_rank, "BROADCAST_BYTES", -1)
    rng = random.Random(9)
    docs = corpus(rng, 100) + [(None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2")]
    items = [(i, " ".join(rng.choices(docs, k=1)[0][1].split()[:20])) for i in range(5)] + [(9, "w1 w2")]
    assert run(spark, docs, items) == plain_search(docs, items, 20)


def test_odd_documents(spark):
    docs = [(d[0], d[1]) for d in ODD]
    items = [(1, "The quick fox"), (2, "word two"), (3, "日本語 Häuser"), (4, "123")]
    assert run(spark, docs, items) == plain_search(docs, items, 20)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, None), (2, "?!")], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []


def test_bounds_never_fall_below_scores():
    rng = random.Random(4)
    docs = [Counter(lexical_rank.terms(t.encode())) for _, t in corpus(rng, 150, words=3000)]
    docs = [c for c in docs if c] + [Counter({b"w1": 300, b"w2": 255, b"w3": 254})]
    queries = lexical_rank.Queries([" ".join(f"w{rng.randrange(60)}" for _ in range(12)) for _ in range(30)] + ["w1 w1 w2 w3"])
    df = Counter(t for c in docs for t in c)
    queries.weigh(len(docs), sum(c.total() for c in docs), {i: df[t] for t, i in queries.vocabulary.items()})
    folded = [tuple(x.tobytes() for x in lexical_rank.fold(c)) for c in docs]
    bounds = queries.bounds(folded, np.array([c.total() for c in docs], np.int64))
    exact = np.array([queries.scores(c) for c in docs])
    assert (bounds >= exact).all() and (bounds == exact).mean() > 0.9


def test_fold_keeps_the_largest_count_of_a_coordinate(monkeypatch):
    monkeypatch.setattr(lexical_rank, "WIDTH", 8)
    counts = {f"t{i}".encode(): i + 1 for i in range(300)}
    at, tf = lexical_rank.fold(counts)
    want = {}
    for t, n in counts.items():
        c = lexical_rank.coordinate(t)
        want[c] = max(want.get(c, 0), min(n, lexical_rank.MANY))
    assert dict(zip(at.tolist(), tf.tolist())) == want
