import itertools
import math
import random
import re

from framelane.llm import filter_audit
from tests.llm.helpers import ODD, documents

BITS = {f: 1 << k for k, f in enumerate(filter_audit.FILTERS)}


def plain_orders(masks):
    rows, shapley = [], dict.fromkeys(BITS, 0)
    for order in itertools.permutations(BITS):
        left = dict(masks)
        for step, f in enumerate(order, start=1):
            gone = [v for m, v in left.items() if m & BITS[f]]
            left = {m: v for m, v in left.items() if not m & BITS[f]}
            removed, good, toxic = (sum(v[i] for v in gone) for i in range(3))
            shapley[f] += removed
            fails = sum(v[0] for m, v in masks.items() if m & BITS[f])
            rows.append((f, "".join(order), step, sum(v[0] for v in left.values()), removed, fails - removed, masks.get(BITS[f], (0,))[0], good, toxic))
    return sorted((*r[1:], shapley[r[0]]) for r in rows)


def plain_mask(doc, docs):
    body = doc[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", body)
    fails = {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", body)) > 5 * len(body),
        "D": re.search(r"[#$%&*|]", body) is not None,
        "E": doc[0] is not None and any(d[0] is not None and d[0] < doc[0] and (d[1] or "") == body for d in docs),
    }
    return sum(BITS[f] for f, bad in fails.items() if bad)


def test_orders_equal_filtering_in_every_order():
    rng = random.Random(5)
    for share in (0.0, 0.1, 0.5, 1.0):
        for _ in range(5):
            masks = {m: (rng.randrange(9), rng.randrange(4), rng.randrange(2)) for m in range(32) if rng.random() < share}
            assert filter_audit.orders(masks) == plain_orders(masks)


def test_adjacent_swaps_meet_every_order_once():
    for n in range(1, 7):
        order = list(range(n))
        seen = {tuple(order)}
        for level in filter_audit.adjacent_swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n) == 1 + len(list(filter_audit.adjacent_swaps(n)))


def test_diagram_shares_equal_nodes_after_swaps():
    d = filter_audit.Diagram({m: (1, 0, 0) for m in range(32)})
    assert len(d.weight) == 7  # one node a level, one leaf, and the empty one
    for level in filter_audit.adjacent_swaps(5):
        d.swap(level)
        assert [len(level) for level in d.unique] == [1] * 6


def test_audit_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "BETA", "x", "y$", "z"] + [f"w{k}" for k in range(rng.choice([3, 300]))]) for _ in range(rng.choice([0, 5, 49, 50, 51, 80]))) for _ in range(40)]
    docs = [*ODD, *[(100 + i, rng.choice(texts), "en", rng.choice(["a", "", None, "z"])) for i in range(120)], (None, texts[0], "en", "a"), (130, texts[0], "en", "a"), (130, texts[0], "en", "z"), (50, texts[0], "en", "z"), (50, texts[0], "en", "z")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(90, 200)] + [(110, 1, 1), (6, 1, 0), (None, 1, 1)]
    table = spark.createDataFrame([(*x, None) for x in labels], "doc_id long, quality int, toxic int, part string")
    masks = {}
    for d in docs:
        own = [x for x in labels if d[0] is not None and x[0] == d[0]]
        mine = masks.setdefault(d[3] or "", {})
        n, good, toxic = mine.get(plain_mask(d, docs), (0, 0, 0))
        mine[plain_mask(d, docs)] = (n + 1, good + any(x[1] == 1 for x in own), toxic + any(x[2] == 1 for x in own))
    given = documents(spark, docs).repartition(5).withColumnRenamed("place", "part")
    got = filter_audit.audit(filter_audit.failure_masks(given, table))
    want = sorted((part, *r) for part, m in masks.items() for r in plain_orders(m))
    assert sorted(map(tuple, got.collect())) == want
    assert got.schema.simpleString() == f"struct<{filter_audit.STEPS.replace(', ', ',').replace(' long', ':bigint').replace(' ', ':')}>"


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failure_masks(documents(spark, []), labels)).count() == 0
    got = filter_audit.audit(filter_audit.failure_masks(documents(spark, [(1, None, None, None)]), labels)).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and {r["removed"] for r in got if r["filter_order"] == "ABCDE"} == {0, 1}
