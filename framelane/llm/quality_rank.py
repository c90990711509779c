"""Quality classifier: document scores from preference pairs (Bradley-Terry), cut at a quantile of the scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane import session
from framelane.llm.common import bounded_batches

#: Bound of the labelled sample: about this many rows of each label are paired, chosen by digest of the key.
ROWS_PER_LABEL = 3000
#: Preference pairs (a row of label 1 before a row of label 0) drawn from the sample.
PAIRS = 60_000
RIDGE = 1e-3
STEPS = 30
#: Standardised features are cut here, so that one odd text does not rule a pair.
REACH = 5.0
#: The quantile is read from counts of scores in so many bins, which cover all labelled rows.
BINS = 100_000

_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Byte classes: lower, upper, digit, space, line feed, other control, each ASCII mark, bytes of longer characters.
CLASSES = ("lower", "upper", "digit", "space", "line", "control", *(f"mark_{c:02x}" for c in _MARKS), "wide")
WORDS = (
    "words", "word_length", "word_spread", "long_words", "no_letter", "all_upper", "first_upper", "inner_digit", "end_mark",
    "distinct", "commonest", "repeat_next",
)
LINES = ("lines", "line_words", "line_spread", "short_lines", "distinct_lines", "full_stops", "no_end", "same_byte")
FEATURES = (*(f"share_{c}" for c in CLASSES), *WORDS, *LINES)


def _class_of() -> np.ndarray:
    out = np.full(256, 5)
    for c in range(256):
        if c >= 128:
            out[c] = len(CLASSES) - 1
        elif chr(c).islower():
            out[c] = 0
        elif chr(c).isupper():
            out[c] = 1
        elif chr(c).isdigit():
            out[c] = 2
        elif c == 10:
            out[c] = 4
        elif chr(c).isspace():
            out[c] = 3
        elif c in _MARKS:
            out[c] = 6 + _MARKS.index(c)
    return out


_CLASS = _class_of()
_END = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def features(body: bytes) -> np.ndarray:
    """FEATURES of a whole text; the empty text has zeros only."""
    out = np.zeros(len(FEATURES))
    if not body:
        return out
    a = np.frombuffer(body, np.uint8)
    kind = _CLASS[a]
    out[: len(CLASSES)] = np.sqrt(np.bincount(kind, minlength=len(CLASSES)) / len(a))
    gap = (kind == 3) | (kind == 4)
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(starts)
    words = body.split()
    if n:
        size = ends - starts

        def held(member: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(member)])
            return sums[ends] - sums[starts]

        upper, digit = held(kind == 1), held(kind == 2)
        letters = held((kind == 0) | (kind == 1) | (kind == len(CLASSES) - 1))
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        out[len(CLASSES): len(CLASSES) + len(WORDS)] = (
            math.log1p(n), math.log1p(size.mean()), math.log1p(size.std()), (size > 12).mean(), (letters == 0).mean(),
            ((upper == letters) & (letters > 1)).mean(), (kind[starts] == 1).mean(), ((digit > 0) & (letters > 0)).mean(), _END[a[ends - 1]].mean(),
            math.log(len(counts)) / math.log(n) if n > 1 else 1.0, max(counts.values()) / n,
            sum(x == y for x, y in zip(words, words[1:])) / n,
        )
    lines = [x for x in body.split(b"\n") if x.strip()]
    if lines:
        sizes = np.array([x.count(b" ") + 1 for x in lines])
        out[len(CLASSES) + len(WORDS):] = (
            math.log1p(len(lines)), math.log1p(sizes.mean()), math.log1p(sizes.std()), (sizes <= 3).mean(), len(set(lines)) / len(lines),
            math.log1p(n / (1 + np.count_nonzero(_STOP[a]))), np.mean([not _STOP[x.rstrip()[-1]] for x in lines]), (a[1:] == a[:-1]).mean() if len(a) > 1 else 0.0,
        )
    return out


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rest, and one float column per feature) of every row, from its text alone."""
    own = docs.schema[key].dataType.simpleString()
    names = [f"f{i}" for i in range(len(FEATURES))]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(body.as_py()) for body in b.column(2)], np.float32).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c) for c in np.ascontiguousarray(x.T)]], names=["id", "rest", *names])

    bounded_batches(docs.sparkSession)
    rest = (F.crc32(F.col(key).cast("string").cast("binary")) % 3).cast("int")
    rows = docs.select(F.col(key).alias("id"), rest.alias("rest"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(go, f"id {own}, rest int, " + ", ".join(f"{n} float" for n in names))


def preferences(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``good`` and of ``bad`` to pair, every row about equally often, by a fixed seed."""
    rng = np.random.default_rng(42)

    def dealt(n: int) -> np.ndarray:
        return np.concatenate([rng.permutation(n) for _ in range(-(-pairs // n))])[:pairs]

    return dealt(len(good)), dealt(len(bad))


def fit_pairs(difference: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights w that minimise the mean of log(1 + exp(-w d)) over the pairs' feature differences, plus ridge |w|^2 / 2, by Newton steps."""

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(difference @ w)).mean() + ridge * (w @ w) / 2)

    w = np.zeros(difference.shape[1])
    now = loss(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -500, 500)))  # of the worse one winning
        slope = ridge * w - difference.T @ p / len(difference)
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / len(difference) + ridge * np.eye(len(w))
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-12:
            break
    return w


def fit(
    rows: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", rows_per_label: int = ROWS_PER_LABEL, pairs: int = PAIRS
) -> dict:
    """Mean, scale and weight of every feature, and the score at which documents are cut.

    Learned from labelled rows that are not held out. The driver gets the features of
    about ``rows_per_label`` rows of each label, never a text. The cut is the quantile of the
    scores of all these rows, not of a sample, below which lies the share of label 0; it is
    read from counts in BINS bins. Keys with contradicting labels, and null keys, teach nothing.
    Where a label has no rows all weights are 0, so every score is one half.
    """
    own = labels.select(F.col(key).alias("id"), F.col(quality).alias("label")).where("id is not null and label in (0, 1)")
    own = own.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    taught = session.cut(rows.where("rest <> 1").join(own, "id"))
    counts = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    names = [f"f{i}" for i in range(len(FEATURES))]
    model = {"mean": np.zeros(len(names)), "scale": np.ones(len(names)), "weights": np.zeros(len(names)), "cut": 0.0}
    if len(counts) < 2:
        return model
    share = F.when(F.col("label") == 1, F.lit(int(min(1.0, rows_per_label / counts[1]) * (1 << 30)))).otherwise(F.lit(int(min(1.0, rows_per_label / counts[0]) * (1 << 30))))
    chosen = taught.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < share).select("id", "label", *names).toArrow()
    x = np.array([chosen.column(n).to_numpy() for n in names], np.float64).T
    y = chosen.column("label").to_numpy()
    order = np.lexsort((*x.T, y))  # rows in an order of their own, whatever order they came in
    x, y = x[order], y[order]
    if not (0 < y.sum() < len(y)):
        return model
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = np.inf  # a constant feature tells nothing
    z = np.clip((x - mean) / scale, -REACH, REACH)
    good, bad = z[y == 1], z[y == 0]
    i, j = preferences(good, bad, pairs)
    model |= {"mean": mean, "scale": scale, "weights": fit_pairs(good[i] - bad[j])}
    low, high = (z @ model["weights"]).min() - 1.0, (z @ model["weights"]).max() + 1.0
    at = F.least(F.greatest(F.floor((strength(model) - F.lit(low)) / F.lit((high - low) / BINS)), F.lit(0)), F.lit(BINS - 1)).alias("bin")
    bins = sorted((r["bin"], r["count"]) for r in taught.select(at).groupBy("bin").count().collect())  # at most BINS rows
    model["cut"] = low + quantile_bin(bins, counts[0]) * (high - low) / BINS
    return model


def quantile_bin(bins: list[tuple[int, int]], below: int) -> float:
    """Where to cut so that as near to ``below`` rows as possible lie lower: the middle between two bins that hold rows."""
    edges = [(abs(below - 0), 0, float(bins[0][0]))]
    seen = 0
    for (at, n), (after, _) in zip(bins, [*bins[1:], (bins[-1][0] + 2, 0)]):
        seen += n
        edges.append((abs(below - seen), seen, (at + 1 + after) / 2))
    return min(edges)[2]


def strength(model: dict) -> Column:
    """Bradley-Terry score of a row of :func:`measure`."""
    total = F.lit(0.0)
    for k, (mean, scale, weight) in enumerate(zip(model["mean"], model["scale"], model["weights"])):
        if weight and math.isfinite(scale):
            z = (F.col(f"f{k}").cast("double") - F.lit(float(mean))) / F.lit(float(scale))
            total = total + F.least(F.greatest(z, F.lit(-REACH)), F.lit(REACH)) * F.lit(float(weight))
    return total


def score(rows: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted: the score is the chance to win against a document at the cut."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(strength(model) - F.lit(float(model["cut"])))))
    out = rows.select(F.col("id").alias(key), F.coalesce(F.col("rest") == 1, F.lit(False)).alias("held_out"), p.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Quality of every row by its whole text: key, held_out (crc32 of the key is 1 modulo 3), score, predicted.

    Null and empty texts are scored by features that are all zero; an empty table gives
    an empty table; repeated rows repeat their answer; rows with a null key are scored,
    not learned from, and not held out. Other columns are not read.
    """
    rows = session.cut(measure(docs, key, text))
    return score(rows, fit(rows, labels, key), key)
