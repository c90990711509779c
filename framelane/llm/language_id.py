"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelane.llm.common import bounded_batches

#: Bound of the labelled sample: about this many rows per language are fitted on, chosen by digest of the key.
ROWS_PER_LANGUAGE = 400
BITS = 14
GRAMS = (2, 3, 4)
EPOCHS = 6
RATE = 0.5
#: Up to this many languages every split of them gets a bit; beyond, a random code of CODE_LENGTH * log2(languages).
EXHAUSTIVE = 6
CODE_LENGTH = 10
#: Mean loss by which the nearest codeword must lead the next, else the answer is flagged.
AMBIGUOUS = 0.01
UNDETERMINED = "und"
_SLICE = 1 << 18
#: ASCII letters in lower case and all bytes of longer characters stand; everything else separates.
_MAP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of -1 / +1, rows far apart; no column is constant."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        columns = [(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns, np.int8).T
    rng, best, far = np.random.default_rng(42), None, -1
    for _ in range(200):
        m = rng.integers(0, 2, (n, math.ceil(CODE_LENGTH * math.log2(n)))).astype(np.int8) * 2 - 1
        gap = m.astype(np.int32) @ m.T.astype(np.int32)
        np.fill_diagonal(gap, -m.shape[1])
        near = (m.shape[1] - gap.max()) // 2
        if near > far and (np.abs(m.sum(axis=0, dtype=np.int32)) < n).all():
            best, far = m, near
    return best


def words(text: str) -> np.ndarray:
    """Bytes of the lower-cased words, each with a space before and after."""
    kept = text.lower().encode("utf-8", "surrogatepass").translate(_MAP).split()
    return np.frombuffer(b" " + b" ".join(kept) + b" ", np.uint8)


def gram_ids(a: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams of ``a``, a bounded slice at a time."""
    for lo in range(0, len(a), _SLICE):
        part = a[lo: lo + _SLICE + max(GRAMS) - 1].astype(np.uint32)
        for n in GRAMS:
            starts = min(len(part) - n + 1, _SLICE)
            if starts <= 0:
                continue
            h = np.full(starts, n, np.uint32)
            for k in range(n):
                h = (h ^ part[k: k + starts]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            yield h >> np.uint32(32 - BITS)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, shares = [], []
        for text in b.column(2):
            counts = np.zeros(1 << BITS, np.int64)
            for g in gram_ids(words(text.as_py())):
                counts += np.bincount(g, minlength=1 << BITS)
            at = np.flatnonzero(counts)
            ids.append(at.astype(np.int32))
            shares.append((counts[at] / max(1, counts.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
            names=["id", "lang", "ids", "shares"],
        )


def labelled(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(id, lang, text, letters, held_out): held out are keys whose crc32 of the decimal text is 1 modulo 3."""
    rest = F.crc32(F.col(key).cast("string").cast("binary")) % 3
    return docs.select(
        F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("body"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"), rest.alias("rest"),
        F.coalesce(rest == 1, F.lit(False)).alias("held_out"),
    )


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> dict:
    """Languages, their codewords and one n-gram classifier per bit, learned from rows that are not held out.

    The driver gets the n-gram shares of about ``rows_per_language`` rows of each
    language (at most 2 ** BITS numbers each), never a text.
    """
    rows = labelled(docs, key, text, lang).where("lang is not null and letters and rest <> 1")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(counts)
    code = codewords(len(names))
    weights, bias = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if code.shape[1]:
        share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, rows_per_language / n) * (1 << 30)))])
        chosen = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < share[F.col("lang")])
        bounded_batches(docs.sparkSession)
        sample = chosen.select("id", "lang", "body").mapInArrow(_count_batches, "id long, lang string, ids array<int>, shares array<float>")
        sample = sorted(zip(*[c.to_pylist() for c in sample.toArrow().columns]), key=lambda r: (r[0], r[1], r[2][:3]))
        place = {x: i for i, x in enumerate(names)}
        data = [(np.array(i, np.int64), np.array(s, np.float32), code[place[x]].astype(np.float32)) for _, x, i, s in sample]
        seen, seen_bias, rng = np.full_like(weights, 1e-10), np.full_like(bias, 1e-10), np.random.default_rng(42)
        for _ in range(EPOCHS):
            for r in rng.permutation(len(data)):
                at, x, y = data[r]
                z = np.clip(y * (x @ weights[at] + bias), -30, 30)
                g = -y / (1 + np.exp(z))
                step = x[:, None] * g
                seen[at] += step * step
                weights[at] -= RATE * step / np.sqrt(seen[at])
                seen_bias += g * g
                bias -= RATE * g / np.sqrt(seen_bias)
    return {"languages": names, "code": code, "weights": weights, "bias": bias}


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[int, float, float]:
    """Nearest codeword under logistic loss, its share of the likelihood, its lead in mean loss."""
    if not code.shape[1]:
        return 0, 1.0, math.inf
    loss = np.logaddexp(0, -code * margins).sum(axis=1)
    order = np.argsort(loss, kind="stable")
    share = np.exp(loss[order[0]] - loss)
    return int(order[0]), float(1 / share.sum()), float(loss[order[1]] - loss[order[0]]) / code.shape[1]


def margins(text: str, model: dict) -> np.ndarray:
    """Value of every bit's classifier: the mean weight over all n-grams of the whole text."""
    total, n = np.zeros(len(model["bias"]), np.float64), 0
    for g in gram_ids(words(text)):
        total += model["weights"].take(g, axis=0).sum(axis=0, dtype=np.float64)
        n += len(g)
    return total / max(1, n) + model["bias"]


def predict(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Language of every row: key, held_out, lang_pred, score, lead, ambiguous.

    Null texts, texts without a letter, and all texts where nothing was learned give
    ``und`` with score 0; an empty table gives an empty table. ``lang`` only feeds the
    model's fit. Repeated rows repeat their answer; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, code = model["languages"], model["code"]
        for b in batches:
            out = []
            for body, letters in zip(b.column(2), b.column(3)):
                if not names or not letters.as_py():
                    out.append((UNDETERMINED, 0.0, 0.0))
                    continue
                best, score, lead = decode(margins(body.as_py(), model), code)
                out.append((names[best], score, lead))
            pred, score, lead = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(lead, pa.float64())],
                names=["id", "held_out", "lang_pred", "score", "lead"],
            )

    bounded_batches(docs.sparkSession)
    rows = labelled(docs, key, text, lang)
    kind = docs.schema[key].dataType.simpleString()
    out = rows.select("id", "held_out", "body", "letters").mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double, lead double")
    return out.select(F.col("id").alias(key), "held_out", "lang_pred", "score", "lead", (F.col("lead") < AMBIGUOUS).alias("ambiguous"))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    return predict(docs, fit(docs, key, text, lang), key, text, lang)
