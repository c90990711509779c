"""License scans: ordered signature rules behind a keyword filter, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelane.llm.common import bounded_batches, word_spans
from framelane.llm.license_rules import rules

_WORD = np.array([c >= 128 or chr(c).isascii() and (chr(c).isdigit() or chr(c).islower()) for c in range(256)])


@lru_cache(maxsize=1)
def _compiled():
    every = rules()
    gate: dict[str, set[int]] = {}
    for k, rule in enumerate(every):
        for word in rule.gates:
            gate.setdefault(word, set()).add(k)
    machine = ahocorasick.Automaton()
    for word, ks in gate.items():
        machine.add_word(word, tuple(sorted(ks)))
    machine.make_automaton()
    return every, machine, [re.compile(f" (?:{r.pattern})(?= )") for r in every]


def unsuppressed(finds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Finds (start, end, rule) that stand: inside none of higher priority, nor inside a longer or earlier one of the same.

    Containment is transitive and priorities compare, so it is enough to know, for each
    priority, how far the finds that start no later reach: one sweep over sorted finds.
    """
    every, _, _ = _compiled()
    levels = sorted({every[k].priority for _, _, k in finds}, reverse=True)
    reach, out = dict.fromkeys(levels, -1), []
    ordered = sorted(finds, key=lambda f: (f[0], -f[1], -every[f[2]].priority, f[2]))
    for start, end, k in ordered:
        p = every[k].priority
        if every[k].base or all(reach[q] < end for q in levels if q >= p):
            out.append((start, end, k))
        reach[p] = max(reach[p], end)
    return out


def scan(text: str | None) -> tuple[int, list[tuple[int, int, int]]]:
    """(words of the text, standing finds (first word, end word, rule))."""
    joined, starts, _ = word_spans((text or "").encode("utf-8", "surrogatepass").lower(), _WORD)
    if not len(starts):
        return 0, []
    every, machine, patterns = _compiled()
    norm = " " + joined.decode("utf-8", "surrogatepass").strip(" ") + " "
    open_rules = set()
    for _, ks in machine.iter(norm):
        open_rules.update(ks)
    finds = []
    for k in sorted(open_rules):
        at, word = 0, -1
        for m in patterns[k].finditer(norm):
            word += norm.count(" ", at, m.start() + 1)
            at = m.start() + 1
            finds.append((word, word + norm.count(" ", m.start() + 1, m.end()) + 1, k))
    return len(starts), unsuppressed(finds)


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, finds array<struct<label, first_word, end_word, priority, base>> in text order, for every row.

    A-Z are lower-cased; words are runs of digits, letters and everything beyond ASCII,
    counted from 0; a find covers the words from first_word to before end_word. Base
    phrases always stand, every place of them. Null and empty texts have no words; empty
    tables give empty tables; repeated rows repeat their answer; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = _compiled()[0]
        for b in batches:
            n, found = [], []
            for body in b.column(1):
                words, finds = scan(body.as_py())
                n.append(words)
                found.append([
                    {"label": every[k].label, "first_word": s, "end_word": e, "priority": every[k].priority, "base": every[k].base}
                    for s, e, k in finds
                ])
            kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("priority", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, kind)], names=["id", "n_words", "finds"])

    bounded_batches(docs.sparkSession)
    own = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("id"), F.col(text).alias("body")).mapInArrow(
        run, f"id {own}, n_words long, finds array<struct<label:string,first_word:long,end_word:long,priority:int,base:boolean>>"
    )
    return out.withColumnRenamed("id", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: counts, extent and labels of the base phrases, all labels, a score.

    ``score`` is the highest priority among the finds, as a share of the highest there is.
    """
    base = F.filter("finds", lambda x: x["base"])

    def names(finds):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(finds, lambda x: x["label"]))), ",")

    top = max(r.priority for r in rules())
    return found.select(
        key, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first_word"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("finds")).alias("labels"),
        F.coalesce(F.array_max(F.transform("finds", lambda x: x["priority"])) / F.lit(float(top)), F.lit(0.0)).alias("score"),
    )
