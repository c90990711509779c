"""Secret scans: known shapes, and windows of high Shannon entropy inside candidate strings."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelane.llm.common import bounded_batches

#: The base shapes, in the order in which equal starts are listed.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

WINDOW = 20
#: Character classes: name, characters, bits of entropy that a window of WINDOW must reach.
CLASSES = (
    ("entropy_hex", b"0123456789abcdefABCDEF", 3.0),
    ("entropy_base64", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
)
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))
#: Candidates that look random but are not secret.
ALLOW = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        rb"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUID
        rb"0123456789|1234567890|9876543210",
        rb"abcdefghij|qwertyuiop|zyxwvutsrq",
        rb"example|sample|placeholder|changeme|dummy|your[_-]?(?:api[_-]?)?(?:key|token|secret)|redacted|lorem|ipsum",
        rb"^(?:sha(?:1|224|256|384|512)|md5)[-_=]",  # named digests
        rb"^https?[/:]|^www[./]|^/?(?:[a-z0-9_-]{2,}/){3,}",  # paths and addresses
        rb"^[a-z]+(?:[-_/][a-z]+)+$|^[0-9]+(?:[-_/=+][0-9]+)*$",  # words, and numbers, joined by signs
        rb"^(.{1,8})\1{2,}",  # one part over and over
    )
)
#: What the allow-list says of a candidate is looked at again where the candidate is hot: these hold for
#: one token between slashes or equals signs as a whole,
_WHOLE = tuple(
    re.compile(p)
    for p in (
        rb"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",
        rb"(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+)(?:[-_]+(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+))+[-_]*",  # words and numbers
        rb"(.{1,8})\1{2,}",
    )
)
#: these for a run as a whole, whose tokens are then judged one by one,
_PATH = re.compile(rb"(?:https?|www)/[a-z0-9_=/-]*|/{0,2}(?:[a-z0-9_-]{2,}/+){3,}[a-z0-9_=/-]*", re.IGNORECASE)
#: and these for the characters of their token that they cover, words for WINDOW more on both sides.
_SEQUENCE, _WORD = re.compile(b"|".join(p.pattern for p in ALLOW[1:3]), re.IGNORECASE), ALLOW[3]
_DIGEST = re.compile(rb"(?:(?<=[/=])|^)(sha1|sha224|sha256|sha384|sha512|md5)[-_=]", re.IGNORECASE)
_DIGEST_BYTES = {b"md5": 16, b"sha1": 20, b"sha224": 28, b"sha256": 32, b"sha384": 48, b"sha512": 64}
_TOKEN, _HEX_ONLY = re.compile(rb"[^/=]+"), re.compile(rb"[0-9a-fA-F]*")
_LOG = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 1)]
_TABLES = tuple((name, np.isin(np.arange(256), np.frombuffer(chars, np.uint8)), least) for name, chars, least in CLASSES)
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")


def runs(member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of true of at least ``least``."""
    edge = np.diff(np.concatenate([[0], member.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def hot_windows(candidate: bytes, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Unions of overlapping windows whose entropy is at least ``least`` bits.

    Entropy is log2(window) - sum(c log2 c) / window; moving on by one character changes
    two counts, so the sum is kept up to date instead of being counted anew.
    """
    counts, total, out = [0] * 256, 0.0, []
    bound = (math.log2(window) - least) * window + 1e-9
    for i, c in enumerate(candidate):
        if i >= window:  # the oldest first, so that no count exceeds the window
            old = candidate[i - window]
            n = counts[old]
            total += _LOG[n - 1] - _LOG[n]
            counts[old] = n - 1
        n = counts[c]
        total += _LOG[n + 1] - _LOG[n]
        counts[c] = n + 1
        if i >= window - 1 and total <= bound:
            start, end = i - window + 1, i + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


def allowed(candidate: bytes) -> bool:
    return any(p.search(candidate) for p in ALLOW) or not (_DIGIT.search(candidate) and _LETTER.search(candidate))


def _mixed(part: bytes) -> bool:
    return bool(_DIGIT.search(part) and _LETTER.search(part))


def unexcused(candidate: bytes, least: float) -> list[tuple[int, int]]:
    """Hot spans of an allowed candidate that are not what it is allowed for."""
    hot = hot_windows(candidate, least) if _mixed(candidate) else []
    if not hot:
        return []
    digests = []
    for m in _DIGEST.finditer(candidate):
        size = _DIGEST_BYTES[m[1].lower()]
        plain = _HEX_ONLY.match(candidate, m.end(), m.end() + 2 * size).end() - m.end()
        digests.append((m.start(), m.end() + (2 * size if plain in (2 * size, len(candidate) - m.end()) else (size + 2) // 3 * 4)))
    if not (digests or _PATH.fullmatch(candidate) or _SEQUENCE.search(candidate) or _WORD.search(candidate) or any(p.fullmatch(candidate) for p in _WHOLE)):
        return hot  # only its start looks harmless
    out = []
    for m in _TOKEN.finditer(candidate):
        s, e = m.span()
        if e - s < WINDOW or not _mixed(m[0]) or any(p.fullmatch(m[0]) for p in _WHOLE):
            continue
        covered = np.zeros(e - s, bool)
        for i, j in digests:
            covered[max(0, i - s): max(0, j - s)] = True
        for w in _SEQUENCE.finditer(m[0]):
            covered[w.start(): w.end()] = True
        for w in _WORD.finditer(m[0]):
            covered[max(0, w.start() - WINDOW): w.end() + WINDOW] = True
        for i, j in runs(~covered, WINDOW):
            if _mixed(m[0][i:j]):
                out += [(s + i + x, s + i + y) for x, y in hot_windows(m[0][i:j], least)]
    return out


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by start, then kind; kind is an index of KINDS."""
    body = (text or "").encode("utf-8", "surrogatepass")
    a, found = np.frombuffer(body, np.uint8), []
    low = body.lower()
    if any(n in low for n in _NAMES):
        found += [(0, *m.span()) for m in ASSIGN.finditer(body) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in body:
        found += [(1, *m.span()) for m in ACCESS.finditer(body) if len(m[0]) >= ACCESS_LEAST]
    wide = runs(_TABLES[-1][1][a], WINDOW)
    for s, e in wide:  # the last class holds all characters of the others
        if e - s >= HEX_LEAST:
            found += [(2, s + m.start(), s + m.end()) for m in HEX.finditer(body[s:e]) if len(m[0]) >= HEX_LEAST]
    base = sorted((s, e) for _, s, e in found)
    starts = [s for s, _ in base]
    reach = np.maximum.accumulate([e for _, e in base]).tolist() if base else []
    for k, (_, member, least) in enumerate(_TABLES, start=3):
        for s, e in wide:
            for x, y in [(s, e)] if k == 2 + len(_TABLES) else [(s + i, s + j) for i, j in runs(member[a[s:e]], WINDOW)]:
                candidate = body[x:y]
                for i, j in (unexcused if allowed(candidate) else hot_windows)(candidate, least):
                    at = bisect_right(starts, x + i)
                    if not (at and reach[at - 1] >= x + j):  # a base span holds it already
                        found.append((k, x + i, x + j))
    found.sort(key=lambda f: (f[1], f[0], f[2]))
    if found and len(body) != len(text):
        points = np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])
        found = [(k, int(points[s]), int(points[e])) for k, s, e in found]
    return found


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans array<struct<kind, start, end>> of every row, in code points, end exclusive, by start, then kind.

    Base kinds are found leftmost and without overlap per kind and always stand; entropy
    spans inside a base span, or of what the allow-list covers, are left out. Null and empty
    texts have no spans; empty tables give empty tables; repeated rows repeat their
    answer; other columns are not read.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in scan(body.as_py())] for body in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["id", "spans"])

    bounded_batches(docs.sparkSession)
    own = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("id"), F.col(text).alias("body")).mapInArrow(
        go, f"id {own}, spans array<struct<kind:string,start:long,end:long>>"
    )
    return out.withColumnRenamed("id", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, digest of their places, all places."""

    def of(*kinds: str):
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    def places(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(
        key, *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(places(of(*KINDS[:3])), 256).alias("base_sha256"), places(F.col("spans")).alias("spans"),
    )
