"""Small tables with every odd case, and plain versions of the operators' definitions."""

import hashlib
import re

import numpy as np
import xxhash

#: Extra columns whose names the operators use themselves.
CLASH = "id long, body string, digest string, salt int, fp long, host string, v string, batch int, __id long, __at double, size long, place int, __row string, carry long, fp_ long"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); the clashing columns are null."""
    n = CLASH.count(",") + 1
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
    data = [(i, t, lang, s, None if t is None else len(t), *[None] * n) for i, t, lang, s in rows]
    return spark.createDataFrame(data, schema)


LONG = "the quick brown fox jumps over the lazy dog and runs away again " * 400
ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "   \t\n", "en", "a"), (4, "word", "en", "b"), (5, "two words", "de", "b"),
    (6, LONG, "en", "a"), (7, LONG, "en", "c"), (7, LONG, "en", "c"), (8, LONG + "end", "en", None), (9, "123 !? 456", "fr", "c"),
    (10, "日本語 テスト é ü ß 😀", "de", "a"), (11, "word", "en", "b"), (None, "word", "en", "a"), (None, None, None, None),
    (12, "Ein ganz anderer Satz über Häuser und Bäume, die schön sind.", "de", "b"),
]


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    k = max(1, len(words) - 2)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i: i + 3]), 42) for i in range(k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(ids, linked):
    """Smallest id reachable from each, links given by a predicate on positions."""
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if label[j] < label[i] and linked(i, j):
                    label[i], changed = label[j], True
    return label


def repeated(docs, length=50):
    """(n_bytes, n_removed, n_spans, sha256 of what is kept) per id, from a dictionary of all strings."""
    first = {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p: p + length], i)
    out = {}
    for i, text in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p: p + length]] < i:
                gone[p: p + length] = True
        runs = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        out[i] = (len(b), int(gone.sum()), int((runs == 1).sum()), sha(bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def secrets(text):
    """Base spans by the stated patterns over characters."""
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def license_base(text):
    """(words, places) of the base phrases."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i: i + len(p.split())] == p.split()]
    return len(words), sorted(places)
