"""SentencePiece encoding (unigram Viterbi over a double-array trie) and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelane.llm.common import bounded_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model format: piece kinds, and what an unknown character costs below the worst piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Words a worker remembers; when full it starts anew.
MEMORY = 400_000
#: Chunks of like length are solved together from this number on, one by one below.
TOGETHER = 24
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LEADS = np.array([1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4 for c in range(256)])


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) over bytes: state s goes by byte c to base[s] + c + 1 if check there is s.

    Nodes with many children are placed first, each size going on where the last one
    of its size was placed; nodes with one child then fill the holes.
    """
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for word, value in keys.items():
        node = 0
        for c in word:
            to = children[node].get(c)
            if to is None:
                to = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = to
        ends[node] = value
    taken = bytearray(len(children) * 2 + 1024)
    taken[0] = 1
    base, place = [0] * len(children), [0] * len(children)
    at, width = 0, 0
    for node in sorted(range(len(children)), key=lambda n: (-len(children[n]), n)):
        codes = list(children[node])
        if not codes:
            break
        if len(codes) != width:
            at, width = 0, len(codes)
        first = min(codes) + 1
        while True:
            at = taken.find(0, at + first) - first  # the first child must meet a free cell
            if at < 0 or at + 258 > len(taken):
                taken += bytes(len(taken))
                at = max(at, 0)
                continue
            if not any(taken[at + c + 1] for c in codes):
                break
            at += 1
        base[node] = at
        for c in codes:
            taken[at + c + 1] = 1
            place[children[node][c]] = at + c + 1
    size = max(place) + 258
    out_base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    for node, kids in enumerate(children):
        out_base[place[node]], value[place[node]] = base[node], ends[node]
        for to in kids.values():
            check[place[to]] = place[node]
    return out_base, check, value


class Model:
    """Pieces, scores and trie; plain arrays, so it is sent to the workers as it is.

    A worker remembers the pieces of the words it has met, at most MEMORY of them: a
    word's number, and for each number where its piece ids stand in one array.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], dummy_prefix: bool = True):
        self.dummy_prefix = dummy_prefix
        self.scores = np.array([s for _, s, _ in pieces], np.float64)
        own = [p for p, _, k in pieces if k in (NORMAL, USER_DEFINED)]
        known = {p.encode(): i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED)}
        if not known:
            raise ValueError("the model has no pieces")
        self.longest = max(map(len, known))
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        found = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.bytes = np.array([found[c] for c in range(256)] if len(found) == 256 else [self.unknown] * 256, np.int32)
        self.has_bytes = len(found) == 256
        self.unknown_score = min(s for _, s, k in pieces if k in (NORMAL, USER_DEFINED)) - UNKNOWN_PENALTY
        self.by_word = not any(MARK in p.lstrip(MARK) for p in own)
        self.by_line = not any("\n" in p for p in own)
        surface = [
            b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN
            else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode()
            for p, _, k in pieces
        ]
        self.surface, self.widths = np.frombuffer(b"".join(surface), np.uint8), np.array([len(x) for x in surface])
        self.base, self.check, self.value = double_array(known)
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __getstate__(self) -> dict:
        kept = ("words", "at", "size", "flat")
        return {k: v for k, v in self.__dict__.items() if k not in kept}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def solve(self, chunk: bytes) -> list[int]:
        """Piece ids of the best path of one chunk; of equal scores the one with the longest last piece."""
        n, base, check, value, scores = len(chunk), self.base, self.check, self.value, self.scores
        best, back, piece = [None] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for t in range(n):
            here = best[t]
            if here is None:
                continue
            char, state, single = int(_LEADS[chunk[t]]), 0, False
            for d in range(t, min(n, t + self.longest)):
                to = base[state] + chunk[d] + 1
                if check[to] != state:
                    break
                state, v = to, value[to]
                if v >= 0:
                    single |= d + 1 - t == char
                    new = here + float(scores[v])
                    if best[d + 1] is None or new > best[d + 1]:
                        best[d + 1], back[d + 1], piece[d + 1] = new, t, int(v)
            if not single:
                end, new = min(n, t + char), here + self.unknown_score
                if best[end] is None or new > best[end]:
                    best[end], back[end], piece[end] = new, t, -1
        return self._path(chunk, back, piece)

    def _path(self, chunk: bytes, back, piece) -> list[int]:
        out, end = [], len(chunk)
        while end:
            start = int(back[end])
            if piece[end] >= 0:
                out.append(int(piece[end]))
            else:
                out += [int(self.bytes[c]) for c in chunk[start:end]][::-1] if self.has_bytes else [self.unknown]
            end = start
        return out[::-1]

    def solve_together(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for many chunks at once, longest first, a column of bytes at a time: (ids, ids per chunk)."""
        lengths = np.array([len(c) for c in chunks])
        width, n = int(lengths[0]), len(chunks)
        text = np.full((width + 1, n), 0xFF, np.int64)
        text[:width].T[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(chunks), np.uint8)
        best = np.full((width + 5, n), -np.inf)
        back, piece = np.zeros((width + 5, n), np.int32), np.zeros((width + 5, n), np.int32)
        best[0] = 0
        for t in range(width):
            longer = int(np.searchsorted(-lengths, -t))
            rows = np.flatnonzero(best[t, :longer] > -np.inf)
            first, char, single = best[t], _LEADS[text[t]], np.zeros(n, bool)
            at, state = rows, np.zeros(len(rows), np.int64)
            for d in range(t, min(width, t + self.longest)):
                to = self.base[state] + text[d, at] + 1
                good = np.flatnonzero(self.check[to] == state)
                if not len(good):
                    break
                at, state = at[good], to[good]
                v = self.value[state]
                hit = np.flatnonzero(v >= 0)
                who, v = at[hit], v[hit]
                if d - t < 4:
                    single[who] |= char[who] == d + 1 - t
                new = first[who] + self.scores[v]
                better = np.flatnonzero(new > best[d + 1, who])
                who = who[better]
                best[d + 1, who], back[d + 1, who], piece[d + 1, who] = new[better], t, v[better]
            lone = rows[~single[rows]]
            end, new = np.minimum(lengths[lone], t + char[lone]), first[lone] + self.unknown_score
            better = np.flatnonzero(new > best[end, lone])
            lone, end = lone[better], end[better]
            best[end, lone], back[end, lone] = new[better], t
            piece[end, lone] = np.where(end - t == 1, self.bytes[text[t, lone]], -1)
        steps, at, rows = [], lengths.copy(), np.arange(n)
        while len(rows):
            steps.append((rows, piece[at[rows], rows]))
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        who, ids = np.concatenate([r for r, _ in steps][::-1]), np.concatenate([p for _, p in steps][::-1])
        order = np.argsort(who, kind="stable")
        who, ids = who[order], ids[order]
        sizes = np.bincount(who, minlength=n)
        if (ids < 0).any():
            odd = {int(r): self._path(chunks[r], back[:, r], piece[:, r]) for r in np.unique(who[ids < 0])}
            split = np.split(ids, np.cumsum(sizes)[:-1])
            split = [np.array(odd[r], np.int32) if r in odd else x for r, x in enumerate(split)]
            ids, sizes = np.concatenate(split), np.array([len(x) for x in split])
        return ids.astype(np.int32), sizes

    def _chunk(self, word: str) -> bytes:
        """Bytes of a remembered word that has no mark before it: after a line's end, or spelled out."""
        return word.encode() if word[:1] == "\n" else word[1:].encode()

    def learn(self, new: set[str]) -> None:
        """Solve words not yet remembered."""
        words = list(new)
        chunks = [(MARK + w).encode() if w[:1] not in ("\n", "\0") else self._chunk(w) for w in words]
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(-lengths, kind="stable")
        lengths, order = lengths[order], order.tolist()
        ids, sizes, lo = [], [], 0
        while lo < len(order):
            hi = min(lo + 8192, int(np.searchsorted(-lengths, -int(lengths[lo] * 0.75), side="right")), len(order))
            group = [chunks[i] for i in order[lo:hi]]
            if len(group) >= TOGETHER:
                x, k = self.solve_together(group)
            else:
                x = [self.solve(c) for c in group]
                k = [len(p) for p in x]
                x = np.fromiter(chain.from_iterable(x), np.int32, sum(k))
            ids.append(x)
            sizes.append(np.asarray(k, np.int64))
            lo = hi
        start = len(self.size)
        self.words.update(zip([words[i] for i in order], range(start, start + len(order))))
        self.flat, self.size = np.concatenate([self.flat, *ids]), np.concatenate([self.size, *sizes])
        self.at = np.cumsum(self.size) - self.size

    def split(self, text: str) -> list[str]:
        """Words of a text, as they are remembered; no piece crosses from one to the next.

        A word stands for the mark and itself; one that starts with a line's end has no mark
        before it; one spelled out with its marks (runs of white space) follows a zero.
        """
        if not text:
            return []
        plain = self.by_word and self.by_line and self.dummy_prefix
        if plain and text[0] != " " and "  " not in text and " \n" not in text and MARK not in text and "\0" not in text:
            return text.replace("\n", " \n").split(" ")
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return ["\0" + x for x in (_RUN.findall(marked) if self.by_word else [marked])]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after the other, and how many each text has."""
        parts = [self.split(t) for t in texts]
        every = list(chain.from_iterable(parts))
        known = self.words
        numbers = [known.get(w, -1) for w in every]
        if -1 in numbers:
            new = {w for w, k in zip(every, numbers) if k < 0}
            if len(known) + len(new) > MEMORY:
                self._forget()
                new = set(every)
            self.learn(new)
            numbers = list(map(self.words.__getitem__, every))
        numbers = np.array(numbers, np.int64)
        sizes = self.size[numbers]
        ids = self.flat[_ranges(self.at[numbers], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)]
        return ids, np.diff(ends)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: the pieces' bytes, marks as spaces, without the space put before the first word."""
        widths = self.widths[ids]
        starts = np.cumsum(self.widths) - self.widths
        raw = self.surface[_ranges(starts[ids], widths)].tobytes()
        bounds = np.concatenate([[0], np.cumsum(widths)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].tolist()
        texts = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        return [x[1:] if x[:1] == b" " else x for x in texts] if self.dummy_prefix else texts

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Model:
    """Read a model file on the driver; only identity normalisation is understood."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("the model normalises its input; only identity normalisation is supported")
    return Model([(p.piece, p.score, p.type) for p in m.pieces], m.normalizer_spec.add_dummy_prefix)


def encode(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, n_pieces, n_fallback, round_trip for every row.

    ``ids`` are the pieces of the best path over the whole text; characters without a
    piece become byte pieces. ``round_trip`` says that decoding gives the text back
    (false where the text itself holds the white-space mark). Null and empty texts
    give no pieces. An empty table gives an empty table; repeated rows repeat their
    answer; other columns are not read.
    """
    low = np.zeros(len(model.scores), bool)
    low[model.bytes] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids, sizes = model.encode_all(texts)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            sums = np.concatenate([[0], np.cumsum(low[ids])])
            same = [x == t.encode() for x, t in zip(model.decode_all(ids, sizes), texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(sizes.astype(np.int64)),
                    pa.array(np.diff(sums[offsets])), pa.array(same, pa.bool_()),
                ],
                names=["id", "ids", "n_pieces", "n_fallback", "round_trip"],
            )

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("id"), F.col(text).alias("body")).mapInArrow(
        run, f"id {kind}, ids array<int>, n_pieces long, n_fallback long, round_trip boolean"
    )
    return out.withColumnRenamed("id", key)


def decode(encoded: DataFrame, model: Model, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from piece ids; null ids give the empty text, invalid byte runs the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [x or [] for x in b.column(1).to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            raw = model.decode_all(np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes)
            texts = [x.decode("utf-8", "replace") for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    bounded_batches(encoded.sparkSession)
    kind = encoded.schema[key].dataType.simpleString()
    out = encoded.select(F.col(key).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", key)
