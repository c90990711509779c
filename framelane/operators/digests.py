"""MD5 of many short strings at once: numpy columns instead of one call per string."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

#: Strings of a pass: the columns of a pass stay in a core's cache.
CHUNK = 16384
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFT = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in four]
_PLACE = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ONE_BLOCK = 55


_LEFT, _RIGHT = ([np.array(x, np.uint32) for x in row] for row in (_SHIFT, [32 - s for s in _SHIFT]))


def _one_block(words: list, n: int, leading: bool) -> list[np.ndarray]:
    """The four numbers of each digest, or the leading one; ``words``: sixteen of a 64-byte block, a column where strings differ."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61 if leading else 64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(b, f, out=f)
            np.bitwise_xor(d, f, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(d, f, out=f)
            np.bitwise_xor(c, f, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(d, f, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(b, f, out=f)
            np.bitwise_xor(c, f, out=f)
        word = words[_PLACE[i]]
        np.add(a, f, out=a)
        if isinstance(word, int):
            np.add(a, np.array((_K[i] + word) & 0xFFFFFFFF, np.uint32), out=a)
        else:
            np.add(a, word, out=a)
            np.add(a, np.array(_K[i], np.uint32), out=a)
        np.left_shift(a, _LEFT[i], out=t)
        np.right_shift(a, _RIGHT[i], out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    out = [b] if leading else [a, b, c, d]  # three steps later b is a
    for x, s in zip(out, _START):
        np.add(x, np.uint32(s), out=x)
    return out


class Heads:
    """Strings whose digests are asked for with one ending after the other; ``order``: their places, as digests come by length."""

    def __init__(self, heads: Sequence[bytes]):
        sizes = np.fromiter(map(len, heads), np.int64, len(heads))
        self.order = np.argsort(sizes, kind="stable")
        self.parts: list[tuple[slice, int, list[bytes], np.ndarray]] = []
        self.heads = [heads[k] for k in self.order]
        ends = [*(np.flatnonzero(np.diff(sizes[self.order])) + 1).tolist(), len(heads)]
        for start, stop in zip([0, *ends], ends):
            for lo in range(start, stop, CHUNK):
                own = self.heads[lo: min(lo + CHUNK, stop)]
                raw = np.frombuffer(b"".join(x[:64].ljust(64, b"\0") for x in own), "<u4").reshape(-1, 16)
                self.parts.append((slice(lo, lo + len(own)), len(own[0]), own, np.ascontiguousarray(raw.T)))

    def digests(self, ending: bytes, leading: bool = False) -> np.ndarray:
        """Four rows of numbers that order like the hexadecimal digests of head + ending, or the first row."""
        out = np.empty((1 if leading else 4, len(self.order)), np.uint32)
        for at, size, heads, words in self.parts:
            length = size + len(ending)
            if length > _ONE_BLOCK:
                got = np.frombuffer(b"".join(hashlib.md5(x + ending).digest() for x in heads), ">u4")
                out[:, at] = got.reshape(-1, 4).T[: len(out)]
                continue
            rest = (b"\0" * size + ending + b"\x80").ljust(56, b"\0") + (8 * length).to_bytes(8, "little")
            block: list = [int(x) for x in np.frombuffer(rest, "<u4")]
            for k in range((size + 3) // 4):
                block[k] = words[k] | np.uint32(block[k])
            for row, x in zip(out, _one_block(block, len(heads), leading)):
                row[at] = x.byteswap(inplace=True)
        return out
