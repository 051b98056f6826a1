"""Words and hashed word shingles of many texts at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Letters, digits and all that is not ASCII make words.
DELIMITERS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
BLANKS = bytes.maketrans(DELIMITERS, b" " * len(DELIMITERS))
_IS_WORD = np.array([bytes([i]) not in {bytes([d]) for d in DELIMITERS} for i in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all others."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of an odd base modulo 2^64, and their inverses."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[k] = np.cumprod(a, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any range of bytes follows: see range_hashes()."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(len(raw))[0], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end, alike wherever they stand; equal lengths only are comparable."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


class Words(NamedTuple):
    hashes: np.ndarray
    doc: np.ndarray  # of each word, sorted
    first: np.ndarray  # for each text its first word; one more at the end

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of each run of n words."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hashes[:m] * _STEP + np.uint64(n)
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * _STEP + self.hashes[k : k + m]
        inside = self.doc[:m] == self.doc[n - 1 :]
        return mix(h[inside]), self.doc[:m][inside]

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of each run of n words; a shorter text is one shingle, one without words has none."""
        h, doc = self.grams(n)
        size = np.diff(self.first)
        parts = [(h, doc)]
        for k in range(1, n):
            if (size == k).any():
                g, d = self.grams(k)
                keep = size[d] == k
                parts.append((g[keep], d[keep]))
        if len(parts) > 1:
            h, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
        return h, doc


def lowered(texts: list[bytes]) -> list[bytes]:
    return [x.lower() if x.isascii() else x.decode("utf-8", "replace").lower().encode() for x in texts]


def words(texts: list[bytes]) -> Words:
    """Hashed words of lower-cased texts."""
    low = lowered(texts)
    joined = b" ".join(low) + b" "
    raw = np.frombuffer(joined, np.uint8)
    inside = _IS_WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    hashes = range_hashes(prefix_hashes(raw), start, end) + (end - start).astype(np.uint64) * _STEP
    ends = np.cumsum([len(x) + 1 for x in low]) if texts else np.zeros(0, np.int64)
    doc = np.searchsorted(ends, start, "right")
    return Words(hashes, doc, np.searchsorted(doc, np.arange(len(texts) + 1)))


def word_list(text: bytes) -> list[bytes]:
    return lowered([text])[0].translate(BLANKS).split()


def shingle_list(ws: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    """As Words.shingles(), spelt out."""
    return [tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))] if ws else []
