"""Words of whole texts as numpy arrays: bounds and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .common import packed

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of words: all but ASCII white space; and lower-case letters, digits and whatever is not ASCII.
NOT_SPACE = ~_SPACE
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_K = _U(0x9E3779B97F4A7C15)
#: Longer words, in bytes, are hashed one by one.
_LONG = 64


class Words:
    """Words of a column of texts, in order: ``start``/``end`` in ``data``, ``hash``, and ``first`` word by row."""

    def __init__(self, col: pa.Array, kind: np.ndarray):
        self.data, offsets = packed(col)
        inside = kind[self.data]
        before = np.empty(len(inside), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        rows = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[rows] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(len(inside), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[rows[rows > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A mixed hash of each word, lower-cased: eight bytes at a time, for all words that have so many; long words by BLAKE2."""
        size = self.end - self.start
        out = size.astype(_U) * _K
        padded = np.zeros(len(self.data) + 8, np.uint8)
        np.take(_LOWER, self.data, out=padded[:-8])
        eights = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        words = np.flatnonzero(size <= _LONG)
        for k in range(0, _LONG, 8):
            words = words[size[words] > k]
            if not len(words):
                break
            lane = eights[self.start[words] + k]
            left = size[words] - k
            short = left < 8
            lane[short] &= (_U(1) << (left[short] * 8).astype(_U)) - _U(1)
            out[words] = mix64((out[words] ^ lane) * _K + _U(k))
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.text(i), digest_size=8).digest(), "little")
        return out

    def text(self, i: int) -> bytes:
        """Word i, lower-cased."""
        return _LOWER[self.data[self.start[i] : self.end[i]]].tobytes()


def sequence_hash(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words."""
    out = np.zeros(max(0, len(h) - n + 1), _U)
    for k in range(n):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out
