"""Words of many texts at once, as byte offsets and 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts tokenized at once, so that the arrays stay in a core's cache.
RUN = 1 << 20

_BYTE = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: Bytes of words: ASCII letters and digits and all of non-ASCII characters; or all but ASCII white space.
ALNUM = ((_LOWER >= 97) & (_LOWER <= 122)) | ((_BYTE >= 48) & (_BYTE <= 57)) | (_BYTE >= 128)
DARK = ~((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, back: bool = False) -> np.ndarray:
    """The first n powers of the base modulo 2 ** 64, or of its inverse."""
    out = np.full(n, _BACK if back else _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


class Words:
    """The words of a run of texts: where they begin and end in the lower-cased bytes, their
    hashes, and which of them belong to text i: from `first[i]` up to `first[i + 1]`."""

    def __init__(self, texts: pa.Array, table: np.ndarray):
        texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        self.raw, self.low, self.at = raw, _LOWER[raw], at
        inside = table[raw]
        edge = at[(at > 0) & (at < len(raw))]
        same = np.concatenate(([False], inside[:-1])) if len(raw) else inside
        same[edge] = False
        self.start = np.flatnonzero(inside & ~same)
        same = np.concatenate((inside[1:], [False])) if len(raw) else inside
        same[edge - 1] = False
        self.end = np.flatnonzero(inside & ~same) + 1
        self.first = np.searchsorted(self.start, at)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out, k = np.empty(len(self.start), np.uint64), 0
        while k < len(out):
            last = max(k + 1, int(np.searchsorted(self.end, self.start[k] + RUN)))
            a, b = self.start[k], self.end[last - 1]
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((self.low[a:b].astype(np.uint64) + np.uint64(1)) * powers(b - a), out=sums[1:])
            s, e = self.start[k:last] - a, self.end[k:last] - a
            out[k:last] = mix((sums[e] - sums[s]) * powers(b - a, back=True)[s])
            k = last
        return out

    def text(self, a: int, b: int) -> list[str]:
        return [self.low[s:e].tobytes().decode() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]
