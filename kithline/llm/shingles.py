"""Vectorised word and shingle hashing over Arrow binary columns.

Words are hashed straight from the UTF-8 bytes of a column: a byte table says
which bytes separate words and folds A-Z onto a-z, and a prefix-sum polynomial
hash gives each word's 64-bit value without making a Python object per word.
Everything depends on the bytes alone, so any executor computes the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
#: Bytes hashed at once; longer texts are cut at word boundaries, so memory stays bounded.
BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    filled, step = 1, base
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * U64(step)
        filled, step = filled + take, step * step % (1 << 64)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits of a hash are usable."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


class WordHasher:
    """Hashes the words of texts given as UTF-8 bytes; `separators` are single bytes."""

    def __init__(self, separators: bytes) -> None:
        self.is_sep = np.zeros(256, bool)
        self.is_sep[list(separators)] = True
        fold = np.arange(256)
        fold[65:91] += 32
        self.value = mix(fold.astype(U64) + U64(0x1234567))
        self.up = _powers(_MULT, BLOCK + 2)
        self.down = _powers(_INV, BLOCK + 2)

    def _block(self, b: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~self.is_sep[b]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return np.empty(0, U64)
        total = np.zeros(len(b) + 1, U64)
        np.cumsum(self.value[b] * self.up[: len(b)], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(U64))

    def words(self, data: bytes | memoryview | np.ndarray) -> np.ndarray:
        """One 64-bit hash for each word of one text, in order."""
        b = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
        if len(b) <= BLOCK:
            return self._block(b)
        parts, at = [], 0
        while at < len(b):
            end = min(at + BLOCK, len(b))
            if end < len(b):
                seps = np.flatnonzero(self.is_sep[b[at:end]])
                if len(seps):
                    end = at + int(seps[-1]) + 1
                else:  # one word longer than a block: hash its blocks and fold them together
                    stop = end
                    while stop < len(b) and not self.is_sep[b[stop]]:
                        stop += 1
                    h = np.array([stop - at], U64)
                    for k in range(at, stop, BLOCK):
                        h = mix(h * U64(_MULT) + self._block(b[k : min(k + BLOCK, stop)]))
                    parts.append(h)
                    at = stop
                    continue
            parts.append(self._block(b[at:end]))
            at = end
        return np.concatenate(parts) if parts else np.empty(0, U64)

    def shingles(self, data: bytes | memoryview | np.ndarray, width: int) -> np.ndarray:
        """Sorted distinct hashes of the `width`-word shingles; a shorter text is one shingle, an empty one none."""
        g = np.sort(self.grams(self.words(data), width))
        return g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) else g

    @staticmethod
    def grams(w: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all runs of `width` words in order; with fewer words, of the whole run."""
        if not len(w):
            return w
        k = min(width, len(w))
        h = np.full(len(w) - k + 1, k * 0xD6E8FEB86659FD93 % (1 << 64), U64)
        for i in range(k):
            h = (h ^ w[i : len(w) - k + 1 + i]) * U64(_MULT)
            h ^= h >> U64(29)
        return mix(h)


def binary_rows(column) -> Iterator[np.ndarray | None]:
    """The rows of an Arrow binary column as byte arrays without copies, None for nulls."""
    import pyarrow as pa

    for x in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        kind = np.int64 if pa.types.is_large_binary(x.type) or pa.types.is_large_string(x.type) else np.int32
        _, offsets, data = x.buffers()
        at = np.frombuffer(offsets, kind)[x.offset : x.offset + len(x) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        valid = x.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(x)):
            yield raw[at[i] : at[i + 1]] if valid[i] else None
