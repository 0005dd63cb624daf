"""Words of a text as positions and hashes, for many texts in a few array operations.

Words are runs of bytes other than the six ASCII blanks (0x09-0x0D, 0x20) in UTF-8. A word's or line's hash is the sum of its
bytes' random numbers times powers of an odd base, modulo 2**64, brought to a common origin by the base's inverse powers.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Texts are taken together up to so many bytes.
PIECE = 1 << 20


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(max(1 << 16, 1 << int(len(data)).bit_length()))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end."""
    _, down = _powers(max(1 << 16, 1 << int(len(sums) - 1).bit_length()))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def find_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and bounds into them: text i has words [at[i], at[i + 1]). A text's end ends a word."""
    inside = ~BLANK[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = bounds[1:-1]
    edges = edges[edges < len(data)]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, bounds)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n successive words, from each word that has n - 1 after it."""
    if len(hashes) < n:
        return hashes[:0]
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def pieces(offsets: np.ndarray):
    """Ranges of texts of about PIECE bytes together, by the texts' offsets in one buffer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string array; null texts count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
