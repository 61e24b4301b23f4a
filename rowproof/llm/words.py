"""Words of whole texts as 64-bit hashes, with numpy over Arrow's own buffers.

A word is a maximal run of bytes other than space and U+0009 to U+000D; a byte run, as no
UTF-8 continuation byte is white space. Hashes are polynomials over random byte values,
taken from one running sum over the bytes, then mixed; equal words have equal hashes in
every process, and different ones differ but for a chance of about 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes of text that are hashed at once, or one longer text
_U = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2^64
_rng = np.random.Generator(np.random.PCG64(7))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 18)
        known = np.full(size, _U(base & (1 << 64) - 1))
        known[0] = 1
        known = np.cumprod(known, dtype=_U)
        if size <= 4 * PIECE:
            _powers[base] = known
    return known[:n]


def run_sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial of values[begin:end], each with base^0 at its begin, mixed."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix((total[ends] - total[begins]) * inverse[begins])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts in them); null counts as empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)), off - off[0]


def pieces(off: np.ndarray, most: int = PIECE):
    """Ranges of texts of about ``most`` bytes together; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, word offsets of the texts): words never run over a text's end."""
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begins, ends, np.searchsorted(begins, off)


def hashed(data: np.ndarray, off: np.ndarray, lower: bool = False):
    """(hash of each word, word offsets of the texts, begins, ends)."""
    begins, ends, at = bounds(data, off)
    return run_sums((_LOWER if lower else _VALUE)[data], begins, ends), at, begins, ends


def hashed_batches(batches, text: str = "text", lower: bool = False):
    """For an Arrow batch iterator: (rows, data, hashes, word offsets, begins, ends) by piece,
    where rows is the slice of the batch."""
    for batch in batches:
        data, off = texts(batch.column(batch.schema.get_field_index(text)))
        for i, j in pieces(off):
            part = data[off[i] : off[j]]
            yield batch.slice(i, j - i), part, *hashed(part, off[i : j + 1] - off[i], lower)
