"""Vectorised word and shingle hashing over raw UTF-8 buffers.

Everything here works on one Arrow string column at a time: the column's
offsets and bytes are viewed as numpy arrays, so no Python string per word is
ever made.  Words follow ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only;
all other bytes, UTF-8 continuation bytes included, are word bytes.

Null texts have an empty byte range; callers that must tell null from empty use
the column's validity.  Hashes are 64-bit and the same on every machine and run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUE = _BYTE_VALUE[_LOWER]
_BYTE_VALUE[_SPACE] = 0
_BASE = int(_RNG.integers(2**61, 2**62)) | 1
_POWERS = np.ones(1, dtype=np.uint64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text handled in one vectorised step; bounds the temporary arrays.
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixer; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1024)
        with np.errstate(over="ignore"):
            _POWERS = np.full(size, _BASE, dtype=np.uint64)
            _POWERS[0] = 1
            np.multiply.accumulate(_POWERS, out=_POWERS)
    return _POWERS


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, int64) and bytes of an Arrow string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of about ``limit`` bytes each; a longer text stands alone, whole."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def word_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit hash per word, and the word offsets of each text (n + 1)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1]
    edges = edges[edges < n]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), rows
    first = int(starts[0])
    lengths = np.diff(np.append(starts, n))
    place = np.arange(first, n) - np.repeat(starts, lengths)
    power = _powers(int(lengths.max()))
    values = _BYTE_VALUE[raw[first:]] * power[place]
    return mix64(np.add.reduceat(values, starts - first) + _STEP), rows


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; empty if there are fewer."""
    m = len(words) - size + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = words[:m].copy()
    for k in range(1, size):
        h = mix64(h * _C2 + _STEP) + words[k : k + m]
    return mix64(h)


def fold(words: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence, of any length."""
    h = np.uint64(len(words)) + _STEP
    with np.errstate(over="ignore"):
        for w in words:
            h = h * _C1 + w
    return mix64(np.array([h], dtype=np.uint64))[0]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one text; a text of fewer words gives one."""
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([fold(words)], dtype=np.uint64)
    return np.unique(window_hashes(words, size))


_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN_VALUE = np.where(_PUNCT, np.uint64(0), _BYTE_VALUE)


def plain_words(offsets: np.ndarray, raw: np.ndarray):
    """Words without their ASCII punctuation: hash, letters left, first byte, bytes with punctuation; and word offsets (n + 1)."""
    n, none = len(raw), np.zeros(0, dtype=np.int64)
    if n == 0:
        return none.astype(np.uint64), none, none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return none.astype(np.uint64), none, none, none, rows
    first, spans = int(starts[0]), np.diff(np.append(starts, n))
    body, at = raw[first:], starts - starts[0]
    kept = inside[first:] & ~_PUNCT[body]
    rank = np.cumsum(kept, dtype=np.int32)
    place = np.maximum(rank - 1 - np.repeat(rank[at] - kept[at], spans), 0)
    hashes = mix64(np.add.reduceat(_PLAIN_VALUE[body] * _powers(int(spans.max()))[place], at) + _STEP)
    return hashes, np.add.reduceat(kept, at, dtype=np.int64), starts, np.add.reduceat(inside[first:], at, dtype=np.int64), rows
