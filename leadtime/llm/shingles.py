"""Vectorised word shingles of whole texts: numpy over the bytes of an Arrow batch, no per-word Python.

A text is lower-cased in A-Z only and cut into words, the maximal runs of bytes other than
0x20 and 0x09-0x0D. Its shingles are the 64-bit hashes of its runs of ``width`` words; a text
of fewer words has one shingle, its whole word sequence, and a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
CHUNK = 2 << 20

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_Q = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(16)], dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_SEP = np.zeros(256, dtype=bool)
_SEP[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < size:
        held = np.full(max(size, CHUNK + 1), base, dtype=np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if size <= 2 * CHUNK:
            _powers[base] = held
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column back to back, and len+1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], (at - at[0] if len(at) else np.zeros(1, np.int64))


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``size`` bytes together; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, their first and end bytes, and len+1 offsets of each text's words."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    word = ~separators[raw]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_FOLD[raw] * _power_table(_P, len(raw))[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power_table(_PINV, len(raw))[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and len+1 offsets of each text's words."""
    hashes, _, _, at = word_spans(raw, offsets)
    return hashes, at


def shingle_arrays(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, repeats kept, and len+1 offsets of each text's."""
    words, at = word_hashes(raw, offsets)
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(count)])
    if not len(words):
        return np.zeros(0, np.uint64), out_at
    total = np.zeros(len(words), np.uint64)
    for k in range(min(width, len(words))):
        total[: len(words) - k] += words[k:] * _Q[k]
    index = np.repeat(at[:-1] - out_at[:-1], count) + np.arange(out_at[-1])
    out = total[index]
    for d in np.flatnonzero((n > 0) & (n < width)):
        out[out_at[d]] = (words[at[d] : at[d + 1]] * _Q[: n[d]]).sum(dtype=np.uint64) + np.uint64(n[d])
    return mix(out), out_at


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle hashes."""
    raw, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        hashes, at = shingle_arrays(raw[part[0] : part[-1]], part - part[0], width)
        for d in range(hi - lo):
            own = np.sort(hashes[at[d] : at[d + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own
