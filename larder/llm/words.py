"""Word, shingle and byte n-gram hashes of whole Arrow text batches, in numpy.

A word's hash is a polynomial in the random values of its bytes, taken modulo 2**64
from one running sum over the batch, so there is no Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; bounds the memory of a task, not the length of a text.
WINDOW = 1 << 20
_M = 0xFFFFFFFFFFFFFFFF
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, WINDOW + (1 << 16))
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and where each begins (one more entry than texts); null is empty."""
    texts = texts.cast(pa.large_utf8()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    first, last = (int(at[0]), int(at[-1])) if len(at) else (0, 0)
    found = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.zeros(0, np.uint8)
    return found, at - first


def _windows(data: np.ndarray, at: np.ndarray):
    """Spans of about WINDOW bytes that end at a white space or where a text ends."""
    begin, n = 0, len(data)
    while begin < n:
        end = begin + WINDOW
        if end >= n:
            end = n
        else:
            text_end = int(at[np.searchsorted(at, end)])
            step = 4096
            while end < text_end:
                gap = np.flatnonzero(_SPACE[data[end : min(end + step, text_end)]])
                if len(gap):
                    end += int(gap[0])
                    break
                end, step = min(end + step, text_end), step * 4
        yield begin, end
        begin = end


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, starts, ends, data): a 64-bit hash per word, each text's first word index (one more entry
    than texts), each word's byte span in data. lower: A-Z count as a-z."""
    data, at = text_buffer(texts)
    table, hashes, starts, ends = _LOWER if lower else _VALUES, [], [], []
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[at] = True
    for a, b in _windows(data, at):
        part = data[a:b]
        inside = ~_SPACE[part]
        fresh = np.empty(len(part), dtype=bool)
        fresh[0], fresh[1:] = True, ~inside[:-1]
        head = np.flatnonzero(inside & (fresh | begins[a:b]))
        if not len(head):
            continue
        over = np.empty(len(part), dtype=bool)
        over[-1], over[:-1] = True, ~inside[1:] | begins[a + 1 : b]
        tail = np.flatnonzero(inside & over)
        power, inverse = power_table(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * power[: len(part)], out=total[1:])
        hashes.append(mix64((total[tail + 1] - total[head]) * inverse[head] + (tail - head).astype(np.uint64)))
        starts.append(head + a)
        ends.append(tail + a + 1)
    none = np.zeros(0, np.int64)
    starts = np.concatenate(starts) if starts else none
    ends = np.concatenate(ends) if ends else none
    first = np.searchsorted(starts, at)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), first, starts, ends, data


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text its distinct lower-cased word shingles as sorted 64-bit hashes.

    With fewer than ``width`` words the whole sequence is the one shingle; without words the set is empty.
    """
    words, first, *_ = word_hashes(texts, lower=True)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(_BASE) + words[k : k + len(rolled)]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = int(b - a)
            for h in words[a:b]:
                whole = (whole * 0xD6E8FEB86659FD93 + int(h)) & _M
            out.append(mix64(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
