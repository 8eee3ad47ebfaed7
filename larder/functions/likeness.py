"""Lengths of longest common subsequences of many pairs of texts at once, a bit for a character."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Characters of the longer texts of the pairs that are worked on together.
_AREA = 1 << 20
_ONE = np.uint64(1)


def _codes(texts: list[str], filler: int) -> np.ndarray:
    """Code points, a row a text, filled up to whole words of 64."""
    width = -(-max(map(len, texts)) // 64) * 64
    joined = "".join(text.ljust(width, "\0") for text in texts).encode("utf-32-le", "surrogatepass")
    out = np.frombuffer(joined, np.uint32).reshape(len(texts), width).copy()
    out[np.arange(width) >= np.array([[len(text)] for text in texts])] = filler
    return out


def _block(a: list[str], b: list[str]) -> np.ndarray:
    """A bit of ``rest`` is 0 where the length of the common subsequence with the text so far rises; fillers never match."""
    one, two = _codes(a, 0xFFFFFFFF), _codes(b, 0xFFFFFFFE)
    words = two.shape[1] // 64
    rest = np.full((len(a), words), ~np.uint64(0))
    for i in range(max(map(len, a))):
        fits = np.packbits(two == one[:, i : i + 1], axis=1, bitorder="little").view(np.uint64)
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            v, u = rest[:, w], rest[:, w] & fits[:, w]
            low = v + u
            total = low + carry
            carry = ((low < v) | (total < low)).astype(np.uint64)
            rest[:, w] = total | (v - u)
    return two.shape[1] - np.bitwise_count(rest).sum(axis=1, dtype=np.int64)


def lcs_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    """The length, in characters, of the longest common subsequence of each pair."""
    out = np.zeros(len(a), np.int64)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    # pairs of like lengths share a block, so that little is filled up
    order = sorted((i for i, (x, _) in enumerate(pairs) if x), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and len(pairs[order[end]][1]) * (end - begin + 1) <= _AREA and len(pairs[order[end]][1]) <= 2 * len(pairs[order[begin]][1]) + 64:
            end += 1
        part = order[begin:end]
        out[part] = _block([pairs[i][0] for i in part], [pairs[i][1] for i in part])
        begin = end
    return pd.Series(out)
