"""Regular expressions over whole Arrow batches.

A line of a receipt meets dozens of patterns, and one at a time per row they are most of a query's time. Here a batch of lines goes
through them in Arrow, whose engine needs time in proportion to the text, however often a pattern begins to fit. Lines repeat, so
each distinct text of a batch goes through them once. Lines with prices differ mostly in their digits, so where no pattern tells
one digit from another, as with ``\\d`` and ``0-9``, texts that differ only in digits are one text. A worker remembers what its
last texts gave, a bounded number of them, as the next batches hold most of them again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


ZERO = ord("0")
ALIKE = np.arange(256, dtype=np.uint8)
ALIKE[ZERO : ZERO + 10] = ZERO
#: Decimal places of the number of a digit in its text, whose digits are copied; texts with more digits meet the patterns themselves
PLACES = 2
#: What a worker remembers of each set of patterns: so many texts, of so many bytes on average in their batch
REMEMBERED, LONGEST = 65536, 256
_remembered: dict[tuple, dict[str, object]] = {}


def blind(*patterns: str) -> bool:
    """Whether no pattern tells one digit from another: it names none, but for counts of repetitions and 0-9."""
    return not any("\\x" in p or re.search(r"\d", re.sub(r"\{\d+(,\d*)?\}|0-9", "", p)) for p in patterns)


def _with_bytes(t: pa.Array, change: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """The texts with other bytes in the places of theirs."""
    validity, offsets, data = t.buffers()
    if data is None:
        return t
    return pa.Array.from_buffers(t.type, len(t), [validity, offsets, pa.py_buffer(change(np.frombuffer(data, np.uint8)))], t.null_count, t.offset)


def _coded(t: pa.Array, alike: bool) -> pa.DictionaryArray:
    return (_with_bytes(t, lambda data: ALIKE[data]) if alike else t).dictionary_encode()


def _recalled(texts: pa.Array, work: Callable[[pa.Array], pa.Array], key: tuple) -> pa.Array:
    """What ``work``, named by ``key``, makes of the texts, only of new ones."""
    if texts.nbytes > LONGEST * len(texts):
        return work(texts)
    known, wanted = _remembered.setdefault(key, {}), texts.to_pylist()
    new = [x for x in wanted if x not in known]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = wanted
    made = work(pa.array(new, texts.type))
    known.update(zip(new, made.to_pylist(), strict=True))
    return pa.array([known[x] for x in wanted], made.type)


def once(t: pa.Array, work: Callable[[pa.Array], pa.Array], *key: str) -> pa.Array:
    """What ``work`` makes of the distinct texts of a batch, dealt to all its rows; null of null. With a ``key`` of all patterns that
    ``work`` has and their use, results are remembered; if the patterns tell no digit from another, texts that differ only
    in their digits are one text."""
    coded = _coded(t, bool(key) and blind(*key))
    return (_recalled(coded.dictionary, work, key) if key else work(coded.dictionary)).take(coded.indices)


def _is_digit(data: np.ndarray) -> np.ndarray:
    return data - np.uint8(ZERO) < 10


def _spread(t: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins, and the last ends, in the bytes of all; the bytes."""
    _, offsets, data = t.buffers()
    starts = np.frombuffer(offsets, np.int32)[t.offset : t.offset + len(t) + 1].astype(np.int64)
    return starts, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def copied(t: pa.Array, work: Callable[[pa.Array], pa.Array], *key: str) -> pa.Array:
    """``once`` for a ``work`` that leaves digits out, keeps or copies them, and makes none.

    Where the patterns tell no digit from another, texts that differ only in digits are one, in which the digits spell their own
    numbers, a decimal place at a time. So what ``work`` makes of it says which digit of a text stands where, and each text's own digits are put there.
    """
    if len(t) == 0 or not pa.types.is_string(t.type) or not blind(*key):
        return once(t, work)
    coded = _coded(t, True)
    shapes = coded.dictionary
    if not 0 < len(shapes) * 2 <= len(t):
        return once(t, work)
    starts, data = _spread(shapes)
    digit = np.flatnonzero(_is_digit(data))
    counts = np.diff(np.searchsorted(digit, starts))
    if counts.max() > 10**PLACES:
        return once(t, work)
    number = np.arange(len(digit)) - np.repeat(np.cumsum(counts) - counts, counts)

    def spelled(data: np.ndarray, k: int) -> np.ndarray:
        data = data.copy()
        data[digit] = ZERO + number // 10**k % 10
        return data

    made = [_recalled(_with_bytes(shapes, lambda data, k=k: spelled(data, k)), work, (*key, str(k))).take(coded.indices) for k in range(PLACES)]
    starts, data = _spread(made[0])
    digit = np.flatnonzero(_is_digit(data[: starts[-1]]))
    number = sum((_spread(m)[1][digit].astype(np.int64) - ZERO) * 10**k for k, m in enumerate(made))
    own_starts, own = _spread(t)
    own_digit = np.flatnonzero(_is_digit(own))
    first = np.repeat(np.searchsorted(own_digit, own_starts[:-1]), np.diff(np.searchsorted(digit, starts)))

    def put(data: np.ndarray) -> np.ndarray:
        data = data.copy()
        data[digit] = own[own_digit[first + number]]
        return data

    return _with_bytes(made[0], put)


def which(text: Column, patterns: list[str]) -> Column:
    """A number whose bit i says whether pattern i, of 63 at most, is found; null of null."""

    def work(t: pa.Array) -> pa.Array:
        out = np.zeros(len(t), np.int64)
        for i, p in enumerate(patterns):
            out |= pc.match_substring_regex(t, p).to_numpy(zero_copy_only=False).astype(np.int64) << i
        return pa.array(out, pa.int64())

    @F.arrow_udf("long")
    def bits(t: pa.Array) -> pa.Array:
        return once(t, work, "which", *patterns)

    return bits(text)


def is_found(text: Column, *patterns: str) -> Column:
    """Whether any of the patterns is found; null of null."""
    return which(text, list(patterns)) != 0


def first_fit(text: Column, rules: list[tuple[str, ...]]) -> Column:
    """The name of the first rule (name, pattern, patterns that must not be found) that fits, else null."""

    def work(rest: pa.Array) -> pa.Array:
        place = np.full(len(rest), -1)
        left = np.arange(len(rest))
        for i, (_, p, *unless) in enumerate(rules):
            hit = pc.match_substring_regex(rest, p)
            for u in unless:
                hit = pc.and_not(hit, pc.match_substring_regex(rest, u))
            hit = hit.to_numpy(zero_copy_only=False)
            if hit.any():
                place[left[hit]] = i
                left = left[~hit]
                rest = rest.filter(pa.array(~hit))
        names = pa.array([r[0] for r in rules], pa.string())
        return names.take(pa.array(place, pa.int64(), mask=place < 0))

    key = ["first_fit", *[p for name, *patterns in rules for p in (name, *patterns, "")]]

    @F.arrow_udf("string")
    def fit(t: pa.Array) -> pa.Array:
        return once(t, work, *key)

    return fit(text)


def replaced(text: Column, changes: list[tuple[str, str]], trim: bool = True) -> Column:
    """All matches of each pattern replaced, in order ($1 keeps a group), with blanks around trimmed after each."""
    steps = [(p, kept.replace("$1", r"\1")) for p, kept in changes]

    def work(t: pa.Array) -> pa.Array:
        for p, kept in steps:
            t = pc.replace_substring_regex(t, p, kept)
            t = pc.ascii_trim(t, " ") if trim else t
        return t

    key = ["trimmed" if trim else "whole", *[x for p, kept in changes for x in (p, kept.replace("$1", "\0"))]]

    @F.arrow_udf("string")
    def change(t: pa.Array) -> pa.Array:
        return copied(t, work, *key)

    return change(text)


def lengths_without(text: Column, patterns: list[str]) -> list[Column]:
    """Per pattern, each of one character, the characters that are left when all its matches are gone, a stretch of them at a time."""

    def work(t: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pc.utf8_length(pc.replace_substring_regex(t, f"(?:{p})+", "")) for p in patterns], [f"l{i}" for i in range(len(patterns))])

    @F.arrow_udf(", ".join(f"l{i} int" for i in range(len(patterns))))
    def left(t: pa.Array) -> pa.Array:
        return once(t, work, "lengths_without", *patterns)

    found = left(text)
    return [found[f"l{i}"] for i in range(len(patterns))]


def times(text: Column, pattern: str) -> Column:
    """How often the pattern is found, matches apart."""

    @F.arrow_udf("int")
    def count(t: pa.Array) -> pa.Array:
        return once(t, lambda some: pc.count_substring_regex(some, pattern).cast(pa.int32()), "times", pattern)

    return count(text)


def groups(text: Column, pattern: str) -> Column:
    """The groups of the first match as fields g1, g2 and so on: '' of a group that takes no part, null where nothing is found."""
    at = iter(range(1, 100))
    named = re.sub(r"(?<!\\)\((?!\?)", lambda m: f"(?P<g{next(at)}>", pattern)
    n = next(at) - 1

    def work(t: pa.Array) -> pa.Array:
        found = pc.extract_regex(t, named)
        gone = pc.is_null(found)
        parts = [pc.if_else(gone, pa.scalar(None, pa.string()), found.field(i).cast(pa.string())) for i in range(n)]
        return pa.StructArray.from_arrays(parts, [f"g{i}" for i in range(1, n + 1)])

    @F.arrow_udf(", ".join(f"g{i} string" for i in range(1, n + 1)))
    def take(t: pa.Array) -> pa.Array:
        found = once(t, work)
        return pa.StructArray.from_arrays([pc.struct_field(found, i) for i in range(n)], [f"g{i}" for i in range(1, n + 1)])

    return take(text)
