"""Texts that differ only in digits share the work of patterns."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.compute as pc

from larder.functions import lines, matching


def _steps(t: pa.Array) -> pa.Array:
    for p, kept in lines.NAME_STRIPS:
        t = pc.ascii_trim(pc.replace_substring_regex(t, p, kept.replace("$1", r"\1")), " ")
    return t


def test_digits_are_told_apart_only_where_a_pattern_names_one():
    assert matching.blind(r"^\d{4,15}[0-9]\s?", "[^0-9]") and matching.blind(*[p for p, _ in lines.NAME_STRIPS])
    assert not matching.blind("[1-9]") and not matching.blind("7up") and not matching.blind(r"\x{30}")


def test_names_with_shared_shapes_are_cleaned_as_by_the_patterns():
    dice = random.Random(1)
    bits = ["12", " ", "A", "é", "2 AB", "*WT ", "004011 ", "E ", "MILK", " 123456789012 ", "3.99", "$", "NF $", "approved", "...", "₂", "٣", " FC", ")", "450000000"]
    shapes = ["".join(dice.choices(bits, k=dice.randint(0, 7))) for _ in range(200)]
    rows = [None if dice.random() < 0.05 else "".join(dice.choice("0123456789") if c in "0123456789" else c for c in dice.choice(shapes)) for _ in range(4000)]
    seen = []

    def counted(t: pa.Array) -> pa.Array:
        seen.append(len(t))
        return _steps(t)

    for t in (pa.array(rows), pa.array(rows).slice(77, 1000), pa.array([None] * 3, pa.string()), pa.array([], pa.string()), pa.array(["9 " * 1200] * 9)):
        assert matching.copied(t, counted, "test").equals(_steps(t))
    assert sum(seen) < 1000  # of 5,012 rows


def test_labels_of_lines_that_differ_in_digits_are_found_once():
    seen = []
    t = pa.array([f"MILK {i}.{i % 100:02d}" for i in range(100, 1000)])

    def work(some: pa.Array) -> pa.Array:
        seen.extend(some.to_pylist())
        return pc.match_substring_regex(some, r"\d+\.\d{2}$")

    assert matching.once(t, work, "test_once", r"\d+\.\d{2}$").to_pylist() == [True] * 900 and seen == ["MILK 000.00"]
    assert matching.once(t, work, "test_once", r"\d+\.\d{2}$").to_pylist() == [True] * 900 and len(seen) == 1
