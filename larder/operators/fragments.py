"""Recognised text fragments with places to lines of text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KEY = "receipt_id"
PRICE = r"^\$?\d+\.\d{2}$"
ENDS_PRICED = re.compile(r"\d+\.\d{2}\s*$", re.ASCII)
LOW = float("-inf")
NEAREST, MARGIN, LEAST, DEFAULT = 50.0, 3.0, 5.0, 8.0


def _sorted(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``place`` in their receipt. Each partition holds whole receipts, one after the other, in this order; rows that are dealt
    by receipt already are not dealt again."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(KEY).orderBy(*order)))


def _batches(rows: Iterator[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    names, types, held = schema.names, to_arrow_schema(schema).types, []
    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _survivors(table: pa.Table, dy: float, dx: float) -> np.ndarray:
    """Whether each fragment stays. What was kept last has the text of the fragment before, as only equal texts merge, so
    only stretches of equal texts in a receipt are walked."""
    key, text = (pc.dictionary_encode(table[c].combine_chunks(), "encode").indices.to_numpy(zero_copy_only=False) for c in (KEY, "text"))
    stays = np.ones(len(key), bool)
    again = np.flatnonzero((key[1:] == key[:-1]) & (text[1:] == text[:-1])) + 1
    y, x, conf = (table[c].to_numpy() for c in ("y", "x", "conf"))
    before = kept = -1
    for i in again.tolist():
        if i - 1 != before:
            kept = i - 1
        before = i
        if abs(y[i] - y[kept]) < dy and abs(x[i] - x[kept]) < dx:
            stays[kept if conf[i] > conf[kept] else i] = False
            kept = i if conf[i] > conf[kept] else kept
        else:
            kept = i
    return stays


def dedup_fragments(frags: DataFrame, dy: float = 15.0, dx: float = 20.0, least: float = 0.4) -> DataFrame:
    """Fragments of equal text close to the last one kept are one, that of higher conf; those under ``least`` go.

    What is kept depends on what was kept before, so each receipt's fragments are folded in (y, x) order. A fragment
    without a place is close to none.
    """
    typed = frags.where(F.col("conf") >= least).select(KEY, *[F.col(c).cast("double").alias(c) for c in ("y", "x")], "text", F.col("conf").cast("double").alias("conf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the fragment kept last, which the next batch may still replace
        for batch in batches:
            table = pa.Table.from_batches([batch]).drop_columns("place")
            table = pa.concat_tables([last, table]) if last else table
            table = table.filter(pa.array(_survivors(table, dy, dx)))
            last = table.slice(len(table) - 1) if len(table) else None
            yield from table.slice(0, max(len(table) - 1, 0)).to_batches()
        if last:
            yield from last.to_batches()

    return _sorted(typed, ["y", "x", "text", "conf"]).mapInArrow(run, typed.schema)


def row_threshold(frags: DataFrame) -> DataFrame:
    """Per receipt how far a fragment may be from a row's mean y: the 90th percentile of the distances from prices to
    the nearest other text (under 50) plus 3; else 0.7 of the median gap over 1; 5 at least; 8 without gaps.

    The nearest neighbours of a price in y are the last fragment that is no price, from above and from below.
    """
    frags = frags.where(F.char_length(F.trim("text")) > 1).withColumn("price", F.trim("text").rlike(PRICE))
    w = Window.partitionBy(KEY).orderBy("y")
    other = F.when(~F.col("price"), F.col("y"))
    up = F.last(other, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    down = F.last(other, ignorenulls=True).over(Window.partitionBy(KEY).orderBy(F.desc("y")).rangeBetween(Window.unboundedPreceding, 0))
    near = F.least(F.col("y") - up, down - F.col("y"))
    gap = F.col("y") - F.lag("y").over(w)
    rows = frags.withColumns({"near": F.when(F.col("price"), near), "gap": F.when(gap > 1, gap)})
    rows = rows.withColumn("near", F.when(F.col("near") < NEAREST, F.col("near")))
    lists = rows.groupBy(KEY).agg(F.array_sort(F.collect_list("near")).alias("near"), F.array_sort(F.collect_list("gap")).alias("gap"))
    p90 = F.get("near", F.floor(F.size("near") * 0.9).cast("int")) + MARGIN
    median = F.get("gap", F.expr("cast(size(gap) div 2 as int)")) * 0.7
    return lists.select(KEY, F.when(F.size("near") > 0, F.greatest(p90, F.lit(LEAST))).when(F.size("gap") > 0, F.greatest(median, F.lit(LEAST))).otherwise(DEFAULT).cast("double").alias("threshold"))


def _threshold(y: list[float], price: list[bool]) -> float:
    """``row_threshold`` of one receipt, its places in order."""
    near, waiting, last = [], [], None
    for v, p in zip(y, price, strict=True):
        if p:
            waiting.append(v)
        else:
            near.extend([v - w if last is None else min(v - w, w - last) for w in waiting])
            waiting, last = [], v
    if last is not None:
        near.extend([w - last for w in waiting])
    near = sorted([d for d in near if d < NEAREST])
    if near:
        return max(near[int(len(near) * 0.9)] + MARGIN, LEAST)
    gaps = sorted([b - a for a, b in zip(y, y[1:], strict=False) if b - a > 1])
    return max(gaps[len(gaps) // 2] * 0.7, LEAST) if gaps else DEFAULT


def _row_numbers(y: list[float | None], price: list[bool]) -> list[int]:
    """The row of each fragment of a receipt, from 0."""
    none = y.count(None)  # they come first
    threshold = _threshold(y[none:], price[none:])
    numbers, row_no, total, n = [], 0, 0.0, 0
    for v in y:
        if n and v is not None and abs(v - total / n) > threshold:
            row_no, total, n = row_no + 1, v, 1
        else:
            total, n = total + (v or 0.0), n + 1
        numbers.append(row_no)
    return numbers


def _by_x(fragment: tuple) -> tuple:
    """Order of a row's fragments (y, x, text), nulls first."""
    y, x, text = fragment
    if x is None or y is None or text is None:
        return LOW if x is None else x, LOW if y is None else y, text or ""
    return x, y, text


def _joined(fragments: list[tuple]) -> str:
    if len(fragments) > 1:
        fragments = sorted(fragments, key=_by_x)
    return " ".join([text for _, _, text in fragments if text is not None])


def _cut(row: list[tuple]) -> int:
    """Where the second part of a row, fragments (y, x, text) by y, begins; 0 if it is whole."""
    if len(row) < 3 or (row[0][0] is not None and row[-1][0] - row[0][0] <= 2):
        return 0
    gaps = [0.0 if None in (a[0], b[0]) else abs(b[0] - a[0]) for a, b in zip(row, row[1:], strict=False)]
    most = max(gaps)
    if not most > 2:
        return 0
    cut = gaps.index(most) + 1
    sizes = [sum(len(f[2]) + 1 for f in part if f[2] is not None) - 1 for part in (row[:cut], row[cut:])]
    if min(sizes) <= 3:
        return 0
    whole = _joined(row)
    return 0 if len(whole) < 50 and ENDS_PRICED.search(whole) else cut


def _receipts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Receipts as key and columns; one that goes on in the next batch is held back, a receipt being a small group."""
    held = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        place = columns.pop()
        starts = [i for i, p in enumerate(place) if p == 1]
        head = starts[0] if starts else len(place)
        if held:
            for old, new in zip(held, columns, strict=True):
                old.extend(new[:head])
        if starts:
            if held:
                yield held[0][0], held[1:]
            for i, j in zip(starts, starts[1:], strict=False):
                yield columns[0][i], [c[i:j] for c in columns[1:]]
            held = [c[starts[-1]:] for c in columns]
    if held:
        yield held[0][0], held[1:]


def _in_rows(frags: DataFrame, schema: StructType, finish: Callable[[object, list[list[tuple]]], Iterator[tuple]]) -> DataFrame:
    """What ``finish`` makes of each receipt and its rows of fragments by y, in one pass over the sorted fragments."""
    frags = frags.where((F.char_length(F.trim("text")) > 1) & F.col(KEY).isNotNull()).select(KEY, *[F.col(c).cast("double").alias(c) for c in ("y", "x")], "text")

    def priced(batch: pa.RecordBatch) -> pa.RecordBatch:
        price = pc.match_substring_regex(pc.ascii_trim(batch.column("text"), " "), PRICE)
        return pa.RecordBatch.from_arrays([*batch.columns[:4], price, batch.column("place")], [KEY, "y", "x", "text", "price", "place"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, (y, x, text, price) in _receipts(priced(b) for b in batches):
            rows = []
            for row_no, *fragment in zip(_row_numbers(y, price), y, x, text, strict=True):
                if row_no == len(rows):
                    rows.append([])
                rows[-1].append(fragment)
            yield from finish(key, rows)

    return _sorted(frags, ["y", "x", "text"]).mapInArrow(lambda batches: _batches(made(batches), schema), schema)


def _schema(frags: DataFrame, columns: str) -> StructType:
    return StructType([frags.schema[KEY], *StructType.fromDDL(columns).fields])


def fragment_rows(frags: DataFrame) -> DataFrame:
    """Fragments with ``row_no``: by y, a new row begins where y is over the threshold from the running mean of the row."""
    return _in_rows(frags, _schema(frags, "row_no int, y double, x double, text string"), lambda key, rows: ((key, i, *f) for i, row in enumerate(rows) for f in row))


def _with_part(key: object, row_no: int, row: list[tuple]) -> Iterator[tuple]:
    cut = _cut(row)
    return ((key, row_no, int(0 < cut <= i), x, y, text) for i, (y, x, text) in enumerate(row))


def split_rows(rows: DataFrame) -> DataFrame:
    """Rows of over two fragments in two at their largest y gap if it is over 2 and both parts have over 3 characters,
    unless the row is short and ends with a price. Adds ``part``, 0 or 1."""
    rows = rows.where(F.col(KEY).isNotNull() & F.col("row_no").isNotNull()).select(KEY, "row_no", "y", "x", "text")
    schema = rows.select(KEY, "row_no", F.lit(0).alias("part"), "x", "y", "text").schema

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, columns in _receipts(batches):
            for row_no, row in groupby(zip(*columns, strict=True), lambda f: f[0]):
                yield from _with_part(key, row_no, [f[1:] for f in row])

    return _sorted(rows, ["row_no", "y", "x", "text"]).mapInArrow(lambda batches: _batches(made(batches), schema), schema)


def split_fragments(frags: DataFrame) -> DataFrame:
    """``split_rows`` of ``fragment_rows`` in one pass."""
    return _in_rows(frags, _schema(frags, "row_no int, part int, x double, y double, text string"), lambda key, rows: (f for i, row in enumerate(rows) for f in _with_part(key, i, row)))


def fragments_to_lines(frags: DataFrame) -> DataFrame:
    """Lines of text from fragments, in order, each row's fragments by x."""

    def lines(key: object, rows: list[list[tuple]]) -> Iterator[tuple]:
        parts = (part for row in rows for cut in [_cut(row)] for part in (row[:cut], row[cut:]) if part)
        return ((key, i, _joined(part)) for i, part in enumerate(parts))

    return _in_rows(frags, _schema(frags, "line_no int, text string"), lines)
