"""Dates in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# The shape that a text needs before a format is tried on it
SHAPES = {
    "yyyy-MM-dd": r"^\d{4}-\d{1,2}-\d{1,2}$", "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$", "yyyy/MM/dd": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yy": r"^\d{1,2}-\d{1,2}-\d{2}$",
    "MMMM d, yyyy": r"^\p{L}{3,9} \d{1,2}, \d{4}$", "MMM d, yyyy": r"^\p{L}{3} \d{1,2}, \d{4}$", "MMM d yyyy": r"^\p{L}{3} \d{1,2} \d{4}$",
}


def parse_date(text: Column, formats: list[str] | None = None) -> Column:
    """The date by the first format that fits, else null. Two-digit years of 69 and more are of the 1900s."""
    t = F.initcap(F.trim(text))
    tries = []
    for f in formats or fixed.DATE_FORMATS:
        loose = f.replace("MM", "M").replace("dd", "d") if "-MM-" in f or "/MM/" in f else f
        found = F.when(t.rlike(SHAPES[f]), F.try_to_timestamp(t, F.lit(loose)).cast("date"))
        if f.endswith("/yy") or f.endswith("-yy"):
            found = F.when(F.year(found) >= 2069, F.add_months(found, -1200)).otherwise(found)
        tries.append(found)
    return F.coalesce(*tries)
