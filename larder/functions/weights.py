"""Weights and quantities in text: parsing, grams, display units, plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# Grams of a unit, in two precisions
GRAMS = {"g": 1.0, "kg": 1000.0, "oz": 28.3495, "lb": 453.592, "ml": 1.0, "l": 1000.0}
COARSE_GRAMS = {"g": 1.0, "kg": 1000.0, "oz": 28.35, "fl oz": 28.35, "lb": 453.6, "lbs": 453.6, "ml": 1.0, "l": 1000.0, "cl": 10.0}
#: Amounts in names, in quantities, and in quantities with decimal commas; ounces cut to ``o``.
NAME_AMOUNT = r"(?i)(\d+(?:\.\d+)?)\s*(kg|g|lb|lbs|oz|ml|l)\b"
AMOUNT = r"(?i)(\d+(?:\.\d+)?)\s*(kg|g|lb|lbs|oz|fl oz|ml|l|cl)\b"
COMMA_AMOUNT = r"(?i)(\d+(?:[.,]\d+)?)\s*(kg|g|lb|lbs|oz|fl oz|ml|l|cl)\b"
CUT_OUNCES = r"(?i)(\d+(?:\.\d+)?)\s*o\b"
MOST_GRAMS, LEAST_GRAMS = 25000, 20
NO_RATIO, DISAGREE = 999.0, 5.0


def _lookup(key: Column, table: dict[str, float], default: float | None = None) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def _weight(value: Column, unit: Column) -> Column:
    """A struct of value and unit, null as a whole where the value is."""
    return F.when(value.isNotNull(), F.struct(value.alias("value"), unit.alias("unit")))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def extract_weight(name: Column) -> Column:
    """Weight named in a product name, ``16o`` read as ``16 oz``; a weight of 0 and no match are null."""
    text = F.regexp_replace(F.trim(name), CUT_OUNCES, "$1 oz")
    value, unit = _number(text, NAME_AMOUNT), F.lower(F.regexp_extract(text, NAME_AMOUNT, 2))
    return _weight(F.when(value != 0, value), F.when(unit == "lbs", "lb").otherwise(unit))


def parse_quantity(text: Column) -> Column:
    """First amount of a quantity; fl oz counts as oz, cl as ten ml. Decimal commas are not read: ``1,5 l`` is 5 l."""
    value, unit = _number(text, AMOUNT), F.lower(F.regexp_extract(text, AMOUNT, 2))
    value = F.when(unit == "cl", value * 10).otherwise(value)
    return _weight(value, F.when(unit == "lbs", "lb").when(unit == "fl oz", "oz").when(unit == "cl", "ml").otherwise(unit))


def parse_grams(text: Column) -> Column:
    """Grams of a quantity, decimal commas read; null outside 0 to 25000 grams."""
    value = F.regexp_replace(F.regexp_extract(text, COMMA_AMOUNT, 1), ",", ".").try_cast("double")
    grams = value * _lookup(F.lower(F.regexp_extract(text, COMMA_AMOUNT, 2)), COARSE_GRAMS)
    return F.when((grams > 0) & (grams <= MOST_GRAMS), grams)


def to_grams(value: Column, unit: Column) -> Column:
    return value * _lookup(unit, GRAMS, 1.0)


def best_unit(grams: Column) -> Column:
    """A struct of value and unit: pounds from 2 lb on, ounces from 1 oz on, else grams; one decimal."""
    lb, oz = grams / COARSE_GRAMS["lb"], grams / COARSE_GRAMS["oz"]
    value = F.when(lb >= 2, F.round(lb, 1)).when(oz >= 1, F.round(oz, 1)).otherwise(F.round(grams, 1))
    return F.struct(value.alias("value"), F.when(lb >= 2, "lb").when(oz >= 1, "oz").otherwise("g").alias("unit"))


def weight_plausible(grams: Column, name: Column) -> Column:
    """At most 25 kg, and at least 20 g unless the name is of a condiment."""
    condiment = F.lower(name).rlike("|".join(fixed.CONDIMENTS))
    return F.coalesce((grams <= MOST_GRAMS) & ((grams >= LEAST_GRAMS) | condiment), F.lit(False))


def weight_ratio(a: Column, b: Column) -> Column:
    """How many times the larger is the smaller; 999 where either is 0."""
    return F.when((a == 0) | (b == 0), F.lit(NO_RATIO)).otherwise(F.greatest(a / b, b / a))
