"""Why a catalog row is junk: by name, quantity or language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .weights import COARSE_GRAMS, _lookup

# Script ranges, in the order they are tested
SCRIPTS = {"cyrillic": "[Ѐ-ӿ]", "chinese": "[一-鿿]", "arabic": "[؀-ۿ]", "japanese": "[぀-ヿ]", "korean": "[가-힯]"}


def junk_name_reason(name: Column) -> Column:
    """The first reason that fits, null for a good name. Lengths are of the trimmed name."""
    n = F.trim(name)
    reason = F.when(name.isNull() | (n == ""), "empty_name").when(F.char_length(n) <= 2, "too_short")
    reason = reason.when(n.rlike(r"^\d+%?\s"), "starts_with_number").when(n.rlike(r"^[\d\-.]+$"), "pure_number")
    for script, pattern in SCRIPTS.items():
        reason = reason.when(n.rlike(pattern), script)
    return reason


def junk_quantity_reason(quantity: Column) -> Column:
    """too_heavy over 25 kg, zero_weight at 0; null where nothing can be read."""
    pattern = r"(\d+(?:\.\d+)?)\s*(kg|g|lb|lbs|oz|ml|l|cl)\b"
    q = F.lower(F.trim(quantity))
    value = F.regexp_extract(q, pattern, 1).try_cast("double")
    grams = value * _lookup(F.regexp_extract(q, pattern, 2), COARSE_GRAMS)
    return F.when(grams > 25000, "too_heavy").when(value == 0, "zero_weight")


def foreign_words(name: Column) -> Column:
    """The marker words of other languages among the distinct words of a name, sorted."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-zA-ZäöüéèêàâîïôùûçñÄÖÜß]", " ")), r"\s+")
    return F.array_sort(F.array_intersect(words, F.array(*[F.lit(w) for w in fixed.FOREIGN_WORDS])))


def foreign_reason(name: Column, least: int = 2) -> Column:
    """non_english with up to three of the words, where ``least`` or more were found."""
    found = foreign_words(name)
    return F.when(F.size(found) >= least, F.concat(F.lit("non_english:"), F.array_join(F.slice(found, 1, 3), ",")))


def junk_reason(name: Column, quantity: Column) -> Column:
    """Name before quantity before language, without their details."""
    return F.coalesce(junk_name_reason(name), junk_quantity_reason(quantity), F.when(foreign_reason(name).isNotNull(), "non_english"))
