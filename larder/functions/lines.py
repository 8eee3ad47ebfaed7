"""Receipt lines as columns: noise, sections, prices, names, features, labels."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, matching

# Patterns of lines
ITEM = r"^(.+?)\s+(\d+\.\d{2})\s*-?\s*B?\s*$"
LAST_PRICE = r"\$?(\d+\.\d{2})\s*-?\s*$"
ONE_PRICE = r"\$?(\d+[.,]\d{2})"
PRICES = r"\$?\d+\.\d{2}"
WEIGHT_LINE = r"(?i)(\d+(?:\.\d+)?)\s*(lb|lbs|oz|kg|g)\s*(?:@|.*?/\s*(?:lb|oz|kg|g))"
DATES = [
    r"(?i)\.?DATE:\s*(\d{1,2}[/-]\d{1,2}[/-]\d{4})",
    r"(?i)((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4})",
    r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})",
    r"(\d{1,2}[/-]\d{1,2}[/-]\d{2})(?:[^0-9]|$)",
]
TAX_CODES = r"(?i)\s+(?:FC|FT|NF|TF\s*P|TP|FA|FB|FW|PC|NP|KF|[FTNXOAB])\s*$"
#: What is stripped from an item name, in order. $1 keeps what a pattern had to look at.
NAME_STRIPS = [
    (r"(?i)^\*?WT\s+", ""), (r"^[*#]+\s*", ""), (r"\s*\$\s*\d*\.?\d*\s*$", ""), (r"\s*\$$", ""),
    (r"^\d{4,15}(?:KF)?\s+", ""), (r"^\d{4,15}(?:-\d+)?\s+", ""), (r"^E\s+", ""), (r"^\d{4,15}\s+", ""), (r"^\^\s*", ""), (r"^\d\s+([A-Z])", "$1"), (TAX_CODES, ""),
    (r"\s*↓\s*$", ""), (r"(?i)\s+t\s+F\s*$", ""), (r"\s+\d{8,15}(?:KF)?\s*$", ""), (r"(?i)\s+NF\s*\$?\s*$", ""), (r"(?i)\s+[FTNXOAB]\s*\$\s*$", ""),
    (r"\s+\d{9,15}\s+", " "), (r"\s+\d{9,15}\s*$", ""), (r"(?i)\s+APPROVED.*$", ""), (r"^[.:()]+\s*|\s*[.:()]+$", ""), (r"^\d\s+([A-Z]{2})", "$1"),
]
#: Date and time before other text; product codes inside a line.
STAMP = r"(?i)^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\s+\d{1,2}:\d{2}(?:\s*[AP]M)?)\s+(.{10,})$"
CODE_BEGINS, NEXT_CODE = r"(^|\s)(\d{9,13}\s)", r"( )(\d{9,13}\s)"
#: Names that are no items, counts of quantity lines and their units of twelve.
STORE_LINE = r"(?i)^[A-Z],\s+\w+\s+STORE"
TILL_WORDS = ["USD", "CAD", "TILL", "VISA", "LEOSO"]
QUANTITY = r"(?i)^\s*(\d+)\s*(EA|EACH|PC|PCS|DZ|DOZ|DOZEN)?\b"
DOZENS = ["DZ", "DOZ", "DOZEN"]
#: What name resolution mends, and the marks that stand for prices, codes and numbers, in order.
CUT_OUNCES, LAST_COUNT, POSSESSIVE = r"(?i)(\d+(?:\.\d+)?)\s*o\b", r"\s+\d+\.\s*$", "['’][sS]$"
OUTER_MARKS = "'\".,;:"
KEPT = frozenset(fixed.KEPT_UPPER)
LINE_MARKS = [
    (r"\$?\d+\.\d{2}", " _PRICE_ "), (r"\d{6,}", " _UPC_ "), (r"\d+", " _NUM_ "), (r"[^\p{L}\p{N}\s@#%_]", " "), (r"\s+", " "),
]
FOREIGN_SCRIPT = r"^[　-鿿가-힯\s/\[\]()·]+$"


def any_of(words: list[str]) -> str:
    """A pattern that finds any of the words, literally."""
    return "|".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", w) for w in words)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def fix_units(text: Column) -> Column:
    """``1b`` misread for ``lb``."""
    return F.regexp_replace(text, r"\b1b\b", "lb")


def unmerged(text: Column) -> Column:
    """The lines that a merged line holds: date and time before ten or more other characters are a line of their
    own; with two or more codes of 9 to 13 digits each begins a line."""
    dated = F.array(F.trim(F.regexp_extract(text, STAMP, 1)), F.trim(F.regexp_extract(text, STAMP, 2)))
    padded = F.concat(text, F.lit(" "))
    # two passes, as a match takes the space that a following code would begin with
    marked = F.regexp_replace(F.regexp_replace(padded, CODE_BEGINS, "\u0001$2"), NEXT_CODE, "\u0001$2")
    parts = F.filter(F.transform(F.split(marked, "\u0001"), lambda p: F.trim(p)), lambda p: p != "")
    many = F.size(F.split(marked, "\u0001")) > 2
    return F.when(text.rlike(STAMP), dated).when(many, parts).otherwise(F.array(F.trim(text)))


def is_noise(name: Column) -> Column:
    """Receipt metadata by keyword; short keywords only as words of texts of at most three words."""
    n = F.upper(F.trim(name))
    short = r"\b(?:" + any_of([w for w in fixed.NOISE_WORDS if len(w) <= 4]) + r")\b"
    long = any_of([w for w in fixed.NOISE_WORDS if len(w) > 4])
    few = r"^(?:\S*\s+){0,2}\S*$"  # three words at most
    words = matching.which(n, [short, few, long])
    return F.coalesce((F.char_length(n) <= 1) | n.startswith("*") | (words.bitwiseAND(3) == 3) | (words.bitwiseAND(4) != 0), F.lit(True))


def is_store_noise(text: Column) -> Column:
    """Any of the store patterns; those that ignore case are one alternation, the others another."""
    t = F.trim(text)
    loose = [p.removeprefix("(?i)") for p in fixed.NOISE_PATTERNS if p.startswith("(?i)")]
    strict = [p for p in fixed.NOISE_PATTERNS if not p.startswith("(?i)")]
    return matching.is_found(t, "(?i)" + "|".join(loose), "|".join(strict))


def section_header(text: Column, exact: bool = False) -> Column:
    """The line in capitals where it is, or begins with, a section name; else null."""
    t = F.upper(F.trim(text))
    pattern = "^(?:" + any_of(fixed.SECTION_HEADERS) + ")" + ("$" if exact else "")
    return F.when(matching.is_found(t, pattern), t)


def extract_date(text: Column) -> Column:
    """The date spelled in a line, by the first of four patterns that fits."""
    return F.rtrim(F.trim(F.coalesce(*[found(text, p) for p in DATES])), F.lit(","))


def split_price(text: Column) -> Column:
    """A struct of name and price: name, blank, price; or a price at the end; else no price."""
    item, last = matching.groups(text, ITEM), matching.groups(text, LAST_PRICE)
    name = F.trim(F.coalesce(item["g1"], matching.replaced(text, [(LAST_PRICE, "")], trim=False)))
    return F.struct(name.alias("name"), F.coalesce(item["g2"], last["g1"]).try_cast("double").alias("price"))


def strip_name(text: Column, strips: list[tuple[str, str]]) -> Column:
    return matching.replaced(text, strips)


def clean_item_name(name: Column) -> Column:
    return strip_name(name, NAME_STRIPS)


def strip_codes(name: Column) -> Column:
    """Product codes and tax letters only, as before a fuzzy search."""
    return strip_name(F.trim(name), NAME_STRIPS[4:16])


def valid_item(name: Column) -> Column:
    """A name that can be an item: letters, no noise, no payment words, no listed brands that are no food."""
    upper = F.upper(F.trim(name))
    letters, = matching.lengths_without(name, [r"[^\p{L}]"])
    bad = is_noise(name) | is_store_noise(name) | (letters < 3) | matching.is_found(upper, any_of(fixed.PAYMENT_WORDS)) | upper.isin(fixed.NONFOOD_BRANDS)
    bad = bad | upper.isin(TILL_WORDS) | matching.is_found(name, STORE_LINE, FOREIGN_SCRIPT)
    return F.coalesce(~bad, F.lit(False))


def parse_qty(line: Column) -> Column:
    """Leading count of a quantity line, dozens times twelve; 1 without one."""
    found = matching.groups(line, QUANTITY)
    count = found["g1"].try_cast("int")
    return F.coalesce(F.when(F.upper(found["g2"]).isin(DOZENS), count * 12).otherwise(count), F.lit(1))


def line_weight(line: Column) -> Column:
    """Weight of a line like ``1.25 lb @ $3.99/lb``."""
    found = matching.groups(line, WEIGHT_LINE)
    unit, value = F.lower(found["g2"]), found["g1"].try_cast("double")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.when(unit == "lbs", "lb").otherwise(unit).alias("unit")))


def _written_out(word: str) -> str:
    """A word without its misspelling or abbreviation, looked up once."""
    mended = fixed.MISSPELLINGS.get(word.upper(), word)
    return fixed.ABBREVIATIONS.get(mended.upper().strip(OUTER_MARKS), mended)


def _shown(word: str) -> str:
    if "0" <= word[0] <= "9":
        return word
    upper = word.upper()
    return upper if upper in KEPT else word[0].upper() + word[1:].lower()


def _resolved(names: pa.Array) -> pa.Array:
    """The names of a batch resolved; each of its words is looked up once."""
    for pattern, kept in ((CUT_OUNCES, r"\1oz"), (LAST_COUNT, "")):
        names = pc.replace_substring_regex(names, pattern, kept)
    owned = pc.match_substring_regex(names, POSSESSIVE).to_pylist()
    for pattern, kept in ((POSSESSIVE, ""), ("([a-z])([A-Z])", r"\1 \2"), (r"\s+", " ")):
        names = pc.replace_substring_regex(names, pattern, kept)
    out, spelled, shown = [], {}, {}
    for name, own in zip(names.to_pylist(), owned, strict=True):
        words = [w for w in name.split(" ") if w]
        for w in words:
            if w not in spelled:
                spelled[w] = _written_out(w)
        full = " ".join([spelled[w] for w in words])
        if own and not full.endswith("s"):
            full += "s"
        words = [w for w in full.split(" ") if w]
        for w in words:
            if w not in shown:
                shown[w] = _shown(w)
        out.append(" ".join([shown[w] for w in words]))
    return pa.array(out, pa.string())


def resolve_name(name: Column) -> Column:
    """Misspellings mended, abbreviations written out, words capitalised; measures and listed words keep their case."""

    @F.arrow_udf("string")
    def resolve(t: pa.Array) -> pa.Array:
        return matching.once(t, _resolved)

    return resolve(F.trim(name))


def normalize_line(text: Column) -> Column:
    """Lower case with prices, codes and numbers as marks, for n-grams."""
    return F.trim(matching.replaced(F.lower(F.trim(text)), LINE_MARKS, trim=False))


# Features by pattern. The first list is of the wide feature set, the second of the positional one.
FLAGS_A = {
    "has_price": r"\d+\.\d{2}", "has_dollar": r"\$", "ends_with_price": r"\d+\.\d{2}\s*$", "has_tax_code": r"\s[FTNXOAB]\s*$", "starts_with_upc": r"^\d{8,15}", "has_date": r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}",
    "starts_with_date": r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", "has_time": r"\d{1,2}:\d{2}", "has_month_name": r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)", "has_phone": r"\d{3}[\-.)+]\d{3}[\-.)+]\d{4}",
    "has_address": r"(?i)\b(?:Ave|St|Blvd|Rd|Dr|Ln|Ct|Way|Hwy)\b", "has_zip": r"\b\d{5}(?:\-\d{4})?\b", "has_state": r"\b(?:WA|CA|OR|TX|NY|FL|IL|PA|OH|GA)\b", "has_total": "(?i)TOTAL", "has_subtotal": "(?i)SUBTOTAL",
    "has_tax": r"(?i)\bTAX\b", "has_change": "(?i)CHANGE", "has_card": "(?i)VISA|MASTERCARD|DEBIT|CREDIT|CARD", "has_aid": r"(?i)AID\s*:", "has_auth": "(?i)AUTH", "has_return": "(?i)RETURN", "has_save": "(?i)SAVE|SAVING",
    "has_ea": r"(?i)\b\d+\s*(?:EA|EACH)\b", "has_qty_prefix": r"(?i)^\s*\d+\s*(?:EA|EACH|PC|PCS|DZ|@)", "has_weight": r"(?i)\d+\.?\d*\s*(?:lb|lbs|oz|kg|g)\b", "has_at_per": r"(?i)@|per\s*(?:lb|oz|kg)",
}
FLAGS_B = {
    "has_dollar_sign": r"\$", "ends_with_price": r"\$?\d+\.\d{2}\s*-?\s*$", "has_price": r"\$?\d+\.\d{2}", "has_negative_price": r"\d+\.\d{2}\s*-", "starts_with_digits": r"^\d", "starts_with_long_number": r"^\d{6,}",
    "is_all_digits_symbols": r"^[\d\s#*=.$]+$", "has_weight_unit": r"(?i)\b(oz|lb|lbs|kg|g)\b", "has_each": r"(?i)EACH| EA | EA$", "has_organic": "(?i)ORG", "has_off": r"(?i)\boff\b", "has_saved": "(?i)SAVED",
    "has_coupon": "(?i)COUPON|CPN|CARTWHEEL", "has_discount": "(?i)DISCOUNT|SAVINGS", "has_subtotal": "(?i)SUBTOTAL", "has_total": "(?i)TOTAL", "has_tax": "(?i)TAX", "has_payment": "(?i)VISA|CASH|DEBIT|CREDIT|CARD",
    "has_store_name": "(?i)WHOLE FOODS|TRADER JOE|WALMART|COSTCO|TARGET|KROGER|SAFEWAY", "has_address_pattern": r"(?i)\d+\s+\w+\s+(St|Rd|Ave|Blvd|Dr)\b", "has_phone": r"\(\d{3}\)\s*\d{3}",
    "has_date": r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", "has_time": r"(?i)\d{1,2}:\d{2}\s*(AM|PM)", "has_at_sign": "@", "has_qty_pattern": r"(?i)\d+\s*(EA|DZ)\b", "has_weight_price": r"(?i)\d+\.\d+\s*(lb|oz|kg)\s*@",
    "has_per_unit": r"(?i)/\s*(lb|oz|kg|ea)\b", "has_tare": "(?i)TARE", "has_tax_code": r"\b(FC|T)\s+\$?\d+\.\d{2}",
}


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _counts(text: Column, *keep: str) -> list[Column]:
    return matching.lengths_without(text, [f"[^{k}]" for k in keep])


def _flags(text: Column, patterns: dict[str, str]) -> dict[str, Column]:
    found = matching.which(text, list(patterns.values()))
    return {name: F.getbit(found, F.lit(i)).cast("int") for i, name in enumerate(patterns)}


def line_features_a(text: Column) -> dict[str, Column]:
    """33 features of a line: counts, shares, flags."""
    t = F.trim(text)
    chars = F.char_length(t)
    alpha, digits, upper, special = matching.lengths_without(t, [r"[^\p{L}]", "[^0-9]", r"[^\p{Lu}]", r"[\p{L}\p{N}\s]"])
    out = {
        "n_words": F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))), "n_chars": chars, "alpha_ratio": _ratio(alpha, chars), "digit_ratio": _ratio(digits, chars),
        "upper_ratio": _ratio(upper, alpha), "special_ratio": _ratio(special, chars), "n_prices": matching.times(t, r"\d+\.\d{2}"),
    }
    return out | _flags(t, FLAGS_A)


def line_features_b(text: Column, pos: Column) -> dict[str, Column]:
    """38 features of a line and its position from 0 to 1."""
    t = F.trim(text)
    chars = F.char_length(t)
    alpha, digits, upper, lower = _counts(t, r"\p{L}", "0-9", r"\p{Lu}", r"\p{Ll}")
    out = {
        "char_count": chars, "word_count": F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))), "line_pos": F.round(pos, 3), "is_top_10pct": (pos < 0.1).cast("int"), "is_bottom_20pct": (pos > 0.8).cast("int"),
        "price_count": matching.times(t, PRICES), "digit_ratio": F.round(_ratio(digits, chars), 3), "upper_ratio": F.round(_ratio(upper, alpha), 3),
        "has_mixed_case": ((upper > 0) & (lower > 0)).cast("int"),
    }
    return out | _flags(t, FLAGS_B)


# Label rules in their order; the first list holds only near the top of a receipt.
TOP_RULES = ["(?i)WHOLE FOODS|TRADER JOE|TARGET|WALMART|COSTCO", r"(?i)\d+\s+\w+\s+(St|Rd|Ave|Blvd)\b", r"\(\d{3}\)", r"(?i)STORE\s*#", r"(?i)OPEN\s+\d", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"]
LABEL_RULES = [
    ("header", r"(?i)^(?:CLEANING SUPPLIES|GROCERY|HEALTH-BEAUTY-COSMETICS|HOME)$"), ("header", "(?i)EXPECT MORE|PAY LESS|EXPIRES"), ("metadata", "(?i)SUBTOTAL|TAX|TOTAL"), ("metadata", r"(?i)BAL.*\d+\.\d{2}|\d+\.\d{2}.*BAL"),
    ("metadata", "(?i)VISA|CASH|DEBIT|CREDIT|APPROVED|AUTH CODE|CARD #|TRANS ID|REDCARD"), ("discount", r"(?i)\boff\b"), ("discount", r"\d+\.\d{2}\s*-\s*$"), ("discount", r"\$\d+\.\d{2}\s*-"), ("discount", r"(?i)^Cartwheel\b"),
    ("discount", r"(?i)^Saved\b"), ("discount", r"(?i)^\*(?:[^W]|W[^T]|W?$)"), ("weight", r"(?i)\d+\.\d+\s*(lb|oz|kg)\s*(@|.*?/\s*(lb|oz|kg))"), ("weight", "(?i)TARE"), ("qty", r"(?i)@.*\d+\s*(EA|DZ)\b|\d+\s*(EA|DZ)\b.*@"),
    ("qty", r"^\d+\s*@\s*\$?\d+\.\d{2}"), ("noise", r"^[\d\s#*=.$]+$"), ("noise", r"(?i)^(ITEM|TARE)\b"), ("noise", "^.{0,2}$"), ("item", r"\$?\d+\.\d{2}\s*-?\s*B?\s*$"), ("item", r"^(?:.*\p{L}.{3,}|.+\p{L}.{2,}|.{2,}\p{L}.+|.{3,}\p{L}.*)$"),
]


def rule_label(text: Column, pos: Column) -> Column:
    """item, discount, header, metadata, qty, weight or noise, by the first rule that fits."""
    t = F.trim(text)
    top = matching.first_fit(F.when(pos < 0.15, t), [("header", p) for p in TOP_RULES])
    return F.coalesce(F.when(F.char_length(t) <= 1, "noise"), top, matching.first_fit(t, LABEL_RULES), F.lit("noise"))


def kind(text: Column) -> Column:
    """The text as far as its rule label, positional features and normalised form tell it from others: with 0 for every digit, as long as
    none of their patterns tells one digit from another."""
    patterns = [*TOP_RULES, *[p for _, *rule in LABEL_RULES for p in rule], *FLAGS_B.values(), *[p for p, _ in LINE_MARKS], PRICES]
    return F.translate(text, "0123456789", "0" * 10) if matching.blind(*patterns) else text
