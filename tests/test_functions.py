"""Scalar functions on literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larder.functions import dates, fixed, lines, quality, weights
from larder.operators import catalog, lookup, receipts


def _of(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def _pairs(rows):
    return [None if r is None else (r["value"], r["unit"]) for r in rows]


def test_table_sizes():
    sizes = {"FOOD_KEYWORDS": 83, "ABBREVIATIONS": 184, "NOISE_PATTERNS": 137, "STORES": 39, "DEFAULT_WEIGHTS": 143, "BRANDS": 81, "STAPLES": 86, "TAG_NAMES": 151, "FOREIGN_WORDS": 87, "GENERIC_WORDS": 46}
    assert {k: len(getattr(fixed, k)) for k in sizes} == sizes


def test_quantities(spark):
    assert _pairs(_of(spark, ["16oz", "12 fl oz", "33 cl", "1,5 l", "abc", None], weights.parse_quantity)) == [(16, "oz"), (12, "oz"), (330, "ml"), (5, "l"), None, None]
    assert _of(spark, ["1,5 kg", "26 kg", "0 g", "2 lbs"], weights.parse_grams) == [1500, None, None, pytest.approx(907.2)]
    assert _pairs(_of(spark, ["MILK 16 o", "0 oz", "2 LBS", None], weights.extract_weight)) == [(16, "oz"), None, (2, "lb"), None]
    assert _pairs(_of(spark, [1000.0, 200.0, 20.0], weights.best_unit, "double")) == [(2.2, "lb"), (7.1, "oz"), (20.0, "g")]
    assert _of(spark, [0.0, 2.0, 8.0], lambda c: weights.weight_ratio(c, F.lit(4.0)), "double") == [999.0, 2.0, 2.0]
    assert _of(spark, [10.0, 20.0, 30000.0], lambda c: weights.weight_plausible(c, F.lit("Sea Salt")), "double") == [True, True, False]


def test_junk_names(spark):
    names = ["", "AB", "100 Calorie Packs", "3x Whiter", "123-456", "Сок", "牛奶", "Milk", None]
    assert _of(spark, names, quality.junk_name_reason) == ["empty_name", "too_short", "starts_with_number", None, "pure_number", "cyrillic", "too_short", None, "empty_name"]
    assert _of(spark, ["26 kg", "0 g", "5 oz", None], quality.junk_quantity_reason) == ["too_heavy", "zero_weight", None, None]
    assert _of(spark, ["Milch und Brot", "Milk bread", "Pain"], quality.foreign_reason) == ["non_english:brot,milch,und", None, None]


def test_food_categories(spark):
    assert _of(spark, ["Organic Banana", "Regular", "Ribeye Steak", "Loo", ""], receipts.food_category) == ["Produce", "Snacks", "Beverages", "Other", "Produce"]
    assert _of(spark, ["Regular", ""], lambda c: receipts.food_category(c, strict=True)) == ["Other", "Other"]


def test_dates(spark):
    day = lambda r: None if r is None else r.isoformat()
    assert [day(r) for r in _of(spark, ["02-10-2026", "Feb 10, 2026", "FEBRUARY 3, 2026", "2/1/26", "1/5/75", "Feb 10 2026", "soon", None], dates.parse_date)] == ["2026-10-02", "2026-02-10", "2026-02-03", "2026-02-01", "1975-01-05", None, None, None]
    other = lambda c: dates.parse_date(c, fixed.RECEIPT_DATE_FORMATS)
    assert [day(r) for r in _of(spark, ["02-10-2026", "Feb 10 2026"], other)] == ["2026-02-10", "2026-02-10"]


def test_names_of_items(spark):
    dirty = ["*WT BANANA", "004011 ORG APPLE FC", "GG CREAM 261050447 GHIRARDELLI", "2 MILK $3.99", "BREAD APPROVED . THANK YOU"]
    assert _of(spark, dirty, lines.clean_item_name) == ["BANANA", "ORG APPLE", "GG CREAM GHIRARDELLI", "MILK", "BREAD"]
    assert _of(spark, ["ORG CHKN BRST 16 o", "STRAWBERIES", "TJ's", "365 oatMilk"], lines.resolve_name) == ["Organic Chicken Breast 16oz", "Strawberries", "Trader Joe's", "365 Oat Milk"]
    assert _of(spark, ["3 EA @ 1.99", "2 DZ", "x", None], lines.parse_qty) == [3, 24, 1, 1]
    assert _of(spark, ["MILK 3.99", "TOTAL", "X", "APPLES", "VISA"], lambda c: lines.valid_item(lines.split_price(c)["name"])) == [True, False, False, True, False]
    assert _of(spark, ["DATE: 02/10/2026 x", "Feb 3, 2026", "1/2/26", "none"], lines.extract_date) == ["02/10/2026", "Feb 3, 2026", "1/2/26", None]


def test_labels_and_features(spark):
    label = lambda c: lines.rule_label(c, F.lit(0.5))
    texts = ["MILK 3.99", "SUBTOTAL 5.00", "2 EA @ $1.99", "1.25 lb @ $3.99/lb", "$1 off", "GROCERY", "*SALE", "*WT APPLES 2.00", "12", "Bread", "abc"]
    assert _of(spark, texts, label) == ["item", "metadata", "qty", "weight", "discount", "header", "discount", "item", "noise", "item", "noise"]
    assert _of(spark, ["WALMART"], lambda c: lines.rule_label(c, F.lit(0.0))) == ["header"]
    assert len(lines.line_features_a(F.lit(""))) == 33 and len(lines.line_features_b(F.lit(""), F.lit(0.0))) == 38
    assert _of(spark, ["Milk 2% $3.99 x123456 77"], lines.normalize_line) == ["milk _NUM_ % _PRICE_ x _UPC_ _NUM_"]


def test_token_set_ratio(spark):
    pairs = [("A B", "B A C"), ("", "A"), ("ABC", "ABD"), ("FUJI APPLE", "FUJI PEAR"), (None, "A"), ("A A  B", "B\u00a0A")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.score for r in lookup.token_set_ratios(rows, F.col("a"), F.col("b")).orderBy("i").collect()]
    assert got == pytest.approx([100, 0, 200 / 3, max(100 * 2 * 7 / 19, 100 * 8 / 14, 100 * 8 / 13), 0, 100])
    assert lookup.token_set_ratios(rows, F.col("a"), F.col("b"), 75).count() == 2


def test_nested_catalog_columns(spark):
    rows = [([("fr", "Lait"), ("en", " ")],), ([("fr", " "), ("de", " Milch ")],), ([],), (None,)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n array<struct<lang:string,text:string>>")
    assert [r[0] for r in df.orderBy("i").select(catalog.pick_localized(F.col("n"))).collect()] == ["", "Milch", None, None]
    assert _of(spark, [["a", "", None, "b"], [], None], catalog.join_tags, "array<string>") == ["a,b", None, None]
