"""Operators on small tables: each trap, plus properties."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from larder.operators import catalog, classify, fragments, lines, lookup, receipts, report, signals

DAY = dt.date(2026, 1, 1)


def _series(spark, values, key=1):
    return spark.createDataFrame([(key, i, DAY + dt.timedelta(i), float(v)) for i, v in enumerate(values)], "user_id int, day_index int, date date, calories double")


@pytest.mark.parametrize(("span", "days"), [(1, 28), (13, 28), (14, 14), (20, 20)])
def test_spine(spark, span, days):
    df = spark.createDataFrame([(1, DAY), (1, DAY + dt.timedelta(span - 1))], "user_id int, date date")
    assert signals.calendar_spine(df, "user_id").count() == days


def test_moving_average_divides_by_n(spark):
    df = signals.moving_average(_series(spark, [3, 0, 0, 6]), "user_id", ["calories"], 3)
    assert [r.calories_ma3 for r in df.orderBy("day_index").collect()] == [1, 1, 1, 2]
    flat = signals.moving_average(_series(spark, [5] * 20), "user_id", ["calories"], 7).where("day_index >= 6")
    assert {r.calories_ma7 for r in flat.collect()} == {5.0}


def test_detection(spark):
    d = signals.threshold_detect(F.col("calories"), F.col("day_index"), 5.0, 2)
    df = _series(spark, [0, 0, 4, 6])
    assert [r.d for r in df.withColumn("d", d).orderBy("day_index").collect()] == [0, 0, 1, 0]
    assert df.agg(signals.deficiency_rate(F.col("calories"), F.col("day_index"), 5.0, 2)).first()[0] == 0.5
    assert df.agg(signals.deficiency_rate(F.col("calories"), F.col("day_index"), 5.0, 9)).first()[0] == 0


def test_spectrum(spark):
    rows = [(1, i, DAY, int(i % 7 == 0), 0, int(i == 3)) for i in range(28)]
    df = spark.createDataFrame(rows, "user_id int, day_index int, date date, weekly int, never int, once int")
    spec = signals.dft(df, "user_id", ["weekly", "never", "once"])
    top = {r.signal: (r.k, r.period) for r in signals.dominant_period(spec, "user_id").collect()}
    assert top == {"weekly": (4, 7.0), "never": (1, 28.0), "once": (1, 28.0)}
    ratio = {r.signal: r.weekly_ratio for r in signals.weekly_strength(spec, "user_id").collect()}
    assert ratio["never"] == 0 and ratio["once"] == pytest.approx(1 / 13) and ratio["weekly"] == pytest.approx(1 / 3)
    # Parseval: all bins of a real signal hold n times its energy
    total = sum(r.magnitude**2 for r in spec.where("signal = 'weekly'").collect()) * 2 + 4**2 + sum((-1) ** i for i in range(0, 28, 7)) ** 2
    assert total == pytest.approx(28 * 4)
    reg = signals.regularity(signals.weekly_strength(spec, "user_id"), "user_id")
    assert [(r.signal, r.regularity) for r in reg.orderBy("rank").collect()] == [("weekly", "Regular"), ("once", "Irregular"), ("never", "Irregular")]


def test_snr_starts_at_first_purchase(spark):
    got = {r.n: r.snr for r in signals.snr(_series(spark, [0, 0, 2, 4]), "user_id", "calories", (3,)).collect()}
    assert got[1] == pytest.approx(9.0) and got[3] == pytest.approx((4 / 3) ** 2 / (4 / 9))


def test_nearest_rank_medians(spark):
    df = spark.createDataFrame([("en:cookies", f"{g} g") for g in (1, 2, 3, 4, 5, 6)] + [("en:milks", "1 l")], "categories string, quantity string")
    (r,) = catalog.category_medians(df).collect()
    assert (r.name, r.p25_g, r.median_g, r.p75_g, r.sample_count) == ("cookies", 2, 4, 5, 6)


def test_drop_junk_keeps_both_sides(spark):
    df = spark.createDataFrame([("Milk", "1 l"), ("AB", "1 l"), ("Bread", "99 kg")], "product_name string, quantity string")
    kept, dropped = catalog.drop_junk(df)
    assert [r.product_name for r in kept.collect()] == ["Milk"] and {r.reason for r in dropped.collect()} == {"too_short", "too_heavy"}


def test_impute_dates(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, dt.date(2026, 1, 10)), (1, 2, None), (2, 0, None), (2, 1, None)], "user_id int, i int, date date")
    got = {(r.user_id, r.i): r.date.isoformat() for r in receipts.impute_dates(df, "user_id", "date", "i", F.lit("2026-02-01").cast("date")).collect()}
    assert got == {(1, 0): "2026-01-07", (1, 1): "2026-01-10", (1, 2): "2026-01-11", (2, 0): "2026-01-24", (2, 1): "2026-01-28"}


def test_receipt_keys(spark):
    df = spark.createDataFrame([(1, i, DAY if i < 4 else None, s) for i, s in enumerate(["Trader Joe's", "H & M", "H & M", "", "x", "y"])], "user_id int, i int, date date, store string")
    got = [r.receipt_key for r in receipts.receipt_keys(df, "user_id", "date", "store", "i").orderBy("i").collect()]
    assert got == ["2026-01-01", "2026-01-01_h_and_m", "2026-01-01_h_and_m_2", "2026-01-01_2", "missing_date_001", "missing_date_002"]


def test_merge_duplicates(spark):
    rows = [(1, 0, "A", 1, None), (1, 1, "a", 1, 2.0), (2, 0, "A", 1, 1.5), (2, 1, "A", 2, 2.0), (3, 0, "B", None, 4.0)]
    got = {(r.receipt_id, r.name): (r.qty, r.line_price) for r in lines.merge_duplicates(spark.createDataFrame(rows, "receipt_id int, line_no int, name string, qty int, line_price double")).collect()}
    assert got == {(1, "A"): (2, None), (2, "A"): (3, 3.5), (3, "B"): (None, 4.0)}


def test_attach_modifiers(spark):
    labels = ["qty", "item", "qty", "qty", "weight", "item"]
    df = spark.createDataFrame([(1, i, f"t{i}", lab) for i, lab in enumerate(labels)], "receipt_id int, line_no int, text string, label string")
    got = [(r.line_no, r.qty_line, r.weight_line) for r in lines.attach_modifiers(df).orderBy("line_no").collect()]
    assert got == [(1, "t2", "t4"), (5, None, None)]


def test_pairs_of_names_and_prices(spark):
    cases = {1: "NNP", 2: "PN", 3: "NPN", 4: "NXP", 5: "NIP", 6: "PPN"}
    rows = [(r, i, k, f"n{i}" if k in "NI" else None, float(i) if k in "PI" else None) for r, kinds in cases.items() for i, k in enumerate(kinds)]
    got = {}
    for r in lines.pair_name_price(spark.createDataFrame(rows, "receipt_id int, line_no int, kind string, name string, price double")).collect():
        got.setdefault(r.receipt_id, []).append((r.name, r.price))
    assert got == {1: [("n1", 2.0)], 2: [("n1", 0.0)], 3: [("n0", 1.0)], 5: [("n1", 1.0)], 6: [("n2", 1.0)]}


def test_rule_parser(spark):
    text = ["TARGET", "GROCERY", "1.25 lb @ $3.99/lb", "BANANAS 4.99", "2 EA @ 1.50", "OAT MILK", "3.00", "BREAD 16 oz 2.00", "SUBTOTAL 9.99", "BALSAMIC 4.00", "TOTAL 11.99"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "receipt_id int, line_no int, text string")
    kinds = lines.line_kinds(df)
    assert [r.line_kind for r in kinds.orderBy("line_no").collect()] == ["header", "section", "weight", "item", "qty", "name", "noise", "item", "subtotal", "total", "total"]
    got = {r.name: (r.qty, r.line_price, r.weight["value"] if r.weight else None) for r in lines.rule_items(kinds).collect()}
    # a price alone is store noise by the pattern of price fragments, so it pairs with no name here
    assert got == {"BANANAS": (1, 4.99, 1.25), "BREAD 16 oz": (2, 2.0, 16.0)}


def test_sections_carry_forward(spark):
    df = spark.createDataFrame([(1, i, t, "item") for i, t in enumerate(["MILK", "HOME", "SOAP", "PRODUCE ITEMS", "KIWI"])], "receipt_id int, line_no int, text string, label string")
    assert [r.section for r in lines.active_section(df).orderBy("line_no").collect()] == ["", "HOME", "HOME", "PRODUCE ITEMS", "PRODUCE ITEMS"]
    assert [r.section for r in lines.active_section(df, exact=True).orderBy("line_no").collect()][3:] == ["HOME", "HOME"]


def test_store_over_two_lines(spark):
    text = {1: ["WHOLE", "FOODS MARKET"], 2: ["my shop", "MILK 3.99"], 3: ["thanks for", "shopping at walmart"]}
    df = spark.createDataFrame([(r, i, t) for r, ts in text.items() for i, t in enumerate(ts)], "receipt_id int, line_no int, text string")
    got = {r.receipt_id: r.store for r in lines.detect_store(df).collect()}
    assert got[1] is not None and got[2] is None and got[3] is not None and got[1] != got[3]


def test_rows_are_split_at_wide_gaps(spark):
    f = [(1, 10.0, 0.0, "WHOLE", 0.9), (1, 10.5, 50.0, "MILK", 0.9), (1, 16.0, 0.0, "OATS", 0.9), (1, 16.5, 50.0, "BREAD", 0.9), (1, 200.0, 0.0, "END", 0.9)]
    df = spark.createDataFrame(f, "receipt_id int, y double, x double, text string, conf double")
    rows = fragments.split_rows(df.select("receipt_id", F.when(F.col("y") < 100, 0).otherwise(1).alias("row_no"), "y", "x", "text"))
    assert sorted((r.row_no, r.part, r.text) for r in rows.collect()) == [(0, 0, "MILK"), (0, 0, "WHOLE"), (0, 1, "BREAD"), (0, 1, "OATS"), (1, 0, "END")]


def test_capitals_as_in_titles(spark):
    names = ["Ben & Jerry's", "7-Up light", "OAT MILK", "crème brûlée", "a1b c"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "t string").select(lookup.titled(F.col("t"))).collect()]
    assert got == [n.title() for n in names]


def test_hot_gram_is_split(spark, monkeypatch):
    monkeypatch.setattr(lookup, "PART", 3)
    names = [f"milk {i}" for i in range(20)] + ["bread", "oat milk"]
    n, t = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([("milk",), ("mil",), ("bread",)], "term string")
    got = sorted((r.term, r.name) for r in lookup.contains_join(t, n).collect())
    assert got == sorted((a, b) for a in ("milk", "mil", "bread") for b in names if a in b)


def test_purchase_insights(spark):
    items = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "b", 3)], "user_id int, name string, ord int")
    receipts_ = spark.createDataFrame([(1, " X ", 2.0), (1, "X", None), (1, "Y", 3.5)], "user_id int, store string, total double")
    found = report.purchase_insights(
        report.item_frequency(items, "user_id", "name", "ord"), report.store_visits(receipts_, "user_id", "store"), report.spending(receipts_, "user_id", "total"), "user_id", "name", "store"
    )
    assert {(r.section, r.name): r.value for r in found.collect()} == {("top_item", "b"): 2.0, ("top_store", "X"): 2.0, ("spending", "total"): 5.5, ("spending", "per_receipt"): 1.8333}


def test_fragments(spark):
    f = [(1, 10.0, 0.0, "MILK", 0.9), (1, 11.0, 90.0, "3.99", 0.9), (1, 12.0, 5.0, "MILK", 0.95), (1, 40.0, 0.0, "BREAD", 0.9), (1, 41.0, 80.0, "2.00", 0.3)]
    df = spark.createDataFrame(f, "receipt_id int, y double, x double, text string, conf double")
    kept = fragments.dedup_fragments(df)
    assert sorted((r.text, r.conf) for r in kept.collect()) == [("3.99", 0.9), ("BREAD", 0.9), ("MILK", 0.9), ("MILK", 0.95)]
    lines_ = [r.text for r in fragments.fragments_to_lines(df.where("conf > 0.3 and y <> 12")).orderBy("line_no").collect()]
    assert lines_ == ["MILK 3.99", "BREAD"]


def test_contains_join_equals_nested_loop(spark):
    names = ["whole milk", "oat milk drink", "bread", "a", "café au lait"]
    terms = ["milk", "oat", "k", "é", "whole milk", "zzz", "", "ad", "au l"]
    n, t = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in terms], "term string")
    got = {(r.term, r.name) for r in lookup.contains_join(t, n).collect()}
    assert got == {(a, b) for a in terms for b in names if a and a in b}


def test_tiers_and_resolution(spark):
    products = spark.createDataFrame([(1, "Organic Oat Milk", "B", "1 l", 50.0), (2, "Oat Milk", "B", "500 ml", 45.0), (3, "Rye Bread", "B", "", 200.0), (4, "Potato Chips", "B", "2 kg", 500.0)], "code long, product_name string, brands string, quantity string, energy_kcal double")
    names = spark.createDataFrame([("oat milk",), ("Milk",), ("my oat milk",), ("fresh oat",), ("rye",)], "name string")
    assert {r.name: (r.tier, r.code) for r in lookup.lookup_products(names, products).collect()} == {"oat milk": (0, 2), "Milk": (1, 1), "my oat milk": (2, 1), "fresh oat": (3, 1)}
    items = spark.createDataFrame([(1, "Oat Milk", 2, None, ""), (2, "Potato Chips", 1, None, ""), (3, "Banana", 1, None, ""), (4, "Soap", 1, None, "nonfood")], "i int, name string, qty int, weight struct<value:double,unit:string>, weight_source string").withColumn("resolved_name", F.lit(""))
    got = {r.i: (r.weight_source, r.weight_grams, r.actual and r.actual.energy_kcal) for r in lookup.resolve_items(items, products).collect()}
    assert got[1] == ("off_db", 1000.0, 450.0) and got[2][0] == "category_default_override" and got[3][0] == "category_default" and got[4] == ("nonfood", None, None)
    assert got[2][1] == round(4.8 * 28.3495, 2)


def test_report_tables(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "b", 3)], "user_id int, name string, ord int")
    assert [(r.name, r.n) for r in report.item_frequency(df, "user_id", "name", "ord").orderBy("rank").collect()] == [("b", 2), ("a", 1)]
    weeks = report.weekly_trend(_series(spark, [7.0] * 10), "user_id", "calories").orderBy("week").collect()
    assert [w["mean"] for w in weeks] == [7.0, 7.0, *[None] * 6]
    assert [r[0] for r in spark.createDataFrame([(79.9,), (80.0,), (100.0,)], "p double").select(report.band(F.col("p"))).collect()] == ["red", "amber", "green"]
    empty = report.store_visits(spark.createDataFrame([], "user_id int, store string"), "user_id", "store")
    assert empty.count() == 0


def test_boosted_line_classifier(spark):
    rows = [(1, i, i / 60, t, lab) for i, (t, lab) in enumerate([("MILK 3.99", "item"), ("TOTAL 9.00", "noise"), ("2 EA @ 1.00", "qty")] * 20)]
    df = spark.createDataFrame(rows, "receipt_id int, line_no int, line_pos double, text string, label string")
    model = classify.train_line_classifier(df, kind="gbt", trees=3, depth=2)
    out = classify.classify_lines(model, df)
    assert out.where("label = predicted").count() == 60 and out.where("confidence between 0 and 1").count() == 60


def test_line_classifier(spark):
    rows = [(1, i, i / 200, t, lab) for i, (t, lab) in enumerate([("MILK 3.99", "item"), ("TOTAL 9.00", "noise"), ("2 EA @ 1.00", "qty")] * 60)]
    df = spark.createDataFrame(rows, "receipt_id int, line_no int, line_pos double, text string, label string")
    model = classify.train_line_classifier(df, kind="forest", trees=5)
    out = classify.classify_lines(model, df)
    assert out.where("label = predicted").count() == 180 and out.where("confidence between 0 and 1").count() == 180
    assert len(classify.top_features(model)) == 15
    many = df.withColumn("receipt_id", (F.col("line_no") % 9).cast("int"))
    mean, deviation = classify.cv_accuracy(many, folds=2, kind="forest", trees=3)
    assert mean > 0.9 and 0 <= deviation < 0.1
    folds = classify.with_folds(many, 5).groupBy("receipt_id").agg(F.countDistinct("fold").alias("n"))
    assert {r.n for r in folds.collect()} == {1}
    assert math.isclose(sum(v for _, v in classify.top_features(model, 999)), 1.0, abs_tol=1e-6)
