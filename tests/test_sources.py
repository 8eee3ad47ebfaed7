"""Reading and writing, the stream of receipts, and the registered queries against their SQL."""

from __future__ import annotations

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from larder.operators import classify, receipts, signals
from larder.plans.queries import ORACLE_SQL, QUERIES
from larder.sources import readers, writers
from larder.streaming.receipts import append_receipts

SMALL = "/root/testdata/sf0.001"
RECEIPT = {"store_name": "Shop", "date": "", "receipt_date": "2026-02-09", "total": "$1,012.50", "items": [
    {"original_name": "MLK", "matched_name": "Milk", "nutrition": {"calories": 60.0, "protein_g": 3.0}, "status": "matched", "price": 2.0}, {"original_name": "SOAP", "status": "unmatched"}], "totals": {"calories": 0.0}}


def test_receipts_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECEIPT, indent=1))
    (tmp_path / "b.json").write_text("{not json")
    raw = readers.read_receipts(spark, [str(tmp_path / "*.json"), str(tmp_path / "a.json")])
    (r,) = receipts.normalize_receipts(raw).collect()
    assert (r.date_text, r.store, r.total_price, len(r["items"]), r.totals.calories) == ("2026-02-09", "Shop", 1012.5, 1, 60.0)
    assert (r["items"][0].food_name, r["items"][0].portion_g, r["items"][0].fat_g) == ("Milk", 100.0, 0.0)


def test_receipts_of_an_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([RECEIPT, RECEIPT | {"store_name": "Other"}]))
    (tmp_path / "b.json").write_text(json.dumps(RECEIPT))
    (tmp_path / "c.json").write_text("")
    raw = readers.read_receipts(spark, [str(tmp_path), str(tmp_path / "*.json")])
    assert raw.count() == 3 and sorted(r.store_name for r in raw.collect()) == ["Other", "Shop", "Shop"]


def test_products_signal_history_and_models(spark, tmp_path):
    nested = spark.createDataFrame(
        [("1", [("en", "Milk")], "B", "1 l", ["en:milks"], [("fat", "3.5")], 9)],
        "code string, product_name array<struct<lang:string,text:string>>, brands string, quantity string, categories_tags array<string>, nutriments array<struct<name:string,`100g`:string>>, other int",
    )
    nested.write.parquet(str(tmp_path / "products"))
    assert readers.read_products(spark, str(tmp_path / "products")).columns == ["code", "product_name", "brands", "quantity", "categories_tags", "nutriments"]
    history = [{"receipt_id": 1, "date": "2026-01-28", "day_index": 0, "store": "", "total_price": "", "n_items": 1, "items": [{"food_name": "Milk", "calories": 61}], "totals": {"calories": 61}}, {"receipt_id": 2, "date": "2026-02-09", "total_price": 12.5}]
    (tmp_path / "h.json").write_text(json.dumps(history))
    read = readers.read_history(spark, str(tmp_path / "h.json")).orderBy("receipt_id")
    assert [(r.receipt_id, r.total_price) for r in read.collect()] == [(1, None), (2, 12.5)]
    writers.write_history(read, str(tmp_path / "history"))
    assert readers.read_history(spark, str(tmp_path / "history"), lines=True).count() == 2
    items = spark.createDataFrame([("Oats", "Oats", 1, (12.0, "oz"), 340.2, "receipt", 2.5)], "name string, resolved_name string, qty int, weight struct<value:double,unit:string>, weight_grams double, weight_source string, line_price double")
    nutrients = F.struct(*[F.lit(1.0).alias(n) for n in writers.fixed.NUTRIENTS])
    writers.write_items(items.withColumns({"per100": nutrients, "actual": nutrients}), str(tmp_path / "items"))
    assert len(spark.read.csv(str(tmp_path / "items/csv"), header=True).columns) == 26 and spark.read.json(str(tmp_path / "items/json")).count() == 1
    medians = spark.createDataFrame([("milk", 1.0, "lb", 5, 1.0, 2.0, 3.0)], "name string, value double, unit string, sample_count int, p25_g double, median_g double, p75_g double")
    writers.write_medians(medians, str(tmp_path / "medians"))
    assert spark.read.json(str(tmp_path / "medians/simple")).columns == ["name", "unit", "value"]
    model = classify.train_line_classifier(spark.createDataFrame([(i / 9, t, lab) for i in range(9) for t, lab in (("MILK 3.99", "item"), ("TOTAL 9.00", "noise"))], "line_pos double, text string, label string"), kind="forest", trees=2)
    writers.save_model(model, str(tmp_path / "model"))
    assert len(writers.load_model(str(tmp_path / "model")).stages) == len(model.stages)


def test_golden_signal_of_the_sample(spark, tmp_path):
    # rates and means over 36 days, computed beforehand with plain arithmetic from daily calories: zero days and three purchases
    days = [(i, 0.0) for i in range(36)]
    for i, c in ((0, 700.0), (9, 2500.0), (20, 1900.0)):
        days[i] = (i, c)
    text = "day_index,date,calories,protein_g,carbs_g,fat_g,fiber_g,cat_beverages,cat_dairy,cat_grains,cat_meat,cat_produce,cat_snacks\n"
    (tmp_path / "d.csv").write_text(text + "".join(f"{i},2026-02-{1 + i % 28:02d},{c},0,0,0,0,0,0,0,0,0,0\n" for i, c in days))
    rows = readers.read_signal(spark, str(tmp_path / "d.csv"))
    assert rows.count() == 36 and dict(rows.dtypes)["cat_snacks"] == "int"
    smooth = signals.moving_average(rows.withColumn("user_id", F.lit(1)), "user_id", ["calories"], 7)
    raw, ma = smooth.agg(signals.deficiency_rate(F.col("calories"), F.col("day_index"), 1800.0, 0), signals.deficiency_rate(F.col("calories_ma7"), F.col("day_index"), 1800.0, 2)).first()
    assert raw == pytest.approx(34 / 36) and ma == 1.0
    assert smooth.where("day_index = 15").first().calories_ma7 == pytest.approx(2500 / 7)


def test_food_csvs_with_optional_ones_missing(spark, tmp_path):
    (tmp_path / "food.csv").write_text('fdc_id,data_type,description,food_category_id\n1,x,"Milk, whole",2\n')
    (tmp_path / "food_nutrient.csv").write_text("id,fdc_id,nutrient_id,amount\n9,1,1008,61\n10,1,1093,n/a\n")
    t = readers.read_food_csvs(spark, str(tmp_path))
    assert t["food"].first().description == "Milk, whole" and t["food_nutrient"].count() == 2 and t["food_portion"].count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 2.5), (2, 0, 1.0)], "user_id int, day_index int, calories double")
    writers.write_signal(df, str(tmp_path / "s"), "user_id")
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 2
    out = str(tmp_path / "runs")
    writers.write_run(df, out, "2026-01-01")
    writers.write_run(df.where("user_id = 1").withColumn("calories", F.lit(9.0)), out, "2026-01-01")
    writers.write_run(df, out, "2026-01-02")
    got = {(r.user_id, str(r.run_date)): r.calories for r in spark.read.parquet(out).collect()}
    assert got == {(1, "2026-01-01"): 9.0, (2, "2026-01-01"): 1.0, (1, "2026-01-02"): 2.5, (2, "2026-01-02"): 1.0}
    writers.write_catalog(df, str(tmp_path / "c"))
    writers.write_catalog(df.limit(1), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_annotations_keep_file_order(spark, tmp_path):
    for i, label in enumerate(("", "qty")):
        (tmp_path / f"{i}.csv").write_text(f"image,line_num,line_pos,text,auto_label,corrected_label\na.png,0,0.0,x,item,{label}\n")
    from larder.operators.classify import merge_annotations

    rows = readers.read_annotations(spark, [str(tmp_path / "0.csv"), str(tmp_path / "1.csv")])
    (r,) = merge_annotations(rows).collect()
    assert r.corrected_label == "qty" and r.first_seen.file_ord == 0
    assert readers.read_annotations(spark, []).count() == 0


def test_stream_adds_each_receipt_once(spark, tmp_path):
    src, table, point = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "point")
    src.mkdir()
    for n, name in enumerate(("a", "b")):
        (src / f"{name}.json").write_text(json.dumps(RECEIPT))
        append_receipts(spark, str(src), table, point).awaitTermination(60)
        assert spark.read.parquet(table).count() == n + 1
    append_receipts(spark, str(src), table, point).awaitTermination(60)  # nothing new
    assert spark.read.parquet(table).count() == 2
    # the last batch did its work but was not noted as done: it runs again and replaces what it wrote
    (tmp_path / "point" / "commits" / "1").unlink()
    (tmp_path / "point" / "commits" / ".1.crc").unlink(missing_ok=True)
    append_receipts(spark, str(src), table, point).awaitTermination(60)
    assert spark.read.parquet(table).count() == 2 and {r["batch"] for r in spark.read.parquet(table).collect()} == {0, 1}


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["user_id", "nutrient", "target", "d_raw", "d_ma", "flag"] and df.count() > 0
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(__spark_entry__.queries())


CHECKED = [
    "ag9_impute_dates", "ag11_daily_signal", "ag15_receipt_keys", "sg4_smoothed_signal", "sg8_detection_report", "sg13_dominant_period", "rp2_item_prices", "rp10_insights", "cat3_extract_named", "cat10_build_foods",
    "wt8_category_medians", "dq4_junk_reason", "dq5_quality_totals", "cat10_build_report", "cat11_distinct_categories", "ag18_run_summary", "rp10_purchase_insights", "ln9_detect_store", "ln11_receipt_totals", "ln20_rule_items", "ln26_split_rows", "lk2_contains_join", "lk9_fuzzy_match", "lk13_resolve_items", "lk14_resolve_with_foods", "sg12_dft", "ln16_parse_qty", "lk1_lookup_products", "lk2_contains_join", "lk7_lookup_foods", "ln5_rule_label", "ln7_active_section", "ln17_extract_items", "ln18_pair_name_price", "ln21_merge_duplicates", "ln24_fragments_to_lines", "ml2_merge_annotations",
]


def _same(a, b) -> bool:
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if isinstance(a, float) or isinstance(b, float) else a == b


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents labels pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    rel = tables.execute(ORACLE_SQL[name])
    at = [d[0] for d in rel.description]
    assert sorted(at) == names
    want = [tuple(float(r[at.index(c)]) if type(r[at.index(c)]).__name__ == "Decimal" else r[at.index(c)] for c in names) for r in rel.fetchall()]
    order = lambda row: tuple((x is None, str(x)) for x in row)
    assert len(got) == len(want) and all(_same(x, y) if x is not None and y is not None else x is y for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True) for x, y in zip(a, b, strict=True))
