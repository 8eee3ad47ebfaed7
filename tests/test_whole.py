"""Queries read whole tables and whole texts."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from larder.operators import classify, lookup
from larder.plans import classify_queries, line_queries
from larder.plans.queries import ORACLE_SQL, QUERIES
from larder.plans.views import view

SMALL = "/root/testdata/sf0.001"


def _by_sql(sql: str) -> list[tuple]:
    con = duckdb.connect()
    for t in "lineitem part orders documents pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return sorted(con.execute(sql).fetchall(), key=str)


@pytest.mark.parametrize("name", ["dq1_junk_name_reason", "dq3_foreign_reason", "dq4_junk_reason", "dq5_quality_report", "dq6_drop_junk", "ln18_pair_name_price"])
def test_whole_texts(spark, name):
    assert sorted(map(tuple, QUERIES[name](spark, SMALL).collect()), key=str) == _by_sql(ORACLE_SQL[name])


def test_marker_words_late_in_a_text(spark, tmp_path):
    text = "plain words " * 20 + "avec fromage sans sucre"
    spark.createDataFrame([(1, text, 0)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert QUERIES["dq6_drop_junk"](spark, str(tmp_path)).count() == 0


def test_best_candidate_of_high_id_counts(spark):
    rows = [(i, f"Kefir Cookies {chr(97 + i // 26)}{chr(97 + i % 26)} Crunchy", "") for i in range(250)] + [(999, "Kefir Fresh", "1 l")]
    products = spark.createDataFrame(rows, "code long, product_name string, quantity string")
    names = spark.createDataFrame([("Kefir",)], "name string")
    pairs = lookup.fuzzy_candidates(names, products)
    assert pairs.where("name = 'Kefir'").count() == 251 and lookup.fuzzy_candidates(names, products, cap=200).where("name = 'Kefir'").count() == 200
    wanted = spark.createDataFrame([("Kefir Fesh",)], "name string")
    best = lookup.fuzzy_best(lookup.fuzzy_candidates(wanted, products)).collect()
    assert [(r.name, r.code) for r in best] == [("Kefir Fesh", 999)]
    items = wanted.select("name", F.lit("").alias("resolved_name"), F.lit(1).alias("qty"), F.lit(None).cast("struct<value:double,unit:string>").alias("weight"), F.lit("").alias("weight_source"))
    (r,) = lookup.resolve_items(items, products).collect()
    assert (r.resolved_name, r.weight_source, r.weight_grams) == ("Kefir Fresh", "off_db_fuzzy", 1000.0)


def test_labels_of_all_receipts_are_learned(spark, monkeypatch):
    texts = ["MILK 3.99", "TOTAL 9.00", "2 EA @ $1.00"]
    lines = spark.createDataFrame([(10 * r + 1, i, texts[i % 3]) for r in range(20) for i in range(9)], "receipt_id long, line_no int, text string")
    monkeypatch.setattr(classify_queries, "view", lambda *_: lines)
    got = classify_queries.ml9(spark, "").collect()
    assert len(got) == 180 and {r.label for r in got} <= {r.predicted for r in got}


def test_all_lines_are_read(spark):
    lines = view(spark, SMALL, "receipt_lines")
    got = {(r.receipt_id, r.line_no): r.qty for r in QUERIES["ln16_parse_qty"](spark, SMALL).collect()}
    assert len(got) == lines.count()
    assert sorted(((*k, v) for k, v in got.items()), key=str) == _by_sql(ORACLE_SQL["ln16_parse_qty"])


def test_totals_of_noise_lines_anywhere(spark, monkeypatch):
    texts = ["SUBTOTAL $5.10", "TAX 0.40", "TOTAL $5.50"]
    lines = spark.createDataFrame([(1, 10 * i, t) for i, t in enumerate(["MILK 5.10", *texts, "Thank you"])], "receipt_id long, line_no int, text string")
    monkeypatch.setattr(line_queries, "view", lambda *_: lines)
    got = {r.receipt_id: (r.subtotal, r.tax, r.total) for r in line_queries.ln11(spark, "").collect()}
    assert got[1] == ("5.10", "0.40", "5.50")


def test_gaps_are_null_values(spark):
    for name, gap in (("food_nutrient", "fdc_id % 17 = 0"), ("food_portion", "fdc_id % 4 = 0")):
        assert view(spark, SMALL, name).where(gap).count() > 0
    for name in ("cat6_pivot_nutrients", "cat8_first_portion"):
        assert QUERIES[name](spark, SMALL).count() == len(_by_sql(ORACLE_SQL[name]))


def test_repeated_terms_count_by_their_logarithm(spark, tmp_path):
    df = spark.createDataFrame([("a a a b",), ("a b",), ("c",)], "normal string")
    model = Pipeline(stages=classify.text_features()).fit(df)
    model.save(str(tmp_path / "model"))
    vocabulary = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
    a, b = vocabulary.index("a"), vocabulary.index("b")
    for fitted in (model, PipelineModel.load(str(tmp_path / "model"))):
        row = fitted.transform(df).where("normal = 'a a a b'").first().tfidf
        assert row[a] / row[b] == pytest.approx(1 + math.log(3))
