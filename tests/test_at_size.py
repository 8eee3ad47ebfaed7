from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from larder.functions import lines, matching
from larder.operators import boosting, signals
from larder.plans import queries, views

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_receipt_lines_read_each_table_once(spark):
    found = views.view(spark, SMALL, "receipt_lines")
    assert len(set(re.findall(r"FileScan parquet.*lineitem\.parquet", _plan(found)))) == 1  # four scans before
    tables = {n: views.view(spark, SMALL, n) for n in ("numbered", "orders")}
    want = spark.sql(views.VIEWS["receipt_lines"], **tables)
    assert found.schema == want.schema or [f.dataType for f in found.schema] == [f.dataType for f in want.schema]
    assert sorted(found.collect()) == sorted(want.collect())


@pytest.mark.parametrize("name", ["ln3_line_features_a", "ln4_line_features_b", "ln14_clean_item_name", "ln16_parse_qty", "ln20_line_kinds", "ml1_annotate"])
def test_no_pattern_runs_row_by_row_on_every_line(spark, name):
    plan = _plan(queries.QUERIES[name](spark, SMALL))
    assert "ArrowEvalPython" in plan and "regexp_extract(" not in plan and len(re.findall(r"RLIKE|rlike", plan)) < 5


def test_patterns_of_batches_on_odd_texts(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "ab 12"), (3, "é 7 B 8"), (4, "x\ny")], "id int, t string").repartition(2)
    got = rows.select(
        "id", matching.which(F.col("t"), [r"\d", "B", "^$"]).alias("bits"), matching.first_fit(F.col("t"), [("a", "a", r"\d"), ("digit", r"\d")]).alias("fit"),
        matching.groups(F.col("t"), r"(\D+)(\d)(z)?").alias("g"), matching.replaced(F.col("t"), [(r"(\d)", "<$1> ")]).alias("r"), lines.is_noise(F.col("t")).alias("noise"),
    )
    got = {r.id: r for r in got.collect()}
    assert [got[i].bits for i in range(5)] == [None, 4, 1, 3, 0] and [got[i].fit for i in range(5)] == [None, None, "digit", "digit", None]
    assert tuple(got[2].g) == ("ab ", "1", "") and got[0].g.g1 is None and got[4].g.g1 is None
    assert [got[i].r for i in range(5)] == [None, "", "ab <1> <2>", "é <7>  B <8>", "x\ny"] and got[0].noise and got[1].noise and not got[2].noise


def test_dominant_period_weighs_bins_as_its_sql(spark):
    rows = [("u", "s", 40, 3, 2.0), ("u", "s", 40, 10, 2.00002), ("v", "s", 40, 3, 2.0), ("v", "s", 40, 10, 2.0002)]
    spectrum = spark.createDataFrame(rows, "user string, signal string, n long, k int, magnitude double")
    assert {r.user: r.k for r in signals.dominant_period(spectrum, "user").collect()} == {"u": 3, "v": 10}  # u: 10 before


def test_nutrients_of_a_food_are_one_group(spark):
    plan = _plan(queries.QUERIES["cat6_pivot_nutrients"](spark, SMALL))
    assert "pivotfirst" not in plan.lower() and "hashpartitioning(fdc_id" in plan and not re.search(r"hashpartitioning\(fdc_id#\d+L?, nutrient_id", plan)


def test_defaults_by_keyword_do_not_walk_all_keywords_per_row(spark):
    assert "transform(" not in _plan(queries.QUERIES["lk11_category_default"](spark, SMALL))


def test_equal_binned_rows_are_grown_once_with_their_count(spark):
    rng = np.random.default_rng(3)
    rows = [(int(y), [float(y), float(x)]) for y, x in zip(rng.integers(0, 3, 60), rng.integers(0, 3, 60), strict=True)]
    df = spark.createDataFrame(rows, "y int, x array<double>")
    forest = boosting.Forest(2, 0.1, boosting.bin_edges(df, 2, 8), [-1.0, -1.1, -1.2])
    table = boosting.binned(df, forest)
    few = boosting.counted(table)
    assert few.count() < 60 and few.agg(F.sum("n")).first()[0] == 60
    sums = [boosting.histograms(t, forest, 0, [boosting.Tree.of_depth(2) for _ in range(3)], 0).select("klass", "node", "feature", "bin", F.round("residual", 9), F.round("weight", 9), "n") for t in (table, few)]
    assert sorted(sums[0].collect()) == sorted(sums[1].collect())


def test_equal_texts_of_a_batch_are_matched_once():
    seen = []
    got = matching.once(pa.array(["a", "b", None, "a"]), lambda t: seen.extend(t.to_pylist()) or pc.utf8_upper(t))
    assert got.to_pylist() == ["A", "B", None, "A"] and seen == ["a", "b"]


def test_names_are_resolved_in_batches(spark):
    plan = _plan(queries.QUERIES["ln22_resolve_name"](spark, SMALL))
    assert "ArrowEvalPython" in plan and "transform(" not in plan  # every word met all abbreviations before
    texts = ["", None, "  ORG  milk's ", "12oz 'BRST.' 3.", "GV", "x oz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(1)
    assert [r.n for r in df.select("id", lines.resolve_name(F.col("t")).alias("n")).orderBy("id").collect()] == ["", None, "Organic Milks", "12oz Breast", "Great Value", "X OZ"]


@pytest.mark.parametrize("name", ["ln24_fragments_to_lines", "ln26_split_rows", "ln27_dedup_fragments"])
def test_fragments_are_made_and_folded_once(spark, name):
    plan = _plan(queries.QUERIES[name](spark, SMALL))
    assert len(re.findall(r"FileScan parquet.*lineitem\.parquet", plan.split("Initial Plan")[-1])) == 1  # two to four before
    assert plan.count("MapInArrow") == 1 and "Join [receipt_id" not in plan
