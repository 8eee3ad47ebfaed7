"""Notes of annotation files are made once."""

from __future__ import annotations

from larder.plans import classify_queries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_notes_of_two_files_are_made_once(spark):
    notes = spark.createDataFrame([(1, n, "item") for n in range(13)], "image long, line_num int, auto_label string")
    want = spark.sql(classify_queries._FILES.replace("FROM a", "FROM {a}"), a=notes)
    files = classify_queries._files(notes)
    assert sorted(files.collect(), key=str) == sorted(want.collect(), key=str) and files.columns == want.columns
    assert _plan(classify_queries.ml3(spark, "/root/testdata/sf0.001")).count("ArrowEvalPython") == 1
