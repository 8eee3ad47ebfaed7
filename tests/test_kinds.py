"""Lines that differ in nothing that a label or a feature tells are learned and classified once, with their number."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from larder.functions import lines
from larder.operators import boosting, classify
from larder.operators import lines as ln
from larder.plans.queries import QUERIES
from larder.plans.views import view

SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", None, "7", "12", "3 DZ @ $12.49", "٣ EA ٤.٥٠", "1b 12/31/24 9:05 PM", "Trader Joe's #512 (555) 123", "123456789 MILK 3.99 -", "0.99", "*WT 1.25 lb @ $3.99/lb", "FC $1.00", "x²½ 12345 5,10"]


def _repeated(rows):
    return rows.withColumn("n", F.explode(F.expr("array_repeat(1L, int(n))")))


def test_label_and_features_are_those_of_the_kind(spark):
    odd = spark.createDataFrame([(i, j / 4, t) for i, t in enumerate(ODD) for j in range(5)], "receipt_id long, line_pos double, text string")
    real = ln.positioned(view(spark, SMALL, "receipt_lines")).select("receipt_id", "line_pos", "text")
    rows = odd.unionByName(real).withColumn("of_kind", lines.kind(F.col("text")))

    def told(text):
        return F.struct(lines.rule_label(text, F.col("line_pos")), lines.normalize_line(text), *lines.line_features_b(text, F.col("line_pos")).values())

    assert rows.where(~told(F.col("text")).eqNullSafe(told(F.col("of_kind")))).count() == 0
    assert rows.select("of_kind").distinct().count() * 5 < rows.select("text").distinct().count()


def _learning(monkeypatch) -> list[tuple[int, int]]:
    """Of what a query's classifier learns from, the rows and the lines that these are, put down as it is trained, with two trees."""
    learned, train = [], classify.train_line_classifier

    def seen(rows, *args, **how):
        learned.append((rows.count(), rows.agg(F.sum("n")).first()[0] if "n" in rows.columns else rows.count()))
        return train(rows, *args, **how | {"trees": 2})

    monkeypatch.setattr(classify, "train_line_classifier", seen)
    return learned


def _labelled(spark):
    rows = ln.labelled(view(spark, SMALL, "receipt_lines"))
    return rows.select("receipt_id", "line_no", classify.effective_label(F.lit(""), F.col("label")).alias("label"))


def test_boosting_learns_from_kinds_and_counts_all_lines(spark, monkeypatch):
    learned = _learning(monkeypatch)
    got = QUERIES["ml6_boosted_lines"](spark, SMALL).groupBy("label").agg(F.sum("n").alias("n")).collect()
    assert sorted(got) == sorted(_labelled(spark).groupBy("label").agg(F.count("*").alias("n")).collect())
    ((few, all_),) = learned
    assert few * 3 < all_ == sum(r["n"] for r in got)


def test_forest_learns_from_kinds_and_labels_all_lines(spark, monkeypatch):
    learned = _learning(monkeypatch)
    got = QUERIES["ml9_classify_lines"](spark, SMALL).select("receipt_id", "line_no", "label").collect()
    assert sorted(got) == sorted(_labelled(spark).collect())
    ((few, all_),) = learned
    assert few * 3 < all_ == len(got)


def test_counted_rows_teach_what_repeated_rows_do(spark):
    rng = np.random.default_rng(8)
    texts = ["MILK 3.99", "TOTAL 9.00", "2 EA @ 1.00", "PRODUCE", "OLD MILK 1.00 -"]
    rows = [(i / 40, texts[k], ["item", "noise", "qty", "header", "noise"][k if rng.random() < 0.9 else 0], int(rng.integers(1, 9))) for i, k in enumerate(rng.integers(0, 5, 40))]
    df = spark.createDataFrame(rows, "line_pos double, text string, label string, n long")
    few, many = (classify.train_line_classifier(r, n="n", trees=3, depth=3) for r in (df, _repeated(df)))
    assert few.stages[-1].trees.text() == many.stages[-1].trees.text()
    features = classify.with_features(df)
    from_n, from_rows = ([s for s in classify.line_classifier(trees=1).getStages()[:7]] for _ in range(2))
    weights = []
    for stages, learned in ((from_n, features), (from_rows, _repeated(features).drop("n"))):
        fitted = classify.Pipeline(stages=stages).fit(learned)
        weights.append([tuple(r[0]) for r in fitted.transform(features).orderBy("line_pos").select(vector_to_array("tfidf")).collect()])
    assert np.allclose(*weights)


def test_edges_of_counted_rows(spark):
    df = spark.createDataFrame([([1.0], 97), ([2.0], 1), ([3.0], 1), ([4.0], 1), ([0.0], 50)], "x array<double>, n long")
    assert boosting.bin_edges(df, 1, 6) == boosting.bin_edges(_repeated(df).drop("n"), 1, 6) == [[0.0, 1.0]]


def _leaves(stage) -> list[int]:
    """How many drawn lines each leaf of the tree of one stage has."""
    found, left = [], [stage.trees[0]._call_java("rootNode")]
    while left:
        node = left.pop()
        if node.subtreeDepth() == 0:
            found.append(node.impurityStats().count())
        else:
            left += [node.leftChild(), node.rightChild()]
    return found


def test_forest_draws_lines_not_rows(spark, tmp_path):
    rows = [(i, float(i % 2), [float(i)], 1 if i == 3 else 1000) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, y double, x array<double>, n long").withColumn("features", array_to_vector("x"))
    forest = classify.CountedForest(labelCol="y", featuresCol="features", weightCol="n", idCol="id", seed=3, numTrees=5, maxDepth=3, minInstancesPerNode=6)
    model = forest.fit(df)
    leaves = [_leaves(t) for t in model.stages[:-1]]
    assert len(leaves) == 5 and leaves == [_leaves(t) for t in forest.fit(df.repartition(3)).stages[:-1]]
    # a row of 1,000 lines is left out of no tree, as whole rows would be of a third of them; one line, drawn now and then, makes no leaf
    assert all(len(found) == 3 and all(850 < n < 1150 for n in found) for found in leaves) and len({tuple(found) for found in leaves}) == 5
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    got = [[tuple(r) for r in m.transform(df).orderBy("id").select(vector_to_array("probability"), "prediction").collect()] for m in (model, again)]
    assert got[0] == got[1] and [p for _, p in got[0]] == [0.0, 1.0, 0.0, 0.0] and all(sum(s) == pytest.approx(1) for s, _ in got[0])


def test_forest_of_few_lines(spark):
    df = spark.createDataFrame([(0, "A", 0.0, "item"), (1, "B", 1.0, "noise"), (1, "B", 0.5, "noise")], "receipt_id int, text string, line_pos double, label string")
    model = classify.train_line_classifier(df, kind="forest", trees=3)
    assert classify.classify_lines(model, df).count() == 3


def test_kinds_of_null_texts_are_found_again(spark):
    rows = spark.createDataFrame([(1, None, 0.0), (2, "A 1", 0.5), (3, "A 2", 0.5), (4, None, 0.0)], "receipt_id int, text string, line_pos double")
    kinds = classify.alike(classify.as_kinds(rows)).withColumn("label", F.coalesce("text", F.lit("none")))
    assert sorted(kinds.select("label", "n").collect()) == [("A 0", 2), ("none", 2)]
    found = classify.of_kinds(classify.as_kinds(rows), kinds)
    assert sorted((r.receipt_id, r.label) for r in found.collect()) == [(1, "none"), (2, "A 0"), (3, "A 0"), (4, "none")]
