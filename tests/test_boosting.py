from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from larder.operators import boosting, classify


def _plain(x, y, classes, rounds, step, depth, leaf):
    """The same boosting over all cuts between values, row by row; probabilities of the rows."""
    prior = np.log([np.mean(y == k) for k in range(classes)])
    scores = np.tile(prior, (len(y), 1))

    def tree(rows, residual, level):
        weight = np.abs(residual[rows]) * (1 - np.abs(residual[rows]))
        value = (classes - 1) / classes * residual[rows].sum() / weight.sum()
        best = (1e-9, None, None)
        for f in range(x.shape[1]) if level < depth else ():
            for cut in sorted(set(x[:, f]))[:-1]:
                a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(a), len(b)) >= leaf:
                    gain = sum(residual[p].sum() ** 2 / len(p) for p in (a, b)) - residual[rows].sum() ** 2 / len(rows)
                    if round(gain, 9) > best[0]:
                        best = (round(gain, 9), a, b)
        out = np.zeros(len(y))
        if best[1] is None:
            out[rows] = value
            return out
        return tree(best[1], residual, level + 1) + tree(best[2], residual, level + 1)

    for _ in range(rounds):
        share = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        scores = scores + step * np.stack([tree(np.arange(len(y)), (y == k) - share[:, k], 0) for k in range(classes)], axis=1)
    return np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)


def _frame(spark, x, y):
    rows = [(i, int(label), [float(v) for v in values]) for i, (values, label) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, y int, x array<double>").withColumn("features", array_to_vector("x"))


def _cases():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(-2, 4, 150), rng.integers(0, 2, 150), rng.integers(0, 5, 150)]).astype(float)
    y = ((x[:, 0] > 1).astype(int) + ((x[:, 1] > 0) & (x[:, 2] > 2)) + (rng.random(150) < 0.1)).clip(0, 2)
    return x, y


@pytest.mark.parametrize("refresh", [1, 5])
def test_softmax_boosting_equals_plain_boosting(spark, monkeypatch, refresh):
    monkeypatch.setattr(boosting, "REFRESH", refresh)
    monkeypatch.setattr(boosting, "PART_ROWS", 40)
    x, y = _cases()
    df = _frame(spark, x, y)
    model = boosting.SoftmaxBoosting(featuresCol="features", labelCol="y", maxIter=3, stepSize=0.3, maxDepth=2, minInstancesPerNode=3).fit(df)
    got = [r.probability.toArray() for r in model.transform(df).orderBy("id").collect()]
    assert np.allclose(got, _plain(x, y, 3, 3, 0.3, 2, 3), atol=1e-9)
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9


def test_softmax_boosting_of_few_rows(spark, tmp_path):
    new = boosting.SoftmaxBoosting(featuresCol="features", labelCol="y", maxIter=2, maxDepth=2, minInstancesPerNode=1)
    some = _frame(spark, [[0.0, 5.0]] * 4, [1, 1, 1, 1])
    alone = new.fit(some).transform(some).collect()  # one class: no trees, all rows are of it
    assert all(r.prediction == 1.0 for r in alone)
    none = new.fit(some.limit(0))
    assert none.trees.rounds == [] and none.transform(some.limit(0)).count() == 0
    same = _frame(spark, [[1.0, 2.0]] * 4, [0, 0, 0, 1])  # equal rows cannot be cut
    likely = new.fit(same).transform(same).first()
    assert likely.prediction == 0.0 and likely.probability[0] == pytest.approx(0.75, abs=0.1)
    x, y = _cases()
    model = new.fit(_frame(spark, x, y))
    model.write().overwrite().save(str(tmp_path / "m"))
    kept = boosting.SoftmaxBoostingModel.load(str(tmp_path / "m"))
    assert kept.trees.text() == model.trees.text()


def test_softmax_classifier_of_lines(spark):
    texts = [("MILK 3.99", "item"), ("TOTAL 9.00", "noise"), ("2 EA @ 1.00", "qty"), ("PRODUCE", "header")]
    rows = [(i % 10, i, i / 80, t, lab if i % 20 else "item") for i, (t, lab) in enumerate(texts * 20)]
    df = spark.createDataFrame(rows, "receipt_id int, line_no int, line_pos double, text string, label string")
    right = {}
    for kind in ("softmax", "gbt"):
        model = classify.train_line_classifier(df, kind=kind, trees=3, depth=2)
        out = classify.classify_lines(model, df)
        assert out.where("confidence between 0 and 1").count() == 80
        right[kind] = out.where(F.col("label") == F.col("predicted")).count()
        assert len(classify.top_features(model)) == 15
    assert right["softmax"] >= right["gbt"] >= 70
