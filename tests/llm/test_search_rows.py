from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import ann


def _rows(kind: str) -> np.ndarray:
    rng = np.random.default_rng(7)
    if kind == "lengths":  # most directions, few of them long
        x = rng.standard_normal((3000, 24))
        return x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(rng.standard_normal((3000, 1)) * 1.5)
    if kind == "shell":  # one crowd around a common vector, far wider apart than its members' products
        x = rng.standard_normal((3000, 64))
        x[:, 0] = 50
        return x
    return rng.standard_normal((3000, 96)) * np.where(np.arange(3000) % 3 == 0, 30.0, 0.01)[:, None]  # two scales


@pytest.mark.parametrize("kind", ["lengths", "shell", "scales"])
def test_search_finds_the_nearest_of_any_rows(spark, kind):
    x = _rows(kind)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    for q, rows in got.groupby("query_id"):
        near = x @ x[q]
        near[q] = -np.inf
        rows = rows.sort_values("rank")
        assert rows.vec_id.tolist() == sorted(range(len(x)), key=lambda i: (-near[i], i))[:20]
    assert got.query_id.nunique() == 150
