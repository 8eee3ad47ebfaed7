"""Softmax boosting for Spark ML: in each round a regression tree per class, grown level by level from histograms.

A pass over the binned rows adds up, per class, node, feature and bin, the residuals, what they divide by in a leaf, and
the rows; Spark sums these over the tasks and finds the best cut of each node. Only one row per class and node reaches
the driver, so what it holds grows with the trees and not with the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasStepSize, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: After so many rounds the scores are written anew, so that a pass applies no more trees than these.
REFRESH = 5
LEAST_GAIN = 1e-9
#: Rows of a partition of the binned table when it is written.
PART_ROWS = 20_000
SUMS = "klass int, node int, feature int, bin int, residual double, weight double, n long"


@dataclass
class Tree:
    """Nodes by number, the children of i at 2i + 1 and 2i + 2: where they cut (bin ``cut`` and below go to the first), and their values."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels; a node without a cut keeps its rows."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            feature = self.feature[at]
            beyond = bins[rows, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(feature >= 0, 2 * at + 1 + beyond, at)
        return at


@dataclass
class Forest:
    """``edges`` between the bins of each feature, ``prior`` log-shares of the classes, ``rounds`` of one tree a class, ``gains`` by feature."""

    depth: int
    step: float
    edges: list[list[float]]
    prior: list[float]
    rounds: list[list[Tree]] = field(default_factory=list)
    gains: list[float] = field(default_factory=list)

    def bins(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros(features.shape, np.uint8)
        for i, edges in enumerate(self.edges):
            out[:, i] = np.searchsorted(edges, features[:, i], side="left")
        return out

    def scores(self, bins: np.ndarray, start: np.ndarray, first: int = 0) -> np.ndarray:
        out = start.copy()
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += self.step * tree.value[tree.nodes(bins, self.depth)]
        return out

    def text(self) -> str:
        rounds = [[[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in trees] for trees in self.rounds]
        return json.dumps({"depth": self.depth, "step": self.step, "edges": self.edges, "prior": self.prior, "rounds": rounds, "gains": self.gains})

    @classmethod
    def of_text(cls, text: str) -> Forest:
        parts = json.loads(text)
        rounds = [[Tree(np.array(f, np.int32), np.array(c, np.int32), np.array(v)) for f, c, v in trees] for trees in parts.pop("rounds")]
        return cls(**parts, rounds=rounds)


def shares(scores: np.ndarray) -> np.ndarray:
    """Softmax of each row."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def number(rows: DataFrame) -> Column:
    """``n`` of rows that stand for so many, else 1."""
    return F.col("n") if "n" in rows.columns else F.lit(1)


def bin_edges(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Per feature at most ``bins`` - 1 edges: 0 and quantiles of the values that are not 0; ``rows`` has an array ``x``
    and may have ``n``, how many rows it stands for."""
    at = [i / (bins - 1) for i in range(1, bins - 1)]
    values = rows.select(F.posexplode("x").alias("feature", "value"), number(rows).alias("n")).where("value != 0")
    values = values.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("feature")
    values = values.withColumns({"upto": F.sum("n").over(whole.orderBy("value")), "all": F.sum("n").over(whole)})
    cuts = values.groupBy("feature").agg(F.array(*[F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("value"))) for p in at]).alias("edges"))
    found = {r["feature"]: r["edges"] for r in cuts.collect()}
    return [sorted({0.0, *found.get(i, [])}) for i in range(width)]


def binned(rows: DataFrame, forest: Forest) -> DataFrame:
    """``y``, ``bins`` (a byte a feature), ``score`` (8 bytes a class) and ``n`` of rows with ``y``, an array ``x`` and perhaps ``n``."""
    start = np.array(forest.prior)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bins = [r.tobytes() for r in forest.bins(x)]
                score = [start.tobytes()] * batch.num_rows
                yield pa.RecordBatch.from_arrays([batch["y"], pa.array(bins, pa.binary()), pa.array(score, pa.binary()), batch["n"]], ["y", "bins", "score", "n"])

    return rows.select("y", "x", number(rows).cast("long").alias("n")).mapInArrow(convert, "y int, bins binary, score binary, n long")


def counted(table: DataFrame) -> DataFrame:
    """Equal rows of a binned table as one, with ``n``, how many they are: they go the same way through every tree."""
    return table.groupBy("y", "bins", "score").agg(F.sum("n").alias("n"))


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(n, -1)
    score = np.frombuffer(b"".join(batch["score"].to_pylist()), np.float64).reshape(n, -1)
    return batch["y"].to_numpy(zero_copy_only=False), bins, score


def rescored(table: DataFrame, forest: Forest, first: int) -> DataFrame:
    """``table`` with the trees of the rounds from ``first`` on added to its scores."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, bins, score = _matrices(batch)
                new = [r.tobytes() for r in forest.scores(bins, score, first)]
                yield pa.RecordBatch.from_arrays([batch["y"], batch["bins"], pa.array(new, pa.binary()), batch["n"]], ["y", "bins", "score", "n"])

    return table.mapInArrow(convert, table.schema)


def histograms(table: DataFrame, forest: Forest, first: int, growing: list[Tree], level: int) -> DataFrame:
    """Sums per class, open node of the level, feature and bin, over the rows of ``table``.

    A task keeps one array of classes * nodes * features * bins whatever its rows, and gives what is not empty. Most values
    are 0, so only others are added up one by one; the bin of 0 gets what these leave of the node's total.
    """
    width, classes, most = len(forest.edges), len(growing), max(len(e) for e in forest.edges) + 1
    low, nodes = 2**level - 1, 2**level
    zero = np.array([np.searchsorted(e, 0.0, side="left") for e in forest.edges])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((classes, 3, nodes * width * most))
        totals = np.zeros((classes, 3, nodes))
        for batch in batches:
            if not batch.num_rows:
                continue
            y, bins, score = _matrices(batch)
            share = shares(forest.scores(bins, score, first))
            count = batch["n"].to_numpy()
            row, feature = np.nonzero(bins != zero)
            place = feature * most + bins[row, feature]
            for k, tree in enumerate(growing):
                node = tree.nodes(bins, level) - low
                open_ = node >= 0
                residual = (y == k) - share[:, k]
                weight = np.abs(residual) * (1 - np.abs(residual))
                seen = open_[row]
                at = row[seen]
                cell = node[at] * (width * most) + place[seen]
                for i, value in enumerate((residual * count, weight * count, count)):
                    sums[k, i] += np.bincount(cell, value[at], sums.shape[2])
                    totals[k, i] += np.bincount(node[open_], value[open_], nodes)
        full = sums.reshape(classes, 3, nodes, width, most)
        full[:, :, :, np.arange(width), zero] = totals[..., None] - full.sum(axis=4)
        klass, node, feature, bin_ = np.nonzero(full[:, 2])
        ints = [pa.array(a, pa.int32()) for a in (klass, node + low, feature, bin_)]
        residual, weight, n = (full[klass, i, node, feature, bin_] for i in range(3))
        values = [pa.array(residual), pa.array(weight), pa.array(n.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*ints, *values], ["klass", "node", "feature", "bin", "residual", "weight", "n"])

    parts = table.mapInArrow(add, SUMS)
    return parts.groupBy("klass", "node", "feature", "bin").agg(F.sum("residual").alias("residual"), F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def best_cuts(sums: DataFrame, leaf: int) -> DataFrame:
    """Per class and node the cut that takes most from the squared residuals and leaves ``leaf`` rows on both sides, with
    the sums below the cut and of the whole node; a node without such a cut has a null ``best``. Ties: least feature, then bin."""
    whole = Window.partitionBy("klass", "node", "feature")
    below = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    names = ("residual", "weight", "n")
    rows = sums.withColumns({f"below_{c}": F.sum(c).over(below) for c in names} | {f"all_{c}": F.sum(c).over(whole) for c in names})
    beyond_n, beyond_residual = F.expr("all_n - below_n"), F.expr("all_residual - below_residual")
    square = lambda residual, n: residual * residual / n
    gain = square(F.col("below_residual"), F.col("below_n")) + square(beyond_residual, beyond_n) - square(F.col("all_residual"), F.col("all_n"))
    allowed = (F.col("below_n") >= leaf) & (beyond_n >= leaf) & (beyond_n > 0)
    gain = F.round(F.when(allowed, gain), 9)
    pick = F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "below_residual", "below_weight", "below_n")
    totals = [F.first(f"all_{c}").alias(c) for c in names]
    return rows.groupBy("klass", "node").agg(F.max(F.when(gain > LEAST_GAIN, pick)).alias("best"), *totals)


def _leaf(residual: float, weight: float, classes: int) -> float:
    return 0.0 if weight < 1e-150 else (classes - 1) / classes * residual / weight


def grow(rows: DataFrame, rounds: int, step: float, depth: int, leaf: int, bins: int, name: str = "boosting") -> Forest:
    """The forest of ``rows``: y int from 0 (a class each), x array<double>, all of one length, without nulls, and perhaps n, how many
    rows it stands for.

    Binned rows and, every REFRESH rounds, their scores are tables of the shared folder; all passes read these, so a lost
    executor costs only a reread. Repeated rows count as often as they come. No rows, or one class only, give no trees.
    """
    rows = written(rows, f"{name}-rows")  # read three times
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum(number(rows)).alias("n")).collect()}
    classes, total = max(counts, default=0) + 1, sum(counts.values())
    prior = [float(np.log(max(counts.get(k, 0), 1e-9) / max(total, 1))) for k in range(classes)]
    width = len(first["x"]) if (first := rows.select("x").first()) else 0
    forest = Forest(depth, step, bin_edges(rows, width, bins) if total else [], prior, gains=[0.0] * width)
    if len(counts) < 2 or not width:
        return forest
    table = written(counted(binned(rows, forest)), name)
    table, done = written(table.repartition(table.count() // PART_ROWS + 1), name), 0
    for _ in range(rounds):
        if len(forest.rounds) - done >= REFRESH:
            table, done = written(rescored(table, forest, done), name), len(forest.rounds)
        growing = [Tree.of_depth(depth) for _ in range(classes)]
        for level in range(depth):
            cut = 0
            for r in best_cuts(histograms(table, forest, done, growing, level), leaf).collect():
                tree, node, best = growing[r["klass"]], r["node"], r["best"]
                if level == 0:
                    tree.value[0] = _leaf(r["residual"], r["weight"], classes)
                if best is None:
                    continue
                cut += 1
                tree.feature[node], tree.cut[node] = -best["feature"], -best["bin"]
                tree.value[2 * node + 1] = _leaf(best["below_residual"], best["below_weight"], classes)
                tree.value[2 * node + 2] = _leaf(r["residual"] - best["below_residual"], r["weight"] - best["below_weight"], classes)
                forest.gains[-best["feature"]] += best["gain"]
            if not cut:
                break
        forest.rounds.append(growing)
    return forest


class _Settings(HasFeaturesCol, HasLabelCol, HasMaxIter, HasStepSize, HasWeightCol):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows on each side of a cut at least", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, 256 at most", TypeConverters.toInt)
    forest = Param(Params._dummy(), "forest", "the fitted trees as JSON", TypeConverters.toString)


class SoftmaxBoosting(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for several classes at once, by the gradient of the multinomial log-likelihood. ``weightCol``: how many rows, a whole number, a row stands for."""

    def __init__(self, **how):
        super().__init__()
        self._setDefault(maxIter=300, stepSize=0.1, maxDepth=5, minInstancesPerNode=3, maxBins=32)
        self._set(**how)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        of = self.getOrDefault
        n = F.col(of("weightCol")) if self.isSet("weightCol") else F.lit(1)
        rows = dataset.select(F.col(of("labelCol")).cast("int").alias("y"), vector_to_array(of("featuresCol")).alias("x"), n.cast("long").alias("n"))
        forest = grow(rows, of("maxIter"), of("stepSize"), of("maxDepth"), of("minInstancesPerNode"), of("maxBins"))
        return SoftmaxBoostingModel(featuresCol=of("featuresCol"), labelCol=of("labelCol"), forest=forest.text())


class SoftmaxBoostingModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability``, a share per class, and ``prediction``, the class of the greatest (ties: the least class)."""

    def __init__(self, **how):
        super().__init__()
        self._set(**how)

    @property
    def trees(self) -> Forest:
        return Forest.of_text(self.getOrDefault("forest"))

    @property
    def featureImportances(self) -> DenseVector:
        """What each feature's cuts took from the squared residuals, as shares."""
        gains = np.array(self.trees.gains)
        return Vectors.dense(gains / (gains.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        forest = self.trees

        @F.pandas_udf("array<double>")
        def likely(features: pd.Series) -> pd.Series:
            if features.empty:
                return pd.Series([], dtype=object)
            bins = forest.bins(np.stack(features.to_list()))
            start = np.tile(np.array(forest.prior), (len(bins), 1))
            return pd.Series(list(shares(forest.scores(bins, start))))

        share = dataset.withColumn("probability", likely(vector_to_array(self.getOrDefault("featuresCol"))))
        best = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
        return share.withColumn("prediction", best).withColumn("probability", array_to_vector("probability"))
