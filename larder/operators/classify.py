"""Annotated lines and the line classifier, on Spark ML."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasInputCols, HasLabelCol, HasOutputCol, HasSeed, HasWeightCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines
from ..sources.scratch import written
from .boosting import SoftmaxBoosting, number

FEATURES, NGRAMS, LEAST_DOCS = 200, 2, 2
TREES, DEPTH, STEP, LEAF, SEED = 300, 5, 0.1, 3, 42


def annotate(labelled: DataFrame) -> DataFrame:
    """An annotation table of labelled lines, to be corrected by hand."""
    return labelled.select(F.col("receipt_id").alias("image"), F.col("line_no").alias("line_num"), F.round("line_pos", 3).alias("line_pos"), "text", F.col("label").alias("auto_label"), F.lit("").alias("corrected_label"))


def label_counts(annotations: DataFrame, label: str = "auto_label") -> DataFrame:
    return annotations.groupBy(label).agg(F.count("*").alias("n"))


def merge_annotations(annotations: DataFrame) -> DataFrame:
    """Of each (image, line_num) the row of the last file, and the last there; ``first_seen`` keeps the order."""
    w = Window.partitionBy("image", "line_num")
    last = F.row_number().over(w.orderBy(F.desc("file_ord"), F.desc("row_ord")))
    seen = F.min(F.struct("file_ord", "row_ord")).over(w)
    rows = annotations.withColumns({"__n": last, "first_seen": seen}).where("__n = 1")
    return rows.drop("__n")


def effective_label(corrected: Column, auto: Column) -> Column:
    """The corrected label if there is one, else the automatic; metadata and discount count as noise."""
    label = F.coalesce(F.when(F.trim(corrected) != "", F.trim(corrected)), auto)
    return F.when(label.isin("metadata", "discount"), "noise").otherwise(label)


def as_kinds(rows: DataFrame) -> DataFrame:
    """Lines with their kind for ``text``: what label rules and features tell apart."""
    return rows.withColumn("text", lines.kind(F.col("text")))


def alike(rows: DataFrame, *by: str, n: str | None = None) -> DataFrame:
    """Lines with the same ``text``, ``line_pos`` and columns ``by`` as one, with ``n``, how many they are (the sum of a column ``n``, if it
    is named). Of lines ``as_kinds`` these are far fewer than the lines, as receipts repeat."""
    return rows.groupBy("text", "line_pos", *by).agg((F.sum(n) if n else F.count("*")).alias("n"))


def of_kinds(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Lines with what ``kinds``, a row per text and position as of ``alike``, have beside these and ``n``."""
    known = kinds.drop("n").withColumnsRenamed({"text": "__text", "line_pos": "__pos"})
    same = F.col("text").eqNullSafe(F.col("__text")) & F.col("line_pos").eqNullSafe(F.col("__pos"))
    return rows.join(known, same).drop("__text", "__pos")


def with_features(rows: DataFrame) -> DataFrame:
    """Rows with the positional features as a vector and the normalised text."""
    feats = lines.line_features_b(F.col("text"), F.col("line_pos"))
    return rows.withColumns({"hand": array_to_vector(F.array(*[c.cast("double") for c in feats.values()])), "normal": lines.normalize_line(F.col("text"))})


class LogCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 + ln(count) of the counts over 0."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        if inputCol and outputCol:
            self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        logs = F.transform(vector_to_array(self.getInputCol()), lambda n: F.when(n > 0, 1 + F.log(n)).otherwise(0.0))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(logs))


class Terms(Estimator, HasInputCol, HasOutputCol):
    """Counts of the FEATURES terms that come most often (ties: the first by name) of those in LEAST_DOCS lines; a row may stand for ``n`` lines."""

    def __init__(self, **how):
        super().__init__()
        self._set(**how)

    def _fit(self, dataset: DataFrame) -> CountVectorizerModel:
        rows = dataset.select(F.col(self.getInputCol()).alias("terms"), number(dataset).alias("n"))
        of_line = rows.select("n", "terms", F.explode(F.array_distinct("terms")).alias("term"))
        often = F.expr("n * size(filter(terms, t -> t = term))")
        terms = of_line.groupBy("term").agg(F.sum("n").alias("docs"), F.sum(often).alias("often")).where(F.col("docs") >= LEAST_DOCS)
        found = terms.orderBy(F.desc("often"), "term").limit(FEATURES).collect()
        return CountVectorizerModel.from_vocabulary([r["term"] for r in found], inputCol=self.getInputCol(), outputCol=self.getOutputCol())


class Rarity(Estimator, HasInputCol, HasOutputCol):
    """Each term times ln((lines + 1) / (lines with the term + 1)); a row may stand for ``n`` lines."""

    def __init__(self, **how):
        super().__init__()
        self._set(**how)

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        rows = dataset.select(vector_to_array(self.getInputCol()).alias("x"), number(dataset).alias("n"))
        size, total = rows.agg(F.max(F.size("x")), F.sum("n")).first()
        docs = rows.select("n", F.posexplode("x").alias("term", "x")).where("x > 0").groupBy("term").agg(F.sum("n").alias("docs")).collect()
        found = np.zeros(size or 0)
        found[[r["term"] for r in docs]] = [r["docs"] for r in docs]
        rare = np.log(((total or 0) + 1) / (found + 1))
        return ElementwiseProduct(scalingVec=Vectors.dense(rare), inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def text_features() -> list:
    """Stages from ``normal`` to ``tfidf``: one- and two-word terms, logarithmic counts, idf, unit length."""
    return [
        RegexTokenizer(inputCol="normal", outputCol="words", pattern=r"\s+", toLowercase=False), NGram(n=NGRAMS, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"), Terms(inputCol="terms", outputCol="counts"),
        LogCounts(inputCol="counts", outputCol="logs"), Rarity(inputCol="logs", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="tfidf"),
    ]


class MeanShares(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """``probability``, the mean of the input vectors, which go, and ``prediction``, its greatest class (ties: the least)."""

    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        if inputCols:
            self._set(inputCols=inputCols)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.getInputCols()
        total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [vector_to_array(c) for c in names])
        share = dataset.withColumn("probability", F.transform(total, lambda x: x / len(names))).drop(*names)
        best = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
        return share.withColumn("prediction", best).withColumn("probability", array_to_vector("probability"))


class CountedForest(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed):
    """A random forest of Spark's trees on rows that stand for ``weightCol`` lines each.

    A forest that draws every line with a Poisson number of mean 1 draws a row of n lines with one of mean n, and so does this. A row's numbers
    follow from ``idCol`` and the seed. Spark counts rows, not lines, for the least size of a leaf, so that is given as a share of the weights.
    """

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "lines on each side of a cut at least", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "a long that tells the rows apart", TypeConverters.toString)

    def __init__(self, **how):
        super().__init__()
        self._set(**how)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        of = self.getOrDefault
        trees, seed, leaf = of("numTrees"), of("seed"), of("minInstancesPerNode")

        @F.pandas_udf("array<long>")
        def draw(row: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([np.random.default_rng((seed, r % 2**64)).poisson(m, trees) for r, m in zip(row.tolist(), n.tolist(), strict=True)], dtype=object)

        n = F.col(of("weightCol")).cast("long")
        bags = written(dataset.select(of("labelCol"), of("featuresCol"), n.alias("n"), draw(of("idCol"), n).alias("drawn")), "bags")
        totals = bags.agg(*[F.sum(F.col("drawn")[t]).alias(f"t{t}") for t in range(trees)]).first()
        how = {"labelCol": of("labelCol"), "featuresCol": of("featuresCol"), "weightCol": "weight", "numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "sqrt"}
        stages = []
        for t in range(trees):
            size = totals[t] or 0
            bag = bags.withColumn("weight", F.col("drawn")[t] if size else F.col("n")).where("weight > 0")  # of few lines all may be left out
            depth = of("maxDepth") if size >= 2 * leaf else 0
            least = (leaf - 0.5) / size if depth else 0.0
            tree = RandomForestClassifier(maxDepth=depth, minInstancesPerNode=1, minWeightFractionPerNode=least, seed=seed + t, **how).fit(bag)
            stages.append(tree.setProbabilityCol(f"shares_{t}").setRawPredictionCol("").setPredictionCol(""))
        return PipelineModel([*stages, MeanShares(inputCols=[f"shares_{t}" for t in range(trees)])])


def line_classifier(kind: str = "softmax", trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Pipeline:
    """A classifier of lines on hand-made and text features: "softmax", boosted trees of all classes at once; "gbt", boosted
    trees of one class against the rest; "forest", a random forest. The first makes no random choice and needs no seed.
    Rows stand for ``n`` lines, which must be 1 for "gbt", and have an ``id``."""
    how = {"maxDepth": depth, "minInstancesPerNode": LEAF, "labelCol": "y", "featuresCol": "features"}
    if kind == "softmax":
        model = SoftmaxBoosting(maxIter=trees, stepSize=STEP, weightCol="n", **how)
    elif kind == "gbt":
        model = OneVsRest(classifier=GBTClassifier(maxIter=trees, stepSize=STEP, seed=seed, **how), labelCol="y", featuresCol="features")
    else:
        model = CountedForest(numTrees=trees, seed=seed, weightCol="n", idCol="id", **how)
    features = VectorAssembler(inputCols=["hand", "tfidf"], outputCol="features")
    return Pipeline(stages=[*text_features(), features, StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), model])


def _to_fit(rows: DataFrame, kind: str, *by: str, n: str | None = None) -> DataFrame:
    """What a classifier of a kind learns from: lines alike as one, but for "gbt" every line, as Spark's trees count rows."""
    kinds = alike(as_kinds(rows), "label", *by, n=n)
    if kind == "gbt":
        kinds = kinds.withColumn("n", F.explode(F.expr("array_repeat(1L, int(n))")))
    return with_features(kinds).select("label", "hand", "normal", "n", F.xxhash64("label", "text", "line_pos", *by).alias("id"), *by)


def train_line_classifier(rows: DataFrame, kind: str = "softmax", n: str | None = None, **how) -> PipelineModel:
    """``n`` names a column of how many lines a row stands for. The features are written once, as every stage of the fit reads them anew."""
    return line_classifier(kind, **how).fit(written(_to_fit(rows, kind, n=n), "features"))


def cv_accuracy(rows: DataFrame, folds: int = 5, key: str = "receipt_id", kind: str = "softmax", **how) -> tuple[float, float]:
    """Mean and deviation of the accuracy over ``folds`` folds; all lines of a receipt are in the fold of its hash.

    A fold without receipts is an error, so there should be several times as many receipts as folds.
    """
    score = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy", weightCol="n")
    grouped = written(_to_fit(with_folds(rows, folds, key), kind, "fold"), "features")
    cv = CrossValidator(estimator=line_classifier(kind, **how), estimatorParamMaps=ParamGridBuilder().build(), evaluator=score, numFolds=folds, seed=SEED, foldCol="fold")
    fitted = cv.fit(grouped)
    return fitted.avgMetrics[0], fitted.stdMetrics[0]


def with_folds(rows: DataFrame, folds: int, key: str = "receipt_id") -> DataFrame:
    """``rows`` with ``fold``, 0 to folds - 1, the same for all rows of a key."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(folds)).cast("int"))


def top_features(model: PipelineModel, k: int = 15) -> list[tuple[str, float]]:
    """The features that matter most, over all classes."""
    last = model.stages[-1]
    parts = last.models if hasattr(last, "models") else [s for s in getattr(last, "stages", [last]) if hasattr(s, "featureImportances")]
    mean = sum(p.featureImportances.toArray() for p in parts) / len(parts)
    vocabulary = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
    names = [*lines.line_features_b(F.lit(""), F.lit(0.0)), *[f"tfidf_{v}" for v in vocabulary]]
    return sorted(zip(names, mean.tolist(), strict=False), key=lambda x: -x[1])[:k]


def classify_lines(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with predicted label and confidence; blank lines are noise."""
    labels = next(s.labels for s in model.stages if hasattr(s, "labels"))
    features = [s for s in model.stages if not isinstance(s, type(model.stages[-2]))]
    out = PipelineModel([*features]).transform(with_features(rows))
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels).transform(out)
    scores = vector_to_array("probability" if "probability" in out.columns else "rawPrediction")
    sure = F.array_max(scores) if "probability" in out.columns else 1 / (1 + F.exp(-F.array_max(scores)))
    blank = F.trim("text") == ""
    return named.select(*rows.columns, F.when(blank, "noise").otherwise(F.col("predicted")).alias("predicted"), F.when(blank, 1.0).otherwise(sure).alias("confidence"))
