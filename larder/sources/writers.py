"""Writing signals, histories, items, catalogs and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def write_signal(df: DataFrame, path: str, key: str | None = None, kind: str = "csv") -> None:
    """A daily, smoothed or detection table, in a folder per ``key`` if one is given."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(key) if key else writer).format(kind).save(path)


def write_history(df: DataFrame, path: str) -> None:
    """A receipt on each line, so that a large history is written and read in parts."""
    df.write.mode("overwrite").json(path)


def item_columns(items: DataFrame) -> DataFrame:
    """The flat 26 columns of items: name to price, nutrients per 100 g, nutrients of the whole."""
    base = ["name", "resolved_name", "qty", F.col("weight.value").alias("weight_value"), F.col("weight.unit").alias("weight_unit"), "weight_grams", "weight_source", "line_price"]
    both = [F.col(f"{s}.{n}").alias(f"{n}_{t}") for s, t in (("per100", "per100g"), ("actual", "actual")) for n in fixed.NUTRIENTS]
    return items.select(*base, *both)


def write_items(items: DataFrame, path: str) -> None:
    """Nested JSON and flat CSV of items, side by side."""
    items.write.mode("overwrite").json(f"{path}/json")
    item_columns(items).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_catalog(df: DataFrame, path: str) -> None:
    """A catalog in place of the one that was there."""
    df.write.mode("overwrite").parquet(path)


def write_medians(medians: DataFrame, path: str) -> None:
    """All of the medians, and value and unit only."""
    medians.write.mode("overwrite").json(f"{path}/detailed")
    medians.select("name", "value", "unit").write.mode("overwrite").json(f"{path}/simple")


def write_run(df: DataFrame, path: str, run_date: str, key: str = "user_id") -> None:
    """A result under user and run date; the same day's rerun replaces its own partitions and no others."""
    dated = df.withColumn("run_date", F.lit(run_date))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key, "run_date").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
