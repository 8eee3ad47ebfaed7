"""Reading catalogs, receipts, signals and annotations with fixed schemas."""

from __future__ import annotations

import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOTALS = "struct<calories:double,protein_g:double,carbs_g:double,fat_g:double,fiber_g:double>"
RECEIPT = (
    "store_name string, store string, date string, receipt_date string, purchase_date string, total string, total_price string, "
    f"items array<struct<original_name:string,matched_name:string,portion_g:double,weight_source:string,nutrition:{_TOTALS},status:string,price:double>>, totals {_TOTALS}"
)
HISTORY = (
    "receipt_id int, date date, day_index int, store string, total_price string, trip_type string, n_items int, "
    f"items array<struct<food_name:string,original_name:string,category:string,portion_g:double,calories:double,protein_g:double,carbs_g:double,fat_g:double,fiber_g:double,price:double>>, totals {_TOTALS}"
)
SIGNAL = "day_index int, date date, calories double, protein_g double, carbs_g double, fat_g double, fiber_g double, cat_beverages int, cat_dairy int, cat_grains int, cat_meat int, cat_produce int, cat_snacks int"
ANNOTATION = "image string, line_num int, line_pos double, text string, auto_label string, corrected_label string"
FOOD_TABLES = {
    "food": "fdc_id int, description string, food_category_id string",
    "food_nutrient": "fdc_id int, nutrient_id int, amount string",
    "nutrient": "id int, name string, unit_name string",
    "food_category": "id string, description string",
    "food_portion": "fdc_id int, gram_weight string, portion_description string",
}
OPTIONAL = ("food_category", "food_portion", "nutrient")


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """The six columns that the catalog needs of a nested product table; no other column is read."""
    return spark.read.parquet(path).select("code", "product_name", "brands", "quantity", "categories_tags", "nutriments")


def _csv_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.csv(path, header=True, multiLine=False)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_food_csvs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The food source tables by name, with their columns found by header; optional files may be missing and are then empty.

    Rows get ``row_ord``, which rises along the file: splits of a file are read in their order, a row's
    place in its task comes after, however many rows a split has.
    """
    out = {}
    for name, schema in FOOD_TABLES.items():
        path = os.path.join(folder, f"{name}.csv")
        rows = _csv_if_there(spark, path) if name in OPTIONAL else spark.read.csv(path, header=True, multiLine=False)
        if rows is None:
            out[name] = spark.createDataFrame([], schema + ", row_ord struct<block:long,row:long>")
            continue
        kinds = dict(f.split(" ") for f in schema.split(", "))
        out[name] = rows.select(*[F.col(c).try_cast(k).alias(c) for c, k in kinds.items()], _row_order().alias("row_ord"))
    return out


def _row_order() -> Column:
    """Where the block of the row begins in its file, then a number that rises along the rows of a task."""
    return F.struct(F.col("_metadata.file_block_start").cast("long").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_receipts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Receipts of JSON files, folders or patterns, each file once, however many of ``paths`` name it; a file holds one
    receipt or an array of them. Files that can't be read are left out. ``source_file`` is a file's path."""
    paths = sorted({paths} if isinstance(paths, str) else set(paths))
    files = spark.read.format("binaryFile").load(paths).select("path", "content").dropDuplicates(["path"])
    text = F.trim(F.col("content").cast("string"))
    many = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    parsed = files.select(F.col("path").alias("source_file"), F.from_json(many, f"array<struct<{_as_fields(RECEIPT)}>>").alias("receipts"))
    return parsed.select("source_file", F.explode("receipts").alias("r")).where("r is not null").select("r.*", "source_file")


def _as_fields(schema: str) -> str:
    """A table schema as the fields of a struct."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", schema)


def read_signal(spark: SparkSession, path: str, schema: str = SIGNAL) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Purchase history: a file with an array of receipts, or with ``lines`` a receipt on each line, as write_history
    writes it. A blank total price becomes null."""
    rows = spark.read.schema(HISTORY).option("multiLine", not lines).json(path)
    return rows.withColumn("total_price", F.regexp_replace("total_price", "[$,]", "").try_cast("double"))


def read_annotations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Annotation files in the given order: ``file_ord`` by file, ``row_ord`` by row."""
    out = None
    for i, path in enumerate(paths):
        rows = spark.read.schema(ANNOTATION).csv(path, header=True).select("*", F.lit(i).alias("file_ord"), F.monotonically_increasing_id().alias("row_ord"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], ANNOTATION + ", file_ord int, row_ord long") if out is None else out
