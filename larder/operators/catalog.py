"""Building product and food catalogs: nested and long sources, cleaning, category weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.quality import junk_name_reason, junk_quantity_reason, junk_reason
from ..functions.weights import best_unit, parse_grams


def pick_localized(texts: Column, lang: str = "en") -> Column:
    """From array<struct<lang,text>>: the first text of ``lang``, even if blank, else the first that is not blank; trimmed."""
    own = F.get(F.filter(texts, lambda x: x["lang"] == lang), F.lit(0))
    other = F.get(F.filter(texts, lambda x: F.coalesce(F.trim(x["text"]), F.lit("")) != ""), F.lit(0))
    return F.when(own.isNotNull(), F.coalesce(F.trim(own["text"]), F.lit(""))).otherwise(F.trim(other["text"]))


def join_tags(tags: Column) -> Column:
    """Tags that are not blank, joined by commas; null for no tags."""
    kept = F.filter(tags, lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, ","))


def extract_named(values: Column, names: list[str]) -> list[Column]:
    """From array<struct<name,100g>>: for each name its last value that is a number, to four decimals."""
    def one(name: str) -> Column:
        fits = F.filter(values, lambda x: (x["name"] == name) & x["100g"].try_cast("double").isNotNull())
        return F.round(F.try_element_at(fits, F.lit(-1))["100g"].try_cast("double"), 4).alias(name.replace("-", "_"))

    return [one(n) for n in names]


def filter_named(df: DataFrame, name: str = "product_name", quantity: str = "quantity") -> DataFrame:
    return df.where((F.trim(name) != "") & (F.trim(quantity) != ""))


def catalog_summary(products: DataFrame) -> DataFrame:
    return products.agg(F.count("*").alias("n_products"), F.count_if(F.col("energy_kcal").isNotNull()).alias("n_with_kcal"))


def sample_where(df: DataFrame, predicate: Column, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows that fit, by ``key``."""
    return df.where(predicate).orderBy(key).limit(n)


def coverage(products: DataFrame) -> DataFrame:
    """Rows in all, with categories, with quantity, with both, and their shares in per cent."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    counts = products.agg(
        F.count("*").alias("total"), F.count_if(has("categories")).alias("with_categories"), F.count_if(has("quantity")).alias("with_quantity"),
        F.count_if(has("categories") & has("quantity")).alias("with_both"),
    )
    share = lambda c: F.round(F.try_divide(F.col(c) * 100.0, "total"), 2).alias(f"pct_{c}")
    return counts.select("*", *[share(c) for c in ("with_categories", "with_quantity", "with_both")])


def top_tags(products: DataFrame, k: int = 20, prefix: str = "en:", column: str = "categories") -> DataFrame:
    tags = products.select(F.explode(F.split(column, ",")).alias("tag")).select(F.trim("tag").alias("tag"))
    return tags.where(F.col("tag").startswith(prefix)).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def pivot_nutrients(long: DataFrame, order: str) -> DataFrame:
    """food_nutrient (fdc_id, nutrient_id, amount) to a row per food. The last amount of an id that is a number
    counts; sugars come from the stand-in id where the main one is absent."""
    ids = [*map(int, fixed.NUTRIENT_IDS), fixed.SUGARS_STAND_IN]
    rows = long.where(F.col("nutrient_id").isin(ids)).select("fdc_id", "nutrient_id", F.col("amount").try_cast("double").alias("amount"), order)
    # one group a food, whose last amounts stand side by side, not one a food and nutrient
    last = [F.max_by("amount", F.when(F.col("nutrient_id") == i, F.col(order))).alias(str(i)) for i in ids]
    wide = rows.where(F.col("amount").isNotNull()).groupBy("fdc_id").agg(*last)
    named = {name: F.col(i) for i, name in fixed.NUTRIENT_IDS.items()}
    named["sugars"] = F.coalesce(named["sugars"], F.col(str(fixed.SUGARS_STAND_IN)))
    return wide.select("fdc_id", *[c.alias(n) for n, c in named.items()])


def first_portion(portions: DataFrame, order: str) -> DataFrame:
    """The first portion weight of each food that is a number."""
    grams = portions.select("fdc_id", F.col("gram_weight").try_cast("double").alias("g"), order).where(F.col("g").isNotNull())
    return grams.groupBy("fdc_id").agg(F.min_by("g", order).alias("serving_g"))


def derive_salt(foods: DataFrame) -> DataFrame:
    """sodium from milligrams to grams, and salt as 2.5 times that; four decimals, null stays null."""
    mg = F.col("sodium")
    return foods.withColumns({"sodium": F.round(mg / 1000, 4), "salt": F.round(mg * 2.5 / 1000, 4)})


def build_foods(food: DataFrame, nutrients: DataFrame, categories: DataFrame, portions: DataFrame) -> DataFrame:
    """Foods with a description and at least one nutrient, their category ('' if unknown) and first portion."""
    categories = categories.select(F.col("id").alias("food_category_id"), F.col("description").alias("category"))
    named = food.where(F.trim("description") != "").join(categories, "food_category_id", "left").join(portions, "fdc_id", "left")
    named = named.join(nutrients, "fdc_id").withColumn("category", F.coalesce("category", F.lit("")))
    return derive_salt(named).select("fdc_id", F.trim("description").alias("product_name"), "category", "serving_g", *fixed.NUTRIENTS)


def build_report(food: DataFrame, foods: DataFrame) -> DataFrame:
    """How many source foods there are, and how many of them were inserted and skipped."""
    inserted = foods.agg(F.count("*").alias("inserted"))
    return food.agg(F.count("*").alias("total")).crossJoin(inserted).select("total", "inserted", (F.col("total") - F.col("inserted")).alias("skipped"))


def distinct_categories(foods: DataFrame) -> DataFrame:
    """The number of categories that are not blank."""
    return foods.agg(F.countDistinct(F.when(F.trim("category") != "", F.col("category"))).alias("n_categories"))


def category_breakdown(foods: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent categories that are not blank; equals by name."""
    return foods.where(F.trim("category") != "").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)


def quality_report(products: DataFrame) -> DataFrame:
    """Rows by junk reason ('' for good ones), with their share of all in per cent."""
    reasons = products.select(F.coalesce(junk_reason(F.col("product_name"), F.col("quantity")), F.lit("")).alias("reason"))
    counts = reasons.groupBy("reason").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


def quality_totals(products: DataFrame) -> DataFrame:
    """One row: all rows, junk by class (name, quantity, language), deleted, their share in per cent to one decimal, and remaining."""
    name, quantity = F.col("product_name"), F.col("quantity")
    by_name = junk_name_reason(name).isNotNull()
    by_quantity = ~by_name & junk_quantity_reason(quantity).isNotNull()
    counts = products.agg(
        F.count("*").alias("total"), F.count_if(by_name).alias("junk_name"), F.count_if(by_quantity).alias("junk_quantity"),
        F.count_if(junk_reason(name, quantity).isNotNull()).alias("deleted"),
    )
    return counts.select(
        "total", "junk_name", "junk_quantity", (F.col("deleted") - F.col("junk_name") - F.col("junk_quantity")).alias("non_english"), "deleted",
        F.round(F.try_divide(F.col("deleted") * 100.0, "total"), 1).alias("pct_deleted"), (F.col("total") - F.col("deleted")).alias("remaining"),
    )


def drop_junk(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): good rows, and junk rows with their reason."""
    marked = products.withColumn("reason", junk_reason(F.col("product_name"), F.col("quantity")))
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def category_medians(products: DataFrame, min_n: int = 5) -> DataFrame:
    """Nearest-rank quantiles of grams per simple category: index n/4, n/2 and 3n/4 from 0, of categories with ``min_n`` weights.

    A product counts once for each of its tags, so twice where two tags have one name. Equal weights are counted
    first, so that a category with a third of all rows sends one row a weight, not one a product, to its window.
    """
    names = products.sparkSession.createDataFrame(list(fixed.TAG_NAMES.items()), "tag string, name string")
    rows = products.select(F.explode(F.split("categories", ",")).alias("tag"), parse_grams(F.col("quantity")).alias("grams"))
    rows = rows.where(F.col("grams").isNotNull()).select(F.trim("tag").alias("tag"), "grams").join(F.broadcast(names), "tag")
    counts = rows.groupBy("name", "grams").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("name").orderBy("grams").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "n": F.sum("k").over(Window.partitionBy("name"))})
    pick = lambda rank: F.min(F.when(F.col("upto") > F.expr(rank), F.col("grams")))
    out = ranked.where(F.col("n") >= min_n).groupBy("name", "n").agg(pick("n div 4").alias("p25_g"), pick("n div 2").alias("median_g"), pick("3 * n div 4").alias("p75_g"))
    unit = best_unit(F.col("median_g"))
    return out.select("name", unit["value"].alias("value"), unit["unit"].alias("unit"), F.col("n").alias("sample_count"), "p25_g", "median_g", "p75_g")


def medians_simple(medians: DataFrame) -> DataFrame:
    return medians.select("name", "value", "unit")
