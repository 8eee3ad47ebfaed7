"""Receipts: adapting items, dates, keys, purchase history, user profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

NUTRIENTS = list(fixed.INTAKE)


def adapt_items(items: DataFrame) -> DataFrame:
    """Items with status: matched if calories and one of protein, fat, carbs are known; unknown nutrients become 0."""
    known = F.col("calories").isNotNull() & F.coalesce("protein_g", "fat_g", "carbs_g").isNotNull()
    return items.withColumn("status", F.when(known, "matched").otherwise("unmatched")).withColumns({n: F.coalesce(n, F.lit(0.0)) for n in NUTRIENTS})


def receipt_nutrition(adapted: DataFrame, key: str) -> DataFrame:
    """Sums over matched items, and the numbers of matched and of all items; receipts without items have no row."""
    matched = F.col("status") == "matched"
    return adapted.groupBy(key).agg(*[F.sum(F.when(matched, F.col(n)).otherwise(0.0)).alias(n) for n in NUTRIENTS], F.count_if(matched).alias("n_matched"), F.count("*").alias("n_items"))


def adapt_incremental(done: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What was adapted before, and the new receipts that were not."""
    return done.unionByName(new.join(done.select(key), key, "left_anti"), allowMissingColumns=True)


def filled(*columns: str) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in columns])


def money(text: Column) -> Column:
    """An amount without $ and commas; blank and anything else is null."""
    return F.regexp_replace(text, "[$,]", "").try_cast("double")


def normalize_receipts(raw: DataFrame) -> DataFrame:
    """Read receipts (see sources.readers.RECEIPT) to one shape: alternate names, matched items only, defaults, totals.

    Stored totals count unless calories are missing or 0; then the sums of the items do.
    """
    default = lambda c, v: F.coalesce(c, F.lit(v))
    kept = F.filter("items", lambda x: (x["status"] == "matched") & x["nutrition"].isNotNull())
    item = lambda x: F.struct(
        F.coalesce(F.nullif(x["matched_name"], F.lit("")), F.nullif(x["original_name"], F.lit("")), F.lit("unknown")).alias("food_name"), x["original_name"].alias("original_name"), default(x["portion_g"], 100.0).alias("portion_g"),
        *[default(x["nutrition"][n], 0.0).alias(n) for n in NUTRIENTS], x["price"].alias("price"),
    )
    out = raw.select("source_file", filled("date", "receipt_date", "purchase_date").alias("date_text"), F.coalesce("store_name", "store", F.lit("Unknown")).alias("store"), money(F.coalesce("total", "total_price")).alias("total_price"), F.transform(kept, item).alias("items"), "totals")
    summed = lambda n: F.aggregate("items", F.lit(0.0), lambda acc, x: acc + x[n])
    stored = F.coalesce(F.col("totals.calories"), F.lit(0.0)) != 0
    return out.withColumn("totals", F.struct(*[F.when(stored, F.coalesce(f"totals.{n}", F.lit(0.0))).otherwise(summed(n)).alias(n) for n in NUTRIENTS]))


def food_category(name: Column, strict: bool = False) -> Column:
    """The category of the keyword that equals the name; else of the first that the name holds or that holds the name; else Other.

    ``strict`` leaves out keywords that hold the name, which blank and very short names all do.
    """
    n = F.lower(F.trim(name))
    table = F.create_map(*[F.lit(x) for pair in fixed.FOOD_KEYWORDS.items() for x in pair])
    first = F.coalesce(*[F.when(n.contains(k) | (F.lit(k).contains(n) if not strict else F.lit(False)), F.lit(c)) for k, c in fixed.FOOD_KEYWORDS.items()])
    return F.coalesce(F.try_element_at(table, n), first, F.lit("Other"))


def impute_dates(receipts: DataFrame, key: str, date: str, order: str, today: Column | None = None) -> DataFrame:
    """Missing dates per user: from three days before the first known (without any, four days times their number
    before ``today``), the next missing one each four days later, in input order."""
    today = F.current_date() if today is None else today
    user = Window.partitionBy(key)
    missing = F.col(date).isNull()
    nth = F.row_number().over(Window.partitionBy(key, missing).orderBy(order)) - 1
    base = F.coalesce(F.date_sub(F.min(date).over(user), 3), F.date_sub(today, (4 * F.count_if(missing).over(user)).cast("int")))
    return receipts.withColumns({"__base": base, "__nth": nth}).withColumn(date, F.coalesce(date, F.date_add("__base", (4 * F.col("__nth")).cast("int")))).drop("__base", "__nth")


def purchase_history(receipts: DataFrame, key: str, date: str, order: str) -> DataFrame:
    """Receipts numbered per user by date, with the days since the user's first."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(date, order))
    return receipts.withColumns({"receipt_id": number, "day_index": F.datediff(date, F.min(date).over(Window.partitionBy(key)))})


def signal_summary(daily: DataFrame, key: str) -> DataFrame:
    shopping = F.count_if(F.col("calories") > 0)
    return daily.groupBy(key).agg(F.min("date").alias("first"), F.max("date").alias("last"), shopping.alias("shopping_days"), (F.count("*") - shopping).alias("other_days"))


def receipt_keys(receipts: DataFrame, key: str, date: str, store: str, order: str) -> DataFrame:
    """A file-like key per receipt: the date; with the store if the date is taken; with a number from 2 if that is too.
    Receipts without a date are missing_date_001 and so on. First come, first served, by ``order``."""
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(store)), " ", "_"), "'", ""), "&", "and")
    rows = receipts.withColumn("__slug", F.coalesce(slug, F.lit(""))).withColumn("__day", F.row_number().over(Window.partitionBy(key, date).orderBy(order)))
    stem = F.when((F.col("__day") > 1) & (F.col("__slug") != ""), F.concat(F.col(date).cast("string"), F.lit("_"), F.col("__slug"))).otherwise(F.col(date).cast("string"))
    rows = rows.withColumn("__stem", stem).withColumn("__nth", F.row_number().over(Window.partitionBy(key, "__stem").orderBy(order)))
    dated = F.when(F.col("__nth") > 1, F.concat_ws("_", "__stem", F.col("__nth").cast("string"))).otherwise(F.col("__stem"))
    undated = F.concat(F.lit("missing_date_"), F.lpad(F.col("__nth").cast("string"), 3, "0"))
    return rows.withColumn("receipt_key", F.when(F.col(date).isNull(), undated).otherwise(dated)).drop("__slug", "__day", "__stem", "__nth")


def date_range(receipts: DataFrame, key: str, date: str) -> DataFrame:
    ends = F.concat(F.min(date).cast("string"), F.lit(" to "), F.max(date).cast("string"))
    return receipts.groupBy(key).agg(F.coalesce(ends, F.lit("undated")).alias("date_range"))


def user_profile(receipts: DataFrame, key: str, date: str, before: DataFrame | None = None) -> DataFrame:
    """Receipts and last run per user; created stays what ``before`` (key, created) says."""
    now = receipts.groupBy(key).agg(F.count("*").alias("receipt_count"), F.max(date).alias("last_run"), F.min(date).alias("first"))
    if before is None:
        return now.withColumnRenamed("first", "created")
    return now.join(before, key, "left").withColumn("created", F.coalesce("created", "first")).drop("first")


def run_summary(log: DataFrame) -> DataFrame:
    """Rows (success, n, failed): a row of counts for each outcome, failed null, and a row for each failed name, n null."""
    counts = log.groupBy("success").agg(F.count("*").alias("n")).withColumn("failed", F.lit(None).cast("string"))
    names = log.where(~F.col("success")).select("success", F.lit(None).cast("long").alias("n"), F.col("base_name").alias("failed"))
    return counts.unionByName(names)
