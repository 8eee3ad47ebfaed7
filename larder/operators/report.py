"""Tables behind the report: items, categories, stores, spending, intake, insights. All per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Advice by nutrient, in the order in which it is given; the last advice is to keep on with the most regular signal.
ACTIONS = {
    "fiber_g": "fiber is low: eat beans, lentils or wholemeal bread",
    "calories": "energy is low: eat larger meals, with oil or nut butter",
    "carbs_g": "carbohydrates are low: eat potatoes, pasta or fruit",
    "fat_g": "fat is low: eat oily fish, seeds or nuts",
}
KEEP_ON = "keep on buying regularly: "


def item_frequency(items: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Names by how often they come, equals by first seen, with their rank."""
    rows = items.groupBy(key, name).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first_seen", name)))


def item_prices(items: DataFrame, receipt: str, name: str, price: str, total: str) -> DataFrame:
    """Per name the number and sum of prices; a missing or 0 price is the receipt's total over its number of items, or 0."""
    shared = F.coalesce(F.col(total), F.lit(0.0)) / F.count("*").over(Window.partitionBy(receipt))
    paid = F.when(F.coalesce(price, F.lit(0.0)) != 0, F.col(price)).otherwise(shared)
    return items.withColumn("__paid", paid).groupBy(name).agg(F.count("*").alias("n"), F.sum("__paid").alias("spent"))


def category_counts(items: DataFrame, key: str, category: str) -> DataFrame:
    return items.groupBy(key, category).agg(F.count("*").alias("n"))


def store_visits(receipts: DataFrame, key: str, store: str) -> DataFrame:
    """Visits per store with a name, and the rank."""
    visits = receipts.where(F.trim(store) != "").groupBy(key, F.trim(store).alias("store")).agg(F.count("*").alias("visits"))
    return visits.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("visits"), "store")))


def spending(receipts: DataFrame, key: str, total: str) -> DataFrame:
    """Sum, and mean over all receipts, those without a total counting 0."""
    spent = F.sum(F.coalesce(total, F.lit(0.0)))
    return receipts.groupBy(key).agg(spent.alias("total_spending"), (spent / F.count("*")).alias("per_receipt"))


def weekly_trend(smooth: DataFrame, key: str, column: str, weeks: int = 8) -> DataFrame:
    """Mean per week for ``weeks`` weeks; null for weeks without days."""
    means = smooth.groupBy(key, F.expr("day_index div 7").cast("int").alias("week")).agg(F.avg(column).alias("mean"))
    slots = smooth.select(key).distinct().withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    return slots.join(means, [key, "week"], "left")


def macro_split(intake: DataFrame, key: str) -> DataFrame:
    """Shares of carbs, protein and fat by grams."""
    wide = intake.groupBy(key).pivot("nutrient", ["carbs_g", "protein_g", "fat_g"]).agg(F.first("avg"))
    total = F.col("carbs_g") + F.col("protein_g") + F.col("fat_g")
    return wide.select(key, *[F.try_divide(F.col(n), total).alias(f"{n[:-2]}_share") for n in ("carbs_g", "protein_g", "fat_g")])


def band(pct: Column) -> Column:
    return F.when(pct < 80, "red").when(pct < 100, "amber").otherwise("green")


def target_percent(intake: DataFrame, key: str) -> DataFrame:
    pct = F.col("avg") / F.col("target") * 100
    return intake.select(key, "nutrient", pct.alias("pct"), band(pct).alias("band"))


def insights(intake: DataFrame, regularity: DataFrame, key: str, least: float = 80.0) -> DataFrame:
    """Rows (key, section, name, value): nutrients good and low at ``least`` per cent of their target, the gap of the
    low ones, the most and the least regular signal, and the actions for low nutrients in order, the last of
    which is to keep on with the most regular signal."""
    pct = F.col("avg") / F.col("target") * 100
    good = intake.where(pct >= least).select(key, F.lit("good").alias("section"), F.col("nutrient").alias("name"), pct.alias("value"))
    low = intake.where(pct < least)
    gaps = low.select(key, F.lit("improve").alias("section"), F.col("nutrient").alias("name"), (F.col("target") - F.col("avg")).alias("value"))
    named = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    nth = F.create_map(*[F.lit(x) for i, n in enumerate(ACTIONS) for x in (n, i)])
    acts = low.where(F.col("nutrient").isin(*ACTIONS)).withColumn("value", F.row_number().over(Window.partitionBy(key).orderBy(F.element_at(nth, F.col("nutrient")))).cast("double"))
    acts = acts.select(key, F.lit("action").alias("section"), F.element_at(named, F.col("nutrient")).alias("name"), "value")
    last = F.max("rank").over(Window.partitionBy(key))
    ends = regularity.withColumn("last", last).where((F.col("rank") == 1) | (F.col("rank") == F.col("last")))
    ends = ends.select(key, F.when(F.col("rank") == 1, "most_regular").otherwise("least_regular").alias("section"), F.col("signal").alias("name"), F.col("weekly_ratio").alias("value"))
    many = acts.groupBy(key).agg(F.count("*").alias("k"))
    keep = ends.where("section = 'most_regular'").join(many, key, "left")
    keep = keep.select(key, F.lit("action").alias("section"), F.concat(F.lit(KEEP_ON), "name").alias("name"), (F.coalesce("k", F.lit(0)) + 1).cast("double").alias("value"))
    return good.unionByName(gaps).unionByName(acts).unionByName(ends).unionByName(keep)


def purchase_insights(items: DataFrame, stores: DataFrame, spent: DataFrame, key: str, name: str, store: str) -> DataFrame:
    """Rows (key, section, name, value) from item_frequency, store_visits and spending: the most bought item and the most
    visited store with their numbers, the total spent and per receipt, to four decimals."""
    top = items.where("rank = 1").select(key, F.lit("top_item").alias("section"), F.col(name).alias("name"), F.col("n").cast("double").alias("value"))
    shop = stores.where("rank = 1").select(key, F.lit("top_store").alias("section"), F.col(store).alias("name"), F.col("visits").cast("double").alias("value"))
    money = [spent.select(key, F.lit("spending").alias("section"), F.lit(n).alias("name"), F.round(c, 4).alias("value")) for n, c in (("total", "total_spending"), ("per_receipt", "per_receipt"))]
    return top.unionByName(shop).unionByName(money[0]).unionByName(money[1])


def item_report(items: DataFrame) -> DataFrame:
    """Items with the resolved name, or the raw one, a quantity of at least 1, and whether the name changed."""
    shown = F.coalesce(F.when(F.col("resolved_name") != "", F.col("resolved_name")), F.col("name"))
    rest = [c for c in items.columns if c not in ("name", "resolved_name", "qty")]
    return items.select(*rest, shown.alias("name"), F.coalesce("qty", F.lit(1)).alias("qty"), (shown != F.col("name")).alias("renamed"))
