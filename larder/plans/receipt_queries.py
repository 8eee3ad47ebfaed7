"""Receipts, purchase history and the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, fixed
from ..operators import receipts as rc
from ..operators import report as rp
from ..operators import signals as sg
from . import signal_queries as sq
from .registry import query
from .views import view

N = rc.NUTRIENTS
_KNOWN = "calories IS NOT NULL AND coalesce(protein_g, fat_g, carbs_g) IS NOT NULL"
_ADAPTED = f"SELECT receipt_no, pos, name, CASE WHEN {_KNOWN} THEN 'matched' ELSE 'unmatched' END AS status, {', '.join(f'coalesce({n}, 0) AS {n}' for n in N)} FROM {{receipt_items}}"
_TOTALS = f"SELECT receipt_no, {', '.join(f'sum(CASE WHEN status = ' + chr(39) + 'matched' + chr(39) + f' THEN {n} ELSE 0 END) AS {n}' for n in N)}, count(*) FILTER (status = 'matched') AS n_matched, count(*) AS n_items FROM ({_ADAPTED}) GROUP BY receipt_no"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("ag1_adapt_items", _ADAPTED)
def ag1(spark, sf):
    return rc.adapt_items(view(spark, sf, "receipt_items")).select("receipt_no", "pos", "name", "status", *N)


@query("ag2_receipt_nutrition", _TOTALS)
def ag2(spark, sf):
    return rc.receipt_nutrition(rc.adapt_items(view(spark, sf, "receipt_items")), "receipt_no")


@query("ag4_adapt_incremental", f"SELECT * FROM ({_TOTALS})")
def ag4(spark, sf):
    done = rc.receipt_nutrition(rc.adapt_items(view(spark, sf, "receipt_items").where("receipt_no % 3 = 0")), "receipt_no")
    return rc.adapt_incremental(done, ag2(spark, sf), "receipt_no")


_CAT = "coalesce(CASE n " + " ".join(f"WHEN {_q(k)} THEN {_q(c)}" for k, c in fixed.FOOD_KEYWORDS.items()) + " END, CASE " + " ".join(f"WHEN contains(n, {_q(k)}) OR contains({_q(k)}, n) THEN {_q(c)}" for k, c in fixed.FOOD_KEYWORDS.items()) + " END, 'Other')"
_FOODS = "SELECT search_id, CASE search_id % 5 WHEN 0 THEN concat(name, ' organic banana') WHEN 1 THEN 'Ribeye Steak' WHEN 2 THEN 'Regular' WHEN 3 THEN concat(substr(name, 1, 3), ' MILK') ELSE name END AS food FROM {searches}"


@query("ag7_food_category", f"SELECT search_id, food, {_CAT} AS category FROM (SELECT *, lower(trim(food)) AS n FROM ({_FOODS}))")
def ag7(spark, sf):
    return spark.sql(_FOODS, searches=view(spark, sf, "searches")).withColumn("category", rc.food_category(F.col("food")))


_DATES = """SELECT o_orderkey, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 8 WHEN 0 THEN concat(year(o_orderdate), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))
 WHEN 1 THEN concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate)) WHEN 2 THEN concat(month(o_orderdate), '/', day(o_orderdate), '/', substr(CAST(year(o_orderdate) AS STRING), 3, 2)) WHEN 3 THEN concat(year(o_orderdate), '/', month(o_orderdate), '/', day(o_orderdate))
 WHEN 4 THEN concat(day(o_orderdate), '-', month(o_orderdate), '-', year(o_orderdate)) WHEN 5 THEN concat(CASE month(o_orderdate) WHEN 1 THEN 'JANUARY' WHEN 2 THEN 'February' ELSE 'Mar' END, ' ', day(o_orderdate), ', ', year(o_orderdate)) WHEN 6 THEN 'soon' END AS t FROM {orders}"""
_PARSED = "SELECT o_orderkey, user_id, CASE WHEN o_orderkey % 8 < 5 THEN d WHEN o_orderkey % 8 = 5 THEN make_date(year(d), least(month(d), 3), CASE WHEN month(d) = 2 OR month(d) <> 2 THEN day(d) END) END AS date FROM ({0})".format(_DATES)


@query("ag8_parse_date", _PARSED)
def ag8(spark, sf):
    rows = spark.sql(_DATES, orders=view(spark, sf, "orders"))
    return rows.select("o_orderkey", "user_id", dates.parse_date(F.col("t")).alias("date"))


@query(
    "ag9_impute_dates",
    f"""WITH p AS ({_PARSED}), m AS (SELECT *, row_number() OVER (PARTITION BY user_id, date IS NULL ORDER BY o_orderkey) - 1 AS i, min(date) OVER (PARTITION BY user_id) AS f, count(*) FILTER (date IS NULL) OVER (PARTITION BY user_id) AS k FROM p)
SELECT o_orderkey, user_id, coalesce(date, coalesce(f - 3, DATE '2001-12-31' - (4 * k)::INT) + (4 * i)::INT)::DATE AS date FROM m""",
)
def ag9(spark, sf):
    return rc.impute_dates(ag8(spark, sf), "user_id", "date", "o_orderkey", F.lit("2001-12-31").cast("date"))


@query("ag13_purchase_history", "SELECT receipt_no, user_id, date, row_number() OVER (PARTITION BY user_id ORDER BY date, receipt_no)::INT AS receipt_id, (date - min(date) OVER (PARTITION BY user_id))::INT AS day_index FROM {receipts}")
def ag13(spark, sf):
    return rc.purchase_history(view(spark, sf, "receipts"), "user_id", "date", "receipt_no").select("receipt_no", "user_id", "date", "receipt_id", "day_index")


@query("ag14_signal_summary", f"WITH {sq._DAILY} SELECT user_id, min(date) AS first, max(date) AS last, count(*) FILTER (calories > 0) AS shopping_days, count(*) FILTER (calories <= 0) AS other_days FROM daily GROUP BY user_id")
def ag14(spark, sf):
    return rc.signal_summary(sq._daily(spark, sf), "user_id")


_KEYS = "SELECT receipt_no, user_id % 20 AS user_id, CASE WHEN receipt_no % 50 = 0 THEN NULL ELSE date_trunc('MONTH', date) END AS month, store FROM {receipts}"


@query(
    "ag15_receipt_keys",
    f"""WITH k AS (SELECT receipt_no, user_id, month::DATE AS date, replace(replace(replace(lower(trim(store)), ' ', '_'), '''', ''), '&', 'and') AS slug FROM ({_KEYS})),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY receipt_no) AS nd FROM k), b AS (SELECT *, CASE WHEN nd > 1 AND slug <> '' THEN concat(date::VARCHAR, '_', slug) ELSE date::VARCHAR END AS stem FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, CASE WHEN date IS NULL THEN NULL ELSE stem END ORDER BY receipt_no) AS nth FROM b)
SELECT receipt_no, user_id, CASE WHEN date IS NULL THEN concat('missing_date_', lpad(nth::VARCHAR, 3, '0')) WHEN nth > 1 THEN concat(stem, '_', nth) ELSE stem END AS receipt_key FROM c""",
)
def ag15(spark, sf):
    rows = spark.sql(_KEYS, receipts=view(spark, sf, "receipts")).withColumn("date", F.col("month").cast("date"))
    return rc.receipt_keys(rows, "user_id", "date", "store", "receipt_no").select("receipt_no", "user_id", "receipt_key")


@query("ag16_date_range", "SELECT user_id, concat(min(date)::VARCHAR, ' to ', max(date)::VARCHAR) AS date_range FROM {receipts} GROUP BY user_id")
def ag16(spark, sf):
    return rc.date_range(view(spark, sf, "receipts"), "user_id", "date")


@query("ag17_user_profile", "SELECT user_id, count(*) AS receipt_count, max(date) AS last_run, CASE WHEN user_id % 2 = 0 THEN DATE '1990-01-01' ELSE min(date) END AS created FROM {receipts} GROUP BY user_id")
def ag17(spark, sf):
    before = view(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.lit("1990-01-01").cast("date").alias("created"))
    return rc.user_profile(view(spark, sf, "receipts"), "user_id", "date", before)


@query(
    "ag18_run_summary",
    """SELECT o_orderkey % 97 <> 0 AS success, count(*) AS n, NULL::VARCHAR AS failed FROM {orders} GROUP BY 1
UNION ALL SELECT false, NULL, concat('r', o_orderkey) FROM {orders} WHERE o_orderkey % 97 = 0""",
)
def ag18(spark, sf):
    log = view(spark, sf, "orders").select((F.col("o_orderkey") % 97 != 0).alias("success"), F.concat(F.lit("r"), "o_orderkey").alias("base_name"))
    return rc.run_summary(log)


def _bought(spark, sf):
    return view(spark, sf, "receipt_items").join(view(spark, sf, "receipts"), "receipt_no").withColumn("seen", F.col("receipt_no") * 1000 + F.col("pos"))


_BOUGHT = "SELECT *, receipt_no * 1000 + pos AS seen FROM {receipt_items} JOIN {receipts} USING (receipt_no)"


@query("rp1_item_frequency", f"SELECT user_id, name, n, first_seen, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_seen, name)::INT AS rank FROM (SELECT user_id, name, count(*) AS n, min(seen) AS first_seen FROM ({_BOUGHT}) GROUP BY user_id, name)")
def rp1(spark, sf):
    return rp.item_frequency(_bought(spark, sf), "user_id", "name", "seen")


@query("rp2_item_prices", f"SELECT name, count(*) AS n, round(sum(CASE WHEN coalesce(line_price, 0) <> 0 THEN line_price ELSE coalesce(total_price, 0) / k END), 2) AS spent FROM (SELECT *, count(*) OVER (PARTITION BY receipt_no) AS k FROM ({_BOUGHT})) GROUP BY name")
def rp2(spark, sf):
    return rp.item_prices(_bought(spark, sf), "receipt_no", "name", "line_price", "total_price").withColumn("spent", F.round("spent", 2))


@query("rp3_category_counts", "SELECT user_id, category, count(*) AS n FROM {daily_items} GROUP BY user_id, category")
def rp3(spark, sf):
    return rp.category_counts(view(spark, sf, "daily_items"), "user_id", "category")


@query("rp4_store_visits", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY visits DESC, store)::INT AS rank FROM (SELECT user_id, trim(store) AS store, count(*) AS visits FROM {receipts} WHERE trim(store) <> '' GROUP BY 1, 2)")
def rp4(spark, sf):
    return rp.store_visits(view(spark, sf, "receipts"), "user_id", "store")


@query("rp5_spending", "SELECT user_id, round(sum(coalesce(total_price, 0)), 2) AS total_spending, round(sum(coalesce(total_price, 0)) / count(*), 4) AS per_receipt FROM {receipts} GROUP BY user_id")
def rp5(spark, sf):
    return rp.spending(view(spark, sf, "receipts"), "user_id", "total_price").select("user_id", F.round("total_spending", 2).alias("total_spending"), F.round("per_receipt", 4).alias("per_receipt"))


@query("rp6_weekly_trend", f"WITH {sq._SMOOTH} SELECT u.user_id, w.week::INT AS week, round(avg(calories_ma7), 6) AS mean FROM (SELECT DISTINCT user_id FROM smooth) u CROSS JOIN generate_series(0, 7) w(week) LEFT JOIN smooth s ON s.user_id = u.user_id AND s.day_index // 7 = w.week GROUP BY ALL")
def rp6(spark, sf):
    return rp.weekly_trend(sq._smooth(spark, sf), "user_id", "calories_ma7").withColumn("mean", F.round("mean", 6))


@query("rp7_avg_intake", f"WITH {sq._DETECT} SELECT user_id, nutrient, round(avg, 6) AS avg, target FROM intake")
def rp7(spark, sf):
    return sg.avg_intake(sq._smooth(spark, sf), "user_id").withColumn("avg", F.round("avg", 6))


_SHARE = "max(avg) FILTER (nutrient = 'carbs_g') AS c, max(avg) FILTER (nutrient = 'protein_g') AS p, max(avg) FILTER (nutrient = 'fat_g') AS f"


@query("rp8_macro_split", f"WITH {sq._DETECT} SELECT user_id, round(c / nullif(c + p + f, 0), 6) AS carbs_share, round(p / nullif(c + p + f, 0), 6) AS protein_share, round(f / nullif(c + p + f, 0), 6) AS fat_share FROM (SELECT user_id, {_SHARE} FROM intake GROUP BY user_id)")
def rp8(spark, sf):
    found = rp.macro_split(sg.avg_intake(sq._smooth(spark, sf), "user_id"), "user_id")
    return found.withColumns({c: F.round(c, 6) for c in found.columns[1:]})


@query("rp9_target_percent", f"WITH {sq._DETECT} SELECT user_id, nutrient, round(avg / target * 100, 6) AS pct, CASE WHEN avg / target * 100 < 80 THEN 'red' WHEN avg / target * 100 < 100 THEN 'amber' ELSE 'green' END AS band FROM intake")
def rp9(spark, sf):
    return rp.target_percent(sg.avg_intake(sq._smooth(spark, sf), "user_id"), "user_id").withColumn("pct", F.round("pct", 6))


_ACT = " UNION ALL ".join(f"SELECT '{n}' AS nutrient, {i} AS o, {_q(t)} AS advice" for i, (n, t) in enumerate(rp.ACTIONS.items()))


@query(
    "rp10_insights",
    f"""WITH {sq._BINS.replace(sq._DAILY, sq._DETECT)}, reg AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weekly_ratio, 9) DESC, signal) AS rank, count(*) OVER (PARTITION BY user_id) AS last FROM strength),
low AS (SELECT * FROM intake WHERE avg / target * 100 < 80), n_acts AS (SELECT user_id, count(*) FILTER (nutrient IN (SELECT nutrient FROM ({_ACT}))) AS k FROM low GROUP BY user_id)
SELECT user_id, 'good' AS section, nutrient AS name, round(avg / target * 100, 6) AS value FROM intake WHERE avg / target * 100 >= 80
UNION ALL SELECT user_id, 'improve', nutrient, round(target - avg, 6) FROM low
UNION ALL SELECT user_id, 'action', advice, row_number() OVER (PARTITION BY user_id ORDER BY o) FROM low JOIN ({_ACT}) USING (nutrient)
UNION ALL SELECT user_id, 'action', concat('{rp.KEEP_ON}', signal), coalesce(k, 0) + 1 FROM reg LEFT JOIN n_acts USING (user_id) WHERE rank = 1
UNION ALL SELECT user_id, CASE WHEN rank = 1 THEN 'most_regular' ELSE 'least_regular' END, signal, round(weekly_ratio, 6) FROM reg WHERE rank = 1 OR rank = last""",
)
def rp10(spark, sf):
    intake = sg.avg_intake(sq._smooth(spark, sf), "user_id")
    reg = sg.regularity(sg.weekly_strength(sq._spectrum(spark, sf), "user_id"), "user_id")
    return rp.insights(intake, reg, "user_id").withColumn("value", F.round("value", 6))


_FREQUENT = f"SELECT user_id, name, count(*) AS n, min(seen) AS first_seen FROM ({_BOUGHT}) GROUP BY user_id, name"


@query(
    "rp10_purchase_insights",
    f"""SELECT user_id, 'top_item' AS section, name, n::DOUBLE AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_seen, name) AS rank FROM ({_FREQUENT})) WHERE rank = 1
UNION ALL SELECT user_id, 'top_store', store, visits::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY visits DESC, store) AS rank
  FROM (SELECT user_id, trim(store) AS store, count(*) AS visits FROM {{receipts}} WHERE trim(store) <> '' GROUP BY 1, 2)) WHERE rank = 1
UNION ALL SELECT user_id, 'spending', 'total', round(sum(coalesce(total_price, 0)), 4) FROM {{receipts}} GROUP BY user_id
UNION ALL SELECT user_id, 'spending', 'per_receipt', round(sum(coalesce(total_price, 0)) / count(*), 4) FROM {{receipts}} GROUP BY user_id""",
)
def rp10_purchases(spark, sf):
    return rp.purchase_insights(rp1(spark, sf), rp4(spark, sf), rp.spending(view(spark, sf, "receipts"), "user_id", "total_price"), "user_id", "name", "store")


@query("rp11_item_report", "SELECT receipt_no, pos, CASE WHEN pos % 2 = 0 THEN upper(name) ELSE name END AS name, coalesce(qty, 1) AS qty, pos % 2 = 0 AND upper(name) <> name AS renamed FROM {receipt_items}")
def rp11(spark, sf):
    items = view(spark, sf, "receipt_items").select("receipt_no", "pos", "name", "qty", F.when(F.col("pos") % 2 == 0, F.upper("name")).otherwise("").alias("resolved_name"))
    return rp.item_report(items)
