"""Signals of the daily items: spine, averages, detection, periodicity."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import signals as sg
from .registry import query
from .views import view

CATEGORIES = ["click", "error", "purchase", "signup", "view"]
CATS = [f"cat_{c}" for c in CATEGORIES]
KEY = "user_id"


def _daily(spark, sf):
    return sg.daily_signal(view(spark, sf, "daily_items"), KEY, sg.NUTRIENTS, "category", CATEGORIES)


def _smooth(spark, sf):
    return sg.smoothed_signal(_daily(spark, sf), KEY, sg.NUTRIENTS)


def _spectrum(spark, sf):
    return sg.dft(_daily(spark, sf), KEY, CATS)


_SPAN = """
e AS (SELECT * FROM {daily_items}),
span AS (SELECT user_id, min(date) AS f, max(date) AS l FROM e GROUP BY user_id),
days AS (SELECT user_id, f, unnest(generate_series(f, CASE WHEN l - f + 1 < 14 THEN f + 27 ELSE l END, INTERVAL 1 DAY))::DATE AS date FROM span)"""
_DAILY = f"""{_SPAN},
daily AS (
  SELECT d.user_id, (d.date - d.f)::INT AS day_index, d.date, {", ".join(f"coalesce(round(sum({n}), 1), 0) AS {n}" for n in sg.NUTRIENTS)},
         {", ".join(f"coalesce(max(CASE WHEN category = '{c}' THEN 1 ELSE 0 END), 0)::INT AS cat_{c}" for c in CATEGORIES)}
  FROM days d LEFT JOIN e ON e.user_id = d.user_id AND e.date = d.date GROUP BY ALL)"""
_SMOOTH = f"""{_DAILY},
smooth AS (
  SELECT user_id, day_index, date, {", ".join(f"{n} AS {n}_raw, round(sum({n}) OVER w / 7, 2) AS {n}_ma7" for n in sg.NUTRIENTS)}, {", ".join(CATS)}
  FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day_index ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""
_DETECT = f"""{_SMOOTH},
long AS ({" UNION ALL ".join(f"SELECT user_id, day_index, '{n}' AS nutrient, {t}::DOUBLE AS target, {n}_raw AS raw, {n}_ma7 AS ma FROM smooth" for n, t in sg.TARGETS.items())}),
report AS (
  SELECT user_id, nutrient, target, avg(CASE WHEN raw < target THEN 1.0 ELSE 0 END) AS d_raw,
         coalesce(avg(CASE WHEN day_index >= 2 THEN CASE WHEN ma < target THEN 1.0 ELSE 0 END END), 0) AS d_ma
  FROM long GROUP BY user_id, nutrient, target),
intake AS (SELECT user_id, nutrient, target, avg(ma) AS avg FROM long WHERE day_index >= 2 GROUP BY user_id, nutrient, target)"""
_BINS = f"""{_DAILY},
signals AS ({" UNION ALL ".join(f"SELECT user_id, day_index, 'cat_{c}' AS signal, cat_{c} AS x FROM daily" for c in CATEGORIES)}),
sized AS (SELECT *, count(*) OVER (PARTITION BY user_id, signal) AS n FROM signals),
ks AS (SELECT *, unnest(generate_series(1, n // 2 - 1))::INT AS k FROM sized WHERE n >= 4),
spectrum AS (
  SELECT user_id, signal, n, k, sqrt(pow(sum(x * cos(2 * pi() * (k * day_index % n) / n)), 2) + pow(sum(x * sin(2 * pi() * (k * day_index % n) / n)), 2)) AS magnitude
  FROM ks GROUP BY user_id, signal, n, k),
strength AS (
  SELECT user_id, signal, CASE WHEN sum(magnitude) > 1e-9 THEN coalesce(sum(CASE WHEN k = round_even(n / 7, 0) THEN magnitude END) / sum(magnitude), 0) ELSE 0 END AS weekly_ratio
  FROM spectrum GROUP BY user_id, signal)"""


@query("ag10_calendar_spine", f"WITH {_SPAN} SELECT user_id, (date - f)::INT AS day_index, date FROM days")
def ag10(spark, sf):
    return sg.calendar_spine(view(spark, sf, "daily_items"), KEY)


query("ag11_daily_signal", f"WITH {_DAILY} SELECT * FROM daily")(_daily)
query("sg4_smoothed_signal", f"WITH {_SMOOTH} SELECT * FROM smooth")(_smooth)


@query("sg1_moving_average", f"""WITH {_DAILY} SELECT user_id, day_index, round(sum(calories) OVER (PARTITION BY user_id ORDER BY day_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 3, 6) AS calories_ma3 FROM daily""")
def sg1(spark, sf):
    return sg.moving_average(_daily(spark, sf), KEY, ["calories"], 3).select(KEY, "day_index", F.round("calories_ma3", 6).alias("calories_ma3"))


_WINDOWS = " UNION ALL ".join(
    f"SELECT user_id, day_index, {n} AS n, sum(calories) OVER (PARTITION BY user_id ORDER BY day_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) / {n} AS y FROM daily" for n in (1, 3, 7, 14)
)


@query("sg2_ma_ablation", f"WITH {_DAILY}, w AS ({_WINDOWS}) SELECT user_id, n, round(avg(y), 6) AS mean, round(max(y), 6) AS greatest, count(*) FILTER (y > 1) AS days_over_1 FROM w WHERE n > 1 GROUP BY user_id, n")
def sg2(spark, sf):
    found = sg.ma_ablation(_daily(spark, sf), KEY, "calories")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "greatest")})


@query(
    "sg3_snr",
    f"""WITH {_DAILY}, w AS ({_WINDOWS}), b AS (SELECT *, coalesce(min(CASE WHEN y > 0 THEN day_index END) OVER (PARTITION BY user_id, n), 0) AS begin_at FROM w)
SELECT user_id, n, round(pow(avg(y), 2) / greatest(var_pop(y), 1e-10), 6) AS snr FROM b WHERE day_index >= begin_at GROUP BY user_id, n""",
)
def sg3(spark, sf):
    return sg.snr(_daily(spark, sf), KEY, "calories").withColumn("snr", F.round("snr", 6))


@query("sg5_sparsity", f"WITH {_DAILY} SELECT user_id, count(*) FILTER (calories <> 0) AS shopping_days, round(count(*) FILTER (calories <> 0) * 100.0 / count(*), 6) AS pct FROM daily GROUP BY user_id")
def sg5(spark, sf):
    return sg.sparsity(_daily(spark, sf), KEY, "calories").withColumn("pct", F.round("pct", 6))


@query(
    "sg6_detection_table",
    f"WITH {_SMOOTH} SELECT user_id, day_index, date, " + ", ".join(f"{n}_ma7, CASE WHEN day_index >= 2 AND {n}_ma7 < {t} THEN 1 ELSE 0 END AS {n}_deficient" for n, t in sg.TARGETS.items()) + " FROM smooth",
)
def sg6(spark, sf):
    return sg.detection_table(_smooth(spark, sf), KEY)


@query("sg8_detection_report", f"WITH {_DETECT} SELECT user_id, nutrient, target, round(d_raw, 6) AS d_raw, round(d_ma, 6) AS d_ma, (d_ma > 0.5)::INT AS flag FROM report")
def sg8(spark, sf):
    return sg.detection_report(_smooth(spark, sf), KEY).withColumns({c: F.round(c, 6) for c in ("d_raw", "d_ma")})


@query("sg9_false_alarm_reduction", f"WITH {_DETECT} SELECT user_id, nutrient, round(d_raw - d_ma, 6) AS reduction FROM report WHERE round(d_raw - d_ma, 6) > 0.05")
def sg9(spark, sf):
    found = sg.detection_report(_smooth(spark, sf), KEY).withColumns({c: F.round(c, 9) for c in ("d_raw", "d_ma")})
    return sg.false_alarm_reduction(found, KEY, -1.0).withColumn("reduction", F.round("reduction", 6)).where("reduction > 0.05")


@query(
    "sg10_report_card",
    f"WITH {_DETECT} SELECT user_id, nutrient, target, round(avg, 6) AS avg, round(CASE WHEN avg < target THEN target - avg END, 6) AS gap, CASE WHEN avg < target THEN 'deficient' ELSE 'ok' END AS status FROM intake",
)
def sg10(spark, sf):
    return sg.report_card(_smooth(spark, sf), KEY).withColumns({c: F.round(c, 6) for c in ("avg", "gap")})


@query(
    "sg10_status_lists",
    f"""WITH {_DETECT} SELECT user_id, coalesce(string_agg(CASE WHEN avg < target THEN nutrient END, ',' ORDER BY nutrient), '') AS deficient,
        coalesce(string_agg(CASE WHEN avg >= target THEN nutrient END, ',' ORDER BY nutrient), '') AS ok FROM intake GROUP BY user_id""",
)
def sg10_lists(spark, sf):
    lists = sg.status_lists(sg.report_card(_smooth(spark, sf), KEY), KEY)
    return lists.withColumns({c: F.array_join(c, ",") for c in ("deficient", "ok")})


@query("sg12_dft", f"WITH {_BINS} SELECT user_id, signal, n, k, round(magnitude, 6) AS magnitude, round(n / k, 6) AS period FROM spectrum")
def sg12(spark, sf):
    return _spectrum(spark, sf).withColumns({c: F.round(c, 6) for c in ("magnitude", "period")})


@query("sg13_dominant_period", f"WITH {_BINS} SELECT user_id, signal, arg_max(k, round(magnitude, 9) * 100000 - k) AS k, round(max(n) / arg_max(k, round(magnitude, 9) * 100000 - k), 6) AS period FROM (SELECT user_id, signal, n, k, round(magnitude, 6) AS magnitude FROM spectrum) GROUP BY user_id, signal")
def sg13(spark, sf):
    return sg.dominant_period(_spectrum(spark, sf).withColumn("magnitude", F.round("magnitude", 6)), KEY).withColumn("period", F.round("period", 6))


@query("sg14_weekly_strength", f"WITH {_BINS} SELECT user_id, signal, round(weekly_ratio, 6) AS weekly_ratio FROM strength")
def sg14(spark, sf):
    return sg.weekly_strength(_spectrum(spark, sf), KEY).withColumn("weekly_ratio", F.round("weekly_ratio", 6))


@query("sg15_purchase_days", f"WITH {_BINS} SELECT user_id, signal, sum(x)::BIGINT AS days FROM signals GROUP BY user_id, signal")
def sg15(spark, sf):
    return sg.purchase_days(_daily(spark, sf), KEY, CATS)


@query(
    "sg16_regularity",
    f"WITH {_BINS} SELECT user_id, signal, round(weekly_ratio, 6) AS weekly_ratio, CASE WHEN weekly_ratio > 0.15 THEN 'Regular' ELSE 'Irregular' END AS regularity, row_number() OVER (PARTITION BY user_id ORDER BY round(weekly_ratio, 9) DESC, signal)::INT AS rank FROM strength",
)
def sg16(spark, sf):
    return sg.regularity(sg.weekly_strength(_spectrum(spark, sf), KEY), KEY).withColumn("weekly_ratio", F.round("weekly_ratio", 6))


@query("sg17_activity_matrix", f"WITH {_BINS} SELECT user_id, day_index, signal, x AS bought FROM signals")
def sg17(spark, sf):
    return sg.activity_matrix(_daily(spark, sf), KEY, CATS)


@query("sg18_period_axis", f"WITH {_BINS} SELECT DISTINCT user_id, n, k, round(n / k, 6) AS period FROM spectrum")
def sg18(spark, sf):
    return sg.period_axis(_spectrum(spark, sf), KEY).withColumn("period", F.round("period", 6))


flagship = partial(sg8)
