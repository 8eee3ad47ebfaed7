"""A month of real purchases through the signal operators, against results computed beforehand with plain arithmetic."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from larder.operators import report, signals
from larder.sources import readers

NUTRIENTS = ["calories", "protein_g", "carbs_g", "fat_g", "fiber_g"]
CATEGORIES = ["beverages", "dairy", "grains", "meat", "produce", "snacks"]
#: The days with purchases of 36 days from 2026-01-28 on, the five nutrients, the categories bought.
DAYS = """
0: 103.2 1.7 9.2 6.7 1.7
3: 3430.0 12.5 3.0 373.0 0.0
4: 808.4 11.6 80.8 52.0 5.8
8: 202.4 2.4 21.0 11.6 2.7
10: 1590.9 17.6 341.8 20.5 10.0
12: 11787.9 403.4 2062.1 216.9 68.9 beverages grains produce
25: 1241.0 19.9 183.8 47.7 7.2 dairy
28: 1743.4 31.7 364.8 23.8 9.2 snacks
35: 2442.0 81.3 524.9 43.6 215.6 beverages
"""
#: Fixed values per nutrient: rate of days under the target, raw and averaged; mean of the average; its last value.
RATES = {
    "calories": (33 / 36, 29 / 34, 624.3118, 348.86), "protein_g": (34 / 36, 27 / 34, 15.0571, 11.61),
    "carbs_g": (32 / 36, 27 / 34, 92.3188, 74.99), "fat_g": (34 / 36, 34 / 34, 22.2491, 6.23), "fiber_g": (34 / 36, 33 / 34, 3.9932, 30.80),
}
SNR = {1: 0.1014, 3: 0.2857, 7: 0.8028, 14: 1.6697}
GREATEST = {3: 4459.60, 7: 1940.17, 14: 1280.20}
WEEKS = [344.236, 911.784, 1304.381, 75.981, 350.363, 348.86, None, None]
PERIODS = {"produce": (1, 0.0588), "dairy": (1, 0.0588), "grains": (1, 0.0588), "snacks": (1, 0.0588), "beverages": (11, 0.0748), "meat": (1, 0.0)}


@pytest.fixture(scope="module")
def daily(spark, tmp_path_factory):
    bought = {int(day): rest.split() for day, rest in (line.split(":") for line in DAYS.strip().splitlines())}
    lines = [",".join(["day_index", "date", *NUTRIENTS, *[f"cat_{c}" for c in CATEGORIES]])]
    for i in range(36):
        of = bought.get(i, ["0.0"] * 5)
        lines.append(",".join([str(i), str(date(2026, 1, 28) + timedelta(i)), *of[:5], *[str(int(c in of)) for c in CATEGORIES]]))
    path = tmp_path_factory.mktemp("month") / "daily.csv"
    path.write_text("\n".join(lines) + "\n")
    return readers.read_signal(spark, str(path)).withColumn("user_id", F.lit(1))


def test_rates_and_means(daily):
    smooth = signals.smoothed_signal(daily, "user_id", NUTRIENTS, 7)
    rates = {r.nutrient: r for r in signals.detection_report(smooth, "user_id").collect()}
    means = {r.nutrient: r.avg for r in signals.avg_intake(smooth, "user_id").collect()}
    last = smooth.where("day_index = 35").first()
    for nutrient, (raw, averaged, mean, end) in RATES.items():
        assert rates[nutrient].d_raw == pytest.approx(raw) and rates[nutrient].d_ma == pytest.approx(averaged), nutrient
        assert means[nutrient] == pytest.approx(mean, abs=5e-5) and last[f"{nutrient}_ma7"] == pytest.approx(end, abs=1e-9), nutrient


def test_noise_and_weeks(daily):
    assert {r.n: round(r.snr, 4) for r in signals.snr(daily, "user_id", "calories").collect()} == SNR
    assert {r.n: round(r.greatest, 2) for r in signals.ma_ablation(daily, "user_id", "calories").collect()} == GREATEST
    smooth = signals.smoothed_signal(daily, "user_id", NUTRIENTS, 7)
    weeks = report.weekly_trend(smooth, "user_id", "calories_ma7").orderBy("week").collect()
    assert [w["mean"] and round(w["mean"], 3) for w in weeks] == WEEKS


def test_periods(daily):
    columns = [f"cat_{c}" for c in CATEGORIES]
    spectrum = signals.dft(daily, "user_id", columns)
    best = {r.signal: r for r in signals.dominant_period(spectrum, "user_id").collect()}
    weekly = {r.signal: r.weekly_ratio for r in signals.weekly_strength(spectrum, "user_id").collect()}
    for category, (k, strength) in PERIODS.items():
        signal = f"cat_{category}"
        assert best[signal].k == k and best[signal].period == pytest.approx(36 / k) and round(weekly[signal], 4) == strength, category
