"""Operators at sizes and with groups where a plain form would be quadratic or wrong, against brute force."""

from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from larder.functions.likeness import lcs_lengths
from larder.operators import catalog, fragments, lookup, signals
from larder.sources import readers


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequences_equal_plain_ones():
    rng = random.Random(3)
    letters = ["abc", "ab cdefgh", "aé😀ß"]
    pairs = [tuple("".join(rng.choices(rng.choice(letters), k=rng.choice([0, 1, 7, 30]))) for _ in range(2)) for _ in range(10_000)]
    pairs += [("ab" * n, "ba" * m) for n, m in ((64, 64), (100, 31), (33, 200), (32, 32), (65, 1))]
    a, b = (pd.Series(x) for x in zip(*pairs, strict=True))
    assert lcs_lengths(a, b).tolist() == [plain_lcs(x, y) for x, y in pairs]
    names = pd.Series(["".join(rng.choices("abcdefghij ", k=40)) for _ in range(4000)])
    others = names.sample(frac=1, random_state=1).reset_index(drop=True)
    began = time.time()
    want = [plain_lcs(x, y) for x, y in zip(names, others, strict=True)]
    plain = time.time() - began
    began = time.time()
    got = lcs_lengths(names, others)
    assert (time.time() - began) * 5 < plain and got.tolist() == want


def test_fuzzy_scores_equal_plain_ones(spark):
    rng = random.Random(4)
    pool = ["milk", "milky", "whole", "skim", "organic", "org", "choc", "chocolate", "chip", "2%", "dark", "b", "bread"]
    pairs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 4))), " ".join(rng.choices(pool, k=rng.randint(1, 5)))) for i in range(3000)]

    def ratio(x, y):
        return 200.0 * plain_lcs(x, y) / (len(x) + len(y)) if x or y else 100.0

    def plain(a, b):
        one, two = set(a.split()), set(b.split())
        if not one or not two:
            return 0.0
        both, x, y = (" ".join(sorted(s)) for s in (one & two, one - two, two - one))
        if both and (not x or not y):
            return 100.0
        x, y = f"{both} {x}".strip(), f"{both} {y}".strip()
        return max(ratio(x, y), *([ratio(both, x), ratio(both, y)] if both else [0.0]))

    rows = spark.createDataFrame(pairs, "i int, a string, b string")
    for threshold in (0.0, 75.0):
        got = {r.i: r.score for r in lookup.token_set_ratios(rows, F.col("a"), F.col("b"), threshold).collect()}
        assert got == {i: s for i, a, b in pairs if (s := plain(a, b)) >= threshold}


def test_substring_join_with_a_gram_in_every_name(spark, monkeypatch):
    monkeypatch.setattr(lookup, "PART", 50)
    rng = random.Random(6)
    names = {f"the {''.join(rng.choices('abcd', k=rng.randint(1, 6)))}" for _ in range(1500)}
    terms = {"the", "th", "e", " ", "the a", "abc", "dd", "zzz", "", *("".join(rng.choices("abcd", k=4)) for _ in range(60))}
    got = lookup.contains_join(spark.createDataFrame([(t,) for t in terms] + [("the",)], "term string"), spark.createDataFrame([(n,) for n in names] * 2, "name string"))
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(t, n) for t in terms for n in names if t and t in n}


def plain_fold(frags, dy=15.0, dx=20.0, least=0.4):
    kept = []
    for y, x, text, conf in sorted(f for f in frags if f[3] >= least):
        if kept and abs(y - kept[-1][0]) < dy and abs(x - kept[-1][1]) < dx and text == kept[-1][2]:
            if conf > kept[-1][3]:
                kept[-1] = (y, x, text, conf)
        else:
            kept.append((y, x, text, conf))
    return kept


def test_a_receipt_of_very_many_fragments(spark):
    n = 100_000
    long = spark.range(n).select(F.lit(1).alias("receipt_id"), (F.expr("id div 4") * 11.0).alias("y"), (F.col("id") % 4 * 50.0).alias("x"), F.concat(F.lit("w"), F.col("id")).alias("text"), F.lit(0.9).alias("conf"))
    rng = random.Random(1)
    few = [(2, float(rng.randrange(60)), float(rng.randrange(60)), rng.choice("ab"), rng.choice([0.3, 0.5, 0.9])) for _ in range(200)]
    frags = long.unionByName(spark.createDataFrame(few, long.schema))
    began = time.time()
    kept = fragments.dedup_fragments(frags)
    got = sorted((r.y, r.x, r.text, r.conf) for r in kept.where("receipt_id = 2").collect())
    assert got == sorted(plain_fold([f[1:] for f in few]))
    lines = fragments.fragments_to_lines(kept).where("receipt_id = 1")
    assert lines.count() == n // 4 and lines.where("line_no = 7").first().text == "w28 w29 w30 w31"
    assert time.time() - began < 60


def test_rows_follow_the_running_mean(spark):
    rng = random.Random(2)
    frags = [(k, rng.random() * 80, rng.random() * 100, rng.choice(["ab", "1.99", "cd ef", "x"]), 0.9) for k in (1, 2) for _ in range(60)]
    df = spark.createDataFrame(frags, "receipt_id int, y double, x double, text string, conf double")
    near = {r.receipt_id: r.threshold for r in fragments.row_threshold(df).collect()}
    want = []
    for k in (1, 2):
        row, total, n = -1, 0.0, 0
        for y, x, text in sorted(f[1:4] for f in frags if f[0] == k and len(f[3].strip()) > 1):
            if n == 0 or abs(y - total / n) > near[k]:
                row, total, n = row + 1, y, 1
            else:
                total, n = total + y, n + 1
            want.append((k, row, y, x, text))
    assert sorted(tuple(r) for r in fragments.fragment_rows(df).collect()) == sorted(want)


def test_spectra_of_long_signals_of_any_length(spark):
    rng = np.random.default_rng(7)
    for n in (4, 5, 36, 997, 4000):
        x = (rng.random(n) < 0.3).astype(int)
        df = spark.createDataFrame([(1, i, int(v), None) for i, v in enumerate(x)], "user_id long, day_index int, a int, none int")
        rows = signals.dft(df, "user_id", ["a", "none"]).collect()
        k = np.arange(1, n // 2)
        angle = 2 * np.pi * (np.outer(k, np.arange(n)) % n) / n
        want = np.hypot((x * np.cos(angle)).sum(axis=1), (x * np.sin(angle)).sum(axis=1))
        got = {r.k: r.magnitude for r in rows if r.signal == "a"}
        assert list(got) == k.tolist() and np.abs(np.array(list(got.values())) - want).max() < 1e-9 * max(1, n)
        assert {r.magnitude for r in rows if r.signal == "none"} == {0.0} and all(r.n == n and r.period == n / r.k for r in rows)
    assert signals.dft(df.limit(3), "user_id", ["a"]).count() == 0


def test_last_row_wins_beyond_a_million_rows(spark, tmp_path):
    n = 1_100_000
    lines = [f"{i},1008,5" for i in range(n)]
    lines[1000], lines[-1] = "9999999,1008,111", "9999999,1008,222"
    (tmp_path / "food_nutrient.csv").write_text("fdc_id,nutrient_id,amount\n" + "\n".join(lines) + "\n")
    (tmp_path / "food.csv").write_text("fdc_id,description,food_category_id\n9999999,Bread,1\n")
    tables = readers.read_food_csvs(spark, str(tmp_path))
    (row,) = catalog.pivot_nutrients(tables["food_nutrient"].where("fdc_id = 9999999"), "row_ord").collect()
    assert row.energy_kcal == 222.0
    assert tables["food_portion"].count() == 0 and catalog.first_portion(tables["food_portion"], "row_ord").count() == 0
