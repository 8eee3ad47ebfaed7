"""Catalog building, junk rows, weights in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, quality, weights
from ..operators import catalog as cat
from .registry import query
from .views import view


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_NESTED = """SELECT p_partkey AS code, p_name, p_size, p_partkey % 5 AS m FROM {part}"""


def _nested(spark, sf):
    """part as a nested catalog: names by language, tags, named values."""
    p = view(spark, sf, "part").withColumn("m", F.col("p_partkey") % 5)
    text = lambda lang, t: F.struct(F.lit(lang).alias("lang"), t.alias("text"))
    names = (
        F.when(F.col("m") == 0, F.array(text("fr", F.upper("p_name")), text("en", F.concat(F.lit(" "), "p_name"))))
        .when(F.col("m") == 1, F.array(text("fr", F.lit(" ")), text("de", F.concat("p_name", F.lit(" ")))))
        .when(F.col("m") == 2, F.array(text("en", F.lit("  ")), text("de", F.col("p_name"))))
        .when(F.col("m") == 3, F.array().cast("array<struct<lang:string,text:string>>"))
    )
    tags = F.when(F.col("m") == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("en:a"), F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("en:"), F.lower("p_type"))))
    value = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("100g"))
    values = F.array(value("fat", F.col("p_size") * 0.25), value("energy-kcal", F.col("p_size")), value("fat", F.when(F.col("m") == 0, F.lit("x")).when(F.col("m") == 1, F.lit("1.23456"))), value("salt", F.lit(None)))
    return p.select(F.col("p_partkey").alias("code"), names.alias("product_name"), tags.alias("categories_tags"), values.alias("nutriments"))


@query("cat1_pick_localized", "SELECT p_partkey AS code, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN '' END AS product_name FROM {part}")
def cat1(spark, sf):
    return _nested(spark, sf).select("code", cat.pick_localized(F.col("product_name")).alias("product_name"))


@query("cat2_join_tags", "SELECT p_partkey AS code, CASE WHEN p_partkey % 5 <> 4 THEN concat('en:a,en:', lower(p_type)) END AS categories FROM {part}")
def cat2(spark, sf):
    return _nested(spark, sf).select("code", cat.join_tags(F.col("categories_tags")).alias("categories"))


@query("cat3_extract_named", "SELECT p_partkey AS code, CASE WHEN p_partkey % 5 = 1 THEN 1.2346 ELSE p_size * 0.25 END::DOUBLE AS fat, p_size::DOUBLE AS energy_kcal, NULL::DOUBLE AS salt FROM {part}")
def cat3(spark, sf):
    return _nested(spark, sf).select("code", *cat.extract_named(F.col("nutriments"), ["fat", "energy-kcal", "salt"]))


@query("cat4_filter_named", "SELECT code, product_name, quantity FROM {products} WHERE trim(product_name) <> '' AND trim(quantity) <> ''")
def cat4(spark, sf):
    return cat.filter_named(view(spark, sf, "products")).select("code", "product_name", "quantity")


@query("cat5_catalog_summary", "SELECT count(*) AS n_products, count(energy_kcal) AS n_with_kcal FROM {products}")
def cat5(spark, sf):
    return cat.catalog_summary(view(spark, sf, "products"))


_PIVOT = (
    "SELECT fdc_id, "
    + ", ".join((f"coalesce(v{i}, v{fixed.SUGARS_STAND_IN})" if n == "sugars" else f"v{i}") + f" AS {n}" for i, n in fixed.NUTRIENT_IDS.items())
    + " FROM (SELECT fdc_id, "
    + ", ".join(f"arg_max(a, row_ord) FILTER (nutrient_id = {i}) AS v{i}" for i in [*fixed.NUTRIENT_IDS, fixed.SUGARS_STAND_IN])
    + " FROM (SELECT *, try_cast(amount AS DOUBLE) AS a FROM {food_nutrient}) WHERE a IS NOT NULL AND nutrient_id <> 9999 GROUP BY fdc_id)"
)
_PORTION = "SELECT fdc_id, arg_min(g, row_ord) AS serving_g FROM (SELECT *, try_cast(gram_weight AS DOUBLE) AS g FROM {food_portion}) WHERE g IS NOT NULL GROUP BY fdc_id"
_FOODS = f"""SELECT f.fdc_id, trim(f.description) AS product_name, coalesce(c.description, '') AS category, serving_g, energy_kcal, fat, saturated_fat, carbohydrates, sugars, fiber, proteins,
 round(sodium * 2.5 / 1000, 4)::DOUBLE AS salt, round(sodium / 1000, 4)::DOUBLE AS sodium
FROM {{food}} f JOIN ({_PIVOT}) n ON n.fdc_id = f.fdc_id LEFT JOIN {{food_category}} c ON c.id = f.food_category_id LEFT JOIN ({_PORTION}) p ON p.fdc_id = f.fdc_id WHERE trim(f.description) <> ''"""


@query("cat6_pivot_nutrients", _PIVOT)
def cat6(spark, sf):
    return cat.pivot_nutrients(view(spark, sf, "food_nutrient"), "row_ord")


@query("cat8_first_portion", _PORTION)
def cat8(spark, sf):
    return cat.first_portion(view(spark, sf, "food_portion"), "row_ord")


@query("cat10_build_foods", _FOODS)
def cat10(spark, sf):
    return cat.build_foods(view(spark, sf, "food"), cat6(spark, sf), view(spark, sf, "food_category"), cat8(spark, sf))


@query("cat11_category_breakdown", f"SELECT category, count(*) AS n FROM ({_FOODS}) WHERE trim(category) <> '' GROUP BY category ORDER BY n DESC, category LIMIT 15")
def cat11(spark, sf):
    return cat.category_breakdown(cat10(spark, sf))


@query(
    "cat12_coverage",
    """SELECT *, round(with_categories * 100.0 / total, 2)::DOUBLE AS pct_with_categories, round(with_quantity * 100.0 / total, 2)::DOUBLE AS pct_with_quantity, round(with_both * 100.0 / total, 2)::DOUBLE AS pct_with_both
FROM (SELECT count(*) AS total, count(*) FILTER (categories <> '') AS with_categories, count(*) FILTER (quantity <> '') AS with_quantity, count(*) FILTER (categories <> '' AND quantity <> '') AS with_both FROM {products})""",
)
def cat12(spark, sf):
    return cat.coverage(view(spark, sf, "products"))


@query("cat13_top_tags", "SELECT tag, count(*) AS n FROM (SELECT trim(unnest(string_split(categories, ','))) AS tag FROM {products}) WHERE starts_with(tag, 'en:') GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def cat13(spark, sf):
    return cat.top_tags(view(spark, sf, "products"))


@query("cat14_sample_where", "SELECT code, product_name FROM {products} WHERE brands LIKE '%#2%' ORDER BY code LIMIT 5")
def cat14(spark, sf):
    return cat.sample_where(view(spark, sf, "products"), F.col("brands").contains("#2"), "code").select("code", "product_name")


@query("cat5_sample_by_brand", "SELECT code, product_name, brands FROM {products} WHERE contains(brands, '#2') ORDER BY code LIMIT 5")
def cat5_sample(spark, sf):
    """The report feature of a sample of five products of a brand."""
    return cat.sample_where(view(spark, sf, "products"), F.col("brands").contains("#2"), "code").select("code", "product_name", "brands")


@query("cat10_build_report", f"SELECT t AS total, i AS inserted, t - i AS skipped FROM (SELECT count(*) AS t FROM {{food}}), (SELECT count(*) AS i FROM ({_FOODS}))")
def cat10_report(spark, sf):
    return cat.build_report(view(spark, sf, "food"), cat10(spark, sf))


@query("cat11_distinct_categories", f"SELECT count(DISTINCT category) FILTER (trim(category) <> '') AS n_categories FROM ({_FOODS})")
def cat11_distinct(spark, sf):
    return cat.distinct_categories(cat10(spark, sf))


_N = "trim(product_name)"
_NAME_REASON = rf"""CASE WHEN product_name IS NULL OR {_N} = '' THEN 'empty_name' WHEN length({_N}) <= 2 THEN 'too_short' WHEN regexp_matches({_N}, '^\d+%?\s') THEN 'starts_with_number' WHEN regexp_matches({_N}, '^[\d\-.]+$') THEN 'pure_number'
 {" ".join(f"WHEN regexp_matches({_N}, '{p}') THEN '{s}'" for s, p in quality.SCRIPTS.items())} END"""
_GRAMS = lambda u: "CASE " + u + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.COARSE_GRAMS.items()) + " END"
_QP = r"'(\d+(?:\.\d+)?)\s*(kg|g|lb|lbs|oz|ml|l|cl)\b'"
_Q_REASON = f"CASE WHEN try_cast(nullif(regexp_extract(lower(trim(quantity)), {_QP}, 1), '') AS DOUBLE) * {_GRAMS(f'regexp_extract(lower(trim(quantity)), {_QP}, 2)')} > 25000 THEN 'too_heavy' WHEN try_cast(nullif(regexp_extract(lower(trim(quantity)), {_QP}, 1), '') AS DOUBLE) = 0 THEN 'zero_weight' END"
_WORDS = f"list_sort(list_intersect(list_distinct(string_split_regex(trim(regexp_replace(lower(product_name), '[^a-zA-ZäöüéèêàâîïôùûçñÄÖÜß]', ' ', 'g')), '\\s+')), [{', '.join(repr(w) for w in fixed.FOREIGN_WORDS)}]))"
_F_REASON = f"CASE WHEN len({_WORDS}) >= 2 THEN concat('non_english:', array_to_string({_WORDS}[1:3], ',')) END"
_REASON = f"coalesce({_NAME_REASON}, {_Q_REASON}, CASE WHEN len({_WORDS}) >= 2 THEN 'non_english' END)"


@query("dq1_junk_name_reason", f"SELECT code, {_NAME_REASON} AS reason FROM {{names}}")
def dq1(spark, sf):
    return view(spark, sf, "names").select("code", quality.junk_name_reason(F.col("product_name")).alias("reason"))


@query("dq2_junk_quantity_reason", f"SELECT code, {_Q_REASON} AS reason FROM {{names}}")
def dq2(spark, sf):
    return view(spark, sf, "names").select("code", quality.junk_quantity_reason(F.col("quantity")).alias("reason"))


@query("dq3_foreign_reason", f"SELECT code, {_F_REASON} AS reason FROM {{names}}")
def dq3(spark, sf):
    return view(spark, sf, "names").select("code", quality.foreign_reason(F.col("product_name")).alias("reason"))


@query("dq4_junk_reason", f"SELECT code, {_REASON} AS reason FROM {{names}}")
def dq4(spark, sf):
    return view(spark, sf, "names").select("code", quality.junk_reason(F.col("product_name"), F.col("quantity")).alias("reason"))


@query("dq5_quality_report", f"SELECT reason, n, round(n * 100.0 / sum(n) OVER (), 2)::DOUBLE AS pct FROM (SELECT coalesce({_REASON}, '') AS reason, count(*) AS n FROM {{names}} GROUP BY 1)")
def dq5(spark, sf):
    return cat.quality_report(view(spark, sf, "names"))


@query(
    "dq5_quality_totals",
    f"""SELECT total, junk_name, junk_quantity, deleted - junk_name - junk_quantity AS non_english, deleted, round(deleted * 100.0 / total, 1)::DOUBLE AS pct_deleted, total - deleted AS remaining FROM (
 SELECT count(*) AS total, count({_NAME_REASON}) AS junk_name, count(*) FILTER (({_NAME_REASON}) IS NULL AND ({_Q_REASON}) IS NOT NULL) AS junk_quantity, count({_REASON}) AS deleted FROM {{names}})""",
)
def dq5_totals(spark, sf):
    return cat.quality_totals(view(spark, sf, "names"))


@query("dq6_drop_junk", f"SELECT code, product_name FROM {{names}} WHERE {_REASON} IS NULL")
def dq6(spark, sf):
    return cat.drop_junk(view(spark, sf, "names"))[0].select("code", "product_name")


_WP = r"'(?i)(\d+(?:\.\d+)?)\s*(kg|g|lb|lbs|oz|ml|l)\b'"
_WT = r"regexp_replace(trim(t), '(?i)(\d+(?:\.\d+)?)\s*o\b', '\1 oz', 'g')"
_TEXTS = "SELECT search_id, concat(name, ' ', quantity) AS t FROM {searches} JOIN {products} ON search_id = code"


def _texts(spark, sf):
    return view(spark, sf, "searches").join(view(spark, sf, "products"), F.col("search_id") == F.col("code")).select("search_id", F.concat("name", F.lit(" "), "quantity").alias("t"), "quantity", "name")


@query(
    "wt1_extract_weight",
    f"SELECT search_id, CASE WHEN v <> 0 THEN v END AS value, CASE WHEN v <> 0 THEN CASE u WHEN 'lbs' THEN 'lb' ELSE u END END AS unit FROM (SELECT search_id, try_cast(nullif(regexp_extract({_WT}, {_WP}, 1), '') AS DOUBLE) AS v, lower(regexp_extract({_WT}, {_WP}, 2)) AS u FROM ({_TEXTS}))",
)
def wt1(spark, sf):
    w = weights.extract_weight(F.col("t"))
    return _texts(spark, sf).select("search_id", w["value"].alias("value"), w["unit"].alias("unit"))


_QTY = r"'(?i)(\d+(?:\.\d+)?)\s*(kg|g|lb|lbs|oz|fl oz|ml|l|cl)\b'"
_PARSED = f"SELECT code, CASE u WHEN 'cl' THEN v * 10 ELSE v END AS value, CASE WHEN v IS NOT NULL THEN CASE u WHEN 'lbs' THEN 'lb' WHEN 'fl oz' THEN 'oz' WHEN 'cl' THEN 'ml' ELSE u END END AS unit FROM (SELECT code, try_cast(nullif(regexp_extract(quantity, {_QTY}, 1), '') AS DOUBLE) AS v, lower(regexp_extract(quantity, {_QTY}, 2)) AS u FROM {{products}})"
_OF = "CASE unit " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.GRAMS.items()) + " END"


@query("wt2_parse_quantity", _PARSED)
def wt2(spark, sf):
    w = weights.parse_quantity(F.col("quantity"))
    return view(spark, sf, "products").select("code", w["value"].alias("value"), w["unit"].alias("unit"))


_GP = r"'(?i)(\d+(?:[.,]\d+)?)\s*(kg|g|lb|lbs|oz|fl oz|ml|l|cl)\b'"
_PG = f"SELECT *, CASE WHEN g0 > 0 AND g0 <= 25000 THEN g0 END AS grams FROM (SELECT *, try_cast(nullif(replace(regexp_extract(quantity, {_GP}, 1), ',', '.'), '') AS DOUBLE) * {_GRAMS(f'lower(regexp_extract(quantity, {_GP}, 2))')} AS g0 FROM {{products}})"


@query("wt3_parse_grams", f"SELECT code, round(grams, 6) AS grams FROM ({_PG})")
def wt3(spark, sf):
    return view(spark, sf, "products").select("code", F.round(weights.parse_grams(F.col("quantity")), 6).alias("grams"))


@query("wt4_to_grams", f"SELECT code, round(value * {_OF}, 6) AS grams FROM ({_PARSED})")
def wt4(spark, sf):
    return wt2(spark, sf).select("code", F.round(weights.to_grams(F.col("value"), F.col("unit")), 6).alias("grams"))


_UNIT = lambda g: (f"CASE WHEN {g} / 453.6 >= 2 THEN round({g} / 453.6, 1) WHEN {g} / 28.35 >= 1 THEN round({g} / 28.35, 1) ELSE round({g}, 1) END", f"CASE WHEN {g} / 453.6 >= 2 THEN 'lb' WHEN {g} / 28.35 >= 1 THEN 'oz' ELSE 'g' END")


@query("wt5_best_unit", "SELECT p_partkey AS code, {0} AS value, {1} AS unit FROM {{part}}".format(*_UNIT("(p_size::DOUBLE * 37)")))
def wt5(spark, sf):
    u = weights.best_unit(F.col("p_size").cast("double") * 37)
    return view(spark, sf, "part").select(F.col("p_partkey").alias("code"), u["value"].alias("value"), u["unit"].alias("unit"))


@query(
    "wt6_weight_plausible",
    f"SELECT code, coalesce(value * {_OF} <= 25000 AND (value * {_OF} >= 20 OR regexp_matches(lower(product_name), '{'|'.join(fixed.CONDIMENTS)}')), false) AS plausible FROM ({_PARSED}) JOIN (SELECT code, product_name FROM {{products}}) USING (code)",
)
def wt6(spark, sf):
    p = view(spark, sf, "products").withColumn("w", weights.parse_quantity(F.col("quantity")))
    return p.select("code", weights.weight_plausible(weights.to_grams(F.col("w.value"), F.col("w.unit")), F.col("product_name")).alias("plausible"))


@query("wt7_weight_ratio", "SELECT p_partkey AS code, round(CASE WHEN p_size % 10 = 0 THEN 999 ELSE greatest((p_size % 10) / 7.0, 7.0 / (p_size % 10)) END::DOUBLE, 6) AS ratio FROM {part}")
def wt7(spark, sf):
    return view(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.round(weights.weight_ratio((F.col("p_size") % 10).cast("double"), F.lit(7.0)), 6).alias("ratio"))


_MEDIANS = f"""SELECT name, {_UNIT("median_g")[0]} AS value, {_UNIT("median_g")[1]} AS unit, n AS sample_count, p25_g, median_g, p75_g FROM (
 SELECT name, n, max(grams) FILTER (pos = n // 4) AS p25_g, max(grams) FILTER (pos = n // 2) AS median_g, max(grams) FILTER (pos = 3 * n // 4) AS p75_g
 FROM (SELECT name, grams, row_number() OVER (PARTITION BY name ORDER BY grams) - 1 AS pos, count(*) OVER (PARTITION BY name) AS n
       FROM (SELECT trim(unnest(string_split(categories, ','))) AS tag, grams FROM ({_PG}) WHERE grams IS NOT NULL) JOIN (VALUES {_values(fixed.TAG_NAMES.items())}) t(tag, name) USING (tag))
 WHERE n >= 5 GROUP BY name, n)"""


@query("wt8_category_medians", _MEDIANS)
def wt8(spark, sf):
    return cat.category_medians(view(spark, sf, "products"))


@query("wt9_medians_simple", f"SELECT name, value, unit FROM ({_MEDIANS})")
def wt9(spark, sf):
    return cat.medians_simple(wt8(spark, sf))
