"""Catalog lookup, fuzzy match, weights and nutrition of items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, lines, weights
from ..operators import lookup as lk
from .catalog_queries import _OF, _PARSED
from .line_queries import _cleaned
from .registry import query
from .views import view


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TERMS = f"""n AS (SELECT DISTINCT name, lower(name) AS low, string_split(lower(name), ' ') AS w FROM {{searches}}),
k AS (SELECT *, list_filter(w, lambda x: NOT list_contains([{", ".join(_q(m) for m in fixed.MODIFIERS)}], x)) AS core, list_sort(list_transform(list_filter(w, lambda x: length(x) >= 4), lambda x: {{'n': -length(x), 'i': list_position(w, x), 'w': x}})) AS long FROM n)"""
_PRODUCT_HITS = """SELECT name, 0 AS tier, min(code) AS code FROM k JOIN p ON found = low GROUP BY name UNION ALL SELECT name, 1, min(code) FROM k JOIN p ON contains(found, low) GROUP BY name
UNION ALL SELECT name, 2, min(code) FROM k JOIN p ON contains(found, array_to_string(w[-2:], ' ')) WHERE len(w) >= 2 GROUP BY name UNION ALL SELECT name, 3, min(code) FROM k JOIN p ON contains(found, array_to_string(core, ' ')) WHERE len(core) > 0 AND len(core) < len(w) GROUP BY name"""


@query("lk1_lookup_products", f"WITH {_TERMS}, p AS (SELECT code, lower(product_name) AS found FROM {{products}} WHERE quantity <> ''), h AS ({_PRODUCT_HITS}) SELECT name, min(tier)::INT AS tier, arg_min(code, tier) AS code FROM h GROUP BY name")
def lk1(spark, sf):
    return lk.lookup_products(view(spark, sf, "searches"), view(spark, sf, "products")).select("name", "tier", "code")


@query("lk2_contains_join", f"WITH {_TERMS}, p AS (SELECT DISTINCT lower(product_name) AS found FROM {{products}}) SELECT low AS term, found FROM (SELECT DISTINCT low FROM n) JOIN p ON contains(found, low)")
def lk2(spark, sf):
    names = view(spark, sf, "products").select(F.lower("product_name").alias("found"))
    return lk.contains_join(view(spark, sf, "searches").select(F.lower("name").alias("term")), names, "term", "found")


@query("lk3_store_preference", "SELECT s.name, s.store, min(p.code) AS code FROM {searches} s JOIN {products} p ON contains(lower(p.product_name), lower(s.name)) AND contains(lower(p.brands), lower(s.store)) WHERE p.quantity <> '' GROUP BY s.name, s.store")
def lk3(spark, sf):
    return lk.store_preference(view(spark, sf, "searches"), view(spark, sf, "products"), "name", "store")


_FOOD_HITS = f"""{_PRODUCT_HITS.split("UNION ALL SELECT name, 3")[0]}
UNION ALL SELECT name, 3, min(code) FROM k JOIN p ON contains(found, long[1].w) WHERE len(long) >= 1 GROUP BY name
UNION ALL SELECT name, 4, min(code) FROM k JOIN p ON contains(found, long[2].w) WHERE len(long) >= 2 GROUP BY name"""


@query(
    "lk7_lookup_foods",
    f"""WITH {_TERMS}, p AS (SELECT code, lower(product_name) AS found, energy_kcal FROM {{products}}), h AS ({_FOOD_HITS})
SELECT name, min(tier)::INT AS tier, arg_min(h.code, tier) AS code FROM h JOIN p ON p.code = h.code WHERE energy_kcal IS NOT NULL GROUP BY name""",
)
def lk7(spark, sf):
    return lk.lookup_foods(view(spark, sf, "searches"), view(spark, sf, "products"), "name", "code").select("name", "tier", "code")


_CLEANED = _cleaned("trim(name)", lines.NAME_STRIPS[4:16])
_GENERIC = ", ".join(_q(w) for w in fixed.GENERIC_WORDS)


_CANDIDATES = rf"""WITH a AS (SELECT DISTINCT name, {_CLEANED} AS query FROM {{searches}}),
w AS (SELECT name, query, list_transform(list_filter(string_split_regex(regexp_replace(query, '[^a-zA-Z ]', ' ', 'g'), '\s+'),
  lambda x: length(x) >= 3 AND NOT list_contains([{_GENERIC}], lower(x)))[1:3], lambda x: lower(x)) AS words FROM a),
p AS (SELECT product_name, lower(product_name) AS found, min(code) AS code FROM {{products}} WHERE product_name IS NOT NULL GROUP BY product_name),
h AS (SELECT name, query, code, product_name, contains(found, words[1]) AS first_,
  len(list_filter(list_distinct(words), lambda x: contains(found, x))) = len(list_distinct(words)) AS full_ FROM w JOIN p ON len(words) > 0)
SELECT name, query, code, product_name FROM (SELECT *, max(full_::INT) OVER (PARTITION BY name) AS some_ FROM h WHERE full_ OR first_)
WHERE full_ OR (some_ = 0 AND first_)"""


@query("lk8_fuzzy_candidates", _CANDIDATES)
def lk8(spark, sf):
    return lk.fuzzy_candidates(view(spark, sf, "searches"), view(spark, sf, "products"))


def _sql_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> '')"


#: Best match of each name. The longest common subsequence counts the bits that stay unset, one step a character.
_BEST = rf"""SELECT name, query, code, product_name, score FROM (
  WITH c AS ({_CANDIDATES}),
  u AS (SELECT DISTINCT query, product_name, list_sort(list_distinct({_sql_words("upper(query)")})) AS a,
    list_sort(list_distinct({_sql_words("upper(product_name)")})) AS b FROM c),
  v AS (SELECT *, length(array_to_string(list_filter(a, lambda x: list_contains(b, x)), ' ')) AS m,
    array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' ') AS s,
    array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ' ') AS t FROM u),
  l AS (SELECT *, (1::BIGINT << length(t)) - 1 AS unset FROM v),
  d AS (SELECT *, CASE WHEN s = '' OR t = '' THEN 0 ELSE length(t) - bit_count(list_reduce(list_prepend(unset, list_transform(string_split(s, ''),
    lambda x: list_sum(list_transform(range(length(t)), lambda i: CASE WHEN substr(t, i::INT + 1, 1) = x THEN 1::BIGINT << i::INT ELSE 0 END))::BIGINT)),
    lambda r, f: ((r + (r & f)) | (r - (r & f))) & unset)) END AS lcs FROM l),
  e AS (SELECT query, product_name, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 WHEN m > 0 AND (s = '' OR t = '') THEN 100
    WHEN m = 0 THEN 200::DOUBLE * lcs / (length(s) + length(t))
    ELSE greatest(200::DOUBLE * (m + 1 + lcs) / (2 * (m + 1) + length(s) + length(t)), 200::DOUBLE * m / (2 * m + 1 + length(s)),
      200::DOUBLE * m / (2 * m + 1 + length(t))) END AS score FROM d)
  SELECT c.*, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, code) AS place
  FROM c JOIN e ON c.query = e.query AND c.product_name = e.product_name WHERE score >= 75) WHERE place = 1"""
_SENSITIVE = ", ".join(_q(w) for w in fixed.SENSITIVE_WORDS)
_LETTERS = "len(list_filter({}, lambda x: regexp_matches(x, '[a-zA-Z]')))"
_TITLED = (
    "array_to_string(list_transform(range(1, length(short) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr(lower(short), i::INT - 1, 1), '\\p{L}') "
    "THEN upper(substr(lower(short), i::INT, 1)) ELSE substr(lower(short), i::INT, 1) END), '')"
)
_MATCHES = rf"""SELECT name, {_TITLED} AS better, score FROM (
  SELECT *, CASE WHEN length(trim(product_name)) > 50 THEN array_to_string({_sql_words("trim(product_name)")}[1:5], ' ') ELSE trim(product_name) END AS short
  FROM (SELECT *, {_sql_words("lower(query)")} AS own, {_sql_words("lower(product_name)")} AS other FROM ({_BEST}))
  WHERE len(list_filter(other, lambda x: list_contains([{_SENSITIVE}], x) AND NOT list_contains(own, x))) = 0 AND len(other) <= len(own) + 3
    AND {_LETTERS.format("other")} >= {_LETTERS.format("own")} - 1 AND NOT regexp_matches(product_name, '^\d+%?\s'))"""


@query("lk9_fuzzy_match", _MATCHES)
def lk9(spark, sf):
    return lk.fuzzy_accept(lk.fuzzy_best(lk8(spark, sf)))


@query("lk10_fuzzy_best", _BEST)
def lk10(spark, sf):
    return lk.fuzzy_best(lk8(spark, sf))


_FOOD = "SELECT search_id, CASE search_id % 6 WHEN 0 THEN concat(name, ' chip chocolate') WHEN 1 THEN 'Breyers Natural' WHEN 2 THEN 'ORG SWEET POTATO' WHEN 3 THEN concat(name, ' milk') WHEN 4 THEN 'Chicken Breast Strips' ELSE name END AS food FROM {searches}"
_WEIGHTS = {k: f"{value} {unit}" for k, (value, unit) in fixed.DEFAULT_WEIGHTS.items()}
_HELD = [*_WEIGHTS.items(), *[(b, _WEIGHTS[c]) for b, c in fixed.BRANDS.items() if c in _WEIGHTS]]
_DEFAULT = "CASE " + " ".join(f"WHEN contains(lower(food), {_q(k)}) THEN {_q(v)}" for k, v in _HELD) + " END"


@query("lk11_category_default", f"SELECT search_id, CAST(string_split(d, ' ')[1] AS DOUBLE) AS value, string_split(d, ' ')[2] AS unit FROM (SELECT search_id, {_DEFAULT} AS d FROM ({_FOOD}))")
def lk11(spark, sf):
    w = lk.category_default(F.col("food"))
    return spark.sql(_FOOD, searches=view(spark, sf, "searches")).select("search_id", w["value"].alias("value"), w["unit"].alias("unit"))


_STAPLES = sorted(fixed.STAPLES, key=len, reverse=True)
_STAPLE = " ".join(f"WHEN contains(lower(food), {_q(k)}) THEN [{', '.join(map(repr, map(float, fixed.STAPLES[k])))}]" for k in _STAPLES)


@query("lk12_staple_nutrition", f"""SELECT search_id, CAST(d[1] AS DOUBLE) AS energy_kcal, CAST(d[7] AS DOUBLE) AS proteins
FROM (SELECT search_id, CASE {_STAPLE} END AS d FROM ({_FOOD}))""")
def lk12(spark, sf):
    s = lk.staple_nutrition(F.col("food"))
    return spark.sql(_FOOD, searches=view(spark, sf, "searches")).select("search_id", s["energy_kcal"].alias("energy_kcal"), s["proteins"].alias("proteins"))


def _hits(names: str, products: str, foods: bool = False) -> str:
    """SQL for name and code of each of ``names`` (name) that ``products`` hold, as lookup_products or lookup_foods find it."""
    terms = _TERMS.replace("{searches}", f"({names})")
    only = "" if foods else "WHERE quantity <> ''"
    own = f"p AS (SELECT code, lower(product_name) AS found, energy_kcal FROM {products} {only})"
    if foods:
        return f"""(WITH {terms}, {own}, h AS ({_FOOD_HITS})
  SELECT name, arg_min(h.code, tier) AS code FROM h JOIN p ON p.code = h.code WHERE energy_kcal IS NOT NULL GROUP BY name)"""
    return f"(WITH {terms}, {own}, h AS ({_PRODUCT_HITS}) SELECT name, arg_min(code, tier) AS code FROM h GROUP BY name)"


def _decided(foods: bool) -> str:
    """The decision table of resolve_items in SQL: which weight, of which source, which nutrients, which name."""
    good = lambda c: f"CASE WHEN NOT ({c}_energy = 0 AND {c}_fat = 0 AND {c}_carbs = 0 AND {c}_proteins = 0) THEN {c}_energy END"
    default = lambda name: _DEFAULT.replace("lower(food)", f"lower({name})")
    grams = lambda w: f"(CAST(string_split({w}, ' ')[1] AS DOUBLE) * {_OF.replace('CASE unit', f'CASE string_split({w}, {_q(chr(32))})[2]')})"
    apart = lambda x, d: f"coalesce(CASE WHEN {x} = 0 OR {d} = 0 THEN 999 ELSE greatest({x} / {d}, {d} / {x}) END > {weights.DISAGREE}, false)"
    fits = lambda g, name: f"coalesce({g} <= 25000 AND ({g} >= 20 OR regexp_matches(lower({name}), '{'|'.join(fixed.CONDIMENTS)}')), false)"
    found = lambda c: ", ".join(f"{c}.{f} AS {c}_{x}" for f, x in (("energy_kcal", "energy"), ("fat", "fat"), ("carbohydrates", "carbs"), ("proteins", "proteins"), ("grams", "grams")))
    parsed = f"(SELECT code, value * {_OF} AS grams FROM ({_PARSED}))".replace("{products}", "{goods}")
    staple = " ".join(f"WHEN contains(lower(search), {_q(k)}) THEN {float(fixed.STAPLES[k][0])}" for k in _STAPLES)
    food = good("food") if foods else "NULL"
    return f"""WITH i AS (SELECT *, coalesce(nullif(resolved_name, ''), name) AS search FROM {{wanted}}),
g AS (SELECT * FROM {{goods}} LEFT JOIN {parsed} USING (code)),
c AS (SELECT name, better FROM ({_MATCHES.replace("{searches}", "(SELECT search AS name FROM i)").replace("{products}", "{goods}")})),
o AS (SELECT name AS search, g.* FROM {_hits("SELECT search AS name FROM i", "g")} JOIN g USING (code)),
z AS (SELECT name AS better, g.* FROM {_hits("SELECT better AS name FROM c", "g")} JOIN g USING (code)),
e AS (SELECT name AS search, g.* FROM {_hits("SELECT search AS name FROM i", "g", True)} JOIN g USING (code)),
j AS (SELECT i.search_id, i.search, i.qty, i.own_value, i.given_source, c.better, {found("o")}, {found("z")}, {found("e").replace(" AS e_", " AS food_")},
    {default("i.search")} AS d, coalesce({default("i.search")}, {default("c.better")}) AS d2
  FROM i LEFT JOIN o ON o.search = i.search LEFT JOIN c ON c.name = i.search LEFT JOIN z ON z.better = c.better LEFT JOIN e ON e.search = i.search),
f AS (SELECT *, own_value IS NOT NULL AND given_source <> '' AS own, own_value IS NULL AND given_source = 'nonfood' AS skip, {grams("d")} AS dg, {grams("d2")} AS dg2,
    {fits("o_grams", "search")} AS direct, {fits("z_grams", "better")} AS second_ FROM j),
r AS (SELECT *, CASE WHEN own THEN given_source WHEN skip THEN 'nonfood' WHEN direct AND {apart("o_grams", "dg")} THEN 'category_default_override' WHEN direct THEN 'off_db'
    WHEN second_ AND {apart("z_grams", "dg2")} THEN 'category_default_override' WHEN second_ THEN 'off_db_fuzzy' WHEN d IS NOT NULL THEN 'category_default' ELSE '' END AS weight_source,
  CASE WHEN own THEN own_value * {weights.GRAMS["oz"]} WHEN skip THEN NULL WHEN direct AND {apart("o_grams", "dg")} THEN dg WHEN direct THEN o_grams
    WHEN second_ AND {apart("z_grams", "dg2")} THEN dg2 WHEN second_ THEN z_grams ELSE dg END * qty AS total,
  CASE WHEN NOT skip THEN coalesce(CASE WHEN own THEN coalesce({good("o")}, {good("z")}) WHEN direct THEN {good("o")} WHEN second_ THEN {good("z")} END, {food}, CASE {staple} END) END AS kcal_per100,
  CASE WHEN better IS NOT NULL AND upper(better) <> upper(search) AND NOT skip
    AND CASE WHEN own THEN {good("o")} IS NULL AND {good("z")} IS NOT NULL ELSE NOT direct END THEN better ELSE search END AS resolved_name FROM f)
SELECT search_id, resolved_name, qty, weight_source, round(total, 2) AS weight_grams, kcal_per100, round(kcal_per100 * total / 100, 2) AS kcal FROM r"""


def _resolved(spark, sf, foods: bool):
    weight = F.when(F.col("own_value").isNotNull(), F.struct(F.col("own_value").alias("value"), F.lit("oz").alias("unit")))
    items = view(spark, sf, "wanted").select("search_id", "name", "resolved_name", "qty", weight.alias("weight"), F.col("given_source").alias("weight_source"))
    goods = view(spark, sf, "goods")
    out = lk.resolve_items(items, goods, goods.withColumnRenamed("code", "fdc_id") if foods else None)
    return out.select("search_id", "resolved_name", "qty", "weight_source", "weight_grams", F.col("per100.energy_kcal").alias("kcal_per100"), F.col("actual.energy_kcal").alias("kcal"))


@query("lk13_resolve_items", _decided(False))
def lk13(spark, sf):
    return _resolved(spark, sf, False)


@query("lk14_resolve_with_foods", _decided(True))
def lk14(spark, sf):
    return _resolved(spark, sf, True)


@query("lk15_scale_nutrition", "SELECT code, round(g * (code % 3 + 1), 2) AS weight_grams, CASE WHEN energy_kcal IS NOT NULL THEN round(energy_kcal * (g * (code % 3 + 1)) / 100, 2) END AS kcal FROM (SELECT code, energy_kcal, CASE WHEN code % 4 <> 0 THEN (code % 50)::DOUBLE END AS g FROM {products})")
def lk15(spark, sf):
    p = view(spark, sf, "products")
    per100 = F.struct(*[F.col(n) if n in p.columns else F.lit(None).cast("double").alias(n) for n in fixed.NUTRIENTS])
    weight = F.when(F.col("code") % 4 != 0, F.struct((F.col("code") % 50).cast("double").alias("value"), F.lit("g").alias("unit")))
    out = lk.scale_nutrition(p.select("code", (F.col("code") % 3 + 1).alias("qty"), per100.alias("per100"), weight.alias("weight")))
    return out.select("code", "weight_grams", F.col("actual.energy_kcal").alias("kcal"))


@query("lk16_nutrient_flags", "SELECT code, energy_kcal IS NOT NULL AS has_data, coalesce(energy_kcal = 0 AND proteins = 0 AND fat = 0 AND carbohydrates = 0, false) AS all_zero FROM {products}")
def lk16(spark, sf):
    p = view(spark, sf, "products")
    per100 = F.struct(*[F.col(n) if n in p.columns else F.lit(None).cast("double").alias(n) for n in fixed.NUTRIENTS])
    return p.select("code", lk.has_data(per100).alias("has_data"), lk.all_zero(per100).alias("all_zero"))
