"""Looking items up in catalogs: tiered exact and substring joins, fuzzy match, weight and nutrition resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, lines, matching, weights
from ..functions.likeness import lcs_lengths
from ..functions.lines import strip_codes

NUTRIENTS = fixed.NUTRIENTS
#: Names of a gram that meet its terms at once.
PART = 10_000
#: Parts that a gram's names are dealt to where they learn how many they are.
SALTS = 32
#: White space of any script.
WHITE = r"[\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def _grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct substrings of the given lengths."""

    def of(n: int) -> Column:
        return F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def contains_join(terms: DataFrame, names: DataFrame, term: str = "term", name: str = "name") -> DataFrame:
    """Pairs of distinct terms and names that hold them, exactly as a nested loop would find them.

    Each term asks only under its rarest gram, of three letters or of its own length. How many names have a gram is counted
    first, map-side and without the names; then only names of a chosen gram travel, in parts by a hash of the name: SALTS
    at first, then as many as PART asks for, which a term meets one by one. So no task gets all names of a common gram. Blank terms
    match nothing here.
    """
    distinct = names.select(name).distinct()
    asked = terms.where(F.char_length(term) > 0).select(term).distinct()
    asked = asked.select(term, F.explode(F.when(F.char_length(term) < 3, F.array(F.col(term))).otherwise(_grams(F.col(term), (3,)))).alias("gram"))
    index = distinct.select(name, F.explode(_grams(F.col(name), (1, 2, 3))).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no name has rules a term out, so it counts as the rarest
    rarest = asked.join(often, "gram", "left").groupBy(term).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    rarest = rarest.where("least.n > 0").select(term, F.col("least.gram").alias("gram"), F.col("least.n").alias("n"))
    chosen = rarest.groupBy("gram").agg(F.max("n").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = index.withColumn("salt", F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")).join(chosen, ["gram", "salt"])
    parts = found.select("gram", name, F.expr(f"pmod(xxhash64({name}, 1), 1 + n div {PART})").alias("part"))
    asks = rarest.withColumn("part", F.explode(F.expr(f"sequence(0L, n div {PART})"))).drop("n")
    return asks.join(parts, ["gram", "part"]).where(F.col(name).contains(F.col(term))).select(term, name)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _tail(text: Column) -> Column:
    words = _words(text)
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, -2, 2), " "))


def _core(text: Column) -> Column:
    """Without modifier words, where there were any and something is left."""
    words = _words(text)
    kept = F.filter(words, lambda w: ~w.isin(fixed.MODIFIERS))
    return F.when((F.size(kept) > 0) & (F.size(kept) < F.size(words)), F.array_join(kept, " "))


def _long_word(text: Column, nth: int) -> Column:
    """The nth longest word of four letters or more; the earlier of equals first."""
    words = F.filter(_words(text), lambda w: F.char_length(w) >= 4)
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.char_length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.get(ranked, F.lit(nth))["w"]


def tiers(names: DataFrame, catalog: DataFrame, terms: list[Column], name: str, id_: str) -> DataFrame:
    """Each name with the lowest catalog id per tier: tier 0 equals the first term, tier 1 holds it, tier n holds term n.

    All tiers share one substring join over distinct catalog names, of which each stands for its lowest id.
    """
    distinct = catalog.where(F.col("product_name").isNotNull()).groupBy(F.lower("product_name").alias("found")).agg(F.min(id_).alias(id_))
    names = names.select(name).distinct().withColumn("low", F.lower(name))
    asked = names.select(name, F.posexplode(F.array(*terms)).alias("tier", "term")).where("term is not null")
    hits = contains_join(asked, distinct, "term", "found").join(distinct, "found").groupBy("term").agg(F.min(id_).alias(id_))
    by_part = asked.join(hits, "term").select(name, (F.col("tier") + 1).alias("tier"), id_)
    exact = names.join(distinct, F.col("low") == F.col("found")).select(name, F.lit(0).alias("tier"), id_)
    return exact.unionByName(by_part)


def _first(hits: DataFrame, name: str) -> DataFrame:
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(name).orderBy("tier"))).where("__n = 1").drop("__n")


def lookup_products(names: DataFrame, products: DataFrame, name: str = "name", id_: str = "code") -> DataFrame:
    """The first tier that finds a product with a quantity decides, even if its nutrients are unknown: equal, held,
    last two words held, core words held. Ties go to the lowest id. Adds tier, id, quantity and nutrients."""
    low = F.col("low")
    usable = products.where(F.col("quantity") != "")
    hits = _first(tiers(names, usable, [low, _tail(low), _core(low)], name, id_), name)
    return hits.join(usable.select(id_, "quantity", *[n for n in NUTRIENTS if n in products.columns]), id_)


def lookup_foods(names: DataFrame, foods: DataFrame, name: str = "name", id_: str = "fdc_id") -> DataFrame:
    """As lookup_products, with the two longest words as last tiers; a tier counts only if its first row has energy."""
    low = F.col("low")
    hits = tiers(names, foods, [low, _tail(low), _long_word(low, 0), _long_word(low, 1)], name, id_)
    return _first(hits.join(foods.select(id_, *[n for n in NUTRIENTS if n in foods.columns]), id_).where("energy_kcal is not null"), name)


def store_preference(names: DataFrame, products: DataFrame, name: str, store: str, id_: str = "code") -> DataFrame:
    """An optional tier before the others: the lowest product whose name holds the name and whose brand holds the store."""
    usable = products.where(F.col("quantity") != "").select(id_, F.lower("product_name").alias("found"), F.lower("brands").alias("brand"))
    asked = names.select(name, store).distinct().withColumn("term", F.lower(name))
    pairs = contains_join(asked, usable, "term", "found").join(usable, "found").join(asked, "term")
    return pairs.where(F.col("brand").contains(F.lower(store))).groupBy(name, store).agg(F.min(id_).alias(id_))


def fuzzy_candidates(names: DataFrame, products: DataFrame, name: str = "name", id_: str = "code", cap: int | None = None) -> DataFrame:
    """Names and products that hold the first three words of three letters or more that are not generic; where there are
    none, those that hold the first word. All of them; with ``cap`` (200 in the reference) at most so many of lowest id each."""
    cleaned = strip_codes(F.col(name))
    words = F.filter(_words(F.regexp_replace(cleaned, "[^a-zA-Z ]", " ")), lambda w: (F.char_length(w) >= 3) & ~F.lower(w).isin(fixed.GENERIC_WORDS))
    asked = names.select(name).distinct().withColumns({"query": cleaned, "words": F.transform(F.slice(words, 1, 3), lambda w: F.lower(w))}).where(F.size("words") > 0)
    distinct = products.where(F.col("product_name").isNotNull()).groupBy("product_name").agg(F.min(id_).alias(id_)).withColumn("found", F.lower("product_name"))
    each = asked.select(name, "query", F.size("words").alias("k"), F.posexplode("words").alias("nth", "term"))
    hits = each.join(contains_join(each, distinct, "term", "found"), "term").groupBy(name, "query", "k", "found").agg(F.countDistinct("term").alias("n"), F.max((F.col("nth") == 0).cast("int")).alias("first"))
    need = F.size(F.array_distinct("words"))
    hits = hits.join(asked.select(name, need.alias("need")), name)
    full = F.col("n") == F.col("need")
    some = F.max(full.cast("int")).over(Window.partitionBy(name))
    kept = hits.where("first = 1 or n = need").withColumn("some", some).where(full | ((F.col("some") == 0) & (F.col("first") == 1)))
    pairs = kept.join(distinct, "found").select(name, "query", id_, "product_name")
    if cap is None:
        return pairs
    return pairs.withColumn("__n", F.row_number().over(Window.partitionBy(name).orderBy(id_))).where(F.col("__n") <= cap).drop("__n")


def _score(both: Column, one: Column, two: Column, lcs: Column) -> Column:
    """Likeness of two texts by their sets of words, 0 to 100, from the number of characters of the words of both, of those of
    only one, and of the longest common subsequence of the latter.

    Each text is taken as its words, sorted, those of both first; likeness is twice the common subsequence over both
    lengths. The best of comparing the two texts, and the words of both with either, counts; so 100 if one text has no
    words of its own. The words of both begin the texts alike, so only what follows need be compared.
    """
    ratio = lambda common, total: F.lit(200.0) * common / total
    whole = ratio(both + 1 + lcs, 2 * (both + 1) + one + two)
    part = F.greatest(ratio(both, 2 * both + 1 + one), ratio(both, 2 * both + 1 + two))
    some = (both > 0) & ((one == 0) | (two == 0))
    return F.when((both + one == 0) | (both + two == 0), 0.0).when(some, 100.0).when(both == 0, ratio(lcs, one + two)).otherwise(F.greatest(whole, part))


def token_set_ratios(pairs: DataFrame, one: Column, two: Column, threshold: float = 0.0) -> DataFrame:
    """``pairs`` with the ``score`` of two texts, those of ``threshold`` or more.

    A common subsequence is no longer than the shorter text, which bounds the score; what the bound leaves out is
    never compared. Words are parted by any white space; null texts have no words.
    """
    words = lambda text: F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")))
    a, b = words(one), words(two)
    size = lambda text: F.char_length(text)
    texts = F.struct(F.array_join(F.array_intersect(a, b), " ").alias("both"), F.array_join(F.array_except(a, b), " ").alias("one"), F.array_join(F.array_except(b, a), " ").alias("two"))
    rows = pairs.withColumn("__t", texts)
    sizes = [size(F.col(f"__t.{c}")) for c in ("both", "one", "two")]
    rows = rows.where(_score(*sizes, F.least(*sizes[1:])) >= threshold)
    rows = rows.withColumn("__lcs", F.pandas_udf(lcs_lengths, "long")(F.col("__t.one"), F.col("__t.two")))
    return rows.withColumn("score", _score(*sizes, F.col("__lcs"))).where(F.col("score") >= threshold).drop("__t", "__lcs")


def fuzzy_best(candidates: DataFrame, name: str = "name", id_: str = "code", threshold: float = 75.0) -> DataFrame:
    """The best candidate of each name from ``threshold`` on; the lowest id of equals. A name's candidates meet as one row a task."""
    scored = token_set_ratios(candidates, F.upper("query"), F.upper("product_name"), threshold)
    best = scored.groupBy(name).agg(F.min(F.struct((-F.col("score")).alias("minus"), id_, "query", "product_name")).alias("best"))
    return best.select(name, f"best.{id_}", "best.query", "best.product_name", (-F.col("best.minus")).alias("score"))


def fuzzy_accept(best: DataFrame, name: str = "name") -> DataFrame:
    """Matches without sensitive words that the query lacks, of a fitting number of words; ``better`` is the name to use."""
    own, other = _words(F.lower("query")), _words(F.lower("product_name"))
    intruding = F.array_except(F.array_intersect(other, F.array(*[F.lit(w) for w in fixed.SENSITIVE_WORDS])), own)
    alpha = lambda words: F.size(F.filter(words, lambda w: w.rlike("[a-zA-Z]")))
    good = (F.size(intruding) == 0) & (F.size(other) <= F.size(own) + 3) & (alpha(other) >= alpha(own) - 1) & ~F.col("product_name").rlike(r"^\d+%?\s")
    text = F.trim("product_name")
    short = F.when(F.char_length(text) > 50, F.array_join(F.slice(_words(text), 1, 5), " ")).otherwise(text)
    return best.where(good).select(name, titled(short).alias("better"), "score")


def titled(text: Column) -> Column:
    """Each letter that follows no letter in upper case, all others in lower case: "Ben & Jerry's" is "Ben & Jerry'S"."""
    chars = F.split(F.lower(text), "")
    upper = lambda c, i: F.when((i == 0) | ~F.coalesce(F.get(chars, i - 1), F.lit("")).rlike(r"\p{L}"), F.upper(c)).otherwise(c)
    return F.array_join(F.transform(chars, upper), "")


def _first_held(text: Column, keys: list[str], values: list[Column]) -> Column:
    """The value of the first key that the text holds; both lists are constants, so the code does not grow with them."""
    place = matching.first_fit(text, [(str(i), lines.any_of([k])) for i, k in enumerate(keys)]).cast("int")
    return F.when(place.isNotNull(), F.get(F.array(*values), place))


def category_default(name: Column) -> Column:
    """A struct of value and unit by the first keyword that the name holds, else by the first brand's category."""
    table = [*fixed.DEFAULT_WEIGHTS.items(), *[(b, fixed.DEFAULT_WEIGHTS[c]) for b, c in fixed.BRANDS.items() if c in fixed.DEFAULT_WEIGHTS]]
    return _first_held(F.lower(name), [k for k, _ in table], [F.struct(F.lit(v).alias("value"), F.lit(u).alias("unit")) for _, (v, u) in table])


def staple_nutrition(name: Column) -> Column:
    """A struct of the nine nutrients by the longest staple that the name holds; the first of equals."""
    order = sorted(fixed.STAPLES, key=len, reverse=True)
    values = [F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(NUTRIENTS, fixed.STAPLES[k], strict=True)]) for k in order]
    return _first_held(F.lower(name), order, values)


def has_data(nutrients: Column) -> Column:
    return F.coalesce(*[nutrients[n] for n in NUTRIENTS]).isNotNull()


def all_zero(nutrients: Column) -> Column:
    """Energy, protein, fat and carbohydrates all equal 0; unknown is not 0."""
    zero = F.lit(True)
    for n in ("energy_kcal", "proteins", "fat", "carbohydrates"):
        zero = zero & nutrients[n].eqNullSafe(F.lit(0.0))
    return zero


def _with_lookup(items: DataFrame, products: DataFrame, name: str, prefix: str) -> DataFrame:
    """Items with the weight in grams and nutrients that their name finds."""
    columns = [F.coalesce(F.col(n), F.lit(None).cast("double")).alias(n) if n in products.columns else F.lit(None).cast("double").alias(n) for n in NUTRIENTS]
    hits = lookup_products(items.where(F.col(name).isNotNull()), products, name)
    hits = hits.select(name, weights.parse_quantity(F.col("quantity")).alias(f"{prefix}_weight"), F.struct(*columns).alias(f"{prefix}_per100"))
    return items.join(hits, name, "left")


def resolve_items(items: DataFrame, products: DataFrame, foods: DataFrame | None = None) -> DataFrame:
    """Weight, its source, nutrients per 100 g and actual for each item.

    ``items`` has name, resolved_name, qty, weight (struct) and weight_source. A weight on the receipt stays; else
    the product found by name, if plausible, the category default instead where the two disagree five times; else
    the same by the fuzzy name, which is taken over; else the category default. Nutrients fall back to staples.
    Names are looked up once each and joined back.
    """
    items = items.withColumn("search", F.coalesce(F.when(F.col("resolved_name") != "", F.col("resolved_name")), F.col("name")))
    known = _with_lookup(items, products, "search", "off")
    fuzzy = fuzzy_accept(fuzzy_best(fuzzy_candidates(items.select("search"), products, "search"), "search"), "search").select("search", "better")
    known = _with_lookup(known.join(fuzzy, "search", "left"), products, "better", "fuzzy")
    if foods is not None:
        found = lookup_foods(items.select("search"), foods, "search")
        values = F.struct(*[F.col(n) if n in foods.columns else F.lit(None).cast("double").alias(n) for n in NUTRIENTS])
        known = known.join(found.select("search", values.alias("food_per100")), "search", "left")
    grams = lambda w: weights.to_grams(F.col(w)["value"], F.col(w)["unit"])
    own = F.col("weight").isNotNull() & (F.coalesce("weight_source", F.lit("")) != "")
    skip = ~own & (F.coalesce("weight_source", F.lit("")) == "nonfood")
    default = category_default(F.col("search"))
    known = known.withColumn("default", default).withColumn("default2", F.coalesce("default", category_default(F.col("better"))))
    direct = weights.weight_plausible(grams("off_weight"), F.col("search"))
    second = weights.weight_plausible(grams("fuzzy_weight"), F.col("better"))
    apart = lambda a, b: F.coalesce(weights.weight_ratio(grams(a), grams(b)) > weights.DISAGREE, F.lit(False))
    source = (
        F.when(own, F.col("weight_source")).when(skip, "nonfood").when(direct & apart("off_weight", "default"), "category_default_override").when(direct, "off_db")
        .when(second & apart("fuzzy_weight", "default2"), "category_default_override").when(second, "off_db_fuzzy").when(F.col("default").isNotNull(), "category_default").otherwise("")
    )
    weight = F.when(own, F.col("weight")).when(skip, None).when(direct & apart("off_weight", "default"), F.col("default")).when(direct, F.col("off_weight"))
    weight = weight.when(second & apart("fuzzy_weight", "default2"), F.col("default2")).when(second, F.col("fuzzy_weight")).otherwise(F.col("default"))
    good = lambda c: F.when(has_data(F.col(c)) & ~all_zero(F.col(c)), F.col(c))
    staple = F.coalesce(good("food_per100"), staple_nutrition(F.col("search"))) if foods is not None else staple_nutrition(F.col("search"))
    per100 = F.when(own, F.coalesce(good("off_per100"), good("fuzzy_per100"))).when(direct, good("off_per100")).when(second, good("fuzzy_per100"))
    renamed = F.col("better").isNotNull() & (F.upper("better") != F.upper("search")) & ~skip & F.when(own, good("off_per100").isNull() & good("fuzzy_per100").isNotNull()).otherwise(~direct)
    out = known.select(
        *[c for c in items.columns if c not in ("search", "weight", "weight_source", "resolved_name")], F.when(renamed, F.col("better")).otherwise(F.col("search")).alias("resolved_name"),
        weight.alias("weight"), source.alias("weight_source"), F.when(~skip, F.coalesce(per100, staple)).alias("per100"),
    )
    return scale_nutrition(out)


def scale_nutrition(items: DataFrame) -> DataFrame:
    """weight_grams (two decimals) and the nutrients of the whole, per 100 g times the unrounded grams; none without a weight."""
    total = weights.to_grams(F.col("weight.value"), F.col("weight.unit")) * F.coalesce("qty", F.lit(1))
    actual = F.struct(*[F.round(F.col(f"per100.{n}") * total / 100, 2).alias(n) for n in NUTRIENTS])
    return items.withColumns({"weight_grams": F.round(total, 2), "actual": F.when(total.isNotNull() & has_data(F.col("per100")), actual)})

