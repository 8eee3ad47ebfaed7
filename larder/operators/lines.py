"""Receipt lines to labelled lines to items. Windows are per receipt, ordered by line_no; a receipt is one small group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, lines, matching, weights

KEY, ORDER = "receipt_id", "line_no"


def _all(key: str = KEY):
    return Window.partitionBy(key)


def _so_far(key: str = KEY):
    return Window.partitionBy(key).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)


def explode_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts to trimmed lines that are not empty, with line_no from 0 and position from 0 to 1 among all lines of the text."""
    rows = docs.select(F.col(key).alias(KEY), F.posexplode(F.split(text, "\n")).alias(ORDER, "text"), F.size(F.split(text, "\n")).alias("n"))
    rows = rows.withColumn("text", F.trim(lines.fix_units(F.col("text")))).where("text != ''")
    return rows.select(KEY, ORDER, (F.col(ORDER) / F.greatest(F.col("n") - 1, F.lit(1))).alias("line_pos"), "text")


def unmerge_lines(rows: DataFrame) -> DataFrame:
    """Merged lines apart: line_no stays, ``part`` counts from 0."""
    return rows.select(KEY, ORDER, F.posexplode(lines.unmerged(F.col("text"))).alias("part", "text"))


def positioned(rows: DataFrame) -> DataFrame:
    """line_pos from 0 to 1 by rank among the lines of a receipt."""
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(ORDER)) - 1
    return rows.withColumn("line_pos", rank / F.greatest(F.count("*").over(_all()) - 1, F.lit(1)))


def labelled(rows: DataFrame) -> DataFrame:
    """Lines with position and rule label."""
    return positioned(rows).withColumn("label", lines.rule_label(F.col("text"), F.col("line_pos")))


def active_section(rows: DataFrame, exact: bool = False) -> DataFrame:
    """The section that holds at each line ('' before the first), and labels with headers and store noise put in."""
    rows = rows.withColumns({"__header": lines.section_header(F.col("text"), exact), "__noise": lines.is_store_noise(F.col("text"))})
    section = F.coalesce(F.last("__header", ignorenulls=True).over(_so_far()), F.lit(""))
    label = F.when(F.col("__header").isNotNull(), "header").when(F.col("__noise"), "noise").otherwise(F.col("label"))
    return rows.withColumns({"section": section, "label": label}).drop("__header", "__noise")


def _priority(text: Column, table: dict[str, str]) -> Column:
    """The value of the first key, in table order, that the text holds."""
    return F.coalesce(*[F.when(text.contains(k), F.lit(v)) for k, v in table.items()])


def detect_store(rows: DataFrame) -> DataFrame:
    """Per receipt the display name of the first keyword, in table order, in the whole text in capitals.

    The lines of a receipt, one small group, are joined by blanks first, as a keyword may go over two lines.
    """
    ordered = F.array_sort(F.collect_list(F.struct(ORDER, "text")))
    whole = rows.groupBy(KEY).agg(F.upper(F.array_join(F.transform(ordered, lambda x: x["text"]), " ")).alias("whole"))
    return whole.select(KEY, _priority(F.col("whole"), fixed.STORES).alias("store"))


def receipt_date(rows: DataFrame) -> DataFrame:
    """Per receipt the date text of the first line labelled date that has one, else of the first line of any label."""
    found = rows.withColumn("d", lines.extract_date(F.col("text"))).where("d is not null")
    first = F.min_by("d", F.struct((F.col("label") != "date").cast("int"), F.col(ORDER)))
    return found.groupBy(KEY).agg(first.alias("date_text"))


def receipt_totals(rows: DataFrame) -> DataFrame:
    """Per receipt subtotal, tax and total as texts, of noise lines; the last line of each kind counts."""
    upper = F.upper("text")
    price = F.regexp_replace(lines.found(F.col("text"), lines.ONE_PRICE), ",", ".")
    last_price = F.regexp_replace(F.try_element_at(F.regexp_extract_all("text", F.lit(lines.ONE_PRICE), F.lit(1)), F.lit(-1)), ",", ".")
    sub = upper.contains("SUBTOTAL") & ~upper.contains("PACKAGE")
    tax = ~sub & upper.rlike(r"\bTAX\b")
    total = ~sub & ~tax & upper.contains("TOTAL") & ~upper.rlike("SUB|PACKAGE|SAVINGS")
    noise = rows.where("label = 'noise'").withColumns({"subtotal": F.when(sub, price), "tax": F.when(tax, last_price), "total": F.when(total, price)})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ORDER))).alias(c)
    return noise.groupBy(KEY).agg(last("subtotal"), last("tax"), last("total"))


def attach_modifiers(rows: DataFrame) -> DataFrame:
    """Items with the first qty line and the first weight line between them and the next item; others are left."""
    item = F.col("label") == "item"
    rows = rows.withColumn("item_no", F.count_if(item).over(_so_far())).where("item_no > 0")
    first = lambda label: F.min_by("text", F.when(F.col("label") == label, F.col(ORDER))).alias(f"{label}_line")
    kept = [F.min_by(c, F.when(item, F.col(ORDER))).alias(c) for c in ("text", *(c for c in rows.columns if c == "section"))]
    return rows.groupBy(KEY, "item_no").agg(F.min(F.when(item, F.col(ORDER))).alias(ORDER), *kept, first("qty"), first("weight"))


def extract_items(attached: DataFrame) -> DataFrame:
    """Items with name, resolved name, quantity, price, weight and its source; rows that can't be items are left out."""
    parts = attached.withColumn("split", lines.split_price(F.col("text")))
    named = parts.withColumn("name", lines.clean_item_name(F.col("split.name"))).where(lines.valid_item(F.col("name")))
    weight = F.coalesce(weights.extract_weight(F.col("name")), lines.line_weight(F.col("weight_line")))
    named = named.withColumn("weight", weight)
    nonfood = F.col("section").isin(fixed.NONFOOD_SECTIONS) if "section" in attached.columns else F.lit(False)
    source = F.when(F.col("weight").isNotNull(), "receipt").when(nonfood, "nonfood").otherwise("")
    return named.select(KEY, ORDER, "name", lines.resolve_name(F.col("name")).alias("resolved_name"), lines.parse_qty(F.col("qty_line")).alias("qty"), F.col("split.price").alias("line_price"), "weight", source.alias("weight_source"))


def pair_name_price(rows: DataFrame) -> DataFrame:
    """Names and prices on lines of their own, paired whichever comes first.

    ``kind`` is N (name), P (price), I (item with its price), X (clears what is pending) or S
    (skipped). A run is a stretch of N and P that alternate; places 1 and 2, 3 and 4 of a run are pairs.
    """
    w = Window.partitionBy(KEY).orderBy(ORDER)
    rows = rows.where("kind != 'S'").withColumn("before", F.lag("kind").over(w))
    fresh = F.col("before").isNull() | (F.col("before") == F.col("kind")) | F.col("before").isin("I", "X")
    rows = rows.withColumn("run", F.sum(fresh.cast("int")).over(_so_far()))
    in_run = Window.partitionBy(KEY, "run").orderBy(ORDER)
    rows = rows.withColumns({"place": F.row_number().over(in_run), "other": F.lag(F.struct("name", "price")).over(in_run)})
    pair = F.col("kind").isin("N", "P") & (F.col("place") % 2 == 0)
    name = F.when(pair, F.coalesce("name", "other.name")).otherwise(F.col("name"))
    price = F.when(pair, F.coalesce("price", "other.price")).otherwise(F.col("price"))
    return rows.where(pair | (F.col("kind") == "I")).select(KEY, ORDER, name.alias("name"), price.alias("price"))


# What a line is for the rule parser, first rule that fits; a third pattern must not be found
LINE_KINDS = [
    ("subtotal", "(?i)SUBTOTAL"), ("tax", "(?i)TAX"), ("total", "(?i)BAL"), ("total", "(?i)TOTAL", "(?i)SUB"), ("off", r"(?i)\boff\b"), ("negative", r"\d+\.\d{2}\s*-\s*$"), ("tare", r"(?i)^.*(TARE|ITEM)\s*="),
    ("digits", r"^[\d\s#*=.$]+$", r"^\d+\.\d{2}$"), ("weight", lines.WEIGHT_LINE), ("qty", r"(?i)@.*\d+\s*(?:EA|DZ)|\d+\s*(?:EA|DZ).*@"), ("bare", r"(?i)^\d+\s*(OZ|EA|DZ)\b"), ("price", r"^\d+\.\d{2}$"), ("item", lines.ITEM),
]


def line_kinds(rows: DataFrame) -> DataFrame:
    """``line_kind`` of each line for the rule parser. Headers count as such until a line has named the store."""
    text = F.trim(lines.fix_units(F.col("text")))
    rows = rows.withColumn("text", text).where("text != ''")
    words = matching.which(F.upper("text"), [lines.any_of([h.upper() for h in fixed.HEADER_WORDS]), lines.any_of(list(fixed.STORES))])
    rows = rows.withColumns({"__words": words, "__section": lines.section_header(F.col("text")).isNotNull(), "__noise": lines.is_store_noise(F.col("text")), "__fit": matching.first_fit(F.col("text"), LINE_KINDS)})
    header, named = F.col("__words").bitwiseAND(1) != 0, F.col("__words") == 3
    w = Window.partitionBy(KEY).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, -1)
    open_ = ~F.coalesce(F.max(named).over(w), F.lit(False))
    kind = F.when(header & open_, "header").when(F.col("__section"), "section").when(F.col("__noise"), "noise")
    kind = kind.otherwise(F.coalesce("__fit", F.lit("name")))
    return rows.withColumn("line_kind", kind).drop("__words", "__section", "__noise", "__fit")


def rule_items(kinds: DataFrame) -> DataFrame:
    """Items of the rule parser: inline ones and pairs of name and price lines, with the pending weight and quantity.

    A weight line holds for the next item that names none itself, a quantity line for the next item.
    """
    split = lines.split_price(F.col("text"))
    name = lines.clean_item_name(F.when(F.col("line_kind") == "item", split["name"]).when(F.col("line_kind") == "name", F.col("text")))
    price = F.when(F.col("line_kind").isin("item", "price"), split["price"])
    price = F.when(F.col("line_kind") == "price", F.col("text").try_cast("double")).otherwise(price)
    good = (F.char_length("name") > 1) & ~lines.is_noise(F.col("name"))
    kind = F.when(F.col("line_kind") == "price", "P").when(F.col("line_kind") == "item", "I").when(F.col("line_kind") == "name", F.when(good, "N").otherwise("X")).otherwise("S")
    rows = kinds.where("line_kind in ('item', 'price', 'name')").withColumns({"name": name, "price": price}).withColumn("kind", kind)
    items = pair_name_price(rows).where((F.char_length("name") > 1) & ~lines.is_noise(F.col("name")))
    return attach_forward(kinds, items)


def attach_forward(kinds: DataFrame, items: DataFrame) -> DataFrame:
    """Items with the last pending weight and quantity line before them that no earlier item has used."""
    count = F.regexp_extract("text", r"(?i)(\d+)\s*EA", 1).try_cast("int")
    dozen = F.regexp_extract("text", r"(?i)(\d+)\s*DZ", 1).try_cast("int") * 12
    pending = kinds.where("line_kind in ('weight', 'qty')").select(
        KEY, ORDER, F.when(F.col("line_kind") == "weight", lines.line_weight(F.col("text"))).alias("pw"), F.when(F.col("line_kind") == "qty", F.coalesce(count, dozen)).alias("pq")
    )
    own = weights.extract_weight(F.col("name"))
    rows = items.withColumns({"own": own, "item": F.lit(1)}).unionByName(pending.withColumn("item", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(KEY).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, -1)
    is_item = F.col("item") == 1
    rows = rows.withColumns({"w_used": F.count_if(is_item & F.col("own").isNull()).over(w), "q_used": F.count_if(is_item).over(w)})
    in_w, in_q = (Window.partitionBy(KEY, u).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0) for u in ("w_used", "q_used"))
    rows = rows.withColumns({"lw": F.last("pw", ignorenulls=True).over(in_w), "lq": F.last("pq", ignorenulls=True).over(in_q)})
    return rows.where(is_item).select(KEY, ORDER, "name", F.col("price").alias("line_price"), F.coalesce("lq", F.lit(1)).alias("qty"), F.coalesce("own", "lw").alias("weight"))


def merge_duplicates(items: DataFrame, key: str = KEY, pos: str = ORDER) -> DataFrame:
    """Items of one name in capitals become one: quantities add (null is 1); prices add where the first has one,
    rounded to cents; all else is the first's."""
    first = lambda c: F.min_by(c, pos)
    truthy = F.coalesce(F.col("line_price"), F.lit(0.0))
    merged = items.groupBy(key, F.upper("name").alias("__name")).agg(
        F.min(pos).alias(pos), first("name").alias("name"), F.when(F.count("*") > 1, F.sum(F.coalesce("qty", F.lit(1)))).otherwise(first("qty")).cast("int").alias("qty"),
        F.when(first(truthy) != 0, F.round(F.sum(truthy), 2)).otherwise(first("line_price")).alias("line_price"),
        *[first(c).alias(c) for c in items.columns if c not in (key, pos, "name", "qty", "line_price")],
    )
    return merged.drop("__name")
