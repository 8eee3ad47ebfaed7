"""Receipt lines: splitting, labels, items; fragments to lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, lines
from ..operators import fragments as fr
from ..operators import lines as ln
from ..operators.classify import effective_label
from .registry import query
from .views import view


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_q(pattern)})"


def _rows(spark, sf):
    return view(spark, sf, "receipt_lines")


_LOOSE = "(?i)" + "|".join(p.removeprefix("(?i)") for p in fixed.NOISE_PATTERNS if p.startswith("(?i)"))
_STRICT = "|".join(p for p in fixed.NOISE_PATTERNS if not p.startswith("(?i)"))
_STORE_NOISE = lambda t: f"({_m(f'trim({t})', _LOOSE)} OR {_m(f'trim({t})', _STRICT)})"
_NOISE = lambda t: f"""(length(trim({t})) <= 1 OR starts_with(trim({t}), '*') OR ({_m(f"upper(trim({t}))", r"\b(?:" + lines.any_of([w for w in fixed.NOISE_WORDS if len(w) <= 4]) + r")\b")} AND len(string_split_regex(upper(trim({t})), '\\s+')) <= 3) OR {_m(f"upper(trim({t}))", lines.any_of([w for w in fixed.NOISE_WORDS if len(w) > 4]))})"""
_POSITIONED = "pos AS (SELECT *, (row_number() OVER (PARTITION BY receipt_id ORDER BY line_no) - 1) / greatest(count(*) OVER (PARTITION BY receipt_id) - 1, 1) AS line_pos FROM {receipt_lines})"
_LABEL = f"""CASE WHEN length(trim(text)) <= 1 THEN 'noise' {" ".join(f"WHEN line_pos < 0.15 AND {_m('trim(text)', p)} THEN 'header'" for p in lines.TOP_RULES)} {" ".join(f"WHEN {_m('trim(text)', p)} THEN '{n}'" for n, p in lines.LABEL_RULES)} ELSE 'noise' END"""
_LABELLED = f"{_POSITIONED}, lab AS (SELECT *, {_LABEL} AS label FROM pos)"
_HEADER = f"CASE WHEN {_m('upper(trim(text))', '^(?:' + lines.any_of(fixed.SECTION_HEADERS) + ')')} THEN upper(trim(text)) END"
_SECTIONS = f"""{_LABELLED}, sec AS (SELECT receipt_id, line_no, text, line_pos, coalesce(last_value({_HEADER} IGNORE NULLS) OVER (PARTITION BY receipt_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section,
  CASE WHEN {_HEADER} IS NOT NULL THEN 'header' WHEN {_STORE_NOISE('text')} THEN 'noise' ELSE label END AS label FROM lab)"""


@query(
    "ln1_explode_lines",
    r"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {documents}), u AS (SELECT doc_id, unnest(parts) AS t, generate_subscripts(parts, 1) - 1 AS line_no, len(parts) AS n FROM s)
SELECT doc_id AS receipt_id, line_no::INT AS line_no, round(line_no / greatest(n - 1, 1), 6) AS line_pos, trim(regexp_replace(t, '\b1b\b', 'lb', 'g')) AS text FROM u WHERE trim(t) <> ''""",
)
def ln1(spark, sf):
    return ln.explode_lines(view(spark, sf, "documents"), "doc_id").withColumn("line_pos", F.round("line_pos", 6))


_MERGED = """SELECT receipt_id, line_no, CASE line_no % 3 WHEN 0 THEN concat('0', 1 + receipt_id % 9, '/12/2026 10:15 AM ', text, ' ..........') WHEN 1 THEN concat(upper(text), ' ', 210070000 + line_no, ' ', text, ' ', 1267008000 + line_no, ' X ', text) ELSE concat(450000000 + line_no, ' ', text) END AS text FROM {receipt_lines} WHERE line_no <> 1"""


@query(
    "ln2_unmerge_lines",
    f"""WITH m AS ({_MERGED}), l AS (SELECT receipt_id, line_no, text FROM {{receipt_lines}} WHERE line_no <> 1)
SELECT receipt_id, line_no, 0 AS part, CASE line_no % 3 WHEN 0 THEN concat('0', 1 + receipt_id % 9, '/12/2026 10:15 AM') WHEN 1 THEN upper(text) ELSE concat(450000000 + line_no, ' ', text) END AS text FROM l
UNION ALL SELECT receipt_id, line_no, 1, CASE line_no % 3 WHEN 0 THEN concat(text, ' ..........') ELSE concat(210070000 + line_no, ' ', text) END FROM l WHERE line_no % 3 < 2
UNION ALL SELECT receipt_id, line_no, 2, concat(1267008000 + line_no, ' X ', text) FROM l WHERE line_no % 3 = 1""",
)
def ln2(spark, sf):
    return ln.unmerge_lines(spark.sql(_MERGED, receipt_lines=_rows(spark, sf)))


_CNT = lambda keep: f"length(regexp_replace(trim(text), '[^{keep}]', '', 'g'))"
_LEN, _ALPHA, _UP = "length(trim(text))", _CNT(r"\p{L}"), _CNT(r"\p{Lu}")
_A = {
    "n_words": "len(string_split_regex(trim(text), '\\s+'))::INT", "n_chars": f"{_LEN}::INT", "alpha_ratio": f"round({_ALPHA} / greatest({_LEN}, 1), 6)", "digit_ratio": f"round({_CNT('0-9')} / greatest({_LEN}, 1), 6)",
    "upper_ratio": f"round({_UP} / greatest({_ALPHA}, 1), 6)", "special_ratio": rf"round(length(regexp_replace(trim(text), '[\p{{L}}\p{{N}}\s]', '', 'g')) / greatest({_LEN}, 1), 6)", "n_prices": r"len(regexp_extract_all(trim(text), '\d+\.\d{2}'))::INT",
} | {n: f"{_m('trim(text)', p)}::INT" for n, p in lines.FLAGS_A.items()}


@query("ln3_line_features_a", "SELECT receipt_id, line_no, " + ", ".join(f"{e} AS {n}" for n, e in _A.items()) + " FROM {receipt_lines}")
def ln3(spark, sf):
    feats = {n: F.round(c, 6) if n.endswith("_ratio") else c for n, c in lines.line_features_a(F.col("text")).items()}
    return _rows(spark, sf).select("receipt_id", "line_no", *[c.cast("double" if n.endswith("_ratio") else "int").alias(n) for n, c in feats.items()])


_B = {
    "char_count": f"{_LEN}::INT", "word_count": "len(string_split_regex(trim(text), '\\s+'))::INT", "line_pos": "round(line_pos, 3)", "is_top_10pct": "(line_pos < 0.1)::INT", "is_bottom_20pct": "(line_pos > 0.8)::INT",
    "price_count": r"len(regexp_extract_all(trim(text), '\$?\d+\.\d{2}'))::INT", "digit_ratio": f"round({_CNT('0-9')} / greatest({_LEN}, 1), 3)", "upper_ratio": f"round({_UP} / greatest({_ALPHA}, 1), 3)",
    "has_mixed_case": rf"({_UP} > 0 AND {_CNT(chr(92) + 'p{Ll}')} > 0)::INT",
} | {n: f"{_m('trim(text)', p)}::INT" for n, p in lines.FLAGS_B.items()}


@query("ln4_line_features_b", f"WITH {_POSITIONED} SELECT receipt_id, line_no, " + ", ".join(f"{e} AS {n}" for n, e in _B.items()) + " FROM pos")
def ln4(spark, sf):
    feats = lines.line_features_b(F.col("text"), F.col("line_pos"))
    doubles = ("line_pos", "digit_ratio", "upper_ratio")
    return ln.positioned(_rows(spark, sf)).select("receipt_id", "line_no", *[c.cast("double" if n in doubles else "int").alias(n) for n, c in feats.items()])


@query("ln5_rule_label", f"WITH {_LABELLED} SELECT receipt_id, line_no, label FROM lab")
def ln5(spark, sf):
    return ln.labelled(_rows(spark, sf)).select("receipt_id", "line_no", "label")


@query("ln6_noise_flags", f"SELECT receipt_id, line_no, {_STORE_NOISE('text')} AS store_noise, {_NOISE('text')} AS name_noise FROM {{receipt_lines}}")
def ln6(spark, sf):
    return _rows(spark, sf).select("receipt_id", "line_no", lines.is_store_noise(F.col("text")).alias("store_noise"), lines.is_noise(F.col("text")).alias("name_noise"))


@query("ln7_active_section", f"WITH {_SECTIONS} SELECT receipt_id, line_no, section, label FROM sec")
def ln7(spark, sf):
    return ln.active_section(ln.labelled(_rows(spark, sf))).select("receipt_id", "line_no", "section", "label")


@query("ln9_detect_store", "SELECT receipt_id, " + "CASE " + " ".join(f"WHEN contains(t, {_q(k)}) THEN {_q(v)}" for k, v in fixed.STORES.items()) + " END AS store FROM (SELECT receipt_id, upper(string_agg(text, ' ' ORDER BY line_no)) AS t FROM {receipt_lines} GROUP BY receipt_id)")
def ln9(spark, sf):
    return ln.detect_store(_rows(spark, sf))


_DATE = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {_q(p)}, 1), '')" for p in lines.DATES) + ")"


@query("ln10_receipt_date", f"WITH {_LABELLED} SELECT receipt_id, arg_min(d, line_no) AS date_text FROM (SELECT *, {_DATE} AS d FROM lab) WHERE d IS NOT NULL GROUP BY receipt_id")
def ln10(spark, sf):
    return ln.receipt_date(ln.labelled(_rows(spark, sf)))


_P1 = _q(lines.ONE_PRICE)


@query(
    "ln11_receipt_totals",
    f"""WITH {_LABELLED}, u AS (SELECT *, upper(text) AS t, {_m('text', lines.ONE_PRICE)} AS priced FROM lab WHERE label IN ('noise', 'metadata', 'discount')),
k AS (SELECT *, CASE WHEN contains(t, 'SUBTOTAL') AND NOT contains(t, 'PACKAGE') THEN 's' WHEN regexp_matches(t, '\\bTAX\\b') THEN 'x'
  WHEN contains(t, 'TOTAL') AND NOT regexp_matches(t, 'SUB|PACKAGE|SAVINGS') THEN 't' END AS kind FROM u)
SELECT receipt_id, arg_max(replace(regexp_extract(text, {_P1}, 1), ',', '.'), line_no) FILTER (kind = 's' AND priced) AS subtotal,
 arg_max(replace(regexp_extract_all(text, {_P1}, 1)[-1], ',', '.'), line_no) FILTER (kind = 'x' AND priced) AS tax,
 arg_max(replace(regexp_extract(text, {_P1}, 1), ',', '.'), line_no) FILTER (kind = 't' AND priced) AS total FROM k GROUP BY receipt_id""",
)
def ln11(spark, sf):
    return ln.receipt_totals(ln.labelled(_rows(spark, sf)).withColumn("label", effective_label(F.lit(""), F.col("label"))))


_ATTACHED = f"""{_SECTIONS}, num AS (SELECT *, count(*) FILTER (label = 'item') OVER (PARTITION BY receipt_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item_no FROM sec),
att AS (SELECT receipt_id, item_no, min(line_no) FILTER (label = 'item') AS line_no, arg_min(text, line_no) FILTER (label = 'item') AS text, arg_min(section, line_no) FILTER (label = 'item') AS section,
  arg_min(text, line_no) FILTER (label = 'qty') AS qty_line, arg_min(text, line_no) FILTER (label = 'weight') AS weight_line FROM num WHERE item_no > 0 GROUP BY receipt_id, item_no)"""


def _attached(spark, sf):
    return ln.attach_modifiers(ln.active_section(ln.labelled(_rows(spark, sf))))


@query("ln12_attach_modifiers", f"WITH {_ATTACHED} SELECT receipt_id, line_no, text, section, qty_line, weight_line FROM att")
def ln12(spark, sf):
    return _attached(spark, sf).select("receipt_id", "line_no", "text", "section", "qty_line", "weight_line")


_SPLIT_NAME = f"CASE WHEN {_m('text', lines.ITEM)} THEN trim(regexp_extract(text, {_q(lines.ITEM)}, 1)) ELSE trim(regexp_replace(text, {_q(lines.LAST_PRICE)}, '')) END"
_SPLIT_PRICE = f"try_cast(CASE WHEN {_m('text', lines.ITEM)} THEN regexp_extract(text, {_q(lines.ITEM)}, 2) ELSE regexp_extract(text, {_q(lines.LAST_PRICE)}, 1) END AS DOUBLE)"


@query("ln13_split_price", f"SELECT receipt_id, line_no, {_SPLIT_NAME} AS name, {_SPLIT_PRICE} AS price FROM {{receipt_lines}}")
def ln13(spark, sf):
    s = lines.split_price(F.col("text"))
    return _rows(spark, sf).select("receipt_id", "line_no", s["name"].alias("name"), s["price"].alias("price"))


_DIRTY = """SELECT receipt_id, line_no, concat(CASE line_no % 7 WHEN 0 THEN '*WT ' WHEN 1 THEN '004011 ' WHEN 2 THEN '## ' WHEN 3 THEN '2 ' WHEN 4 THEN 'E ' ELSE '' END, text, CASE receipt_id % 6 WHEN 0 THEN ' FC' WHEN 1 THEN ' $ 3.99' WHEN 2 THEN ' 123456789012' WHEN 3 THEN ' NF $' WHEN 4 THEN ' approved . thank you' ELSE ' :)' END) AS text FROM {receipt_lines}"""


def _cleaned(e: str, strips=lines.NAME_STRIPS) -> str:
    for p, kept in strips:
        e = f"trim(regexp_replace({e}, {_q(p)}, {_q(kept.replace('$1', chr(92) + '1'))}, 'g'))"
    return e


@query("ln14_clean_item_name", f"SELECT receipt_id, line_no, {_cleaned('text')} AS name FROM ({_DIRTY})")
def ln14(spark, sf):
    return spark.sql(_DIRTY, receipt_lines=_rows(spark, sf)).select("receipt_id", "line_no", lines.clean_item_name(F.col("text")).alias("name"))


_VALID = lambda n: f"""NOT ({_NOISE(n)} OR {_STORE_NOISE(n)} OR length(regexp_replace({n}, '[^\\p{{L}}]', '', 'g')) < 3 OR {_m(f"upper(trim({n}))", lines.any_of(fixed.PAYMENT_WORDS))} OR upper(trim({n})) IN ({", ".join(_q(b) for b in fixed.NONFOOD_BRANDS)})
 OR {_m(n, r"(?i)^[A-Z],\s+\w+\s+STORE")} OR upper(trim({n})) IN ('USD', 'CAD', 'TILL', 'VISA', 'LEOSO') OR {_m(n, lines.FOREIGN_SCRIPT)})"""  # noqa: E731


@query("ln15_valid_item", f"SELECT receipt_id, line_no, {_VALID('text')} AS valid FROM {{receipt_lines}}")
def ln15(spark, sf):
    return _rows(spark, sf).select("receipt_id", "line_no", lines.valid_item(F.col("text")).alias("valid"))


_QTY = _q(r"(?i)^\s*(\d+)\s*(EA|EACH|PC|PCS|DZ|DOZ|DOZEN)?\b")
_QTY_OF = lambda t: f"coalesce(try_cast(nullif(regexp_extract({t}, {_QTY}, 1), '') AS INT) * CASE WHEN upper(regexp_extract({t}, {_QTY}, 2)) IN ('DZ', 'DOZ', 'DOZEN') THEN 12 ELSE 1 END, 1)::INT"


@query("ln16_parse_qty", f"SELECT receipt_id, line_no, {_QTY_OF('text')} AS qty FROM {{receipt_lines}}")
def ln16(spark, sf):
    return _rows(spark, sf).select("receipt_id", "line_no", lines.parse_qty(F.col("text")).alias("qty"))


_NW = _q(r"(?i)(\d+(?:\.\d+)?)\s*(kg|g|lb|lbs|oz|ml|l)\b")
_ITEMS = f"""{_ATTACHED}, it AS (SELECT *, {_cleaned(_SPLIT_NAME)} AS name, {_SPLIT_PRICE} AS line_price, {_QTY_OF('qty_line')} AS qty FROM att), ok AS (SELECT *, try_cast(nullif(regexp_extract(name, {_NW}, 1), '') AS DOUBLE) AS nv,
 try_cast(nullif(regexp_extract(weight_line, {_q(lines.WEIGHT_LINE)}, 1), '') AS DOUBLE) AS wv FROM it WHERE {_VALID('name')})"""


@query(
    "ln17_extract_items",
    f"""WITH {_ITEMS} SELECT receipt_id, line_no, name, qty, line_price, coalesce(nv, wv) AS weight_value, CASE WHEN nv IS NOT NULL THEN lower(regexp_extract(name, {_NW}, 2)) WHEN wv IS NOT NULL THEN lower(regexp_extract(weight_line, {_q(lines.WEIGHT_LINE)}, 2)) END AS weight_unit,
 CASE WHEN coalesce(nv, wv) IS NOT NULL THEN 'receipt' WHEN section IN ({", ".join(_q(s) for s in fixed.NONFOOD_SECTIONS)}) THEN 'nonfood' ELSE '' END AS weight_source FROM ok""",
)
def ln17(spark, sf):
    items = ln.extract_items(_attached(spark, sf))
    return items.select("receipt_id", "line_no", "name", "qty", "line_price", F.col("weight.value").alias("weight_value"), F.col("weight.unit").alias("weight_unit"), "weight_source")


# turns of a conversation as names and prices on lines of their own
_TURNS = "SELECT conv_id AS receipt_id, CAST(turn AS INT) AS line_no, CASE WHEN length(text) % 5 = 0 THEN 'S' WHEN length(text) % 11 = 0 THEN 'X' WHEN length(text) % 7 = 0 THEN 'I' WHEN length(text) % 2 = 0 THEN 'P' ELSE 'N' END AS kind, text AS n, length(text) / CAST(4 AS DOUBLE) AS p FROM {conversations}"


@query(
    "ln18_pair_name_price",
    f"""WITH RECURSIVE t AS (SELECT receipt_id, row_number() OVER (PARTITION BY receipt_id ORDER BY line_no) AS i, line_no, kind, n, p FROM ({_TURNS}) WHERE kind <> 'S'),
r AS (SELECT receipt_id, i, line_no, CASE WHEN kind = 'N' THEN n END AS pn, CASE WHEN kind = 'P' THEN p END AS pp, CASE WHEN kind = 'I' THEN n END AS name, CASE WHEN kind = 'I' THEN p END AS price FROM t WHERE i = 1
 UNION ALL SELECT t.receipt_id, t.i, t.line_no, CASE WHEN t.kind = 'N' AND r.pp IS NULL THEN t.n END, CASE WHEN t.kind = 'P' AND r.pn IS NULL THEN t.p END,
  CASE WHEN t.kind = 'I' THEN t.n WHEN t.kind = 'N' AND r.pp IS NOT NULL THEN t.n WHEN t.kind = 'P' AND r.pn IS NOT NULL THEN r.pn END,
  CASE WHEN t.kind = 'I' THEN t.p WHEN t.kind = 'N' AND r.pp IS NOT NULL THEN r.pp WHEN t.kind = 'P' AND r.pn IS NOT NULL THEN t.p END FROM t JOIN r ON t.receipt_id = r.receipt_id AND t.i = r.i + 1)
SELECT receipt_id, line_no, name, price FROM r WHERE name IS NOT NULL""",
)
def ln18(spark, sf):
    turns = spark.sql(_TURNS, conversations=view(spark, sf, "conversations"))
    name, price = F.when(F.col("kind").isin("N", "I"), F.col("n")), F.when(F.col("kind").isin("P", "I"), F.col("p"))
    return ln.pair_name_price(turns.withColumns({"name": name, "price": price}))


_KIND = " ".join(f"WHEN {_m('text', p)}{''.join(f' AND NOT {_m(chr(116) + chr(101) + chr(120) + chr(116), u)}' for u in unless)} THEN '{n}'" for n, p, *unless in ln.LINE_KINDS)
_HDR = _m("upper(text)", lines.any_of([h.upper() for h in fixed.HEADER_WORDS]))
_KINDS = f"""kinds AS (SELECT receipt_id, line_no, text, CASE WHEN {_HDR} AND NOT coalesce(max(({_HDR} AND {_m("upper(text)", lines.any_of(list(fixed.STORES)))})::INT) OVER (PARTITION BY receipt_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BOOLEAN THEN 'header'
 WHEN {_HEADER} IS NOT NULL THEN 'section' WHEN {_STORE_NOISE('text')} THEN 'noise' {_KIND} ELSE 'name' END AS line_kind FROM {{receipt_lines}})"""


@query("ln20_line_kinds", f"WITH {_KINDS} SELECT receipt_id, line_no, line_kind FROM kinds")
def ln20(spark, sf):
    return ln.line_kinds(_rows(spark, sf)).select("receipt_id", "line_no", "line_kind")


#: The rule parser as an automaton over a receipt's lines. Its state: the name and the price that wait for each other,
#: the weight and the quantity that wait for an item.
_WAITS = "t.receipt_id, t.i, t.line_no"
_NAME_WEIGHT = "regexp_replace(trim(n), '(?i)(\\d+(?:\\.\\d+)?)\\s*o\\b', '\\1 oz', 'g')"
_RULE_ROWS = f"""rows_ AS (
  SELECT receipt_id, line_no, line_kind, text, CASE line_kind WHEN 'item' THEN {_cleaned(_SPLIT_NAME)} WHEN 'name' THEN {_cleaned('text')} END AS n,
    CASE line_kind WHEN 'item' THEN {_SPLIT_PRICE} WHEN 'price' THEN try_cast(text AS DOUBLE) END AS p
  FROM kinds WHERE line_kind IN ('item', 'price', 'name', 'weight', 'qty')),
told AS (SELECT *, coalesce(length(n) > 1 AND NOT {_NOISE('n')}, false) AS ok, nullif(try_cast(nullif(regexp_extract({_NAME_WEIGHT}, {_NW}, 1), '') AS DOUBLE), 0) AS nv,
    replace(lower(regexp_extract({_NAME_WEIGHT}, {_NW}, 2)), 'lbs', 'lb') AS nu FROM rows_),
t AS MATERIALIZED (
  SELECT receipt_id, line_no, row_number() OVER (PARTITION BY receipt_id ORDER BY line_no) AS i, n, p, ok, nv, CASE WHEN nv IS NOT NULL THEN nu END AS nu,
    CASE line_kind WHEN 'item' THEN 'I' WHEN 'price' THEN 'P' WHEN 'weight' THEN 'W' WHEN 'qty' THEN 'Q' ELSE CASE WHEN ok THEN 'N' ELSE 'X' END END AS kind,
    CASE line_kind WHEN 'weight' THEN try_cast(nullif(regexp_extract(text, {_q(lines.WEIGHT_LINE)}, 1), '') AS DOUBLE) END AS wv,
    CASE line_kind WHEN 'weight' THEN lower(regexp_extract(text, {_q(lines.WEIGHT_LINE)}, 2)) END AS wu,
    CASE line_kind WHEN 'qty' THEN coalesce(try_cast(nullif(regexp_extract(text, '(?i)(\\d+)\\s*EA', 1), '') AS INT),
      try_cast(nullif(regexp_extract(text, '(?i)(\\d+)\\s*DZ', 1), '') AS INT) * 12) END AS q
  FROM told),
r AS (
  SELECT receipt_id, i, line_no, NULL::VARCHAR AS pn, NULL::DOUBLE AS pv, NULL::VARCHAR AS pu, NULL::DOUBLE AS pp, NULL::DOUBLE AS ww, NULL::VARCHAR AS wwu, NULL::INT AS qq,
    NULL::VARCHAR AS name, NULL::DOUBLE AS price, NULL::INT AS qty, NULL::DOUBLE AS weight_value, NULL::VARCHAR AS weight_unit FROM (SELECT DISTINCT receipt_id, 0 AS i, -1 AS line_no FROM t)
  UNION ALL
  SELECT receipt_id, i, line_no, CASE WHEN kind = 'N' AND pp IS NULL THEN n WHEN kind IN ('W', 'Q') THEN pn END, CASE WHEN kind = 'N' AND pp IS NULL THEN nv WHEN kind IN ('W', 'Q') THEN pv END,
    CASE WHEN kind = 'N' AND pp IS NULL THEN nu WHEN kind IN ('W', 'Q') THEN pu END, CASE WHEN kind = 'P' AND pn IS NULL THEN p WHEN kind IN ('W', 'Q') THEN pp END,
    CASE WHEN kind = 'W' THEN coalesce(wv, ww) WHEN emitted AND ev IS NULL THEN NULL ELSE ww END, CASE WHEN kind = 'W' THEN CASE WHEN wv IS NULL THEN wwu ELSE wu END ELSE wwu END,
    CASE WHEN kind = 'Q' THEN coalesce(q, qq) WHEN emitted THEN NULL ELSE qq END,
    CASE WHEN emitted THEN en END, CASE WHEN emitted THEN CASE kind WHEN 'I' THEN p WHEN 'N' THEN pp ELSE p END END, CASE WHEN emitted THEN coalesce(qq, 1) END,
    CASE WHEN emitted THEN coalesce(ev, ww) END, CASE WHEN emitted THEN CASE WHEN ev IS NOT NULL THEN eu WHEN ww IS NOT NULL THEN wwu END END
  FROM (SELECT {_WAITS}, t.kind, t.n, t.p, t.nv, t.nu, t.wv, t.wu, t.q, r.pn, r.pv, r.pu, r.pp, r.ww, r.wwu, r.qq,
      (t.kind = 'I' AND t.ok) OR (t.kind = 'N' AND r.pp IS NOT NULL) OR (t.kind = 'P' AND r.pn IS NOT NULL) AS emitted,
      CASE WHEN t.kind = 'P' THEN r.pn ELSE t.n END AS en, CASE WHEN t.kind = 'P' THEN r.pv ELSE t.nv END AS ev, CASE WHEN t.kind = 'P' THEN r.pu ELSE t.nu END AS eu
    FROM t JOIN r ON t.receipt_id = r.receipt_id AND t.i = r.i + 1))"""


@query(
    "ln20_rule_items",
    f"""WITH RECURSIVE {_KINDS}, {_RULE_ROWS}
SELECT receipt_id, min(line_no)::INT AS line_no, arg_min(name, line_no) AS name, CASE WHEN count(*) > 1 THEN sum(qty) ELSE any_value(qty) END::INT AS qty,
  CASE WHEN arg_min(coalesce(price, 0), line_no) <> 0 THEN round(sum(coalesce(price, 0)), 2) ELSE arg_min_null(price, line_no) END AS line_price,
  arg_min_null(weight_value, line_no) AS weight_value, arg_min_null(weight_unit, line_no) AS weight_unit
FROM r WHERE name IS NOT NULL GROUP BY receipt_id, upper(name)""",
)
def ln20_items(spark, sf):
    items = ln.merge_duplicates(ln.rule_items(ln.line_kinds(_rows(spark, sf))))
    return items.select("receipt_id", "line_no", "name", "qty", "line_price", F.col("weight.value").alias("weight_value"), F.col("weight.unit").alias("weight_unit"))


@query(
    "ln21_merge_duplicates",
    """SELECT receipt_no, min(pos) AS pos, arg_min(name, pos) AS name, CASE WHEN count(*) > 1 THEN sum(coalesce(qty, 1)) ELSE any_value(qty) END::INT AS qty,
 CASE WHEN arg_min(coalesce(line_price, 0), pos) <> 0 THEN round(sum(coalesce(line_price, 0)), 2) ELSE arg_min_null(line_price, pos) END AS line_price FROM {receipt_items} GROUP BY receipt_no, upper(name)""",
)
def ln21(spark, sf):
    return ln.merge_duplicates(view(spark, sf, "receipt_items").select("receipt_no", "pos", "name", "qty", "line_price"), "receipt_no", "pos")


_MAP = lambda table: "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in table.items()) + "}"
_PARTS = lambda t: rf"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"
_RESOLVED = rf"""WITH a AS (SELECT receipt_id, line_no, regexp_replace(regexp_replace(trim(text), '(?i)(\d+(?:\.\d+)?)\s*o\b', '\1oz', 'g'), '\s+\d+\.\s*$', '', 'g') AS t FROM {{receipt_lines}}),
b AS (SELECT *, regexp_matches(t, '[''’][sS]$') AS owned, regexp_replace(regexp_replace(t, '[''’][sS]$', ''), '([a-z])([A-Z])', '\1 \2', 'g') AS u FROM a),
c AS (SELECT *, list_transform({_PARTS("u")}, lambda w: coalesce(map_extract({_MAP(fixed.MISSPELLINGS)}, upper(w))[1], w)) AS mended FROM b),
d AS (SELECT *, array_to_string(list_transform(mended, lambda w: coalesce(map_extract({_MAP(fixed.ABBREVIATIONS)}, regexp_replace(upper(w), '^[''".,;:]+|[''".,;:]+$', '', 'g'))[1], w)), ' ') AS spelled FROM c),
e AS (SELECT *, CASE WHEN owned AND NOT ends_with(spelled, 's') THEN concat(spelled, 's') ELSE spelled END AS whole FROM d)
SELECT receipt_id, line_no, array_to_string(list_transform({_PARTS("whole")}, lambda w: CASE WHEN regexp_matches(w, '^\d') THEN w
  WHEN upper(w) IN ({", ".join(_q(k) for k in fixed.KEPT_UPPER)}) THEN upper(w) ELSE concat(upper(w[1]), lower(w[2:])) END), ' ') AS resolved_name FROM e"""


@query("ln22_resolve_name", _RESOLVED)
def ln22(spark, sf):
    return _rows(spark, sf).select("receipt_id", "line_no", lines.resolve_name(F.col("text")).alias("resolved_name"))


@query(
    "ln23_normalize_line",
    r"SELECT receipt_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '\$?\d+\.\d{2}', ' _PRICE_ ', 'g'), '\d{6,}', ' _UPC_ ', 'g'), '\d+', ' _NUM_ ', 'g'), '[^\p{L}\p{N}\s@#%_]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM {receipt_lines}",
)
def ln23(spark, sf):
    return _rows(spark, sf).select("receipt_id", "line_no", lines.normalize_line(F.col("text")).alias("text"))


# words of lines as fragments: a word every 10 to the right, a line every 20 down, each word 0 to 2 lower
_WORDS = r"""SELECT receipt_id, line_no, w, i FROM (SELECT receipt_id, line_no, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM {receipt_lines}) WHERE length(w) >= 2"""


def _fragments(spark, sf):
    words = _rows(spark, sf).select("receipt_id", "line_no", F.posexplode(F.split("text", " ")).alias("i", "text")).where(F.char_length("text") >= 2)
    return words.select("receipt_id", "line_no", (F.col("line_no") * 20.0 + (F.col("i") + 1) % 3).alias("y"), ((F.col("i") + 1) * 10.0).alias("x"), "text", F.lit(0.95).alias("conf"))


@query(
    "ln24_fragments_to_lines",
    f"SELECT receipt_id, (row_number() OVER (PARTITION BY receipt_id ORDER BY line_no) - 1)::INT AS line_no, string_agg(w, ' ' ORDER BY i) AS text FROM ({_WORDS}) GROUP BY receipt_id, line_no",
)
def ln24(spark, sf):
    return fr.fragments_to_lines(_fragments(spark, sf))


# every word from the third on of lines of four words or more lies three lower, so that a row has a gap of over 2
_UNEVEN = f"""SELECT receipt_id, line_no, w, i, i * 10 AS x, line_no * 40.0 + CASE WHEN i >= 3 AND n >= 4 THEN 3 ELSE 0 END AS y, n,
  row_number() OVER (PARTITION BY receipt_id, line_no ORDER BY i) AS k, count(*) OVER (PARTITION BY receipt_id, line_no) AS m
FROM (SELECT receipt_id, line_no, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i, len(string_split(text, ' ')) AS n FROM {{receipt_lines}}) WHERE length(w) >= 2"""


@query(
    "ln26_split_rows",
    f"""WITH u AS ({_UNEVEN}), l AS (SELECT receipt_id, line_no, string_agg(w, ' ' ORDER BY i) AS whole, count(*) AS m,
  coalesce(min(length(w)) FILTER (n >= 4), 0) AS least_, sum(length(w) + 1) FILTER (n >= 4 AND i < 3) - 1 AS one, sum(length(w) + 1) FILTER (n >= 4 AND i >= 3) - 1 AS two FROM u GROUP BY receipt_id, line_no),
s AS (SELECT receipt_id, line_no, m > 2 AND one > 3 AND two > 3 AND NOT (regexp_matches(whole, '\\d+\\.\\d{{2}}\\s*$') AND length(whole) < 50) AS split FROM l)
SELECT u.receipt_id, (dense_rank() OVER (PARTITION BY u.receipt_id ORDER BY u.line_no) - 1)::INT AS row_no, CASE WHEN coalesce(split, false) AND i >= 3 THEN 1 ELSE 0 END::INT AS part,
  x::DOUBLE AS x, y::DOUBLE AS y, w AS text FROM u JOIN s ON u.receipt_id = s.receipt_id AND u.line_no = s.line_no""",
)
def ln26(spark, sf):
    words = _rows(spark, sf).select("receipt_id", "line_no", F.size(F.split("text", " ")).alias("n"), F.posexplode(F.split("text", " ")).alias("i", "text")).where(F.char_length("text") >= 2)
    lower = F.when((F.col("i") >= 2) & (F.col("n") >= 4), 3.0).otherwise(0.0)
    frags = words.select("receipt_id", (F.col("line_no") * 40.0 + lower).alias("y"), ((F.col("i") + 1) * 10.0).alias("x"), "text")
    return fr.split_fragments(frags)


@query("ln25_row_threshold", f"""WITH f AS (SELECT receipt_id, line_no * 20.0 + i % 3 AS y, regexp_matches(w, '^\\$?\\d+\\.\\d{{2}}$') AS price FROM ({_WORDS})),
near AS (SELECT receipt_id, y, min(d) AS d FROM (SELECT p.receipt_id, p.y, p.rowid_ AS k, abs(p.y - o.y) AS d FROM (SELECT *, row_number() OVER () AS rowid_ FROM f WHERE price) p JOIN f o ON o.receipt_id = p.receipt_id AND NOT o.price) GROUP BY receipt_id, y, k HAVING min(d) < 50),
a AS (SELECT receipt_id, list_sort(list(d)) AS ds FROM near GROUP BY receipt_id), g AS (SELECT receipt_id, list_sort(list(gap) FILTER (gap > 1)) AS gs FROM (SELECT receipt_id, y - lag(y) OVER (PARTITION BY receipt_id ORDER BY y) AS gap FROM f) GROUP BY receipt_id)
SELECT g.receipt_id, CASE WHEN len(ds) > 0 THEN greatest(ds[floor(len(ds) * 0.9)::INT + 1] + 3, 5) WHEN len(gs) > 0 THEN greatest(gs[len(gs) // 2 + 1] * 0.7, 5) ELSE 8 END::DOUBLE AS threshold FROM g LEFT JOIN a USING (receipt_id)""")
def ln25(spark, sf):
    return fr.row_threshold(_fragments(spark, sf))


@query("ln27_dedup_fragments", f"SELECT receipt_id, line_no * 20.0::DOUBLE + i % 3 AS y, i * 10.0::DOUBLE AS x, w AS text, CASE WHEN i % 5 = 0 THEN 0.99 ELSE 0.95 END::DOUBLE AS conf FROM ({_WORDS})".replace("line_no * 20.0::DOUBLE + i % 3 AS y, i * 10.0::DOUBLE AS x", "(line_no * 20.0 + i % 3 + CASE WHEN i % 5 = 0 THEN 0.25 ELSE 0 END)::DOUBLE AS y, (i * 10.0 + CASE WHEN i % 5 = 0 THEN 2 ELSE 0 END)::DOUBLE AS x"))
def ln27(spark, sf):
    """Every fifth word comes twice, the second time a little off and surer."""
    frags = _fragments(spark, sf).drop("line_no")
    again = F.when(F.expr("(x / 10) % 5 = 0"), F.struct((F.col("y") + 0.25).alias("y"), (F.col("x") + 2).alias("x"), F.lit(0.99).alias("conf")))
    both = frags.select("receipt_id", "text", F.explode(F.array_compact(F.array(F.struct("y", "x", "conf"), again))).alias("at"))
    return fr.dedup_fragments(both.select("receipt_id", "at.y", "at.x", "text", "at.conf"))
