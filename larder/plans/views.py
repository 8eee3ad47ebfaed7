"""Views that give the star-schema tables the shape of receipts, catalogs and signals.

Each is one SQL text that Spark and other SQL engines read alike; other views and tables
are named in braces. Money is made from whole cents and signals from binary fractions, so
that sums do not depend on their order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents labels pages conversations".split()

VIEWS = {
    "numbered": """
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "daily_items": """
SELECT user_id, CAST(ts AS DATE) AS date, event_type AS category, CAST(round(value * 100) AS BIGINT) AS cents,
       CAST(round(value * 100) AS BIGINT) * CAST(0.25 AS DOUBLE) AS calories, CAST(round(value * 100) AS BIGINT) * CAST(0.0078125 AS DOUBLE) AS protein_g,
       CAST(round(value * 100) AS BIGINT) * CAST(0.03125 AS DOUBLE) AS carbs_g, CAST(round(value * 100) AS BIGINT) * CAST(0.015625 AS DOUBLE) AS fat_g,
       CAST(round(value * 100) AS BIGINT) * CAST(0.00390625 AS DOUBLE) AS fiber_g
FROM {events}""",
    "products": """
SELECT p_partkey AS code, p_name AS product_name, p_brand AS brands,
       CASE p_partkey % 8 WHEN 0 THEN concat(p_size, 'oz') WHEN 1 THEN concat(p_size, ' lbs') WHEN 2 THEN concat(p_size * 10, ' g') WHEN 3 THEN concat(p_size, ',5 kg')
            WHEN 4 THEN concat(p_size * 10, ' ml') WHEN 5 THEN concat('0', ' g') WHEN 6 THEN '' ELSE concat(p_size, ' fl oz') END AS quantity,
       CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(CASE p_type WHEN 'ECONOMY' THEN 'en:cookies' WHEN 'PROMO' THEN 'en:crisps' WHEN 'LARGE' THEN 'en:cheeses'
            WHEN 'STANDARD' THEN 'en:milks' WHEN 'MEDIUM' THEN 'en:breads' ELSE 'fr:pains' END, CASE WHEN p_partkey % 5 = 0 THEN ', en:biscuits' ELSE '' END) END AS categories,
       CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 9 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(p_size * 10 AS DOUBLE) END AS energy_kcal,
       CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 9 = 1 THEN CAST(0 AS DOUBLE) ELSE p_size * CAST(0.25 AS DOUBLE) END AS fat,
       CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 9 = 1 THEN CAST(0 AS DOUBLE) ELSE p_size * CAST(0.5 AS DOUBLE) END AS carbohydrates,
       CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 9 = 1 THEN CAST(0 AS DOUBLE) ELSE p_size * CAST(0.125 AS DOUBLE) END AS proteins
FROM {part}""",
    "names": """
SELECT doc_id AS code, replace(text, chr(10), ' ') AS product_name, concat(n_chars % 40, CASE n_chars % 4 WHEN 0 THEN ' kg' WHEN 1 THEN ' g' WHEN 2 THEN ' oz' ELSE ' pieces' END) AS quantity
FROM {documents}
UNION ALL
SELECT 1000000000 + page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'AB' WHEN 2 THEN concat(page_id, '% Nature') WHEN 3 THEN concat(page_id, '-', page_id) WHEN 4 THEN url ELSE concat('Сок ', page_id) END,
       CASE WHEN page_id % 5 = 0 THEN NULL ELSE concat(page_id % 60, 'lb') END
FROM {pages}""",
    "food": "SELECT p_partkey AS fdc_id, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE concat(p_name, ' ') END AS description, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS food_category_id FROM {part}",
    "food_nutrient": """
SELECT p_partkey AS fdc_id, CASE k WHEN 1 THEN 1008 WHEN 2 THEN 1004 WHEN 3 THEN 1258 WHEN 4 THEN 1005 WHEN 5 THEN CASE WHEN p_partkey % 3 = 0 THEN 2000 ELSE 1063 END
            WHEN 6 THEN 1079 WHEN 7 THEN 1003 WHEN 8 THEN 1093 WHEN 9 THEN 1008 ELSE 9999 END AS nutrient_id,
       CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN (p_partkey + k) % 10 = 0 THEN 'n/a' ELSE CAST(p_size * k AS STRING) END AS amount, k AS row_ord
FROM {part} CROSS JOIN (SELECT CAST(l_linenumber AS INT) AS k FROM {lineitem} GROUP BY l_linenumber UNION SELECT 8 UNION SELECT 9 UNION SELECT 10) ks""",
    "food_category": "SELECT p_type AS id, concat('category ', lower(p_type)) AS description FROM {part} WHERE p_type <> 'PROMO' GROUP BY p_type",
    "food_portion": "SELECT l_partkey AS fdc_id, CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN n = 2 THEN 'x' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS gram_weight, l_orderkey * 1000 + n AS row_ord FROM {numbered}",
    "receipts": """
SELECT o_orderkey AS receipt_no, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE n_name END AS store,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) / CAST(100 AS DOUBLE) END AS total_price
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "receipt_items": """
SELECT l_orderkey AS receipt_no, CAST(n AS INT) AS pos, CASE WHEN n % 4 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN n % 5 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS qty,
       CASE WHEN n % 3 = 0 THEN NULL ELSE CAST(round(l_extendedprice * 100) AS BIGINT) / CAST(100 AS DOUBLE) END AS line_price, p_type AS category,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE l_quantity * CAST(4 AS DOUBLE) END AS calories, CASE WHEN p_partkey % 6 = 1 THEN NULL ELSE l_quantity * CAST(0.5 AS DOUBLE) END AS protein_g,
       CASE WHEN p_partkey % 6 = 1 THEN NULL ELSE l_quantity * CAST(0.25 AS DOUBLE) END AS carbs_g, CASE WHEN p_partkey % 6 = 1 THEN NULL ELSE l_quantity * CAST(0.125 AS DOUBLE) END AS fat_g,
       CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE l_quantity * CAST(0.0625 AS DOUBLE) END AS fiber_g
FROM {numbered}""",
    "searches": """
SELECT p_partkey AS search_id, CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('organic ', p_name) WHEN 2 THEN substr(p_name, 1, 6) WHEN 3 THEN concat('my fine ', p_name) WHEN 4 THEN concat(p_name, ' extra') ELSE p_name END AS name,
       p_brand AS store FROM {part}""",
    "goods": """
SELECT code, CASE code % 4 WHEN 0 THEN concat(product_name, ' milk') WHEN 1 THEN concat(product_name, ' chicken breast') ELSE product_name END AS product_name,
       quantity, energy_kcal, fat, carbohydrates, proteins
FROM {products}""",
    "wanted": """
SELECT p_partkey AS search_id, CASE p_partkey % 9 WHEN 0 THEN concat(p_name, ' milk') WHEN 1 THEN concat('my fine ', p_name) WHEN 2 THEN p_name WHEN 3 THEN concat('eggs ', substr(p_name, 1, 1))
            WHEN 4 THEN concat('milk ', p_name) WHEN 5 THEN upper(concat(p_name, ' chicken breast')) WHEN 6 THEN concat('nothing ', p_partkey) WHEN 7 THEN concat('chicken breast fine ', p_name) ELSE concat(p_name, 's milk') END AS name,
       CASE WHEN p_partkey % 11 = 0 THEN 'apple juice' ELSE '' END AS resolved_name, CAST(p_partkey % 3 + 1 AS INT) AS qty,
       CASE WHEN p_partkey % 5 = 0 THEN CAST(12 AS DOUBLE) END AS own_value, CASE WHEN p_partkey % 5 = 0 THEN 'receipt' WHEN p_partkey % 7 = 0 THEN 'nonfood' ELSE '' END AS given_source
FROM {part}""",
    "receipt_lines": """
SELECT receipt_id, line_no, text FROM (
  SELECT l_orderkey AS receipt_id, CAST(n * 10 AS INT) AS line_no,
         concat(upper(p_name), CASE WHEN n % 5 = 4 THEN concat(' ', CAST(p_size AS STRING), ' oz') ELSE '' END, CASE WHEN n % 6 = 5 THEN '' ELSE concat(' ', CAST(CAST(floor(c / 100) AS BIGINT) AS STRING), '.', lpad(CAST(c % 100 AS STRING), 2, '0')) END, CASE WHEN n % 7 = 3 THEN ' -' ELSE '' END) AS text
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM {numbered}) i
  UNION ALL SELECT l_orderkey, CAST(n * 10 + 1 AS INT), concat(CAST(CAST(l_quantity AS INT) AS STRING), CASE WHEN n % 2 = 0 THEN ' EA @ $1.99' ELSE ' DZ @ $12.49' END) FROM {numbered} WHERE n % 3 = 1
  UNION ALL SELECT l_orderkey, CAST(n * 10 + 2 AS INT), concat(CAST(CAST(l_quantity AS INT) AS STRING), '.25 lb @ $3.99/lb') FROM {numbered} WHERE n % 4 = 2
  UNION ALL SELECT l_orderkey, CAST(n * 10 + 3 AS INT), 'GROCERY' FROM {numbered} WHERE n % 5 = 1
  UNION ALL SELECT o_orderkey, 0, CASE o_orderkey % 4 WHEN 0 THEN 'WALMART SUPERCENTER' WHEN 1 THEN 'Trader Joe''s #512' WHEN 2 THEN 'corner shop' ELSE 'COSTCO WHOLESALE' END FROM {orders}
  UNION ALL SELECT o_orderkey, 1, CASE o_orderkey % 3 WHEN 0 THEN concat('DATE: ', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING)) WHEN 1 THEN concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', substr(CAST(year(o_orderdate) AS STRING), 3, 2), ' 10:15 AM') ELSE '123 Main St' END FROM {orders}
  UNION ALL SELECT o_orderkey, 2, CASE o_orderkey % 3 WHEN 0 THEN 'HOME' ELSE 'PRODUCE' END FROM {orders} WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 900, concat('SUBTOTAL $', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.10') FROM {orders}
  UNION ALL SELECT o_orderkey, 901, 'TAX 8.5% $1.00 $2.35' FROM {orders} WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT o_orderkey, 902, concat('TOTAL $', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ',99') FROM {orders}
  UNION ALL SELECT o_orderkey, 903, 'Thank you for shopping' FROM {orders}
  UNION ALL SELECT o_orderkey, 904, 'VISA ************1234' FROM {orders} WHERE o_orderkey % 3 = 0) u""",
}

#: A view's text for Spark where it gives the same rows with less work: here an order and each of its lines become their
#: receipt lines in one pass over both tables, dealt by receipt once, where the union above numbers all lines four times.
FASTER = {
    "receipt_lines": """
SELECT receipt_id, l.line_no, l.text FROM (
  SELECT receipt_id, explode(CASE WHEN is_order THEN array(
      named_struct('line_no', 0, 'text', CASE receipt_id % 4 WHEN 0 THEN 'WALMART SUPERCENTER' WHEN 1 THEN 'Trader Joe''s #512' WHEN 2 THEN 'corner shop' ELSE 'COSTCO WHOLESALE' END),
      named_struct('line_no', 1, 'text', CASE receipt_id % 3 WHEN 0 THEN concat('DATE: ', lpad(CAST(month(date) AS STRING), 2, '0'), '/', lpad(CAST(day(date) AS STRING), 2, '0'), '/', CAST(year(date) AS STRING)) WHEN 1 THEN concat(CAST(month(date) AS STRING), '/', CAST(day(date) AS STRING), '/', substr(CAST(year(date) AS STRING), 3, 2), ' 10:15 AM') ELSE '123 Main St' END),
      CASE WHEN receipt_id % 2 = 0 THEN named_struct('line_no', 2, 'text', CASE receipt_id % 3 WHEN 0 THEN 'HOME' ELSE 'PRODUCE' END) END,
      named_struct('line_no', 900, 'text', concat('SUBTOTAL $', total, '.10')),
      CASE WHEN receipt_id % 5 <> 0 THEN named_struct('line_no', 901, 'text', 'TAX 8.5% $1.00 $2.35') END,
      named_struct('line_no', 902, 'text', concat('TOTAL $', total, ',99')),
      named_struct('line_no', 903, 'text', 'Thank you for shopping'),
      CASE WHEN receipt_id % 3 = 0 THEN named_struct('line_no', 904, 'text', 'VISA ************1234') END)
    ELSE array(
      named_struct('line_no', CAST(n * 10 AS INT), 'text', concat(upper(p_name), CASE WHEN n % 5 = 4 THEN concat(' ', CAST(p_size AS STRING), ' oz') ELSE '' END, CASE WHEN n % 6 = 5 THEN '' ELSE concat(' ', CAST(CAST(floor(c / 100) AS BIGINT) AS STRING), '.', lpad(CAST(c % 100 AS STRING), 2, '0')) END, CASE WHEN n % 7 = 3 THEN ' -' ELSE '' END)),
      CASE WHEN n % 3 = 1 THEN named_struct('line_no', CAST(n * 10 + 1 AS INT), 'text', concat(CAST(CAST(l_quantity AS INT) AS STRING), CASE WHEN n % 2 = 0 THEN ' EA @ $1.99' ELSE ' DZ @ $12.49' END)) END,
      CASE WHEN n % 4 = 2 THEN named_struct('line_no', CAST(n * 10 + 2 AS INT), 'text', concat(CAST(CAST(l_quantity AS INT) AS STRING), '.25 lb @ $3.99/lb')) END,
      CASE WHEN n % 5 = 1 THEN named_struct('line_no', CAST(n * 10 + 3 AS INT), 'text', 'GROCERY') END) END) AS l
  FROM (
    SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY receipt_id ORDER BY is_order, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n
    FROM (
      SELECT l_orderkey AS receipt_id, false AS is_order, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, p_name, p_size, NULL AS date, NULL AS total FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
      UNION ALL
      SELECT o_orderkey, true, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, o_orderdate, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) FROM {orders}) r) m) e WHERE l IS NOT NULL""",
}


def plain_sql(text: str) -> str:
    """The SQL with every view in braces written out, for an engine that knows only the tables."""

    def expand(m: re.Match) -> str:
        if m[1] in TABLES:
            return m[1]
        return f"({plain_sql(VIEWS[m[1]])})" if m[1] in VIEWS else m[0]

    text = re.sub(r"(FROM|JOIN|,)(\s+)\{(\w+)\}(?!\s+(?:AS\s+)?(?!ON\b|JOIN\b|CROSS\b|WHERE\b|GROUP\b|UNION\b|USING\b|ORDER\b|LEFT\b|LIMIT\b)[a-z]\w*)", lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" + ("" if m[3] in TABLES else f" {m[3]}"), text)
    return re.sub(r"\{(\w+)\}", expand, text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables, of ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FASTER.get(name, VIEWS[name])
    used = {n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **used)
