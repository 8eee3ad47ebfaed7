"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .fingerprints import fingerprint_documents
from .htmltext import extract_pages
from .langid import identify_languages, learn_dictionaries
from .lexical import search
from .mixing import SEED, mix_sources
from .neardup import near_duplicates
from .packing import pack_documents
from .pii import find_personal_data
from .quality import THRESHOLD, score_quality, train_quality
from .shared import WORD, documents, word_count, written
from .sharding import SEED as SHARD_SEED
from .sharding import shard_rows
from .vectordup import near_vectors
from .wordruns import word_runs


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sources(written(docs, "mix-sizes"), F.col("size"))  # the texts are read once
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def crc_fold(modulus: int) -> Column:
    """The checksum of doc_id as text, modulo; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op3_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(crc_fold(5) == 0, F.lit(False))
    model = train_quality(docs, labels.where(~held_out))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_fold(3) == 1, F.lit(False))
    found = identify_languages(docs, learn_dictionaries(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op5_shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir)).drop("source")


def op6_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_key")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the checksum h of doc_id is divisible by 10, the words from the a-th on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n = F.size("words").cast("long")
    held = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    held = held.select("*", F.when(n > 0, F.expr("floor(h / 10) % size(words)")).alias("a"), n.alias("n"))
    held = held.withColumn("p", F.expr("1 + (n - a) div (3 + floor(h / 10) % 8)"))
    again = F.array_join(F.expr("transform(sequence(0L, n - 1L), i -> words[int(if(i < a, i, a + (i - a) % p))])"), " ")
    return held.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op11_repair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(with_planted_runs(documents(spark, sf_dir)))
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))")
    found = found.withColumns({"n_runs": F.size("runs").cast("long"), "best": longest, "listed": lines})
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_order_minhash": op2_order_minhash,
    "op3_quality_nbsvm": op3_quality_nbsvm,
    "op4_pack_sequences": op4_pack_sequences,
    "op5_shard_interleave": op5_shard_interleave,
    "op6_ivfpq_search": op6_ivfpq_search,
    "op8_pii_spans": op8_pii_spans,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op9_html_text": op9_html_text,
    "op10_language_id": op10_language_id,
    "op11_repair_runs": op11_repair_runs,
    "op12_hyperplane_dedup": op12_hyperplane_dedup,
    "op13_lexical_search": op13_lexical_search,
}


def _nibble_table() -> str:
    """The 16 steps of the checksum of reversed polynomial 0xEDB88320 over half a byte, as an SQL list."""
    table = list(range(16))
    for _ in range(4):
        table = [(c >> 1) ^ (0xEDB88320 * (c & 1)) for c in table]
    return f"({table}::BIGINT[])"


_HALF = f"xor(xor(c, x) >> 4, {_nibble_table()}[(xor(c, x) & 15) + 1])"

ORACLE_SQL = {
    "op5_shard_interleave": f"""
WITH b AS (
  SELECT doc_id, source, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS stratum, (len(bytes) + 8)::BIGINT AS size, md5('{SHARD_SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes),
           lambda c, x: xor({_HALF} >> 4, {_nibble_table()}[({_HALF} & 15) + 1]))) AS text_crc32
  FROM b),
r AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY k, size, text_crc32) - 1)::DOUBLE
         / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS share
  FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY share, stratum) - 1 AS place, count(*) OVER () AS rows_ FROM r),
h AS (SELECT *, place * 24 // rows_ AS shard_ FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard_::INTEGER AS shard, (place - (shard_ * rows_ + 23) // 24)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM h""",
    # all pairs that share a shingle, by an inverted list; equal sets are one node
    "op7_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN coalesce(len(words), 0) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_sort(list_distinct(list_transform(list_zip(words, words[2:], words[3:], words[4:], words[5:], true),
              lambda x: concat_ws(' ', x[1], x[2], x[3], x[4], x[5])))) END AS shingles
  FROM w),
k AS (SELECT doc_id, len(shingles)::BIGINT AS n, md5(array_to_string(shingles, chr(10))) AS same, shingles FROM s),
g AS (
  SELECT same, min(doc_id) AS node, any_value(n) AS n, any_value(shingles) AS shingles
  FROM k WHERE n > 0 AND doc_id IS NOT NULL GROUP BY same),
f AS (SELECT node, n, unnest(shingles) AS shingle FROM g),
l AS (
  SELECT a.node AS a, b.node AS b
  FROM f a JOIN f b ON a.shingle = b.shingle AND a.node < b.node AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node, node AS reached FROM g UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT node, min(reached) AS comp FROM r GROUP BY node),
o AS (
  SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.n > 0 AND k.doc_id IS NOT NULL THEN c.comp ELSE k.doc_id END AS component_id
  FROM k LEFT JOIN g ON k.same = g.same AND k.n > 0 LEFT JOIN c ON g.node = c.node)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o""",
    "op1_mix_sources": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
         / (sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w),
t AS (
  SELECT source, source_size, CASE WHEN cap::DOUBLE <= level * weight THEN cap::DOUBLE
         ELSE (max(CASE WHEN cap::DOUBLE > level * weight THEN level END) OVER ()) * weight END AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
             + least(size, greatest(0, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM r""",
    # every pair of vectors; components by recursion
    "op12_hyperplane_dedup": """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.e AS e FROM v a JOIN v b ON len(a.e) = len(b.e) AND (a.vec_id <> b.vec_id OR a.e <> b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS comp FROM r GROUP BY vec_id),
n AS (SELECT a, e, count(*) AS n FROM l GROUP BY a, e)
SELECT o.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.comp, o.vec_id) AS component_id,
       o.vec_id IS NOT DISTINCT FROM coalesce(c.comp, o.vec_id) AS kept
FROM embeddings o LEFT JOIN c ON o.vec_id = c.vec_id LEFT JOIN n ON o.vec_id = n.a AND o.embedding::DOUBLE[] = n.e""",
    "op13_lexical_search": r"""
WITH t AS (
  SELECT row_number() OVER () AS row_, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM t WHERE len(terms) > 0),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE item_id IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term),
u AS (SELECT row_, unnest(terms) AS term FROM t),
f AS (SELECT row_, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY row_, term),
w AS (SELECT term, floor(1000 * ln((2 * s.docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f CROSS JOIN s GROUP BY term, s.docs),
m AS (SELECT row_, doc_id, 25 + (75 * len(terms) * s.docs) // s.total AS m FROM t CROSS JOIN s WHERE len(terms) > 0),
g AS (
  SELECT q.item_id, m.row_, m.doc_id, sum(q.times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m)))::BIGINT AS score
  FROM f JOIN w ON f.term = w.term JOIN m ON f.row_ = m.row_ JOIN q ON f.term = q.term GROUP BY q.item_id, m.row_, m.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS place FROM g WHERE score > 0)
SELECT item_id, place::INTEGER AS "rank", doc_id, score FROM o WHERE place <= 10""",
}
