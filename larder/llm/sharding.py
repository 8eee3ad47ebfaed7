"""Proportional stratified interleaving of sources into shards (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import bucket_starts, bucket_sums, within_bucket
from .shared import bucket16, null_safe, shuffle_key, written

SEED = 29


def shard_rows(docs: DataFrame, n_shards: int = 24, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard: each shard holds every source in proportion.

    Rows of a source are ranked by a seeded hash of doc_id; the fractional rank
    (rank - 1/2) / rows spreads each source evenly over 0 to 1; all rows are ranked by
    it (ties by source) and the row of global rank r goes to shard r * n_shards div rows.
    So shard sizes in rows differ by one at most: law ``rows``. Both rankings are
    distributed, see ranks.py; the text itself is not shuffled.

    Null text counts 8 bytes and the checksum of an empty text. Null source is a stratum.
    Repeated rows are separate rows, as are equal texts: with counts at most one apart a
    large group of copies can't stay in one shard. No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        null_safe(F.col("source")).alias("__group"), shuffle_key(seed, F.col("doc_id")).alias("__key"),
    ).withColumn("__bucket", bucket16(F.col("__key")))
    base = written(base, "shard-rows")  # the texts are read once
    starts = bucket_starts(bucket_sums(base, "__group", "__bucket", F.lit(1).cast("long")), "__group", "__bucket")
    ranked = base.withColumn("__in", within_bucket("__group", "__bucket", ["__key", "size", "text_crc32"], F.lit(1).cast("long")))
    ranked = ranked.join(starts, ["__group", "__bucket"])
    share = (2 * (F.col("before") + F.col("__in")) + 1).cast("double") / (2 * F.col("whole")).cast("double")
    spread = ranked.select("doc_id", "source", "size", "text_crc32", "__group", share.alias("__share"), F.lit(0).alias("__all"))
    spread = written(spread.withColumn("__slice", F.floor(F.col("__share") * 65536).cast("int")), "shard-ranks")
    starts = bucket_starts(bucket_sums(spread, "__all", "__slice", F.lit(1).cast("long")), "__all", "__slice")
    placed = spread.withColumn("__in", within_bucket("__all", "__slice", ["__share", "__group"], F.lit(1).cast("long")))
    placed = placed.join(starts, ["__all", "__slice"]).withColumn("__rank", F.col("before") + F.col("__in"))
    placed = placed.withColumn("__shard", F.expr(f"__rank * {n_shards}L div whole"))
    first = F.expr(f"(__shard * whole + {n_shards - 1}L) div {n_shards}L")
    return placed.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").cast("int").alias("shard"),
        (F.col("__rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
