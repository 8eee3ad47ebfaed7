"""Mixing sources to target weights by hash-random order and exact prefix cuts (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import bucket_starts, bucket_sums, within_bucket
from .shared import bucket16, null_safe, shuffle_key, word_count, written

WEIGHTS = (5, 2, 1)
SEED = 17


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """Each source's share of all sizes: a row per source, not per document.

    ``totals`` holds ``source`` and ``source_size``. Sources by code point, null last, weigh
    ``weights`` in turn. A target stops at ``max_epochs`` times its source's size; what
    is over goes to the others by weight until none is above. The sources that stop are
    those of least cap per weight, so one pass over that order finds the level.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    everything = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    t = t.withColumn("level", left.cast("double") / F.sum("weight").over(onward).cast("double"))
    t = t.withColumn("stops", F.col("cap").cast("double") <= F.col("level") * F.col("weight"))
    # past the first source that does not stop, what is left only gets less
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    share = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return t.select("source", "source_size", share.alias("target"))


def mix_sources(
    docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = SEED
) -> DataFrame:
    """``docs`` with size, source_size, target and taken: how many words of each row the mix takes.

    Rows of a source are sorted by a seeded hash of doc_id (equal keys by size, then by
    all columns), sizes are summed in that order by a distributed prefix sum (the sums of its
    buckets are written, so that ``docs`` is read once for them and once for the rows), and the
    source is cut at its exact budget, the whole number below its target. A budget above
    the source's size repeats it: ``taken`` is then the size for each full epoch plus
    the part of the last. The row at the cut gives only its first words.

    Null or empty text has size 0 and is never taken. Null source is a source of its own,
    the last. Null doc_id hashes as empty text. Repeated rows are separate rows. Input
    columns named like those added here are replaced. No rows give no rows.
    """
    size = word_count(F.col("text")) if size is None else size
    # all columns of docs travel as one, so that none can clash with those made here
    keyed = docs.select(F.struct("*").alias("row"), null_safe(F.col("source")).alias("group"), shuffle_key(seed, F.col("doc_id")).alias("key"), size.alias("size"))
    keyed = keyed.withColumn("bucket", bucket16(F.col("key")))
    fine = written(bucket_sums(keyed, "group", "bucket", F.col("size")), "mix-sums")
    starts = bucket_starts(fine, "group", "bucket")
    totals = fine.groupBy("group").agg(F.sum("fine").alias("source_size"))
    named = F.when(F.col("group") != "n", F.expr("substring(`group`, 2)"))
    targets = source_targets(totals.select(named.alias("source"), "source_size"), weights, max_epochs)
    targets = targets.select(null_safe(F.col("source")).alias("group"), "target")
    starts = starts.join(targets, "group").withColumnRenamed("whole", "source_size")
    plain = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    hashed = [F.col("row").getField(c) for c in plain if "map<" not in docs.schema[c].dataType.simpleString()]
    order = ["key", "size", *([F.xxhash64(*hashed)] if len(plain) > 3 else [])]
    rows = keyed.withColumn("inside", within_bucket("group", "bucket", order, F.col("size")))
    rows = rows.join(starts, ["group", "bucket"]).withColumn("budget", F.floor("target").cast("long"))
    rest = F.col("budget") - F.expr("budget div source_size") * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("before") - F.col("inside")))
    taken = F.when(F.col("source_size") > 0, F.expr("budget div source_size") * F.col("size") + part).otherwise(F.lit(0))
    kept = [F.col("row").getField(c).alias(c) for c in plain]
    return rows.select(*kept, "size", "source_size", "target", taken.cast("long").alias("taken"))


def expand_mix(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as documents: a row per repeat, the last of them cut to its first words where the budget ends.

    ``mixed`` comes from mix_sources and keeps text. Rows of no words are not in a mix, so null and empty texts go.
    Repeated rows are repeated as often as each is taken; n_chars, where it is asked for, counts the new text. Other
    ``columns`` come back as they are, whatever their names. No rows give no rows.
    """
    taken = mixed.where((F.col("size") > 0) & (F.col("taken") > 0))
    rows = taken.select(F.struct(*[F.col(c) for c in columns if c != "text"], F.lit(True).alias("__")).alias("row"), "text", "size", "taken")
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(1L, taken div size + if(taken % size > 0, 1L, 0L))")))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.expr("taken % size").cast("int")), "")
    rows = rows.select("row", F.when(F.col("copy") > F.expr("taken div size"), head).otherwise(F.col("text")).alias("text"))
    made = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return rows.select(*[made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in columns])


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) as expand_mix of mix_sources gives them, with all their columns and no others.

    Columns that are named like results of mix_sources, or like anything inside, keep their values.
    """
    own = [c for c in docs.columns if c not in ("doc_id", "text", "source", "n_chars")]
    plain = [c for c in docs.columns if c not in own]
    held = [F.struct(*own).alias("held")] if own else []
    mixed = expand_mix(mix_sources(docs.select(*plain, *held)), [*plain, *(["held"] if own else [])])
    return mixed.select(*[F.col("held").getField(c).alias(c) if c in own else F.col(c) for c in docs.columns])
