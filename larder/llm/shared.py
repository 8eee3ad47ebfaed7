"""Where intermediate tables go, and small expressions that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a session on one machine gets a folder of its own there; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="larder-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` cut from its lineage: written as Parquet to the shared folder and read again.

    A lost executor then costs a reread of files, and every reader sees the same rows. The tables of an
    application lie in one folder of its name, which can be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larder-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words as long; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: int, doc_id: Column) -> Column:
    """A hash-random hex key of an id; SQL engines with md5 give the same one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def bucket16(hex_key: Column) -> Column:
    """The first 16 bits of a hex key, 0 to 65535; it follows the key's order."""
    return F.conv(F.substring(hex_key, 1, 4), 16, 10).cast("int")


def share_of(hex_key: Column) -> Column:
    """A hex key as a number from 0 to 1."""
    return F.conv(F.substring(hex_key, 1, 12), 16, 10).cast("double") / float(1 << 48)


def null_safe(name: Column) -> Column:
    """A text that stands for a nullable name, so that null is a group of its own in joins."""
    return F.when(name.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), name.cast("string")))
