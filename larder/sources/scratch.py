"""Intermediate tables of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new folder under spark.checkpoint.dir and read again, so that its lineage ends.

    Where the setting is missing, a session on one machine takes a folder of its own there; a cluster must name one.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="larder-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/larder-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
