"""New receipt files as a stream: each is adapted once and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.receipts import normalize_receipts
from ..sources.readers import RECEIPT


def receipt_stream(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.readStream.schema(RECEIPT + ", _corrupt_record string").option("multiLine", True).json(folder)
    return rows.withColumn("source_file", F.col("_metadata.file_path")).where("_corrupt_record is null").drop("_corrupt_record")


def append_receipts(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Normalised receipts of new files in ``folder`` to the Parquet table, a folder ``batch`` each.

    The checkpoint knows which files were read, and a batch that runs again, after a failure, gets its old number and replaces
    its own folder. So nothing is added twice, and a batch reads its own files only. ``checkpoint`` and ``table`` belong
    together: a new checkpoint needs a new table.
    """

    def add(batch: DataFrame, number: int) -> None:
        normalize_receipts(batch).write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")

    writer = receipt_stream(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
