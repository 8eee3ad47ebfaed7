"""Connected components of a table of edges, by hooking and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the least node it reaches, for every node of ``edges`` (a, b: long).

    Each round points every node at its least neighbour, shortens the pointers until they
    rest, and keeps the edges between different ends. Nothing but counts reaches the driver.
    """
    edges = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while not edges.isEmpty():
        up = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "pointers")
        while True:
            further = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = written(up.join(further, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "pointers")
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        up = up.drop("moved")
        labels = written(labels.join(up.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        for end in ("a", "b"):
            moved = up.select(F.col("node").alias(end), F.col("up").alias("to"))
            edges = edges.join(moved, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return labels
