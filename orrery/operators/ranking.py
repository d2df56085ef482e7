"""Ranks over a whole table without one task that sorts it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.storage import stage


def global_rank(rows: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Rows with ``out``: their place from 1 in ``order``; ranges are ranked apart, after what lies before them."""
    ranges = stage(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("__range").agg(F.count("*").alias("__n"))  # a row a partition
    before = counts.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    placed = ranges.withColumn(out, inside).join(before, "__range")
    return placed.withColumn(out, (F.col(out) + F.col("__before")).cast("long")).drop("__range", "__before")
