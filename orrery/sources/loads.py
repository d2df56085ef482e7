"""Loads that count while they write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed_load(rows: DataFrame, keep: Column, key: str, where: str, metrics: Mapping[str, Column]) -> dict[str, object]:
    """Write the rows that ``keep`` holds for, one of each key, and return what the load saw.

    ``read``, ``kept``, ``written`` and the given aggregates of written rows are observed on the very plan that is written: the
    input is read once, and no second job counts it.
    """
    seen, out = Observation("read"), Observation("written")
    marked = rows.withColumn("__keep", F.coalesce(keep, F.lit(False))).observe(seen, F.count(F.lit(1)).alias("read"), F.count_if("__keep").alias("kept"))
    unique = marked.filter("__keep").drop("__keep").dropDuplicates([key])
    unique.observe(out, F.count(F.lit(1)).alias("written"), *[c.alias(n) for n, c in metrics.items()]).write.parquet(where)
    return {**seen.get, **out.get}
