"""Nearest rows on a line, from neighbours in order in place of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.storage import stage


def nearest_rows(rows: DataFrame, targets: DataFrame, one: tuple[str, str, str], other: tuple[str, str, str]) -> DataFrame:
    """Both keys and ``diff``, to two digits: for each row the target of its group with the least distance, ties by the target's key.

    ``one`` and ``other`` name key, group and value; row keys are unique.  Distinct values of targets lie in order beside the rows, so
    a row sees the nearest below and above it.  Rows whose distance to a further value rounds to the same number, and values
    that are not finite, are compared with all targets of their group.  Null distances come last.
    """
    (key, group, value), (t_key, t_group, t_value) = one, other
    x = rows.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(value).cast("double").alias("x")).filter("g is not null")
    y = targets.select(F.col(t_key).alias("t"), F.col(t_group).alias("g"), F.col(t_value).cast("double").alias("y")).filter("g is not null")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    points = y.filter(finite("y")).groupBy("g", "y").agg(F.min("t").alias("t"))
    line = W.partitionBy("g").orderBy("y")
    points = points.select("g", F.struct("t", "y", F.lag("y").over(line).alias("before"), F.lead("y").over(line).alias("after")).alias("p"), F.col("y").alias("at"))
    both = x.select("g", "k", F.col("x").alias("at"), F.lit(None).cast(points.schema["p"].dataType).alias("p")).unionByName(points.withColumn("k", F.lit(None).cast(x.schema["k"].dataType)))
    order = W.partitionBy("g").orderBy("at")  # equal values are peers, so both frames hold a target of the row's own value
    below = F.last("p", ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    above = F.last("p", ignorenulls=True).over(W.partitionBy("g").orderBy(F.desc("at")).rangeBetween(W.unboundedPreceding, W.currentRow))
    seen = both.withColumns({"low": below, "high": above}).filter("k is not null").withColumnRenamed("at", "x")
    d1, d2 = F.abs(F.col("x") - F.col("low.y")), F.abs(F.col("x") - F.col("high.y"))
    least = F.least(d1, d2)
    again = (F.abs(F.col("x") - F.col("low.before")) == least) | (F.abs(F.col("x") - F.col("high.after")) == least)
    plain = finite("x") & least.isNotNull() & (least < float("inf")) & ~F.coalesce(again, F.lit(False))
    t = F.least(F.when(d1 == least, F.col("low.t")), F.when(d2 == least, F.col("high.t")))
    seen = stage(seen.select("k", "g", "x", least.alias("d"), t.alias("t"), F.coalesce(plain, F.lit(False)).alias("plain")), "nearest")
    odd = seen.filter("not plain").select("k", "g", "x").join(y, "g").withColumn("d", F.abs(F.col("x") - F.col("y")))
    first = W.partitionBy("k").orderBy(F.asc_nulls_last("d"), "t")
    odd = odd.withColumn("pos", F.row_number().over(first)).filter("pos = 1").select("k", "t", "d")
    found = seen.filter("plain").select("k", "t", "d").unionByName(odd)
    return found.select(F.col("k").alias(key), F.col("t").alias(t_key), F.round("d", 2).alias("diff"))
