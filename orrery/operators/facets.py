"""Facets of a filtered table and dictionaries of its categories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.ranking import global_rank


def facets(rows: DataFrame, of: Mapping[str, Column], top: int) -> DataFrame:
    """``(facet, value, n)``: the ``top`` values of each facet, counted in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(k).alias("facet"), c.cast("string").alias("value")) for k, c in of.items()])
    counts = rows.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))
    order = W.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= top).select("facet", "value", "n")


def dictionary_encode(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Rows with ``out``: the place of their category among all in order, from 0; -1 for null."""
    codes = rows.select(F.col(column).alias("__k")).filter("__k is not null").distinct()  # a row a category
    codes = global_rank(codes, [F.asc("__k")], out).withColumn(out, (F.col(out) - 1).cast("int"))
    joined = rows.join(codes, F.col(column) == F.col("__k"), "left").drop("__k")
    return joined.withColumn(out, F.coalesce(out, F.lit(-1)))
