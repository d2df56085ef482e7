"""Exports and table dumps through Spark's writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns asked for; arrays as text joined by comma and space."""
    lists = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType)}
    return rows.select([F.array_join(c, ", ").alias(c) if c in lists else F.col(c) for c in columns])


def export_csv(rows: DataFrame, columns: Sequence[str], where: str) -> None:
    flat(rows, columns).write.mode("overwrite").option("header", True).csv(where)


def export_json_lines(rows: DataFrame, where: str, exported_at: str) -> None:
    """A record a line, each with the time of the export, which the caller gives."""
    rows.select(F.lit(exported_at).alias("exported_at"), F.struct(*rows.columns).alias("record")).write.mode("overwrite").json(where)


def dump(tables: Mapping[str, DataFrame], where: str) -> dict[str, int]:
    """Write every table below ``where``; rows written by table."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{where}/{name}")
    return {name: rows.sparkSession.read.parquet(f"{where}/{name}").count() for name, rows in tables.items()}


def restore(spark: SparkSession, where: str, counts: Mapping[str, int]) -> dict[str, DataFrame]:
    """Tables of a dump; an error if one has not the rows it should have."""
    found = {name: spark.read.parquet(f"{where}/{name}") for name in counts}
    for name, rows in found.items():
        if (n := rows.count()) != counts[name]:
            raise ValueError(f"{name} has {n} rows, not {counts[name]}")
    return found
