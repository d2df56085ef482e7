"""Field-level differences between two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``*keys, change, field, old_value, new_value``: a row a field whose value differs, and one a row that came or went.

    Fields are compared null-safe, each in its own type (NaN equals NaN, 0.0 equals -0.0), and shown as text.  An added or
    removed row has no field.  Versions are joined once on their keys, which are unique and not null in each; rows that are
    alike leave before any field is unpivoted.
    """
    a = old.select(*keys, F.struct(*fields).alias("__a"))
    b = new.select(*keys, F.struct(*fields).alias("__b"))
    both = a.join(b, list(keys), "full").filter(~F.col("__a").eqNullSafe(F.col("__b")))
    none = F.lit(None).cast("string")

    def entry(change: str, field, before, after):
        return F.struct(F.lit(change).alias("change"), field.alias("field"), before.alias("old_value"), after.alias("new_value"))

    changed = [
        F.when(~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), entry("changed", F.lit(f), F.col(f"__a.{f}").cast("string"), F.col(f"__b.{f}").cast("string")))
        for f in fields
    ]
    found = F.when(F.col("__a").isNull(), F.array(entry("added", none, none, none))).when(F.col("__b").isNull(), F.array(entry("removed", none, none, none)))
    return both.select(*keys, F.explode(found.otherwise(F.array_compact(F.array(*changed)))).alias("__c")).select(*keys, "__c.*")


def apply_changes(history: DataFrame, changes: DataFrame, at) -> DataFrame:
    """The history with the changes of the version ``at``; a version that is recorded already is not recorded twice."""
    fresh = changes.withColumn("version", F.lit(at))
    return history.filter(F.col("version") != at).unionByName(fresh.select(*history.columns))
