"""Filter specifications as predicates, and stable pages over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilterSpec:
    """What a search asks for; parts that are not set do not restrict."""

    equals: Mapping[str, object] = field(default_factory=dict)
    one_of: Mapping[str, Sequence[object]] = field(default_factory=dict)
    none_of: Mapping[str, Sequence[object]] = field(default_factory=dict)  # null is dropped, as NOT IN drops it
    at_least: Mapping[str, object] = field(default_factory=dict)
    at_most: Mapping[str, object] = field(default_factory=dict)
    contains: Mapping[tuple[str, ...], str] = field(default_factory=dict)  # in any of the columns, case aside
    has_tag: Mapping[str, str] = field(default_factory=dict)
    flags: Mapping[str, bool] = field(default_factory=dict)  # null counts as no

    def predicate(self) -> Column | None:
        parts = [F.col(c) == v for c, v in self.equals.items()]
        parts += [F.col(c).isin(*v) for c, v in self.one_of.items()]
        parts += [~F.col(c).isin(*v) for c, v in self.none_of.items()]
        parts += [F.col(c) >= v for c, v in self.at_least.items()]
        parts += [F.col(c) <= v for c, v in self.at_most.items()]
        parts += [reduce(or_, [F.coalesce(F.lower(c).contains(t.lower()), F.lit(False)) for c in cs]) for cs, t in self.contains.items()]
        parts += [F.array_contains(c, t) for c, t in self.has_tag.items()]
        parts += [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) == F.lit(v) for c, v in self.flags.items()]
        return reduce(and_, parts) if parts else None


def search(rows: DataFrame, spec: FilterSpec, empty_if_unset: bool = False) -> DataFrame:
    found = spec.predicate()
    if found is None:
        return rows.limit(0) if empty_if_unset else rows
    return rows.filter(found)


def flagged(rows: DataFrame, spec: FilterSpec, out: str = "matched") -> DataFrame:
    """All rows, with 1 where the specification fits."""
    found = spec.predicate()
    return rows.withColumn(out, F.lit(1) if found is None else F.when(found, 1).otherwise(0))


def page(rows: DataFrame, sort: str, allowed: Sequence[str], key: str, number: int, size: int, descending: bool = False) -> DataFrame:
    """Page ``number`` (from 1); nulls last, ties by ``key``. A sort column that is not allowed is an error."""
    if sort not in allowed:
        raise ValueError(f"cannot sort by {sort}")
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return rows.orderBy(order, key).offset((max(1, number) - 1) * size).limit(size)
