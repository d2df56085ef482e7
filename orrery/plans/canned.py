"""Named SQL with bound parameters, and extraction as a table function.

A canned query names its tables in braces and its parameters with a colon; values are
bound by Spark, never pasted into the text, and a missing or unknown one is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from orrery.sources.tables import table


@dataclass(frozen=True)
class Canned:
    title: str
    sql: str
    tables: tuple[str, ...]
    defaults: dict[str, Any]


_CELL = "split_part(p_name, ' ', 1) AS mechanism, p_brand AS sector"
CATALOGUE: dict[str, Canned] = {
    "launch-candidates": Canned(
        "small and cheap items, without the types named",
        "SELECT p_partkey, p_type, p_size FROM {part} WHERE p_size <= :size AND p_retailprice < :price AND NOT array_contains(split(:without, ','), p_type)",
        ("part",), {"size": 25, "price": 1200.0, "without": "ECONOMY,PROMO"},
    ),
    "cell": Canned(
        "items of one cell of the matrix",
        f"SELECT p_partkey, p_name, p_brand FROM (SELECT *, {_CELL} FROM {{part}}) WHERE mechanism = :mechanism AND sector = :sector",
        ("part",), {"mechanism": "almond", "sector": "Brand#11"},
    ),
    "sparse-cells": Canned(
        "cells with few items",
        f"SELECT mechanism, sector, count(*) AS n FROM (SELECT {_CELL} FROM {{part}}) GROUP BY mechanism, sector HAVING count(*) BETWEEN 1 AND :most",
        ("part",), {"most": 3},
    ),
    "cluster-members": Canned(
        "vectors of one cluster, as the table has them",
        "SELECT vec_id, label FROM {embeddings} WHERE label = :cluster_id",
        ("embeddings",), {"cluster_id": 3},
    ),
    "recent-by-day": Canned(
        "events a day and type since a day",
        "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM {events} WHERE ts >= CAST(:since AS TIMESTAMP) GROUP BY CAST(ts AS DATE), event_type",
        ("events",), {"since": "2024-01-20"},
    ),
}


def run_canned(spark: SparkSession, folder: str, name: str, **given: Any) -> DataFrame:
    """The rows of the canned query of that name; values not given are its defaults."""
    if name not in CATALOGUE:
        raise KeyError(f"no canned query {name!r}; there are {', '.join(sorted(CATALOGUE))}")
    one = CATALOGUE[name]
    if unknown := given.keys() - one.defaults.keys():
        raise TypeError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return spark.sql(one.sql, args=one.defaults | given, **{t: table(spark, folder, t) for t in one.tables})


@udtf(returnType="place int, amount double, unit string", useArrow=True)
class AmountMentions:
    """Amounts of a text in order: a number with its decimal mark, a multiplier and a currency sign or word."""

    def eval(self, text: str) -> Iterator[tuple[int, float, str]]:
        import re

        if not text:
            return
        pattern = re.compile(r"(?P<n>\d+(?:[.,]\d+)?) ?(?P<m>million(?:en)?|mio|mrd|milliarden|billion|m|k)?\b\.? ?(?P<c>euro|eur|dollar|usd)?", re.I)
        factor = {"k": 1e3, "m": 1e6, "mio": 1e6, "million": 1e6, "millionen": 1e6, "mrd": 1e9, "milliarden": 1e9, "billion": 1e9}
        for k, m in enumerate(pattern.finditer(text), 1):
            yield k, float(m["n"].replace(",", ".")) * factor.get((m["m"] or "").lower(), 1.0), (m["c"] or "").lower()


def register_functions(spark: SparkSession) -> None:
    """Extraction as a table function, for SQL: ``SELECT ... FROM t, LATERAL amount_mentions(t.text)``."""
    spark.udtf.register("amount_mentions", AmountMentions)
