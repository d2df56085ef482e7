"""Queries that are plain SQL in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from orrery.queries.registry import query
from orrery.sources.tables import table

_NAME = re.compile(r"\{(\w+)\}")


def define(name: str, text: str, duck: str | None = None, **params: object) -> None:
    """Register SQL over tables named in braces; ``duck`` is its wording for the oracle where the dialects differ."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        frames = {t: table(spark, folder, t) for t in set(_NAME.findall(text))}
        return spark.sql(text, **frames)

    query(_NAME.sub(r"\1", duck or text), name)(run)


def letter_masks(a: str) -> str:
    """DuckDB: for each letter of ``a``, of 62 letters at most, a number whose bits are its places."""
    bits = f"list_transform(range(length({a})), lambda i: CASE WHEN {a}[i + 1] = letter THEN CAST(1 AS BIGINT) << i ELSE 0 END)"
    return f"map_from_entries(list_transform(list_distinct(string_split({a}, '')), lambda letter: {{'k': letter, 'v': CAST(coalesce(list_sum({bits}), 0) AS BIGINT)}}))"


def indel_sql(masks: str, a: str, b: str) -> str:
    """DuckDB: indel ratio of ``a``, whose ``letter_masks`` are ``masks``, and ``b``, to four digits; bits hold a row of the table."""
    full = f"((CAST(1 AS BIGINT) << length({a})) - 1)"
    hits = f"list_transform(string_split({b}, ''), lambda letter: coalesce({masks}[letter], 0))"
    last = f"list_reduce({hits}, lambda r, h: ((r + (r & h)) | (r - (r & h))) & {full}, {full})"
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE round(2.0 * (length({a}) - bit_count({last})) / (length({a}) + length({b})), 4) END::DOUBLE"
