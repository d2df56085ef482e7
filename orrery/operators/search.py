"""Prefix search by a scan of all texts; fulltext.py keeps an index for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import tokens


def prefix_search(rows: DataFrame, key: str, text: Column, words: str) -> DataFrame:
    """``key, hits`` of rows in which each query word begins some token; hits counts the matching tokens."""
    terms = [t for t in "".join(c if c.isalnum() else " " for c in words.lower()).split() if t]
    found = tokens(text)
    every = F.lit(bool(terms))
    hits = F.lit(0)
    for t in terms:
        every &= F.exists(found, _begins(t))
        hits = hits + F.size(F.filter(found, _begins(t)))
    return rows.filter(every).select(key, hits.cast("long").alias("hits"))


def _begins(prefix: str):
    return lambda word: word.startswith(prefix)
