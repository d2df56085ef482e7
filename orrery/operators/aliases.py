"""Raw tags to a vocabulary: exact, fuzzy, invented or dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.similarity import fuzzy_join, token_sort
from orrery.storage import stage

PLACEHOLDERS = ("unknown", "n-a", "na", "none", "null")  # fixed values: tags that say nothing


def canonical_tag(raw: Column, placeholders: Sequence[str] = PLACEHOLDERS) -> Column:
    """Lower-case letters and digits, one hyphen for whatever lies between; null for nothing and for placeholders."""
    kebab = F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.when((kebab != "") & ~kebab.isin(*placeholders), kebab)


def tag_aliases(raw: DataFrame, vocabulary: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``raw, canonical, score, method, occurrences`` of each row ``raw, occurrences``, which is once there.

    A canonical form that ``vocabulary`` (``canonical``) holds is exact; else the most alike of it with sorted words, ties by name,
    is fuzzy from ``threshold`` on; else the form stays as an invented tag.  Tags without a form, nulls too, are dropped.
    """
    forms = stage(raw.select("raw", "occurrences", canonical_tag(F.col("raw")).alias("form")), "forms")
    words = vocabulary.select("canonical").filter("canonical is not null").distinct()
    known = words.select(F.col("canonical").alias("form"), F.lit(True).alias("exact"))
    sort = lambda c: token_sort(F.translate(c, "-", " "))
    others = forms.select("form").filter("form is not null").distinct().join(known, "form", "left_anti").withColumn("x", sort(F.col("form")))
    near = fuzzy_join(others, words.withColumn("y", sort(F.col("canonical"))), "x", "y", [], threshold, 1, ["form", "canonical"])
    found = forms.join(known, "form", "left").join(near.select("form", F.col("canonical").alias("near"), "similarity"), "form", "left")
    method = F.when(F.col("form").isNull(), "dropped").when(F.col("exact"), "exact").when(F.col("near").isNotNull(), "fuzzy").otherwise("invented")
    score = F.when(F.col("exact"), 1.0).otherwise(F.coalesce("similarity", F.lit(0.0)))
    return found.select("raw", F.coalesce("near", "form").alias("canonical"), score.alias("score"), method.alias("method"), "occurrences")
