"""Lexicons as data, and their scores as column expressions.

Whole words and phrases are looked for by patterns that begin with the keyword's own letters, so that the
engine passes by most places of a text at the cost of one comparison; what stands before is looked at afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a word, lower case.
LETTERS = "0-9a-zäöüßàâçéèêëîïôûùñóíúáœ_"


@dataclass(frozen=True)
class Lexicon:
    """Keywords, those of them that count twice, and groups of patterns that count twice as a group."""

    keywords: Sequence[str]
    strong: Sequence[str] = ()
    groups: Mapping[str, Sequence[str]] = field(default_factory=dict)


def spaced(text: Column) -> Column:
    """Lower-cased words with one space around each; null and empty text give one space."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{LETTERS}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def word_pattern(keyword: str) -> str:
    """A pattern of the keyword as a whole word, or as whole words with anything but letters between."""
    first, *more = (rf"\Q{w}\E" for w in keyword.split(" "))
    return rf"{first}(?<![{LETTERS}]{first})" + "".join(f"[^{LETTERS}]+{w}" for w in more) + f"(?![{LETTERS}])"


def has_word(words: Column, keyword: str) -> Column:
    """Whether the keyword, of one word or several, stands in lower-cased text (or in ``spaced`` words)."""
    return F.coalesce(words.rlike(word_pattern(keyword)), F.lit(False))


#: One word between what is no letter, as lists of patterns write it.
_ONE_WORD = re.compile(rf"\(\^\|\[\^{re.escape(LETTERS)}\]\)([{LETTERS}]+)\(\$\|\[\^{re.escape(LETTERS)}\]\)")


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns is found in the lower-cased text."""
    if not patterns:
        return F.lit(False)
    quick = [word_pattern(m[1]) if (m := _ONE_WORD.fullmatch(p)) else p for p in patterns]
    return F.coalesce(F.lower(text).rlike("|".join(f"(?:{p})" for p in quick)), F.lit(False))  # one pass for all


def total(parts: Sequence[Column]) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + p
    return out


def relevance(text: Column, words: Column, lexicon: Lexicon) -> Column:
    """1 a keyword, 1 more if it is strong, 2 a group of patterns."""
    parts = [has_word(words, k).cast("int") * (2 if k in lexicon.strong else 1) for k in lexicon.keywords]
    return total(parts + [any_pattern(text, p).cast("int") * 2 for p in lexicon.groups.values()])


def matched(text: Column, words: Column, lexicon: Lexicon, mark: str = "") -> Column:
    """Keywords found, in the lexicon's order, then the groups' labels in brackets."""
    found = [F.when(has_word(words, k), f"{mark}{k}") for k in lexicon.keywords]
    found += [F.when(any_pattern(text, p), f"[{label}]") for label, p in lexicon.groups.items()]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def categories(text: Column, words: Column, of: Mapping[str, Sequence[str]], short: int = 4) -> Column:
    """Categories with a keyword in the text: keywords of up to ``short`` characters as whole words, longer ones anywhere."""
    low = F.lower(text)
    found = []
    for label, keywords in of.items():
        hit = F.lit(False)
        for k in keywords:
            hit = hit | (has_word(words, k) if len(k) <= short else low.contains(k))
        found.append(F.when(F.coalesce(hit, F.lit(False)), F.lit(label)))
    return F.array_compact(F.array(*found))


def read_lexicon(spark: SparkSession, where: str) -> DataFrame:
    """``(category, keyword, priority)`` of JSON lines with ``category, priority, keywords`` and ``exclude``.

    A keyword of several categories belongs to that of the least priority, then the first by name; a keyword that any
    category excludes belongs to none.  A missing priority is 2.
    """
    rows = spark.read.schema("category string, priority int, keywords array<string>, exclude array<string>").json(where)
    words = rows.select("category", F.coalesce("priority", F.lit(2)).alias("priority"), F.explode("keywords").alias("keyword"))
    words = words.withColumn("keyword", F.lower(F.trim("keyword"))).filter("keyword <> ''")
    banned = rows.select(F.explode("exclude").alias("keyword")).select(F.lower(F.trim("keyword")).alias("keyword")).distinct()
    best = words.join(banned, "keyword", "left_anti").groupBy("keyword").agg(F.min(F.struct("priority", "category")).alias("m"))
    return best.select("m.category", "keyword", "m.priority")


def from_table(rows: DataFrame) -> dict[str, list[str]]:
    """A lexicon table as keywords by category, for expressions; as large as the lexicon, never as the corpus."""
    found: dict[str, list[str]] = {}
    for r in rows.orderBy("priority", "category", "keyword").collect():
        found.setdefault(r["category"], []).append(r["keyword"])
    return found
