"""Text normalisers and extractors as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of ``n`` words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def normalize_name(name: Column, suffixes: Sequence[str] = ("gmbh", "ag", "inc", "ltd", "corp", "co", "kg", "ug")) -> Column:
    """Lower case, legal suffixes stripped from the end as long as there are any, punctuation gone, single spaces."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " "), " +", " "))
    return F.regexp_replace(plain, rf"( ({'|'.join(suffixes)}))+$", "")


def normalize_tag(tag: Column, keep: Sequence[str] = ("business", "aws", "saas")) -> Column:
    """Lower-case kebab form, plural s dropped unless the tag is to be kept or ends in ss."""
    kebab = F.regexp_replace(F.regexp_replace(F.lower(F.trim(tag)), "[^a-z0-9]+", "-"), "^-|-$", "")
    plural = kebab.endswith("s") & ~kebab.endswith("ss") & ~kebab.isin(*keep) & (F.length(kebab) > 3)
    return F.when(plural, F.regexp_replace(kebab, "s$", "")).otherwise(kebab)


def normalize_person(name: Column, titles: Sequence[str] = ("dr", "prof", "mr", "mrs", "ing")) -> Column:
    """Lower case letters and single spaces, leading titles dropped."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z ]+", " "), " +", " "))
    return F.regexp_replace(plain, rf"^(({'|'.join(titles)}) )+", "")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port and leading ``www.``; empty without a host."""
    host = F.regexp_extract(F.lower(url), r"^[a-z]+://([^/?#:]+)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def german_number(text: Column) -> Column:
    """``1.234.567,89`` as a double; null if it is no number."""
    return F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".").try_cast("double")


def amounts(text: Column) -> Column:
    """Distinct positive amounts written the German way before EUR, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9][0-9.]*(?:,[0-9]+)?) EUR"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, german_number)), lambda a: a > 0)


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule whose pattern is found; order decides."""
    found = F.lit(default)
    for pattern, label in reversed(rules):
        found = F.when(text.rlike(pattern), F.lit(label)).otherwise(found)
    return found


def lexicon_hits(words: Column, lexicon: Sequence[str]) -> Column:
    """Distinct lexicon words among ``words``, in lexicon order."""
    return F.filter(F.array(*[F.lit(w) for w in lexicon]), lambda w: F.array_contains(words, w))


def weighted_hits(words: Column, weights: Mapping[str, int]) -> Column:
    """Sum of the weights of the distinct words found."""
    total = F.lit(0)
    for word, weight in weights.items():
        total = total + F.when(F.array_contains(words, word), weight).otherwise(0)
    return total


def argmax_label(scores: Sequence[tuple[str, Column]], least: int) -> Column:
    """Label of the largest score if it reaches ``least``; the first of equals."""
    best = F.greatest(*[s for _, s in scores])
    found = F.lit(None).cast("string")
    for label, score in reversed(scores):
        found = F.when(score == best, F.lit(label)).otherwise(found)
    return F.when(best >= least, found)


def strip_html(html: Column) -> Column:
    """Visible text: scripts, styles and tags gone, white space single."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))
