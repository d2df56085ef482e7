"""Composite scores and ordered rules of companies as column expressions; every list of rules is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.lexicon import total

# Legal forms in the order in which they are looked for.
LEGAL_FORMS = (
    "GmbH & Co. KG", "GmbH & Co. KGaA", "AG & Co. KG", "UG (haftungsbeschränkt) & Co. KG", "UG (haftungsbeschränkt)", "gGmbH", "GmbH",
    "AG", "KGaA", "KG", "OHG", "UG", "e.V.", "eV", "GbR", "SE", "PartG", "PartGmbB",
)


def first_part(text: Column, rules: Sequence[tuple[str, object]], default: object = None) -> Column:
    """Value of the first rule whose text is contained, case aside."""
    found = F.lit(default)
    for part, value in reversed(rules):
        found = F.when(F.lower(text).contains(part.lower()), F.lit(value)).otherwise(found)
    return found


def pattern_sum(text: Column, rules: Sequence[tuple[str, int]]) -> Column:
    """Sum of the scores of all patterns found in the lower-cased text; null text gives 0."""
    return total([F.when(F.lower(text).rlike(p), score).otherwise(0) for p, score in rules])


def tier_score(amount: Column, tiers: Sequence[tuple[float, float | None, int]]) -> Column:
    """Score of the first tier (from, below, score) that holds the amount; 0 if none does or there is no amount."""
    found = F.lit(0)
    for low, high, score in reversed(tiers):
        inside = (amount >= low) if high is None else (amount >= low) & (amount < high)
        found = F.when(inside, score).otherwise(found)
    return found


def legal_form(name: Column, forms: Sequence[str] = LEGAL_FORMS, whole_words: bool = False) -> Column:
    """The first form contained in the name, case aside; with ``whole_words`` only as words of their own."""
    found = F.lit(None).cast("string")
    for form in reversed(forms):
        pattern = "(^|[^a-zäöüß])" + "".join("\\" + c if c in ".()&" else c for c in form.lower()) + "($|[^a-zäöüß])"
        hit = F.lower(name).rlike(pattern) if whole_words else F.lower(name).contains(form.lower())
        found = F.when(hit, F.lit(form)).otherwise(found)
    return found


def brand_part(name: Column, form: Column) -> Column:
    """The name without its legal form (as written) and what separated it."""
    bare = F.trim(F.rtrim(F.trim(F.replace(name, form, F.lit(""))), F.lit("&-,")))
    return F.when(form.isNull(), F.trim(name)).otherwise(F.trim(F.replace(bare, F.lit("(haftungsbeschränkt)"), F.lit(""))))


def score_startups(
    companies: DataFrame,
    forms: Sequence[tuple[str, int]],
    established: Sequence[tuple[str, int]],
    places: Sequence[tuple[str, int]],
    name_rules: Sequence[tuple[str, int]],
    purpose_rules: Sequence[tuple[str, int]],
    tiers: Sequence[tuple[float, float | None, int]],
) -> DataFrame:
    """Companies ``(name, form, city, purpose, capital, relevance, tech)`` with subscores, ``score`` and ``classification``."""
    form = F.coalesce(first_part(F.col("form"), [*forms, *established]), F.lit(0))
    purpose = F.greatest(F.lit(-3), F.least(F.lit(5), pattern_sum(F.col("purpose"), purpose_rules)))
    scored = (
        companies.withColumn("form_score", form)
        .withColumn("place_score", F.coalesce(first_part(F.col("city"), places), F.lit(0)))
        .withColumn("name_score", pattern_sum(F.col("name"), name_rules))
        .withColumn("purpose_score", purpose)
        .withColumn("capital_score", tier_score(F.col("capital"), tiers))
        .withColumn("bonus", F.when(F.col("relevance") >= 4, 2).when(F.col("relevance") >= 2, 1).otherwise(0))
    )
    parts = [F.col(c) for c in ("form_score", "place_score", "name_score", "purpose_score", "capital_score", "bonus")]
    return scored.withColumn("score", total(parts)).withColumn("classification", startup_class())


def startup_class() -> Column:
    """Paths A to E to a startup, then what makes a scaleup, by precedence, over the columns of ``score_startups``."""
    score, name, purpose = F.col("score"), F.col("name_score"), F.col("purpose_score")
    known = (F.col("relevance") >= 1) | F.col("tech")
    # The gates of the paths.
    startup = (score >= 5) & known  # A
    startup |= (score >= 3) & (F.col("relevance") >= 2) & F.col("tech")  # B
    startup |= (F.col("relevance") >= 4) & (score >= 2)  # C
    startup |= (score >= 7) & (name >= 3)  # D
    startup |= (purpose >= 3) & (score >= 4)  # E
    scaleup = ((score >= 3) & known) | F.col("tech") | ((F.col("relevance") >= 1) & (score >= 1)) | ((score >= 6) & (name >= 1))
    return F.when(startup, "startup").when(scaleup, "scaleup").otherwise("established")


def any_part(text: Column, parts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | text.contains(p)
    return hit


def shell_penalty(brand: Column, patterns: Sequence[str], vehicles: Sequence[str]) -> Column:
    """-8 for patterns of shells and bare numbers, -5 for short names with a number, -6, -5 or -3 by words for vehicles."""
    low = F.lower(brand)
    hits = total([low.contains(w).cast("int") for w in vehicles])
    words = F.split(brand, " ")
    short = (F.size(words) == 2) & (F.length(words[0]) <= 4) & brand.rlike("^[A-Z]+ ")
    found = F.when(brand.isNull() | (brand == ""), 0)
    for p in patterns:
        found = found.when(low.rlike(p), -8)
    found = found.when(brand.rlike("^[A-Z]{2,4} [0-9]+$"), -5).when(hits >= 2, -6).when((hits == 1) & short, -5).when(hits == 1, -3)
    return found.when(F.regexp_replace(brand, r"[\s.&-]", "").rlike("^[0-9]+$"), -8).otherwise(0)


def english_signal(brand: Column, words: Sequence[str], endings: Sequence[str]) -> Column:
    """2 if a word of the brand is known, 1 if one holds a known word of four letters or more, or ends as invented names do."""
    low = F.lower(brand)
    whole = F.lit(False)
    for w in words:
        whole = whole | F.concat(F.lit(" "), low, F.lit(" ")).contains(f" {w} ")
    inside = any_part(low, [w for w in words if len(w) >= 4])
    invented = F.lit(False)
    for e in endings:
        invented = invented | (low.endswith(e) & (F.length(low) > len(e) + 2))
    invented = invented & ~low.contains(" ") & (F.length(brand) >= 4)
    return F.when(F.length(brand) < 3, 0).when(whole, 2).when(inside | invented, 1).otherwise(0)


def foreign_signal(brand: Column, words: Sequence[str], surnames: Sequence[str], endings: Sequence[str]) -> Column:
    """3 unless the brand holds a word of German trade or begins with a German surname."""
    low = F.lower(brand)
    first = F.split_part(low, F.lit(" "), F.lit(1))
    surname = first.isin(*surnames)
    for e in endings:
        surname = surname | (first.endswith(e) & (F.length(first) >= len(e) + 2))
    return F.when((F.length(brand) < 2) | any_part(low, words) | surname, 0).otherwise(3)
