"""Tags of people and the confidence of their profiles, from tables of rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.lexicon import total
from orrery.functions.text import first_match

EDGE = "[^0-9a-zäöüß]"


def whole(pattern: str) -> str:
    """The pattern between ends of words."""
    return f"(^|{EDGE})({pattern})($|{EDGE})"


@dataclass(frozen=True)
class TagRules:
    """Rules of the tags: (pattern over lower-cased text, label) in order, but for employers: (tier, names, letters from which a name may lie inside a longer one)."""

    places: Sequence[tuple[str, str]]
    roles: Sequence[tuple[str, str]]
    tiers: Sequence[tuple[str, Sequence[str], int]]
    sectors: Sequence[tuple[str, str]]
    confirmed: str
    likely: str
    titles: Sequence[str] = field(default=("senior", "director", "head", "manager", "engineer", "founder", "ceo", "cto", "at"))


def employer_pattern(titles: Sequence[str]) -> str:
    """What follows ``ex-`` up to a separator, a title or the end, as group 1."""
    return rf"(?:^|{EDGE})ex[- ]([a-z0-9][a-z0-9& .]*?)(?: *[|,;–]| +(?:{'|'.join(titles)})(?:$|{EDGE})| *$)"


def employers(headline: Column, rules: TagRules) -> Column:
    """Distinct earlier employers of a headline, lower-cased, in order; names of one letter are none."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(headline), F.lit(employer_pattern(rules.titles)), F.lit(1))), lambda c: F.length(c) > 1)


def employer_tier(companies: Column, rules: TagRules) -> Column:
    """The best tier of a list: the first tier with a name that is one of the companies, or lies in one if it is long enough; ``other``
    if none, null for an empty list."""
    def hit(names: Sequence[str], inside: int) -> Callable[[Column], Column]:
        def holds(c: Column) -> Column:
            any_ = F.lit(False)
            for n in names:
                any_ = any_ | (c.contains(n) if len(n) >= inside else c == n)
            return any_

        return holds

    tier = F.when(F.size(companies) > 0, F.lit("other"))
    for label, names, inside in reversed(rules.tiers):
        tier = F.when(F.exists(companies, hit(names, inside)), label).otherwise(tier)
    return tier


def person_tags(name: Column, headline: Column, location: Column, rules: TagRules) -> dict[str, Column]:
    """Columns ``region, role, employers, tier, sectors, strength, quality``.

    Null headlines have the role ``other``, no employers or sectors and a weak signal; a null or empty location has no region.
    """
    low = F.lower(F.coalesce(headline, F.lit("")))
    firms = F.coalesce(employers(headline, rules), F.array().cast("array<string>"))
    sectors = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(label)) for p, label in rules.sectors]))
    length = F.length(headline)
    quality = F.when(name.isNull() | (F.length(name) < 2) | name.contains(" - ") | (F.length(name) > 80), "junk")
    quality = quality.when(headline.isNull() | (length == 0), "partial").when(length > 180, "junk").when(length < 10, "partial").otherwise("clean")
    return {
        "region": F.when(F.coalesce(location, F.lit("")) != "", F.coalesce(first_match(F.lower(location), rules.places), F.lit("other"))),
        "role": F.coalesce(first_match(low, rules.roles), F.lit("other")),
        "employers": firms,
        "tier": employer_tier(firms, rules),
        "sectors": sectors,
        "strength": F.when(low.rlike(rules.confirmed), "confirmed").when(low.rlike(rules.likely), "likely").otherwise("weak"),
        "quality": quality,
    }


# The parts of a tier (signal, weight of each hit, most of the part) and the most of the tier.
Part = tuple[str, float, float]
CONFIDENCE: tuple[tuple[float, tuple[Part, ...]], ...] = (
    (0.20, (("transition", 0.04, 0.10), ("repeat", 0.10, 0.10), ("founder", 0.03, 0.08))),
    (0.20, (("tier", 0.04, 0.16), ("background", 0.04, 0.04))),
    (0.15, (("cofounder", 0.08, 0.08), ("urgency", 0.03, 0.07), ("traction", 0.02, 0.05))),
)


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words the lower-cased text holds."""
    return total([F.coalesce(F.lower(text).contains(w).cast("int"), F.lit(0)) for w in words])


def profile_confidence(text: Column, location: Column, tier: Column, signals: Mapping[str, Sequence[str]], cities: Sequence[str], countries: Sequence[str]) -> Column:
    """Sum of five capped tiers, at most 1: stealth itself (0.25, else 0.05 a signal up to 0.15), change, background, urgency, place.

    ``tier`` is 0 to 4.  A signal without words counts nothing; null texts and locations have no signal.
    """
    n = {name: hits(text, words) for name, words in signals.items()} | {"tier": tier}
    stealth = F.when(F.coalesce(F.lower(text).contains("stealth"), F.lit(False)), 0.25).otherwise(F.least(F.lit(0.15), n.get("stealth", F.lit(0)) * 0.05))
    parts = [F.least(F.lit(most), total([F.least(F.lit(cap), n[s] * each) for s, each, cap in tiers if s in n] or [F.lit(0.0)])) for most, tiers in CONFIDENCE]
    where = F.lower(F.coalesce(location, F.lit("")))
    place = F.when(hits(where, countries) > 0, 0.08).when(hits(where, cities) > 0, 0.10).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), stealth + total(parts) + place), 4)
