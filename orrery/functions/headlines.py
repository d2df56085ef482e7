"""Company names in headlines, from tables of words, and dates in the forms that feeds write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.extract import NAME, found_after

# The words around a name, and the order of the forms.
GETS_DE = ("erhält", "sammelt", "bekommt", r"sichert\s+sich", "schließt")
GETS_EN = ("raise", "raises", "secure", "secures", "close", "closes", "announce", "announces", "land", "lands", "bag", "bags", "nab", "nabs")
BASED_EN = ("raise", "raises", "secure", "secures", "close", "closes", "announce", "announces")
DONE_DE = ("eingesammelt", "geschlossen", "erhalten", "bekommen")
AFTER_COLON = ("[0-9]", "Seed", "Series", "Pre", "Angel", "Grant")
KINDS = ("Startup", "Start-up", "Fintech", "Healthtech", "Insurtech", "Proptech", "SaaS", "KI-Startup", "AI-Startup", "Cleantech-Startup", "HealthTech-Startup", "Biotech", "Medtech")
ROUNDS_DE = (r"Series\s+[A-Za-z0-9_]", "Seed", "Finanzierung", "Runde")
TRAILING = ("erhält", "sammelt", "bekommt", "sichert", "schließt", "hat", "haben", "will", "wird", "kann", "soll", "raises", "secures", "closes", "announces", "gets", "receives", "launches", "lands")


def one_of(words: Sequence[str]) -> str:
    """Alternatives, longer ones first, so that a word does not stop at one that begins it."""
    return f"(?:{'|'.join(sorted(words, key=lambda w: (-len(w), w)))})"


def name_patterns() -> tuple[str, ...]:
    """The eleven forms of a headline about funding, in the order they are tried; the name is group 1."""
    return (
        rf"^{NAME}\s*:\s+{one_of(AFTER_COLON)}",
        rf"{NAME}\s+{one_of(GETS_DE)}",
        rf"hat\s+{NAME}\s+.*?{one_of(DONE_DE)}",
        rf"{NAME}\s+(?:hat|haben)\s+.*eingesammelt",
        rf"{NAME}\s+{one_of(GETS_EN)}",
        rf"(?:[A-Z][A-Za-z0-9_]+-based)\s+{NAME}\s+{one_of(BASED_EN)}",
        rf"{one_of(KINDS)}\s+{NAME}",
        rf"(?:Gründer(?:-Team)?|Founder)\s+(?:von|of)\s+{NAME}",
        rf"{one_of(ROUNDS_DE)}\s+für\s+{NAME}",
        rf"investier[A-Za-z0-9_]*\s+(?:bei|in)\s+{NAME}",
        rf"{NAME}\s+(?:get|gets|receive|receives)\s+[€$£]\s*[0-9]",
    )


TRAIL = rf"(?i)(\s+{one_of(TRAILING)})+$"


def headline_company(text: Column, no_company: Sequence[str]) -> Column:
    """Name of the first form that leaves a plausible one: words of funding after it gone, two characters or more, none of ``no_company``."""
    names = F.transform(F.array(*[found_after(text, p) for p in name_patterns()]), lambda n: F.regexp_replace(F.trim(n), TRAIL, ""))
    whole = F.filter(names, lambda n: (F.length(n) >= 2) & ~F.lower(n).isin(*no_company) & ~F.lower(n).isin(*[w.lower() for w in TRAILING]))
    return F.get(whole, F.lit(0))


#: Forms of a date after its day name is gone: with the zone as an offset or a name, ISO with an offset or Z, and plain.
DATE_FORMS = ("dd MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def feed_date(text: Column) -> Column:
    """A date of a feed as it is written, its zone left out: day name, day, month and time with ``+0100`` or a zone's name; ISO with an
    offset, with Z or without; date and time; date.  Null for any other text.
    """
    bare = F.regexp_replace(F.trim(text), "^[A-Z][a-z][a-z], ", "")
    bare = F.regexp_replace(bare, r"(^[0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9:]{8}) (?:[+-][0-9]{4}|[A-Z]{3,4})$", "$1")
    bare = F.regexp_replace(bare, r"(^[0-9-]{10}T[0-9:]{8})(?:Z|[+-][0-9]{2}:?[0-9]{2})$", "$1")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(form)) for form in DATE_FORMS])


def too_old(text: Column, now: Column, days: int = 7) -> Column:
    """Whether a date is more than ``days`` before ``now``; what cannot be read is never too old."""
    return F.coalesce(feed_date(text) < now - F.make_dt_interval(F.lit(days)), F.lit(False))
