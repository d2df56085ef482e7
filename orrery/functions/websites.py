"""How sure it is that a page is a company's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and gates of the signals.
OWN_WORD, PART_OF_HOST, PARKED, TITLE, NEAR_TITLE, IMPRINT = 0.3, 0.2, -0.5, (0.7, 0.3), (0.5, 0.1), 0.2


def host_signal(brand: Column, host: Column) -> Column:
    """0.3 if a word of the brand is a word of the host's first part, else 0.2 if one of three letters or more lies in it."""
    base = F.split_part(host, F.lit("."), F.lit(1))
    words = F.filter(F.split(brand, r"[\s.\-]+"), lambda w: w != "")
    return F.when(F.arrays_overlap(words, F.split(base, "-")), OWN_WORD).when(F.exists(words, lambda w: (F.length(w) >= 3) & base.contains(w)), PART_OF_HOST).otherwise(0.0)


def website_confidence(brand: Column, host: Column, title_ratio: Column, html: Column, parked: Sequence[str], imprint: Sequence[str]) -> Column:
    """Sum of the signals between 0 and 1; of a parked page only its host counts, and against it.

    ``title_ratio`` is the token-set ratio of brand and title.  Null texts have no signal.
    """
    low = F.lower(F.coalesce(html, F.lit("")))

    def names(words: Sequence[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | low.contains(w)
        return found

    title = F.when(title_ratio >= TITLE[0], TITLE[1]).when(title_ratio >= NEAR_TITLE[0], NEAR_TITLE[1]).otherwise(0.0)
    page = F.when(names(parked), PARKED).otherwise(title + F.when(names(imprint), IMPRINT).otherwise(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), host_signal(brand, host) + page)), 4)
