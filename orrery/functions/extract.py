"""Amounts, companies, investors, officers and capital changes out of free text, as column expressions and explodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The words of numbers, units, currencies and verbs that tell an amount or a capital event.
NUMBER = r"([0-9]+(?:[,.][0-9]+)?)"
MILLION, BILLION = r"(?:Millionen|Mio\.?)", r"(?:Milliarden|Mrd\.?)"
ENGLISH_MILLION = "(?:million|m)"
GETS = "(?:erhält|sammelt|bekommt)"
RAISES = ("kapitalerhöhung", "stammkapital erhöht", "neue gesellschafter", "sacheinlage")
CUTS = ("kapitalherabsetzung", "herabsetzung des")


def spaced_by(gap: str, *parts: str) -> str:
    """Parts of a phrase with a gap between any two."""
    return gap.join(parts)


#: Ordered: pattern, multiplier, currency.
FUNDING_AMOUNTS = (
    (spaced_by(r"\s*", NUMBER, MILLION, "(?:Euro|EUR|€)"), 1e6, "EUR"),
    (spaced_by(r"\s*", "(?:€|EUR)", NUMBER, MILLION), 1e6, "EUR"),
    (spaced_by(r"\s*", NUMBER, BILLION, "(?:Euro|EUR|€)"), 1e9, "EUR"),
    (GETS + r"\s+" + spaced_by(r"\s*", NUMBER, MILLION), 1e6, "EUR"),
    (spaced_by(r"\s*", r"\$", NUMBER, ENGLISH_MILLION) + r"\b", 1e6, "USD"),
    (spaced_by(r"\s*", NUMBER, ENGLISH_MILLION, "(?:dollar|usd)"), 1e6, "USD"),
)
WORD = "[A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß0-9.-]*"
NAME = rf"({WORD}(?:\s+{WORD}){{0,3}})"
COMPANY_PATTERNS = (
    rf"^{NAME}\s*: (?:[0-9]|Seed|Series|Pre)",
    rf"{NAME}\s+(?:erhält|sammelt|bekommt)",
    rf"{NAME}\s+(?:raises|secures|closes)",
    rf"(?:Startup|Fintech)\s+{NAME}",
    rf"Runde für {NAME}",
)
# Fixed value: what parts the deals of one headline.
DEAL_SPLIT = r"\s*[–—]\s*|\s*\+\+\+\s*"
DEAL = spaced_by(r"\s+", NAME, GETS, spaced_by(r"\s*", NUMBER, MILLION))
TRAILING = "( (erhält|sammelt|bekommt|hat|raises|closes))+$"
NO_COMPANY = ("unbekannt", "unknown", "der", "die", "das", "the", "wie man")
INVESTOR_PATTERNS = (
    r"(?:angeführt|geführt)\s+von\s+([A-Z][A-Za-z0-9 ,&-]*)",
    r"(?:led|backed)\s+by\s+([A-Z][A-Za-z0-9 ,&-]*)",
    r"von\s+([A-Z][A-Za-z0-9]+(?: (?:Capital|Ventures|Partners|Fund))+)",
    r"Investor\s+([A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)*)",
)
INVESTOR_SPLIT = r"\s*,\s*|\s+und\s+|\s+and\s+|\s+sowie\s+|\s*&\s*"
ROUNDS = (
    ("exist|stipendium", "grant"), ("business angel|angel round", "angel"), ("pre-?seed", "pre_seed"), ("seed", "seed"),
    ("series a", "series_a"), ("series b", "series_b"), ("series c", "series_c"), ("growth", "growth"),
)
AMOUNT = "([0-9][0-9.]*(?:,[0-9]{1,2})?)"
CAPITAL_AMOUNTS = (rf"{AMOUNT}\s*(?:EUR|Euro|€)", rf"(?:EUR|€)\s*{AMOUNT}", rf"auf\s+{AMOUNT}")
ROLES = ("Geschäftsführer", "Prokurist", "Vorstand", "Liquidator")
SEGMENT = rf"((?:Bestellt als |Bestellt zum |Ausgeschieden als |Ausgeschieden |Abberufen |Nicht mehr )?(?:{'|'.join(ROLES)})[a-zü]*: [^.]*)"
PERSON = "^((?:Dr~ |Prof~ )*[A-ZÄÖÜ][a-zäöüß]+(?:[- ](?:von |van |de )?[A-ZÄÖÜ][a-zäöüß]+)+)"
BIRTH = r",? ?(geb~ ?|\*)? ?[0-9]{2}\.[0-9]{2}\.[0-9]{4}"
PERSON_SPLIT = r"\s*;\s*|\s+und\s+|,\s+"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def found_after(text: Column, pattern: str) -> Column:
    """`found` of a pattern in which a name comes before other words: the name is looked for only in texts that have these."""
    before, _, rest = pattern.partition(NAME)
    return F.when(text.rlike(rest), found(text, pattern)) if rest and not before else found(text, pattern)


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def funding_amount(text: Column) -> Column:
    """Struct (amount, currency) of the first pattern that is found; "erste Million" is one million."""
    hits = [F.struct(F.when(text.contains("erste Million"), 1e6).alias("amount"), F.lit("EUR").alias("currency"))]
    hits += [F.struct((number(found(text, p)) * m).alias("amount"), F.lit(c).alias("currency")) for p, m, c in FUNDING_AMOUNTS]
    return F.get(F.filter(F.array(*hits), lambda h: h["amount"].isNotNull()), F.lit(0))


def valid_companies(names: Column) -> Column:
    """Names without the verbs after them, of which those that may be companies are kept."""
    clean = F.transform(names, lambda n: F.regexp_replace(n, TRAILING, ""))
    return F.filter(clean, lambda n: (F.length(n) >= 2) & ~F.lower(n).isin(*NO_COMPANY))


def company_name(text: Column) -> Column:
    """The first ordered pattern whose name is left and plausible after cleaning."""
    return F.get(valid_companies(F.array(*[found_after(text, p) for p in COMPANY_PATTERNS])), F.lit(0))


def investors(text: Column) -> Column:
    """Names of the first pattern that matches, split; capitalised and longer than three characters."""
    names = F.split(F.coalesce(*[found(text, p) for p in INVESTOR_PATTERNS]), INVESTOR_SPLIT)
    return F.filter(F.transform(names, F.trim), lambda n: (F.length(n) > 3) & n.rlike("^[A-Z]"))


def round_type(text: Column, rules: Sequence[tuple[str, str]] = ROUNDS) -> Column:
    low = F.lower(text)
    return F.get(F.array_compact(F.array(*[F.when(low.rlike(pattern), F.lit(label)) for pattern, label in rules])), F.lit(0))


def funding_mentions(news: DataFrame, id_col: str = "id", title: str = "title", text: str = "t") -> DataFrame:
    """``(id, pos, company, amount, currency, round_type, investors, confidence)``: a row a deal of a digest, else at most one."""
    digest = F.coalesce(F.col(title).contains("#DealMonitor"), F.lit(False))
    deals = news.filter(digest).select(id_col, F.posexplode(F.split(text, DEAL_SPLIT)).alias("pos", "deal"))
    deal = F.col("deal")
    listed = deals.select(
        id_col, "pos", F.get(valid_companies(F.array(found(deal, DEAL))), F.lit(0)).alias("company"), (number(found(deal, DEAL, 2)) * 1e6).alias("amount"), F.lit("EUR").alias("currency"),
        round_type(deal).alias("round_type"), investors(deal).alias("investors"), F.lit(0.9).alias("confidence"),
    ).filter("company IS NOT NULL")
    t, a = F.col(text), F.col("a")
    one = news.filter(~digest).select(id_col, F.lit(0).alias("pos"), company_name(t).alias("company"), funding_amount(t).alias("a"), round_type(t).alias("round_type"), investors(t).alias("investors"))
    one = one.filter("company IS NOT NULL OR a IS NOT NULL")
    named = F.col("company").isNotNull()
    sure = F.when(named & a.isNotNull(), 0.8).when(named & F.col("round_type").isNotNull(), 0.7).when(a.isNotNull(), 0.5).otherwise(0.3)
    one = one.select(id_col, "pos", "company", a["amount"].alias("amount"), a["currency"].alias("currency"), "round_type", "investors", sure.alias("confidence"))
    return listed.unionByName(one)


def capital_amounts(text: Column) -> Column:
    """Distinct positive amounts of all patterns, pattern by pattern."""
    parse = lambda x: F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    every = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CAPITAL_AMOUNTS])
    return F.array_distinct(F.filter(F.transform(every, parse), lambda a: a > 0))


def capital_event(text: Column, amounts: Column, current: Column) -> Column:
    """Struct (event_type, previous, new, change, confidence), null without a keyword; equal counts are a decrease."""
    low = F.lower(text)
    ups, downs = (sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int")) for words in (RAISES, CUTS))
    up, n = ups > downs, F.size(amounts)
    least, most = F.array_min(amounts), F.array_max(amounts)
    only = F.get(amounts, F.lit(0))
    known = (n == 1) & current.isNotNull() & (current != 0) & (current != only)
    previous = F.when(n >= 2, F.when(up, least).otherwise(most)).when(known, current)
    new = F.when(n >= 2, F.when(up, most).otherwise(least)).when(n == 1, only)
    change = F.abs(new - previous)
    sure = F.least(F.greatest(ups, downs) * 0.15, F.lit(0.4)) + F.when(n > 0, 0.3).otherwise(0.0) + F.when(change.isNotNull(), 0.3).otherwise(0.0)
    event = F.struct(
        F.when(up, "increase").otherwise("decrease").alias("event_type"), previous.alias("previous"), new.alias("new"), change.alias("change"),
        F.round(F.least(sure, F.lit(1.0)), 4).alias("confidence"),
    )
    return F.when((ups > 0) | (downs > 0), event)


def officers(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``(id, officer, role, action, is_current)``: names after role headings; of repeats appointments come before dismissals and lists."""
    plain = text
    for dotted in ("Dr. ", "Prof. ", "geb. "):
        plain = F.replace(plain, F.lit(dotted), F.lit(dotted.replace(".", "~")))
    plain = F.regexp_replace(F.regexp_replace(plain, r"([0-9])\. ", "; "), BIRTH, "")
    parts = rows.select(id_col, F.posexplode(F.regexp_extract_all(plain, F.lit(SEGMENT), F.lit(1))).alias("at", "part"))
    part = F.col("part")
    rank = F.when(part.startswith("Bestellt"), 0).when(part.rlike("^(Ausgeschieden|Abberufen|Nicht)"), 1).otherwise(2)
    role = F.lit(None).cast("string")
    for r in reversed(ROLES):
        role = F.when(part.contains(r), r).otherwise(role)
    names = F.split(F.regexp_replace(part, "^[^:]*: ", ""), PERSON_SPLIT)
    named = parts.select(id_col, "at", role.alias("role"), rank.alias("rank"), F.posexplode(names).alias("pos", "name"))
    named = named.withColumn("officer", F.replace(found(F.trim("name"), PERSON), F.lit("~"), F.lit("."))).filter("officer IS NOT NULL")
    order = W.partitionBy(id_col, F.lower("officer"), "role").orderBy("rank", "at", "pos")
    first = named.withColumn("r", F.row_number().over(order)).filter("r = 1")
    action = F.when(F.col("rank") == 0, "appointed").when(F.col("rank") == 1, "dismissed").otherwise("listed")
    return first.select(id_col, "officer", "role", action.alias("action"), (F.col("rank") != 1).alias("is_current"))
