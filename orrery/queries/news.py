"""Funding news and register announcements: relevance, extraction and types, over views that both engines build alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import extract as E
from orrery.functions.lexicon import any_pattern as any_of
from orrery.functions.scoring import pattern_sum
from orrery.queries.companies import _FLAT, _W1, _W2, _pattern_sum, d_any, q
from orrery.queries.registry import query
from orrery.sources.tables import spread, table
from orrery.storage import stage

_A, _B = "CAST(1 + n_chars % 90 AS STRING)", "CAST(2 + n_chars % 7 AS STRING)"
NEWS = f"""SELECT *, coalesce(title, '') || ' ' || coalesce(description, '') AS t FROM (SELECT doc_id AS id, CASE WHEN n_chars % 3 = 0 THEN 'von Sigma Ventures' END AS description, CASE n_chars % 11
    WHEN 0 THEN '#DealMonitor - ' || {_W1} || ' erhält ' || {_A} || ' Millionen – ' || {_W2} || ' sammelt ' || {_B} || ',5 Mio. ein +++ Unbekannt erhält 3 Mio'
    WHEN 1 THEN {_W1} || ' raises $' || {_A} || 'm Series A led by Alpha Capital, Beta Ventures and Gamma.'
    WHEN 2 THEN 'Seed-Runde für ' || {_W1} || ': ' || {_A} || ',2 Mio. Euro angeführt von Delta Partners, sowie andere'
    WHEN 3 THEN {_W1} || ' sammelt die erste Million ein' WHEN 4 THEN {_W1} || ': Series B über €' || {_A} || ' Millionen'
    WHEN 5 THEN 'Tipps: wie man ' || {_W1} || ' gründet' WHEN 6 THEN 'KI-Startup ' || {_W1} || ' bekommt EXIST-Gründerstipendium'
    WHEN 7 THEN {_W1} || ' erhält 2 Milliarden Euro vom Investor Omega Fund' WHEN 8 THEN {_FLAT} WHEN 9 THEN NULL
    ELSE 'the round: ' || {_W1} || ' closes 12.5 million dollar pre-seed' END AS title FROM documents)"""
_G = "CAST(30 + n_chars % 60 AS STRING) || '.000'"
NOTICES = f"""SELECT doc_id AS id, CASE WHEN n_chars % 3 = 0 THEN CAST(25000 AS DOUBLE) END AS current, CASE n_chars % 8
    WHEN 0 THEN 'Kapitalerhöhung: Das Stammkapital wurde von 25.000,00 EUR auf ' || {_G} || ',50 EUR erhöht.'
    WHEN 1 THEN 'Kapitalherabsetzung von EUR ' || {_G} || ',00 auf 25.000 Euro; Stammkapital erhöht'
    WHEN 2 THEN 'Bestellt als Geschäftsführerin: Dr. Anna ' || {_W1} || ', *01.02.1980; Max von Berg und Eva Stein-Wolf. Ausgeschieden als Prokurist: Otto Kern.'
    WHEN 3 THEN 'Geschäftsführer: 1. ' || {_W1} || ' ' || {_W2} || '; 2. Prof. Dr. Lena Öz. Abberufen Vorstand: Uwe Maier, geb. 03.04.1970, Köln. Geschäftsführer: Lena Öz.'
    WHEN 4 THEN 'Neue Gesellschafter; Sacheinlage. Gegenstand: ' || {_W1} || '. Sitz: Berlin. Kapital EUR 40.000,00'
    WHEN 5 THEN 'Liquidator: ' || {_W1} || ' ' || {_W1} || '. Die Gesellschaft ist aufgelöst.' WHEN 6 THEN NULL ELSE {_FLAT} END AS txt FROM documents"""


def _view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "n_chars"))
    return spark.sql(sql.replace("FROM documents", "FROM {documents}"), documents=docs)


FUNDING = (("erhält|sammelt|bekommt", 2), ("raises|closes", 2), ("seed|series [a-d]", 1), ("million|mio|mrd", 1), ("runde|round", 1), ("investor|ventures|capital", 1), ("tipps|wie man", -3))
AI_STRONG, AI_WEAK = ("ki-[a-z]+", "machine learning", "oning[a-z]*eon"), ("(^| )ki( |$)", "(^| )the( |$)", "exist", "oning")
EARLY = ("exist", "stipendium", "pre-?seed", "business angel")


def _count(text: str, patterns) -> str:
    return _pattern_sum(text, [(p, 1) for p in patterns])


@query(f"""SELECT id, weight, weight >= 2 AS relevant, CASE WHEN {d_any('t', AI_STRONG)} THEN 2 ELSE {_count('t', AI_WEAK)} + CASE WHEN {d_any('title', AI_WEAK)} THEN 1 ELSE 0 END END AS ai_level
    FROM (SELECT *, {_pattern_sum('t', FUNDING)} AS weight FROM ({NEWS}))""")
def weighted_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted funding signals; one strong AI signal is enough, weak ones add up and count once more in the title."""
    weak = pattern_sum(F.col("t"), [(p, 1) for p in AI_WEAK]) + any_of(F.col("title"), AI_WEAK).cast("int")
    level = F.when(any_of(F.col("t"), AI_STRONG), 2).otherwise(weak)
    rows = _view(spark, folder, NEWS).select("id", pattern_sum(F.col("t"), FUNDING).alias("weight"), level.alias("ai_level"))
    return rows.withColumn("relevant", F.col("weight") >= 2)


@query(f"SELECT id, {d_any('t', EARLY)} AS any_hit FROM ({NEWS})")
def any_pattern(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, NEWS).select("id", any_of(F.col("t"), EARLY).alias("any_hit"))


def _x(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {q(pattern)}, {group}), '')"


def _num(text: str) -> str:
    return f"try_cast(replace({text}, ',', '.') AS DOUBLE)"


_AMOUNT = "CASE WHEN contains(t, 'erste Million') THEN 1e6 " + " ".join(f"WHEN {_x('t', p)} IS NOT NULL THEN {_num(_x('t', p))} * {m}" for p, m, _ in E.FUNDING_AMOUNTS) + " END"
_CURRENCY = "CASE WHEN contains(t, 'erste Million') THEN 'EUR' " + " ".join(f"WHEN {_x('t', p)} IS NOT NULL THEN '{c}'" for p, _, c in E.FUNDING_AMOUNTS) + " END"


def _round(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({text}), {q(p)}) THEN {q(v)}" for p, v in E.ROUNDS) + " END"


def _valid(name: str) -> str:
    clean = f"regexp_replace({name}, {q(E.TRAILING)}, '')"
    return f"CASE WHEN length({clean}) >= 2 AND lower({clean}) NOT IN ({', '.join(map(q, E.NO_COMPANY))}) THEN {clean} END"


def _investors(text: str) -> str:
    first = "coalesce(" + ", ".join(_x(text, p) for p in E.INVESTOR_PATTERNS) + ")"
    names = f"list_transform(string_split_regex({first}, {q(E.INVESTOR_SPLIT)}), lambda n: trim(n))"
    return f"array_to_string(list_filter({names}, lambda n: length(n) > 3 AND regexp_matches(n, '^[A-Z]')), '|')"


_COMPANY = "coalesce(" + ", ".join(_valid(_x("t", p)) for p in E.COMPANY_PATTERNS) + ")"


@query(f"SELECT id, CAST({_AMOUNT} AS DOUBLE) AS amount, {_CURRENCY} AS currency FROM ({NEWS})")
def amount_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = _view(spark, folder, NEWS).select("id", E.funding_amount(F.col("t")).alias("a"))
    return rows.select("id", "a.amount", "a.currency")


@query(f"SELECT id, {_round('t')} AS round_type, {_investors('t')} AS investors FROM ({NEWS})")
def round_type(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("t")
    return _view(spark, folder, NEWS).select("id", E.round_type(t).alias("round_type"), F.array_join(E.investors(t), "|").alias("investors"))


@query(f"""WITH n AS ({NEWS}), d AS (SELECT id, unnest(deals) AS deal, generate_subscripts(deals, 1) - 1 AS pos FROM (SELECT id, string_split_regex(t, {q(E.DEAL_SPLIT)}) AS deals FROM n WHERE contains(title, '#DealMonitor'))),
    o AS (SELECT id, 0 AS pos, {_COMPANY} AS company, CAST({_AMOUNT} AS DOUBLE) AS amount, {_CURRENCY} AS currency, {_round('t')} AS round_type, {_investors('t')} AS investors FROM n WHERE title IS NULL OR NOT contains(title, '#DealMonitor'))
    SELECT id, CAST(pos AS INT) AS pos, {_valid(_x('deal', E.DEAL))} AS company, {_num(_x('deal', E.DEAL, 2))} * 1e6 AS amount, 'EUR' AS currency, {_round('deal')} AS round_type, {_investors('deal')} AS investors, 0.9::DOUBLE AS confidence FROM d
      WHERE {_valid(_x('deal', E.DEAL))} IS NOT NULL
    UNION ALL SELECT id, pos, company, amount, currency, round_type, investors, CAST(CASE WHEN company IS NOT NULL AND amount IS NOT NULL THEN 0.8 WHEN company IS NOT NULL AND round_type IS NOT NULL THEN 0.7
      WHEN amount IS NOT NULL THEN 0.5 ELSE 0.3 END AS DOUBLE) FROM o WHERE company IS NOT NULL OR amount IS NOT NULL""")
def extract_funding(spark: SparkSession, folder: str) -> DataFrame:
    news = stage(_view(spark, folder, NEWS).select("id", "title", "t"), "news")  # what the filters and columns below read many times
    return E.funding_mentions(news).withColumn("investors", F.array_join("investors", "|"))


# -- announcements -----------------------------------------------------------------------------------------------------------
_PARSE = "try_cast(replace(replace({0}, '.', ''), ',', '.') AS DOUBLE)"
_ALL = "list_filter(list_transform(" + " || ".join(f"regexp_extract_all(txt, {q(p)}, 1)" for p in E.CAPITAL_AMOUNTS) + f", lambda x: {_PARSE.format('x')}), lambda a: a > 0)"


@query(f"SELECT id, CAST(len(list_distinct(a)) AS INT) AS n, a[1] AS first_amount, list_min(a) AS low, list_max(a) AS high FROM (SELECT id, {_ALL} AS a FROM ({NOTICES}) WHERE txt IS NOT NULL)")
def extract_amounts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _view(spark, folder, NOTICES).filter("txt IS NOT NULL").select("id", E.capital_amounts(F.col("txt")).alias("a"))
    return rows.select("id", F.size("a").alias("n"), F.get("a", F.lit(0)).alias("first_amount"), F.array_min("a").alias("low"), F.array_max("a").alias("high"))


def _hits(words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower(txt), {q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


@query(f"""SELECT id, CASE WHEN ups > downs THEN 'increase' ELSE 'decrease' END AS event_type, previous, latest, abs(latest - previous) AS change,
    round(least(1.0, least(0.15 * greatest(ups, downs), 0.4) + CASE WHEN n > 0 THEN 0.3 ELSE 0 END + CASE WHEN abs(latest - previous) IS NOT NULL THEN 0.3 ELSE 0 END), 4)::DOUBLE AS confidence
    FROM (SELECT *, CASE WHEN n >= 2 THEN CASE WHEN ups > downs THEN list_min(a) ELSE list_max(a) END WHEN n = 1 AND current <> 0 AND current <> a[1] THEN current END AS previous,
      CASE WHEN n >= 2 THEN CASE WHEN ups > downs THEN list_max(a) ELSE list_min(a) END WHEN n = 1 THEN a[1] END AS latest
      FROM (SELECT *, len(list_distinct(a)) AS n FROM (SELECT id, current, {_ALL} AS a, {_hits(E.RAISES)} AS ups, {_hits(E.CUTS)} AS downs FROM ({NOTICES}) WHERE txt IS NOT NULL))) WHERE ups + downs > 0""")
def capital_from_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = _view(spark, folder, NOTICES).withColumn("a", E.capital_amounts(F.col("txt")))
    rows = rows.select("id", E.capital_event(F.col("txt"), F.col("a"), F.col("current")).alias("e")).filter("e IS NOT NULL")
    return rows.select("id", "e.event_type", "e.previous", F.col("e.new").alias("latest"), "e.change", "e.confidence")


_PAIR = r"von (?:EUR )?([0-9][0-9.,]*[0-9])(?: EUR)? auf (?:EUR )?([0-9][0-9.,]*[0-9])"


@query(f"""SELECT id, old_amount, new_amount, CASE WHEN new_amount > old_amount THEN 'increase' WHEN new_amount < old_amount THEN 'decrease' ELSE 'none' END AS kind FROM (
    SELECT id, coalesce({_PARSE.format(_x('txt', _PAIR))}, a[1]) AS old_amount, coalesce({_PARSE.format(_x('txt', _PAIR, 2))}, list_filter(a, lambda x: x <> a[1])[1]) AS new_amount
    FROM (SELECT id, txt, {_ALL} AS a FROM ({NOTICES}) WHERE txt IS NOT NULL))""")
def capital_pair(spark: SparkSession, folder: str) -> DataFrame:
    """``von … auf …``; else the first two distinct amounts."""
    rows = _view(spark, folder, NOTICES).filter("txt IS NOT NULL").withColumn("a", E.capital_amounts(F.col("txt")))
    parse = lambda k: F.replace(F.replace(E.found(F.col("txt"), _PAIR, k), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    old, new = (F.coalesce(parse(k), F.get("a", F.lit(k - 1))) for k in (1, 2))
    rows = rows.select("id", old.alias("old_amount"), new.alias("new_amount"))
    up, down = F.col("new_amount") > F.col("old_amount"), F.col("new_amount") < F.col("old_amount")
    return rows.withColumn("kind", F.when(up, "increase").when(down, "decrease").otherwise("none"))


_MASKED = "replace(replace(replace(txt, 'Dr. ', 'Dr~ '), 'Prof. ', 'Prof~ '), 'geb. ', 'geb~ ')"
_PLAIN = f"regexp_replace(regexp_replace({_MASKED}, '([0-9])\\. ', '; ', 'g'), {q(E.BIRTH)}, '', 'g')"


@query(f"""WITH s AS (SELECT id, unnest(p) AS part, generate_subscripts(p, 1) AS place FROM (SELECT id, regexp_extract_all({_PLAIN}, {q(E.SEGMENT)}, 1) AS p FROM ({NOTICES}))),
    r AS (SELECT id, place, CASE {' '.join(f"WHEN contains(part, '{r}') THEN '{r}'" for r in E.ROLES)} END AS role, CASE WHEN starts_with(part, 'Bestellt') THEN 0 WHEN regexp_matches(part, '^(Ausgeschieden|Abberufen|Nicht)') THEN 1 ELSE 2 END AS rk,
      string_split_regex(regexp_replace(part, '^[^:]*: ', ''), {q(E.PERSON_SPLIT)}) AS names FROM s),
    n AS (SELECT id, place, role, rk, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM r),
    o AS (SELECT id, place, pos, role, rk, replace({_x('trim(name)', E.PERSON)}, '~', '.') AS officer FROM n)
    SELECT id, officer, role, CASE rk WHEN 0 THEN 'appointed' WHEN 1 THEN 'dismissed' ELSE 'listed' END AS action, rk <> 1 AS is_current
    FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(officer), role ORDER BY rk, place, pos) AS k FROM o WHERE officer IS NOT NULL) WHERE k = 1""")
def extract_officers(spark: SparkSession, folder: str) -> DataFrame:
    return E.officers(_view(spark, folder, NOTICES), "id", F.col("txt"))


@query(f"""SELECT id, coalesce({_x('txt', 'Gegenstand: ([^.]+)[.]')}, {_x('txt', '^([^:]+): ')}, 'unknown') AS purpose, coalesce({_x('txt', 'Sitz: ([^.]+)[.]')}, {_x('txt', ', ([A-ZÄÖÜ][a-zäöüß]+)[.]')}, 'unknown') AS seat FROM ({NOTICES})""")
def field_fallbacks(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("txt")
    purpose = F.coalesce(E.found(t, "Gegenstand: ([^.]+)[.]"), E.found(t, "^([^:]+): "), F.lit("unknown"))
    seat = F.coalesce(E.found(t, "Sitz: ([^.]+)[.]"), E.found(t, ", ([A-ZÄÖÜ][a-zäöüß]+)[.]"), F.lit("unknown"))
    return _view(spark, folder, NOTICES).select("id", purpose.alias("purpose"), seat.alias("seat"))


_KINDS = (("kapital", "capital"), ("bestellt|ausgeschieden", "officers"), ("aufgelöst|liquidator", "dissolution"), (r"\|", "table"))
_LABELS = {"Kapitalerhöhung": "raise", "Liquidator": "end", "Bestellt als Geschäftsführerin": "hire"}
_PREFIXES = (("Kapital", "capital"), ("Gesch", "officers"))


@query(f"""SELECT id, CASE {' '.join(f"WHEN regexp_matches(lower(txt), {q(p)}) THEN {q(v)}" for p, v in _KINDS)} ELSE 'other' END AS kind,
    CASE {' '.join(f"WHEN split_part(txt, ':', 1) = {q(k)} THEN {q(v)}" for k, v in _LABELS.items())} {' '.join(f"WHEN starts_with(txt, {q(k)}) THEN {q(v)}" for k, v in _PREFIXES)} ELSE 'other' END AS label_type FROM ({NOTICES})""")
def announcement_type(spark: SparkSession, folder: str) -> DataFrame:
    """First matching rule of the text, and the type of the label before the colon, by name or else by how it begins."""
    t = F.col("txt")
    kind, label = F.lit("other"), F.lit("other")
    for pattern, value in reversed(_KINDS):
        kind = F.when(F.lower(t).rlike(pattern), value).otherwise(kind)
    for prefix, value in reversed(_PREFIXES):
        label = F.when(t.startswith(prefix), value).otherwise(label)
    for name, value in reversed(_LABELS.items()):
        label = F.when(F.split_part(t, F.lit(":"), F.lit(1)) == name, value).otherwise(label)
    return _view(spark, folder, NOTICES).select("id", kind.alias("kind"), label.alias("label_type"))
