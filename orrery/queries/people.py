"""People and headlines: tags, confidence, company names by all forms, and the age of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import headlines as H
from orrery.functions import people as P
from orrery.queries.companies import _FLAT, _W1, _W2, d_int, q
from orrery.queries.registry import query
from orrery.sources.tables import spread, table

# -- people ----------------------------------------------------------------------------------------------------------------------
PEOPLE = f"""SELECT doc_id AS id, CASE n_chars % 6 WHEN 0 THEN NULL WHEN 1 THEN {_W1} || ' - ' || {_W2} ELSE {_W1} || ' ' || {_W2} END AS name,
    CASE n_chars % 5 WHEN 0 THEN 'Berlin, Deutschland' WHEN 1 THEN 'Greater Munich Area' WHEN 2 THEN 'Zürich' WHEN 3 THEN 'Lyon' END AS location,
    CASE n_chars % 13 WHEN 0 THEN 'Co-Founder & CTO | ex-Google | ' || {_W1} WHEN 1 THEN 'CEO, ex-Zalando Director, stealth mode' WHEN 2 THEN 'Geschäftsführer bei ' || {_W1} WHEN 3 THEN NULL WHEN 4 THEN ''
      WHEN 5 THEN 'Building something new in fintech; ex-Sequoia Scouts, ex-BCG' WHEN 6 THEN 'angel investor' WHEN 7 THEN 'Head of Robotics at ' || {_W1} || ', ex-' || {_W2}
      WHEN 8 THEN 'Serial founder, looking for co-founder, pre-seed' WHEN 9 THEN {_FLAT} WHEN 10 THEN 'Engineer' WHEN 11 THEN 'left ' || {_W1} || ' to start a health startup; hiring, first customers'
      ELSE 'ex-McKinsey, ex-N26 and ex-Meta Platforms' END AS headline FROM documents"""
RULES = P.TagRules(
    places=(("berlin", "berlin"), ("münchen|munich|bayern", "munich"), ("zürich|zurich", "zurich"), ("schweiz|switzerland", "switzerland"), ("deutschland|germany", "germany_other")),
    roles=((P.whole("co-?founder|mitgründer"), "co-founder"), (P.whole("cto"), "cto"), (P.whole("ceo|geschäftsführer"), "ceo"), (P.whole("founder|gründer|founding"), "founder"),
           (P.whole("investor|venture"), "investor"), (P.whole("engineer|developer"), "engineer"), (P.whole("director|head of|manager"), "executive")),
    tiers=(("faang", ("google", "meta", "amazon"), 0), ("unicorn", ("zalando", "n26"), 4), ("top_vc", ("sequoia",), 4), ("consulting", ("mckinsey", "bcg"), 4)),
    sectors=((P.whole("fintech|payments"), "fintech"), (P.whole("health|medtech"), "health"), (P.whole("robot|robotics"), "robotics")),
    confirmed=P.whole("stealth"), likely=P.whole("something new|pre-seed|next chapter"),
)
SIGNALS = {"stealth": ("something new", "pre-seed", "next chapter", "coming soon"), "transition": ("left", "ex-", "former"), "repeat": ("serial",), "founder": ("founder", "gründer", "ceo"),
           "background": ("mckinsey", "google"), "cofounder": ("looking for co-founder",), "urgency": ("hiring", "pre-seed", "now"), "traction": ("customers", "revenue")}
CITIES, COUNTRIES = ("berlin", "munich", "zürich"), ("deutschland", "germany", "schweiz")


def people(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    return spark.sql(PEOPLE.replace("FROM documents", "FROM {documents}"), documents=docs)


def _case(text: str, rules, last: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(p)}) THEN {q(v)}" for p, v in rules) + f" ELSE {last} END"


def _tier(names, inside: int) -> str:
    return "len(list_filter(e, lambda c: " + " OR ".join(f"contains(c, {q(n)})" if len(n) >= inside else f"c = {q(n)}" for n in names) + ")) > 0"


_TIER = "CASE " + " ".join(f"WHEN {_tier(names, inside)} THEN {q(label)}" for label, names, inside in RULES.tiers) + " WHEN len(e) > 0 THEN 'other' END"
_D_PEOPLE = f"""SELECT *, lower(coalesce(headline, '')) AS h, list_filter(coalesce(regexp_extract_all(lower(headline), {q(P.employer_pattern(RULES.titles))}, 1), []), lambda c: length(c) > 1) AS e0 FROM ({PEOPLE})"""
_D_PEOPLE = f"SELECT *, list_filter(e0, lambda c, i: list_position(e0, c) = i) AS e FROM ({_D_PEOPLE})"


@query(f"""SELECT id, CASE WHEN coalesce(location, '') <> '' THEN {_case('lower(location)', RULES.places, "'other'")} END AS region, {_case('h', RULES.roles, "'other'")} AS role, array_to_string(e, '|') AS employers, {_TIER} AS tier,
    array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(h, {q(p)}) THEN {q(v)} END' for p, v in RULES.sectors)}], lambda x: x IS NOT NULL), '|') AS sectors,
    CASE WHEN regexp_matches(h, {q(RULES.confirmed)}) THEN 'confirmed' WHEN regexp_matches(h, {q(RULES.likely)}) THEN 'likely' ELSE 'weak' END AS strength,
    CASE WHEN name IS NULL OR length(name) < 2 OR contains(name, ' - ') OR length(name) > 80 THEN 'junk' WHEN headline IS NULL OR headline = '' THEN 'partial' WHEN length(headline) > 180 THEN 'junk' WHEN length(headline) < 10 THEN 'partial' ELSE 'clean' END AS quality
    FROM ({_D_PEOPLE})""")
def person_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Region, role, earlier employers and their tier, sectors, strength and quality of each profile."""
    tags = P.person_tags(F.col("name"), F.col("headline"), F.col("location"), RULES)
    tags |= {c: F.array_join(tags[c], "|") for c in ("employers", "sectors")}
    return people(spark, folder).select("id", *[c.alias(n) for n, c in tags.items()])


def _n(words) -> str:
    return "(" + " + ".join(d_int(f"contains(h, {q(w)})") for w in words) + ")"


_LEVEL = "CASE tier WHEN 'faang' THEN 4 WHEN 'unicorn' THEN 3 WHEN 'top_vc' THEN 2 WHEN 'consulting' THEN 2 WHEN 'other' THEN 1 ELSE 0 END"
_COUNTS = {name: _n(words) for name, words in SIGNALS.items()} | {"tier": f"({_LEVEL})"}
_PARTS = " + ".join(f"least({most}, {' + '.join(f'least({cap}, {_COUNTS[s]} * {each})' for s, each, cap in parts)})" for most, parts in P.CONFIDENCE)
_AT = lambda words: " OR ".join(f"contains(lower(location), {q(w)})" for w in words)


@query(f"""SELECT id, round(least(1, CASE WHEN contains(h, 'stealth') THEN 0.25 ELSE least(0.15, {_COUNTS['stealth']} * 0.05) END + {_PARTS} + CASE WHEN {_AT(COUNTRIES)} THEN 0.08 WHEN {_AT(CITIES)} THEN 0.10 ELSE 0 END), 4)::DOUBLE AS confidence
    FROM (SELECT *, {_TIER} AS tier FROM ({_D_PEOPLE}))""")
def profile_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Five capped tiers of signals over whole headlines."""
    rows = people(spark, folder).withColumn("tier", P.employer_tier(P.employers(F.col("headline"), RULES), RULES)).withColumn("level", F.expr(_LEVEL))
    return rows.select("id", P.profile_confidence(F.col("headline"), F.col("location"), F.col("level"), SIGNALS, CITIES, COUNTRIES).alias("confidence"))


# -- headlines -------------------------------------------------------------------------------------------------------------------
_N = "CAST(1 + n_chars % 90 AS STRING)"
HEADLINES = f"""SELECT doc_id AS id, CASE n_chars % 14 WHEN 0 THEN {_W1} || ': Series A' WHEN 1 THEN {_W1} || ' sichert sich ' || {_N} || ' Mio' WHEN 2 THEN 'Jetzt hat ' || {_W1} || ' endlich ' || {_N} || ' Mio geschlossen'
    WHEN 3 THEN {_W1} || ' haben ' || {_N} || ' Mio eingesammelt' WHEN 4 THEN {_W1} || ' nabs $' || {_N} || 'm' WHEN 5 THEN 'Berlin-based ' || {_W1} || ' secures ' || {_N} WHEN 6 THEN 'Das Medtech ' || {_W1}
    WHEN 7 THEN 'Gründer-Team von ' || {_W1} WHEN 8 THEN 'Finanzierung für ' || {_W1} || ' wird' WHEN 9 THEN 'Fonds investiert bei ' || {_W1} WHEN 10 THEN {_W1} || ' receives €' || {_N} || ' million' WHEN 11 THEN {_FLAT}
    WHEN 12 THEN 'Unbekannt erhält 2; Startup ' || {_W1} END AS t FROM documents"""
NO_COMPANY = ("unknown", "unbekannt", "der", "die", "das", "the", "jetzt", "fonds")


def _cleaned(pattern: str) -> str:
    return f"regexp_replace(trim(nullif(regexp_extract(t, {q(pattern)}, 1), '')), {q(H.TRAIL)}, '')"


@query(f"""SELECT id, list_filter(names, lambda n: length(n) >= 2 AND lower(n) NOT IN ({', '.join(map(q, (*NO_COMPANY, *H.TRAILING)))}))[1] AS company FROM (SELECT id, [{', '.join(_cleaned(p) for p in H.name_patterns())}] AS names FROM ({HEADLINES}))""")
def headline_company(spark: SparkSession, folder: str) -> DataFrame:
    """The company of a headline by eleven forms, the first that leaves a plausible name."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "n_chars"))
    rows = spark.sql(HEADLINES.replace("FROM documents", "FROM {documents}"), documents=docs)
    return rows.select("id", H.headline_company(F.col("t"), NO_COMPANY).alias("company"))


_DAY, _CLOCK = "substr(CAST(ts AS STRING), 1, 10)", "substr(CAST(ts AS STRING), 12, 8)"
_RFC = f"'Mon, ' || substr({_DAY}, 9, 2) || ' ' || split_part('Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec', ' ', CAST(month(ts) AS INT)) || ' ' || substr({_DAY}, 1, 4) || ' ' || {_CLOCK}"
DATED = f"""SELECT event_id, CASE CAST(floor(value) AS BIGINT) % 8 WHEN 0 THEN {_RFC} || ' +0100' WHEN 1 THEN {_RFC} || ' GMT' WHEN 2 THEN {_DAY} || 'T' || {_CLOCK} || '+01:00' WHEN 3 THEN {_DAY} || 'T' || {_CLOCK} || 'Z'
    WHEN 4 THEN ' ' || {_DAY} || ' ' || {_CLOCK} WHEN 5 THEN {_DAY} WHEN 6 THEN 'yesterday' END AS shown FROM events"""
_READ = """CASE WHEN regexp_matches(s, '^[A-Z][a-z]{2}, ') THEN try_strptime(substr(s, 6, 20), '%d %b %Y %H:%M:%S') WHEN regexp_matches(s, '^[0-9-]{10}T') THEN try_strptime(substr(s, 1, 19), '%Y-%m-%dT%H:%M:%S')
    WHEN length(s) = 19 THEN try_strptime(s, '%Y-%m-%d %H:%M:%S') WHEN length(s) = 10 THEN try_strptime(s, '%Y-%m-%d') END"""


@query(f"""SELECT event_id, strftime(dated, '%Y-%m-%d %H:%M:%S') AS dated, coalesce(dated < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY, false) AS too_old FROM (SELECT event_id, {_READ} AS dated FROM (SELECT event_id, trim(shown) AS s FROM ({DATED})))""")
def article_age(spark: SparkSession, folder: str) -> DataFrame:
    """Dates in six forms and whether they are more than a week old; others are kept."""
    rows = spark.sql(DATED.replace("FROM events", "FROM {events}"), events=table(spark, folder, "events"))
    old = H.too_old(F.col("shown"), F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return rows.select("event_id", F.date_format(H.feed_date(F.col("shown")), "yyyy-MM-dd HH:mm:ss").alias("dated"), old.alias("too_old"))
