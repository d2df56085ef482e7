"""Scores and rules of companies and news over views that both engines build by the same SQL.

The views make companies, articles and announcements out of the documents' own
words and lengths; the queries parse them again with column expressions, and
the SQL beside each query does so with DuckDB's own functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import lexicon as L
from orrery.functions import scoring as S
from orrery.queries.registry import query
from orrery.sources.tables import spread, table
from orrery.storage import table_path

_FLAT = "replace(text, chr(10), ' ')"
_W1, _W2 = (f"split_part({_FLAT}, ' ', {k})" for k in (1, 2))
#: Spark: a text up to the end of its second word, which has the same first two words without a pass over the rest.
FIRST_WORDS = r"regexp_extract(text, '^[^ \n]*[ \n]?[^ \n]*', 0)"

COMPANIES = f"""SELECT doc_id AS id, text AS purpose, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) * 25 END AS capital,
    CASE n_chars % 8 WHEN 0 THEN {_W1} WHEN 1 THEN {_W1} || ' ' || {_W2} WHEN 2 THEN {_W1} || 'Labs' WHEN 3 THEN 'Smart ' || {_W1}
      WHEN 4 THEN {_W1} || ' Verwaltungs' WHEN 5 THEN 'ABC Holding' WHEN 6 THEN {_W1} || '.ai' ELSE {_W1} || ' Müller & Söhne' END
    || CASE CAST(floor(n_chars / 8) AS INT) % 12 WHEN 0 THEN ' GmbH' WHEN 1 THEN ' UG (haftungsbeschränkt)' WHEN 2 THEN ' GmbH & Co. KG'
      WHEN 3 THEN ' AG' WHEN 4 THEN ' KG' WHEN 5 THEN ' e.V.' WHEN 6 THEN '' WHEN 7 THEN ' SE' WHEN 8 THEN ' 24 gGmbH'
      WHEN 9 THEN ', GmbH & Co. KGaA' WHEN 10 THEN ' ug' ELSE ' Vorrats GmbH' END AS name,
    CASE CAST(floor(n_chars / 96) AS INT) % 8 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'München-Schwabing' WHEN 2 THEN ' Hamburg' WHEN 3 THEN 'Karlsruhe'
      WHEN 4 THEN 'Bad Dresden' WHEN 5 THEN 'Kleinstadt' WHEN 6 THEN '' END AS city,
    CASE n_chars % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'Currently Registered' WHEN 2 THEN 'dissolved' WHEN 3 THEN '' END AS status,
    CASE WHEN n_chars % 9 = 0 THEN 'unknown' ELSE '202' || CAST(n_chars % 5 AS STRING) || '-0' || CAST(1 + n_chars % 9 AS STRING) || '-15' END AS registered
    FROM documents"""


def companies(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "n_chars"))
    names = COMPANIES.replace(_FLAT, _FLAT.replace("text", FIRST_WORDS))
    return spark.sql(names.replace("FROM documents", "FROM {documents}"), documents=docs)


# -- rules as data -----------------------------------------------------------------------------------------------------------
RELEVANCE = L.Lexicon(
    ("this", "from", "for", "anon", "ention", "von", "mit", "für", "être", "avec", "que", "para", "of the", "in the", "und der", "à la"),
    ("ention", "für", "of the"),
    {"AI": ("^the ", f"(^|[^{L.LETTERS}])ai($|[^{L.LETTERS}])"), ".AI": (r"[a-z]\.ai",), "ROBOT": ("onan", "keitung")},
)
CLIMATE = L.Lexicon(("with", "das", "les", "los", "wind", "nicht"), ("das", "los"))
TECH = {"fintech": ("are", "heatre"), "healthtech": ("für", "keiteng"), "general_ai": ("is", "oning"), "robotics": ("eux", "ciónas"), "security": ("idiot", "password")}
DOMAIN = ("general_ai", "robotics")
SECTORS = {"software": ("than", "ver", "eau"), "energy": ("thing", "strom", "énergie"), "trade": ("ander", "keit", "para"), "health": ("heal", "lich", "ment")}
KNOWN = {"energy": ("the", "der"), "trade": ("le", "la")}
FORMS, ESTABLISHED = (("ug", 3), ("ggmbh", 0), ("gmbh & co", -1), ("gmbh", 1), ("se", 1)), (("kg", -2), ("ag", -1), ("e.v.", -3))
PLACES = (("berlin", 3), ("münchen", 3), ("hamburg", 2), ("karlsruhe", 1), ("dresden", 1))
NAME_RULES = (("labs", 3), (r"\.ai($| )", 3), ("^smart ", 2), ("^[a-z]{3,6} ", 1), ("verwaltung", -3), ("holding", -3), ("söhne", -4), ("vorrat", -4), ("[0-9]", -1))
PURPOSE_RULES = (("of the", 2), ("und der", 2), ("that", 1), (r"tion[a-z]* is ", 2), ("que la", 1), (r"[#*$%]{3}", -3), (r" \| ", -2))
TIERS = ((0.0, 1000.0, -1), (1000.0, 12500.0, 1), (12500.0, 25000.0, 0), (25000.0, 100000.0, 2), (100000.0, None, 3))
BRAND_FORMS = (("GmbH & Co. KG", None), ("GmbH & Co. KGaA", None), ("KG", None), ("OHG", None), ("e.V.", None), ("eV", None), ("GbR", None),
               ("UG (haftungsbeschränkt)", 3), ("UG", 3), ("gGmbH", 0), ("GmbH", 2), ("SE", 1), ("AG", 0))
SHELLS, VEHICLES = ("vorrat", "^projekt [0-9]", "(erste|zweite|dritte) "), ("verwaltung", "holding", "invest", "beteiligung")
ENGLISH, ENDINGS = ("smart", "labs", "the", "and", "with", "cloud"), ("ify", "ly", "ion", "eo")
GERMAN, SURNAMES, SURNAME_ENDINGS = ("söhne", "bau", "handel", "keit"), ("müller", "der", "die"), ("mann", "er", "ung")
STATUSES, ALLOWED_FORMS, ALLOWED_CITIES = ("active", "currently registered"), ("GmbH", "UG (haftungsbeschränkt)", "SE", "UG"), ("Berlin", "Karlsruhe", "München-Schwabing", "Kleinstadt")
CUTOFF = "2021-06-01"  # as of 2023-05-22, 24 months of 30 days


# -- the same rules for DuckDB -------------------------------------------------------------------------------------------------
def q(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def d_word(text: str, word: str) -> str:
    return f"regexp_matches(lower({text}), '(^|[^{L.LETTERS}]){word.replace(' ', f'[^{L.LETTERS}]+')}($|[^{L.LETTERS}])')"


def d_any(text: str, patterns: Sequence[str]) -> str:
    return "coalesce(" + " OR ".join(f"regexp_matches(lower({text}), {q(p)})" for p in patterns) + ", false)"


def d_int(condition: str, score: int = 1) -> str:
    return f"CASE WHEN {condition} THEN {score} ELSE 0 END"


def d_relevance(text: str, lex: L.Lexicon) -> str:
    parts = [d_int(d_word(text, k), 2 if k in lex.strong else 1) for k in lex.keywords] + [d_int(d_any(text, p), 2) for p in lex.groups.values()]
    return "(" + " + ".join(parts) + ")"


def d_first(text: str, rules: Sequence[tuple[str, object]], default: object = None) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), {q(p.lower())}) THEN {q(v)}" for p, v in rules) + f" ELSE {q(default)} END"


def d_list(labels: Sequence[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(v)} END" for v, c in labels) + "], lambda x: x IS NOT NULL)"


def d_category(text: str, keywords: Sequence[str]) -> str:
    return " OR ".join(d_word(text, k) if len(k) <= 4 else f"contains(lower({text}), {q(k)})" for k in keywords)


D_TECH = d_list([(k, f"coalesce({d_category('t', w)}, false)") for k, w in TECH.items()])
D_SCORED = f"""SELECT *, {d_relevance('t', RELEVANCE)} AS ai, {d_relevance('t', CLIMATE)} AS climate, {D_TECH} AS tech FROM (
    SELECT *, coalesce(name, '') || ' ' || coalesce(purpose, '') AS t FROM ({COMPANIES}))"""


def described(spark: SparkSession, folder: str) -> DataFrame:
    """Companies with ``t`` (name and purpose), it in lower case as ``w``, ``ai, climate`` and ``tech``."""
    rows = companies(spark, folder).withColumn("t", F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("purpose", F.lit(""))))
    rows = rows.withColumn("w", F.lower(F.col("t")))
    t, w = F.col("t"), F.col("w")
    return rows.withColumns({"ai": L.relevance(t, w, RELEVANCE), "climate": L.relevance(t, w, CLIMATE), "tech": L.categories(t, w, TECH)})


# -- lexicon scores --------------------------------------------------------------------------------------------------------------
@query(f"SELECT id, ai AS score, climate FROM ({D_SCORED})")
def relevance_score(spark: SparkSession, folder: str) -> DataFrame:
    return described(spark, folder).select("id", F.col("ai").alias("score"), "climate")


@query(f"SELECT id, ai + climate >= 8 AS quick FROM ({D_SCORED})")
def quick_filter(spark: SparkSession, folder: str) -> DataFrame:
    return described(spark, folder).select("id", (F.col("ai") + F.col("climate") >= 8).alias("quick"))


@query(f"""SELECT id, array_to_string({d_list([(k, d_word('t', k)) for k in RELEVANCE.keywords] + [(f'[{g}]', d_any('t', p)) for g, p in RELEVANCE.groups.items()]
    + [(f'[climate] {k}', d_word('t', k)) for k in CLIMATE.keywords])}, '|') AS matched FROM ({D_SCORED})""")
def matched_keywords(spark: SparkSession, folder: str) -> DataFrame:
    t, w = F.col("t"), F.col("w")
    found = F.concat(L.matched(t, w, RELEVANCE), L.matched(t, w, CLIMATE, "[climate] "))
    return described(spark, folder).select("id", F.array_join(found, "|").alias("matched"))


@query(f"SELECT id, array_to_string(tech, ',') AS categories FROM ({D_SCORED})")
def categorize_text(spark: SparkSession, folder: str) -> DataFrame:
    return described(spark, folder).select("id", F.array_join("tech", ",").alias("categories"))


@query(f"SELECT id, {' + '.join(d_int(f'contains(lower(t), {q(k)})') for k in RELEVANCE.keywords)} AS hits, coalesce(try_cast(registered AS DATE) >= DATE '{CUTOFF}', false) AS recent FROM ({D_SCORED})")
def substring_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords anywhere in the text, and whether the company is recent."""
    low = F.lower("t")
    hits = L.total([low.contains(k).cast("int") for k in RELEVANCE.keywords])
    recent = F.coalesce(F.col("registered").try_cast("date") >= F.lit(CUTOFF).cast("date"), F.lit(False))
    return described(spark, folder).select("id", hits.alias("hits"), recent.alias("recent"))


_SECTOR = {k: " + ".join([d_int(f"contains(lower(purpose), {q(w)})") for w in words] + [d_int(f"split_part(lower(name), ' ', 1) = {q(n)}", 3) for n in KNOWN.get(k, ())]) for k, words in SECTORS.items()}
_BEST = f"greatest({', '.join(SECTORS)})"
_CLASSIFIED = f"""SELECT id, CASE WHEN {_BEST} < 1 THEN NULL {' '.join(f"WHEN {k} = {_BEST} THEN {q(k)}" for k in SECTORS)} END AS label, {_BEST} AS best, {', '.join(SECTORS)},
    contains(lower(purpose), 'for the') AS b2b FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _SECTOR.items())} FROM ({COMPANIES}))"""


def _sectors(spark: SparkSession, folder: str) -> DataFrame:
    low, first = F.lower("purpose"), F.split_part(F.lower("name"), F.lit(" "), F.lit(1))
    rows = companies(spark, folder)
    for k, words in SECTORS.items():
        known = [F.when(first == n, 3).otherwise(0) for n in KNOWN.get(k, ())]
        rows = rows.withColumn(k, L.total([F.coalesce(low.contains(w).cast("int"), F.lit(0)) for w in words] + known))
    best = F.greatest(*SECTORS)
    label = F.lit(None).cast("string")
    for k in reversed(list(SECTORS)):
        label = F.when(F.col(k) == best, k).otherwise(label)
    return rows.select("id", F.when(best >= 1, label).alias("label"), best.alias("best"), *SECTORS, low.contains("for the").alias("b2b"))


@query(f"""SELECT id, label, round(least(1.0, best / 5.0), 4) AS confidence, b2b,
    array_to_string({d_list([(k, f"{k} >= 2 AND label <> '{k}'") for k in SECTORS])}, ',') AS others FROM ({_CLASSIFIED})""")
def sector_classify(spark: SparkSession, folder: str) -> DataFrame:
    others = F.array_compact(F.array(*[F.when((F.col(k) >= 2) & (F.col("label") != k), k) for k in SECTORS]))
    return _sectors(spark, folder).select("id", "label", F.round(F.least(F.lit(1.0), F.col("best") / 5.0), 4).alias("confidence"), "b2b", F.array_join(others, ",").alias("others"))


@query(f"SELECT coalesce(label, '(none)') AS sector, count(*) AS n, CAST(sum(CASE WHEN b2b THEN 1 ELSE 0 END) AS BIGINT) AS b2b_n, max(best) AS best FROM ({_CLASSIFIED}) GROUP BY coalesce(label, '(none)')")
def sector_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = _sectors(spark, folder).groupBy(F.coalesce("label", F.lit("(none)")).alias("sector"))
    return rows.agg(F.count("*").alias("n"), F.count_if("b2b").alias("b2b_n"), F.max("best").alias("best"))


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^a-zäöüßàâçéèêëîïôûùñóíúáœ]+'), lambda x: x <> '')"


@query(f"""WITH c AS (SELECT lang, keyword, count(*) AS n FROM (SELECT DISTINCT doc_id, lang, unnest({_TOK}) AS keyword FROM documents WHERE lang IS NOT NULL) GROUP BY lang, keyword),
    top AS (SELECT lang, keyword, row_number() OVER (PARTITION BY lang ORDER BY n DESC, keyword) AS pos FROM c),
    k AS (SELECT * FROM top WHERE pos <= 40 AND pos > 2), banned AS (SELECT DISTINCT keyword FROM top WHERE pos <= 2)
    SELECT category, keyword, priority FROM (SELECT lang AS category, keyword, CASE lang WHEN 'de' THEN 1 WHEN 'fr' THEN 3 ELSE 2 END AS priority,
      row_number() OVER (PARTITION BY keyword ORDER BY CASE lang WHEN 'de' THEN 1 WHEN 'fr' THEN 3 ELSE 2 END, lang) AS r FROM k WHERE keyword NOT IN (SELECT keyword FROM banned)) WHERE r = 1""")
def lexicon_load(spark: SparkSession, folder: str) -> DataFrame:
    """A lexicon of each language's frequent words, written as JSON lines and loaded by priority, without excluded words."""
    docs = table(spark, folder, "documents").filter("lang IS NOT NULL")
    words = F.filter(F.split(F.lower("text"), "[^a-zäöüßàâçéèêëîïôûùñóíúáœ]+"), lambda t: t != "")
    counts = docs.select("lang", F.explode(F.array_distinct(words)).alias("keyword")).groupBy("lang", "keyword").agg(F.count("*").alias("n"))
    pos = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "keyword"))
    top = counts.withColumn("pos", pos).filter("pos <= 40")
    lists = [F.collect_list(F.when(c, F.col("keyword"))).alias(n) for n, c in (("keywords", F.col("pos") > 2), ("exclude", F.col("pos") <= 2))]
    priority = F.when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 3)
    where = table_path(spark, "lexicon")
    top.groupBy(F.col("lang").alias("category"), priority.alias("priority")).agg(*lists).write.json(where)
    return L.read_lexicon(spark, where)


# -- composite scores ------------------------------------------------------------------------------------------------------------
_FORM = "CASE " + " ".join(f"WHEN contains(lower(name), {q(f.lower())}) THEN {q(f)}" for f in S.LEGAL_FORMS) + " END"


@query(f"SELECT id, {_FORM} AS form FROM ({COMPANIES})")
def legal_form(spark: SparkSession, folder: str) -> DataFrame:
    return companies(spark, folder).select("id", S.legal_form(F.col("name")).alias("form"))


_BRAND = f"CASE WHEN form IS NULL THEN trim(name) ELSE trim(replace(trim(rtrim(trim(replace(name, form, '')), '&-,')), '(haftungsbeschränkt)', '')) END"
_BRANDED = f"SELECT *, {_BRAND} AS brand FROM (SELECT *, {_FORM} AS form FROM ({COMPANIES}))"


@query(f"SELECT id, brand FROM ({_BRANDED})")
def brand_part(spark: SparkSession, folder: str) -> DataFrame:
    return _brands(spark, folder).select("id", "brand")


def _brands(spark: SparkSession, folder: str) -> DataFrame:
    rows = companies(spark, folder).withColumn("form", S.legal_form(F.col("name")))
    return rows.withColumn("brand", S.brand_part(F.col("name"), F.col("form")))


def _pattern_sum(text: str, rules) -> str:
    return "(" + " + ".join(d_int(f"regexp_matches(lower({text}), {q(p)})", s) for p, s in rules) + ")"


def _tiers(amount: str) -> str:
    return "CASE " + " ".join(f"WHEN {amount} >= {low}" + (f" AND {amount} < {high}" if high else "") + f" THEN {s}" for low, high, s in TIERS) + " ELSE 0 END"


_STARTUPS = f"""SELECT *, form_score + place_score + name_score + purpose_score + capital_score + bonus AS score FROM (
    SELECT id, coalesce({d_first('form', (*FORMS, *ESTABLISHED))}, 0) AS form_score, coalesce({d_first('city', PLACES)}, 0) AS place_score, {_pattern_sum('name', NAME_RULES)} AS name_score,
      greatest(-3, least(5, {_pattern_sum('purpose', PURPOSE_RULES)})) AS purpose_score, {_tiers('capital')} AS capital_score,
      CASE WHEN ai + climate >= 12 THEN 2 WHEN ai + climate >= 10 THEN 1 ELSE 0 END AS bonus, ai + climate - 8 AS relevance, len(tech) > 2 AS known FROM (SELECT *, {_FORM} AS form FROM ({D_SCORED})))"""
_CLASS = """CASE WHEN (score >= 5 AND (relevance >= 1 OR known)) OR (score >= 3 AND relevance >= 2 AND known) OR (relevance >= 4 AND score >= 2)
    OR (score >= 7 AND name_score >= 3) OR (purpose_score >= 3 AND score >= 4) THEN 'startup'
    WHEN (score >= 3 AND (relevance >= 1 OR known)) OR known OR (relevance >= 1 AND score >= 1) OR (score >= 6 AND name_score >= 1) THEN 'scaleup' ELSE 'established' END"""


def _startups(spark: SparkSession, folder: str) -> DataFrame:
    """Relevance and categories are common in these texts, so they count from a level on."""
    rows = described(spark, folder).withColumns(
        {"form": S.legal_form(F.col("name")), "relevance": F.col("ai") + F.col("climate") - 8, "tech": F.size("tech") > 2}
    )
    return S.score_startups(rows, FORMS, ESTABLISHED, PLACES, NAME_RULES, PURPOSE_RULES, TIERS)


_PARTS = "id, form_score, place_score, name_score, purpose_score, capital_score, bonus, score"


@query(f"SELECT {_PARTS} FROM ({_STARTUPS})")
def composite_score(spark: SparkSession, folder: str) -> DataFrame:
    return _startups(spark, folder).select(*_PARTS.split(", "))


@query(f"SELECT id, {_CLASS} AS classification FROM ({_STARTUPS})")
def classify_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _startups(spark, folder).select("id", "classification")


_LOW = "lower(brand)"
_SHELL = f"""CASE WHEN brand IS NULL OR brand = '' THEN 0 {' '.join(f"WHEN regexp_matches({_LOW}, {q(p)}) THEN -8" for p in SHELLS)}
    WHEN regexp_matches(brand, '^[A-Z]{{2,4}} [0-9]+$') THEN -5 WHEN hits >= 2 THEN -6
    WHEN hits = 1 AND len(string_split(brand, ' ')) = 2 AND length(split_part(brand, ' ', 1)) <= 4 AND regexp_matches(brand, '^[A-Z]+ ') THEN -5 WHEN hits = 1 THEN -3
    WHEN regexp_matches(regexp_replace(brand, '[\\s.&-]', '', 'g'), '^[0-9]+$') THEN -8 ELSE 0 END"""
_HITS = " + ".join(d_int(f"contains({_LOW}, {q(w)})") for w in VEHICLES)


@query(f"SELECT id, {_SHELL} AS penalty FROM (SELECT *, {_HITS} AS hits FROM ({_BRANDED}))")
def shell_penalty(spark: SparkSession, folder: str) -> DataFrame:
    return _brands(spark, folder).select("id", S.shell_penalty(F.col("brand"), SHELLS, VEHICLES).alias("penalty"))


_ENGLISH = f"""CASE WHEN length(brand) < 3 THEN 0 WHEN list_has_any(string_split({_LOW}, ' '), [{', '.join(map(q, ENGLISH))}]) THEN 2
    WHEN {' OR '.join(f"contains({_LOW}, {q(w)})" for w in ENGLISH if len(w) >= 4)}
      OR (NOT contains(brand, ' ') AND length(brand) >= 4 AND ({' OR '.join(f"({_LOW} LIKE '%{e}' AND length(brand) > {len(e) + 2})" for e in ENDINGS)})) THEN 1 ELSE 0 END"""
_FIRST = f"split_part({_LOW}, ' ', 1)"
_FOREIGN = f"""CASE WHEN length(brand) < 2 OR {' OR '.join(f"contains({_LOW}, {q(w)})" for w in GERMAN)} OR {_FIRST} IN ({', '.join(map(q, SURNAMES))})
    OR {' OR '.join(f"({_FIRST} LIKE '%{e}' AND length({_FIRST}) >= {len(e) + 2})" for e in SURNAME_ENDINGS)} THEN 0 ELSE 3 END"""
_GATE = "CASE " + " ".join(f"WHEN form = {q(f)} THEN {q(v) if v is not None else -99}" for f, v in BRAND_FORMS) + " ELSE 0 END"


@query(f"""SELECT id, CASE WHEN name IS NULL THEN 0 WHEN gate = -99 THEN -99 ELSE gate + coalesce({d_first('city', PLACES)}, 0) + {_pattern_sum('name', NAME_RULES)} + {_FOREIGN}
    + CASE WHEN NOT contains(brand, ' ') AND length(brand) BETWEEN 3 AND 12 THEN 2 ELSE 0 END + {_SHELL} + {_ENGLISH} END AS score FROM (SELECT *, {_HITS} AS hits, {_GATE} AS gate FROM ({_BRANDED}))""")
def brand_score(spark: SparkSession, folder: str) -> DataFrame:
    """Legal forms that no startup has end it at -99; else the signals of form, place, name, language, length, shells and English add up."""
    brand, gate = F.col("brand"), F.lit(0)
    for form, value in reversed(BRAND_FORMS):
        gate = F.when(F.col("form") == form, -99 if value is None else value).otherwise(gate)
    short = F.when(~brand.contains(" ") & F.length(brand).between(3, 12), 2).otherwise(0)
    parts = [F.coalesce(S.first_part(F.col("city"), PLACES), F.lit(0)), S.pattern_sum(F.col("name"), NAME_RULES), short]
    parts += [S.foreign_signal(brand, GERMAN, SURNAMES, SURNAME_ENDINGS), S.shell_penalty(brand, SHELLS, VEHICLES), S.english_signal(brand, ENGLISH, ENDINGS)]
    rows = _brands(spark, folder).withColumn("gate", gate)
    score = F.when(F.col("name").isNull(), 0).when(F.col("gate") == -99, -99).otherwise(F.col("gate") + L.total(parts))
    return rows.select("id", score.alias("score"))


# -- filters -----------------------------------------------------------------------------------------------------------------------
_DOMAIN = f"len(list_filter(tech, lambda x: x NOT IN ({', '.join(map(q, DOMAIN))})))"


@query(f"""SELECT id, ai_score, climate, CASE WHEN ai_score + climate < 8 THEN 'score' WHEN status <> '' AND lower(status) NOT IN ({', '.join(map(q, STATUSES))}) THEN 'status'
    WHEN city <> '' AND city NOT IN ({', '.join(map(q, ALLOWED_CITIES))}) THEN 'city' WHEN form IS NOT NULL AND form NOT IN ({', '.join(map(q, ALLOWED_FORMS))}) THEN 'legal_form'
    WHEN capital < 12500 THEN 'capital' WHEN try_cast(registered AS DATE) < DATE '{CUTOFF}' THEN 'date' END AS rejection_reason
    FROM (SELECT *, {_FORM} AS form, CASE WHEN ai + climate = 0 THEN CAST({_DOMAIN} AS INT) ELSE ai END AS ai_score FROM ({D_SCORED}))""")
def filter_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered rejections; without any other score each category outside the domain counts 1; unreadable dates pass."""
    other = F.size(F.filter("tech", lambda t: ~t.isin(*DOMAIN)))
    rows = described(spark, folder).withColumn("form", S.legal_form(F.col("name")))
    rows = rows.withColumn("ai_score", F.when(F.col("ai") + F.col("climate") == 0, other).otherwise(F.col("ai")))
    reason = (
        F.when(F.col("ai_score") + F.col("climate") < 8, "score")
        .when((F.col("status") != "") & ~F.lower("status").isin(*STATUSES), "status")
        .when((F.col("city") != "") & ~F.col("city").isin(*ALLOWED_CITIES), "city")
        .when(F.col("form").isNotNull() & ~F.col("form").isin(*ALLOWED_FORMS), "legal_form")
        .when(F.col("capital") < 12500, "capital")
        .when(F.col("registered").try_cast("date") < F.lit(CUTOFF).cast("date"), "date")
    )
    return rows.select("id", "ai_score", "climate", reason.alias("rejection_reason"))


def filtered(rows: DataFrame, *hooks) -> DataFrame:
    """Rows that every hook lets pass; a hook makes a condition of a DataFrame's columns."""
    for hook in hooks:
        keep: Column = hook(rows)
        rows = rows.filter(F.coalesce(keep, F.lit(False)))
    return rows


@query(f"SELECT id, name FROM ({COMPANIES}) WHERE capital > 20000 AND contains(lower(name), 'labs') AND city IS NOT NULL")
def custom_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Filters that the caller gives as functions."""
    hooks = (lambda r: r["capital"] > 20000, lambda r: F.lower(r["name"]).contains("labs"), lambda r: r["city"].isNotNull())
    return filtered(companies(spark, folder), *hooks).select("id", "name")
