"""Names that lie in or near other names, the grid of searches, and pages that may be a company's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.websites import website_confidence
from orrery.operators import workgrid
from orrery.operators.linking import contained_names, first_links, overlap_matches
from orrery.operators.similarity import token_set_ratio
from orrery.queries.companies import COMPANIES, FIRST_WORDS, companies, q
from orrery.queries.names import _PERSON, PROFILES, normalize_person
from orrery.queries.registry import query
from orrery.queries.sqltext import indel_sql, letter_masks
from orrery.sources.tables import table

_WORDS = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT person, {_WORDS.format('person')} AS x FROM (SELECT DISTINCT {_PERSON} AS person FROM ({PROFILES})) WHERE person IS NOT NULL), c AS (SELECT name, {_WORDS.format('name')} AS y FROM (SELECT DISTINCT name FROM ({COMPANIES})))
    SELECT person, name FROM p JOIN c ON contains(' ' || y || ' ', ' ' || x || ' ') WHERE x <> ''""")
def founder_in_company(spark: SparkSession, folder: str) -> DataFrame:
    """Names of people that lie in names of companies, whole words in a row."""
    people = normalize_person(spark, folder)
    return contained_names(people, companies(spark, folder).select("name"), "person", "name")


STOP = ("gmbh", "ug", "ag", "se", "kg", "ohg", "co.", "&", "und")  # fixed values: words that say nothing of a company
_LIST = "list_filter(string_split_regex(trim(lower({0})), '\\s+'), lambda w: w <> '')"
_TARGET = "trim(split_part(replace(text, chr(10), ' '), ' ', 1) || ' ' || split_part(replace(text, chr(10), ' '), ' ', 2) || CASE WHEN n_chars % 3 = 0 THEN ' GmbH' ELSE '' END)"


@query(f"""WITH t AS (SELECT target, list_distinct({_LIST.format('target')}) AS w FROM (SELECT DISTINCT {_TARGET} AS target FROM documents) WHERE target <> ''),
    r AS (SELECT lower(name) AS name, min(id) AS id, coalesce(contains(lower(status), 'currently'), false) AS active FROM ({COMPANIES}) WHERE coalesce(NOT contains(lower(status), 'dissolved'), true) GROUP BY ALL),
    l AS (SELECT *, {_LIST.format('name')} AS v FROM r), s AS (SELECT target, name, id, active, w, list_filter(list_intersect(w, v), lambda x: x NOT IN ({', '.join(map(q, STOP))})) AS common FROM t, l WHERE list_has_any(w, v)),
    p AS (SELECT target, id, round(len(common) / len(w) + CASE WHEN contains(name, lower(target)) OR contains(lower(target), name) THEN 0.5 ELSE 0 END + CASE WHEN active THEN 0.1 ELSE 0 END, 4)::DOUBLE AS score FROM s WHERE len(common) > 0)
    SELECT target, id, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, id) AS pos FROM p WHERE score >= 0.4) WHERE pos = 1""")
def register_match(spark: SparkSession, folder: str) -> DataFrame:
    """The entry of the register that fits a mentioned name best; dissolved ones are no entries."""
    docs = table(spark, folder, "documents").selectExpr(f"{FIRST_WORDS} AS text", "n_chars")  # a target is made of these
    docs = docs.selectExpr(f"{_TARGET.replace('chr(10)', 'char(10)')} AS target").filter("target <> ''")
    register = companies(spark, folder).filter(~F.coalesce(F.lower("status").contains("dissolved"), F.lit(False)))
    return overlap_matches(docs, register, "target", F.col("name"), "id", F.lower("status").contains("currently"), STOP)


_PEOPLE = "SELECT lower(trim(p_brand || ' ' || split_part(p_name, ' ', 1))) AS person, p_size / 50.0 AS sure FROM part"
_FIRMS = "SELECT lower(p_brand || CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '' END || split_part(p_name, ' ', 1) || CASE WHEN p_size % 5 = 0 THEN 's' ELSE '' END) AS firm FROM part"


@query(f"""WITH p AS (SELECT person, max(sure) AS sure FROM ({_PEOPLE}) WHERE sure >= 0.5 GROUP BY person), d AS (SELECT DISTINCT person FROM ({_PEOPLE}) WHERE sure >= 0.98 AND person LIKE '%red%'),
    x AS (SELECT person, {letter_masks('person')} AS m FROM p WHERE person NOT IN (SELECT person FROM d)), f AS (SELECT DISTINCT firm FROM ({_FIRMS})), s AS (SELECT person, firm, {indel_sql('m', 'person', 'firm')} AS similarity FROM x, f)
    SELECT person, firm, similarity FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY similarity DESC, firm) AS pos FROM s WHERE similarity >= 0.95) WHERE pos = 1""")
def auto_link(spark: SparkSession, folder: str) -> DataFrame:
    """Links of people who have none to firms of nearly the same name."""
    part = table(spark, folder, "part")
    people, firms = (spark.sql(s.replace("FROM part", "FROM {part}"), part=part) for s in (_PEOPLE, _FIRMS))
    people = people.withColumn("sure", F.col("sure").cast("double"))
    linked = people.filter("sure >= 0.98 AND person LIKE '%red%'").select("person").distinct()
    return first_links(people, firms, "person", "firm", "sure", linked)


# -- the grid of searches ----------------------------------------------------------------------------------------------------
_ATTEMPTS = """SELECT e.event_type AS keyword, r.r_name AS state, e.ts AS at, e.value > 350 AS ok, CAST(floor(e.value) AS BIGINT) AS results
    FROM {events} e LEFT JOIN {customer} c ON e.user_id = c.c_custkey LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey LEFT JOIN {region} r ON n.n_regionkey = r.r_regionkey"""
_D_ATTEMPTS = _ATTEMPTS.replace("{", "").replace("}", "").replace("AS at,", "AS happened,")


@query(f"""WITH k AS (SELECT DISTINCT event_type AS keyword FROM events), g AS (SELECT keyword, NULL AS state, 1 AS phase FROM k UNION ALL SELECT keyword, r_name, 2 FROM k, region UNION ALL SELECT DISTINCT o_orderpriority, NULL, 3 FROM orders),
    a AS (SELECT keyword, state, count(*) AS tries, count(*) FILTER (ok) AS good, max_by(results, (happened, results)) FILTER (ok) AS results FROM ({_D_ATTEMPTS}) GROUP BY keyword, state),
    s AS (SELECT g.*, a.results, CASE WHEN good > 0 THEN 'completed' WHEN tries >= 3 THEN 'failed' ELSE 'open' END AS status FROM g LEFT JOIN a ON g.keyword = a.keyword AND g.state IS NOT DISTINCT FROM a.state)
    SELECT phase, count(*) AS cells, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'open') AS open, coalesce(sum(results), 0)::BIGINT AS results,
      round(100 * count(*) FILTER (status = 'completed') / count(*), 2)::DOUBLE AS percent FROM s GROUP BY phase""")
def grid_status(spark: SparkSession, folder: str) -> DataFrame:
    """Event types everywhere and by region, priorities everywhere; events are the attempts."""
    events, orders, region = (table(spark, folder, t) for t in ("events", "orders", "region"))
    words, more = events.select(F.col("event_type").alias("keyword")), orders.select(F.col("o_orderpriority").alias("keyword"))
    grid = workgrid.cells([(words, None), (words, region.select(F.col("r_name").alias("state"))), (more, None)])
    attempts = spark.sql(_ATTEMPTS, events=events, customer=table(spark, folder, "customer"), nation=table(spark, folder, "nation"), region=region)
    return workgrid.progress(workgrid.attempted(grid, attempts))


# -- pages that may be a company's own -----------------------------------------------------------------------------------------
PARKING, IMPRINTS = ("domain for sale", "track(0)"), ("/impressum", "/the\"", "/des\"")
_H1 = "lower(regexp_extract(html, '<h1>([^<]*)</h1>', 1))"
_PAGES = f"""SELECT page_id, html, trim(translate(regexp_extract({_H1}, '^([^ ]+ [^ ]+)', 1), '.,', '')) AS brand, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www[.]', '') AS host,
    lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))) AS title FROM pages"""
_SET = "list_distinct(string_split_regex(trim({0}), '\\s+'))"
_MINUS = "array_to_string(list_sort(list_filter({0}, lambda w: NOT list_contains({1}, w))), ' ')"


@query(f"""WITH p AS (SELECT *, {_SET.format('brand')} AS x, {_SET.format('title')} AS y FROM ({_PAGES})), s AS (SELECT *, array_to_string(list_sort(list_filter(x, lambda w: list_contains(y, w))), ' ') AS b, {_MINUS.format('x', 'y')} AS dx, {_MINUS.format('y', 'x')} AS dy FROM p),
    l AS (SELECT *, trim(b || ' ' || dx) AS l, trim(b || ' ' || dy) AS r FROM s), r AS (SELECT *, greatest({indel_sql(letter_masks('b'), 'b', 'l')}, {indel_sql(letter_masks('b'), 'b', 'r')}, {indel_sql(letter_masks('l'), 'l', 'r')}) AS ratio FROM l),
    h AS (SELECT *, list_filter(string_split_regex(brand, '[\\s.\\-]+'), lambda w: w <> '') AS words, split_part(host, '.', 1) AS base FROM r)
    SELECT page_id, brand, ratio, round(greatest(0, least(1, CASE WHEN list_has_any(words, string_split(base, '-')) THEN 0.3 WHEN len(list_filter(words, lambda w: length(w) >= 3 AND contains(base, w))) > 0 THEN 0.2 ELSE 0 END
      + CASE WHEN {' OR '.join(f'contains(lower(html), {q(w)})' for w in PARKING)} THEN -0.5 ELSE CASE WHEN ratio >= 0.7 THEN 0.3 WHEN ratio >= 0.5 THEN 0.1 ELSE 0 END + CASE WHEN {' OR '.join(f'contains(lower(html), {q(w)})' for w in IMPRINTS)} THEN 0.2 ELSE 0 END END)), 4)::DOUBLE AS confidence FROM h""")
def website_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Pages beside the first two words of their heading as the brand: the title's token-set ratio, host, parking and imprint."""
    pages = spark.sql(_PAGES.replace("FROM pages", "FROM {pages}"), pages=table(spark, folder, "pages"))
    rows = pages.withColumn("ratio", F.round(token_set_ratio(F.col("brand"), F.col("title")), 4))
    sure = website_confidence(F.col("brand"), F.col("host"), F.col("ratio"), F.col("html"), PARKING, IMPRINTS)
    return rows.select("page_id", "brand", "ratio", sure.alias("confidence"))
