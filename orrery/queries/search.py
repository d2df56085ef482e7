"""Queries over the stored full-text index and over dictionaries of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.operators.dictionary import find_names
from orrery.operators.fulltext import build_index, search_prefixes, search_ranked
from orrery.queries.news import NEWS, NOTICES, _view
from orrery.queries.registry import query
from orrery.queries.textual import DOC_TOK, TOK
from orrery.sources.tables import spread, table
from orrery.storage import table_path

_FTS = """SELECT {key}, CAST(len(list_filter(t, lambda x: starts_with(x, 'than'))) + len(list_filter(t, lambda x: starts_with(x, 'er'))) AS BIGINT) AS hits
    FROM (SELECT {key}, {tok} AS t FROM {table}) WHERE len(list_filter(t, lambda x: starts_with(x, 'than'))) > 0 AND len(list_filter(t, lambda x: starts_with(x, 'er'))) > 0"""


def _index(spark: SparkSession, folder: str, name: str, key: str, stems: bool = False):
    return build_index(spread(table(spark, folder, name).select(key, "text")), key, F.col("text"), table_path(spark, f"index-{name}"), stems)


@query(_FTS.format(key="doc_id", tok=DOC_TOK, table="documents"))
def fts_prefix_search(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that have a word beginning with each query word, from the index's postings."""
    return search_prefixes(_index(spark, folder, "documents", "doc_id"), "than er*").withColumnRenamed("key", "doc_id")


@query(f"""SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM ({_FTS.format(key='doc_id', tok=DOC_TOK, table='documents')})
    UNION SELECT item_id FROM ({_FTS.format(key='item_id', tok=DOC_TOK, table='benchmark')}))""")
def fts_union_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose ids either of two indexes finds."""
    found = [search_prefixes(_index(spark, folder, t, k), "than er").select(F.col("key").alias("doc_id")) for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))]
    return table(spark, folder, "documents").join(found[0].union(found[1]).distinct(), "doc_id", "left_semi").select("doc_id", "lang")


@query(f"""WITH t AS (SELECT doc_id, {DOC_TOK} AS w FROM documents), n AS (SELECT count(DISTINCT doc_id) AS texts, sum(coalesce(len(w), 0)) / count(DISTINCT doc_id) AS mean FROM t),
    p AS (SELECT term, doc_id, count(*) AS tf, max(length) AS length FROM (SELECT doc_id, unnest(w) AS term, len(w) AS length FROM t) WHERE term IN ('than', 'er', 'the') GROUP BY term, doc_id),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT doc_id, round(sum(ln(1 + (texts - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM p JOIN f ON p.term = f.term, n GROUP BY doc_id)
    SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 50""")
def fts_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best texts for three words, by BM25."""
    return search_ranked(_index(spark, folder, "documents", "doc_id"), "than er the", 50).withColumnRenamed("key", "doc_id")


@query()
def fts_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best texts by the stems of the words asked for."""
    return search_ranked(_index(spark, folder, "documents", "doc_id", stems=True), "ering thes", 50, stemmed=True).withColumnRenamed("key", "doc_id")


@query("""SELECT d.doc_id, w AS word FROM documents d, (VALUES ('idiot'), ('scum'), ('trash'), ('loser')) v(w) WHERE list_contains(list_filter(regexp_split_to_array(lower(d.text), '[^a-z0-9]+'), lambda x: x <> ''), w)""")
def dictionary_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that hold a word of a list."""
    terms = spark.createDataFrame([(w,) for w in ("idiot", "scum", "trash", "loser")], "word string")
    found = find_names(table(spark, folder, "documents"), "doc_id", F.col("text"), terms, "word", "word", longest=False)
    return found.select("doc_id", F.col("name_id").alias("word")).distinct()


@query(f"""WITH b AS (SELECT {TOK.format('text')} AS w FROM benchmark), n AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS name FROM b WHERE len(w) > 2),
    t AS (SELECT doc_id, {DOC_TOK} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS name FROM t WHERE len(w) > 2)
    SELECT g.doc_id, g.name, count(*) AS n FROM g JOIN n ON g.name = n.name GROUP BY g.doc_id, g.name""")
def dictionary_names(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of three words of the benchmark, thousands of names, counted in all documents in one pass."""
    names = table(spark, folder, "benchmark").select(F.explode(X.ngrams(X.tokens(F.col("text")), 3)).alias("name")).distinct()
    found = find_names(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", F.col("text"), names, "name", "name", longest=False)
    return found.groupBy("doc_id", F.col("name_id").alias("name")).agg(F.count("*").alias("n"))


INVESTORS = (
    ("Alpha Capital", "Alpha Capital", "name"), ("Beta Ventures", "Beta Ventures", "name"), ("Gamma", "Gamma", "alias"), ("Delta Partners", "Delta Partners", "name"),
    ("Omega Fund", "Omega Fund", "name"), ("Omega Fund", "Omega", "alias"), ("Sigma Ventures", "Sigma Ventures", "name"), ("Sigma Ventures", "Eva Stein-Wolf", "partner"),
    ("Alpha Capital", "Max von Berg", "partner"), ("Delta Partners", "Lena Öz", "partner"),
)
SURE = {"name": 0.9, "alias": 0.7, "partner": 0.5}
_WORDS = "' ' || array_to_string({}, ' ') || ' '"
_LISTED = ", ".join(f"('{a}', '{b}', '{k}', {SURE[k]})" for a, b, k in INVESTORS)


@query(f"""WITH v(investor, said, kind, sure) AS (VALUES {_LISTED}), s AS (SELECT id, 'news' AS origin, {_WORDS.format(TOK.format('t'))} AS w FROM ({NEWS}) WHERE t IS NOT NULL
      UNION ALL SELECT id, 'notice', {_WORDS.format(TOK.format('txt'))} FROM ({NOTICES}) WHERE txt IS NOT NULL),
    h AS (SELECT id, origin, investor, kind, sure FROM s JOIN v ON contains(s.w, {_WORDS.format(TOK.format('v.said'))}))
    SELECT id, investor, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, max(sure)::DOUBLE AS confidence FROM h GROUP BY id, investor""")
def investor_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Investors in news and notices by name, alias or a partner's name; the surest kind decides."""
    listed = spark.createDataFrame([(f"{a}|{k}|{b}", b) for a, b, k in INVESTORS], "id string, said string")
    texts = _view(spark, folder, NEWS).select("id", F.lit("news").alias("origin"), F.col("t").alias("said"))
    texts = texts.unionByName(_view(spark, folder, NOTICES).select("id", F.lit("notice").alias("origin"), F.col("txt").alias("said")))
    texts = texts.select(F.concat_ws("|", "id", "origin").alias("key"), "said")
    found = find_names(texts, "key", F.col("said"), listed, "id", "said", longest=False)
    of, by = F.split("key", r"\|"), F.split("name_id", r"\|")
    sure = F.create_map(*[F.lit(x) for pair in SURE.items() for x in pair])
    hits = found.select(of[0].cast("long").alias("id"), of[1].alias("origin"), by[0].alias("investor"), by[1].alias("kind"))
    return hits.groupBy("id", "investor").agg(
        F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max(sure[F.col("kind")]).alias("confidence")
    )
