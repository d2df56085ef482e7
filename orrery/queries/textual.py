"""Text scoring, extraction and normalisation over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.queries.registry import query
from orrery.sources.tables import table

TOK = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
DOC_TOK = TOK.format("text")




# -- numbers and amounts written out ---------------------------------------------------------------------------------
def _german(price):
    """1234.5 as 1.234,50."""
    us = F.format_number(price, 2)
    return F.translate(us, ",.", ".,")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS amount FROM orders")
def german_number(spark: SparkSession, folder: str) -> DataFrame:
    text = _german(F.col("o_totalprice"))
    return table(spark, folder, "orders").select("o_orderkey", F.round(X.german_number(text), 2).alias("amount"))


# -- names, urls, tags -------------------------------------------------------------------------------------------------
@query("SELECT s_suppkey, lower(replace(s_name, '#', ' ')) AS name FROM supplier")
def normalize_name(spark: SparkSession, folder: str) -> DataFrame:
    noisy = F.concat("s_name", F.element_at(F.array(F.lit(" GmbH"), F.lit(", Inc."), F.lit(" Co. KG"), F.lit("")), (F.col("s_suppkey") % 4 + 1).cast("int")))
    return table(spark, folder, "supplier").select("s_suppkey", X.normalize_name(noisy).alias("name"))


@query("SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS host FROM pages")
def normalize_url(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", X.host_of(F.col("url")).alias("host"))


@query("SELECT p_partkey, replace(p_name, ' ', '-') AS tag FROM part")
def normalize_tag(spark: SparkSession, folder: str) -> DataFrame:
    noisy = F.concat(F.lit(" "), F.upper("p_name"), F.lit("s "))
    return table(spark, folder, "part").select("p_partkey", X.normalize_tag(noisy).alias("tag"))


@query("SELECT p_partkey, p_name || ' | ' || p_brand || ' | ' || p_type AS assembled FROM part")
def text_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """Parts joined once each; a part equal to an earlier one in its first 80 lower-case characters is dropped."""
    parts = F.array("p_name", "p_brand", F.upper("p_name"), "p_type", F.lit(""))
    key = lambda x: F.lower(F.substring(x, 1, 80))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when((x == "") | F.exists(out, lambda y: key(y) == key(x)), out).otherwise(F.array_append(out, x)))
    return table(spark, folder, "part").select("p_partkey", F.array_join(kept, " | ").alias("assembled"))


@query(f"""SELECT p_partkey, array_to_string(t, ' ') AS words, CAST(len(t) AS INT) AS n, CASE WHEN len(t) >= 2 THEN t[1] || ' ' || t[2] ELSE '' END AS bigrams FROM (SELECT p_partkey, {TOK.format('p_name')} AS t FROM part)""")
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", X.tokens(F.col("p_name")).alias("t"))
    return part.select("p_partkey", F.array_join("t", " ").alias("words"), F.size("t").alias("n"), F.array_join(X.ngrams(F.col("t"), 2), "|").alias("bigrams"))


@query("SELECT o_orderkey, year(o_orderdate) AS yr FROM orders")
def derive_year(spark: SparkSession, folder: str) -> DataFrame:
    """Cohort labels with four or two digits; two digits below 60 belong to this century."""
    label = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Batch "), F.year("o_orderdate"))).otherwise(F.concat(F.lit("W"), F.date_format("o_orderdate", "yy")))
    orders = table(spark, folder, "orders").select("o_orderkey", label.alias("t"))
    four = F.nullif(F.regexp_extract("t", r"((?:19|20)\d\d)", 1), F.lit("")).cast("int")
    two = F.nullif(F.regexp_extract("t", r"^[WSF](\d\d)$", 1), F.lit("")).cast("int")
    return orders.select("o_orderkey", F.coalesce(four, F.when(two < 60, two + 2000).otherwise(two + 1900)).alias("yr"))


@query("SELECT lang, CAST(count(*) AS VARCHAR) || ' texts in ' || lang AS label FROM documents GROUP BY lang")
def cluster_label(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.concat("n", F.lit(" texts in "), "lang").alias("label"))


@query("SELECT doc_id, md5(source || '|' || text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(F.concat("source", F.lit("|"), "text").cast("binary")).alias("content_hash"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '' ELSE event_type END AS items FROM events")
def coerce_array(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON array, a scalar or nothing as an array."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), "event_type", F.lit('"]'))).when(F.col("event_id") % 3 == 1, F.col("event_type"))
    events = table(spark, folder, "events").select("event_id", raw.alias("raw"))
    listed = F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")).when(F.col("raw").isNotNull(), F.array("raw")).otherwise(F.array().cast("array<string>"))
    return events.select("event_id", F.array_join(listed, ",").alias("items"))


# -- pages and records ---------------------------------------------------------------------------------------------------
@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1,
    regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def page_enrich(spark: SparkSession, folder: str) -> DataFrame:
    def first(pattern: str):
        return F.regexp_extract("html", pattern, 1)

    return table(spark, folder, "pages").select("page_id", first("<title>([^<]*)</title>").alias("title"), first("<h1>([^<]*)</h1>").alias("h1"), first('<html lang="([a-z]+)"').alias("lang"))


@query("""SELECT page_id, contains(html, '<script>') AS scripted, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INT) AS links,
    array_to_string(list_slice(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1, 3), ' ') AS first_links FROM pages""")
def page_keywords(spark: SparkSession, folder: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, folder, "pages").select("page_id", F.col("html").contains("<script>").alias("scripted"), F.size(links).alias("links"), F.array_join(F.slice(links, 1, 3), " ").alias("first_links"))


@query("""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n_chars FROM pages""")
def html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.length(X.strip_html(F.col("html"))).cast("long").alias("n_chars"))


@query("""SELECT c_custkey, 'Main St ' || c_custkey AS street, lpad(CAST(10000 + c_nationkey AS VARCHAR), 5, '0') AS zip, 'City' || c_nationkey AS city FROM customer""")
def address_parse(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat(F.lit("Main St "), "c_custkey", F.lit(", "), F.col("c_nationkey") + 10000, F.lit(" City"), "c_nationkey")
    rows = table(spark, folder, "customer").select("c_custkey", F.split(line, ", ").alias("p"))
    last = F.element_at("p", -1)
    return rows.select("c_custkey", F.get("p", F.lit(0)).alias("street"), F.regexp_extract(last, r"^(\d{5})\s+(.+)$", 1).alias("zip"), F.regexp_extract(last, r"^(\d{5})\s+(.+)$", 2).alias("city"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'HRB' WHEN 1 THEN 'HRA' ELSE NULL END AS kind, CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey END AS number FROM supplier""")
def native_number_parse(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("Court "), F.element_at(F.array(F.lit("hrb "), F.lit("HRA "), F.lit("none ")), (F.col("s_suppkey") % 3 + 1).cast("int")), "s_suppkey")
    rows = table(spark, folder, "supplier").select("s_suppkey", text.alias("t"))
    number = F.nullif(F.regexp_extract("t", r"(?i)hr[ab] (\d+)", 1), F.lit("")).cast("long")
    return rows.select("s_suppkey", X.first_match(F.col("t"), (("(?i)hrb", "HRB"), ("(?i)hra", "HRA"))).alias("kind"), number.alias("number"))


@query("""SELECT o_custkey, min(o_orderdate) AS registered, count(*) AS n FROM orders GROUP BY o_custkey""")
def min_nested_date(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("registered"), F.count("*").alias("n"))


@query("""SELECT event_type, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS high_water FROM events GROUP BY event_type""")
def json_watermark(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, folder, "events").groupBy("event_type").agg(F.max(k).alias("high_water"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed, o_orderkey % 17 = 0 OR o_orderdate >= TIMESTAMP '1998-01-01' AS kept FROM orders""")
def multi_format_date(spark: SparkSession, folder: str) -> DataFrame:
    """Dates written in three ways; what cannot be parsed is kept."""
    ways = ("yyyy-MM-dd", "dd.MM.yyyy", "yyyy/MM/dd")
    shown = F.when(F.col("o_orderkey") % 17 == 0, "soon")
    for k, way in enumerate(ways):
        shown = shown.when(F.col("o_orderkey") % 3 == k, F.date_format("o_orderdate", way))
    rows = table(spark, folder, "orders").select("o_orderkey", shown.alias("t"))
    parsed = F.coalesce(*[F.try_to_timestamp("t", F.lit(w)) for w in ways]).cast("date")
    return rows.select("o_orderkey", parsed.alias("parsed"), (parsed.isNull() | (parsed >= F.lit("1998-01-01").cast("date"))).alias("kept"))


# -- arrays of tags --------------------------------------------------------------------------------------------------------
@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'red')")
def json_tag_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").filter(F.array_contains(F.split("p_name", " "), "red")).select("p_partkey", "p_name")


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE list_contains(string_split(p_name, ' '), 'bolt') AND p_size BETWEEN 5 AND 30
    AND p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 2)""")
def faceted_search(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    busy = part.groupBy("p_brand").count().filter("count > 2").select("p_brand")
    hit = F.array_contains(F.split("p_name", " "), "bolt") & F.col("p_size").between(5, 30)
    return part.filter(hit).join(busy, "p_brand", "left_semi").select("p_partkey", "p_name", "p_brand")


_CELLS = "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS mechanism, p_brand, p_type FROM part"


@query(f"SELECT p_partkey, mechanism, s AS sector FROM ({_CELLS}), LATERAL (SELECT unnest([p_brand, p_type]) AS s)")
def tag_cells(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").withColumn("mechanism", F.explode(F.split("p_name", " ")))
    return part.select("p_partkey", "mechanism", F.explode(F.array("p_brand", "p_type")).alias("sector"))


@query(f"""SELECT mechanism, p_type AS sector, count(DISTINCT p_partkey) AS n, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS brands FROM ({_CELLS}) GROUP BY mechanism, p_type""")
def cooccurrence_matrix(spark: SparkSession, folder: str) -> DataFrame:
    cells = table(spark, folder, "part").withColumn("mechanism", F.explode(F.split("p_name", " ")))
    return cells.groupBy("mechanism", F.col("p_type").alias("sector")).agg(
        F.count_distinct("p_partkey").alias("n"), F.array_join(F.array_sort(F.collect_set("p_brand")), "|").alias("brands")
    )


@query(f"SELECT mechanism AS tag, count(*) AS n FROM ({_CELLS}) GROUP BY mechanism ORDER BY n DESC, tag LIMIT 25")
def tag_frequency(spark: SparkSession, folder: str) -> DataFrame:
    tags = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(25)


@query("""SELECT facet, value, n FROM (SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS pos FROM (
    SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus
    UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority
    UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders WHERE o_totalprice > 100000 GROUP BY year(o_orderdate))) WHERE pos <= 15""")
def facet_counts(spark: SparkSession, folder: str) -> DataFrame:
    from orrery.operators.facets import facets

    orders = table(spark, folder, "orders").filter("o_totalprice > 100000")
    return facets(orders, {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate")}, 15)


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda t: CASE t WHEN 'red' THEN 'color' WHEN 'blue' THEN 'color' WHEN 'ring' THEN NULL ELSE t END), lambda t: t IS NOT NULL), '|') AS tags FROM part""")
def alias_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases: a known tag with a null target is dropped, an unknown tag passes."""
    mapped = F.transform(F.split("p_name", " "), lambda t: F.when(t.isin("red", "blue"), "color").when(t == "ring", None).otherwise(t))
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.array_compact(mapped), "|").alias("tags"))


@query("""SELECT p_partkey, CASE WHEN a = b THEN a ELSE a || '|' || b END AS tags FROM (SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue') THEN 'thing' ELSE split_part(p_name, ' ', 1) END AS a,
    CASE WHEN split_part(p_name, ' ', 2) IN ('bolt', 'ring') THEN 'thing' ELSE split_part(p_name, ' ', 2) END AS b FROM part)""")
def apply_mapping(spark: SparkSession, folder: str) -> DataFrame:
    mapped = F.array_distinct(F.transform(F.split("p_name", " "), lambda t: F.when(t.isin("red", "blue", "bolt", "ring"), "thing").otherwise(t)))
    return table(spark, folder, "part").select("p_partkey", F.array_join(mapped, "|").alias("tags"))


@query("SELECT p_partkey, p_name AS tags FROM part")
def ordered_distinct(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.array_distinct(F.concat(words, F.reverse(words))), " ").alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN -1 ELSE code END AS code FROM part LEFT JOIN (SELECT p_type AS k, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INT) AS code FROM (SELECT DISTINCT p_type FROM part WHERE p_type <> 'PROMO')) ON p_type = k")
def dict_encode(spark: SparkSession, folder: str) -> DataFrame:
    from orrery.operators.facets import dictionary_encode

    part = table(spark, folder, "part").withColumn("kind", F.nullif("p_type", F.lit("PROMO")))
    return dictionary_encode(part, "kind", "code").select("p_partkey", "code")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS members, count(*) AS n FROM nation GROUP BY n_regionkey")
def nested_collect(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    return rows.select("n_regionkey", F.array_join("m.n_name", ",").alias("members"), F.size("m").cast("long").alias("n"))


@query("""SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_acctbal DESC, s_suppkey) AS best FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS pos FROM supplier) WHERE pos <= 5 GROUP BY s_nationkey""")
def nested_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Only the best five of a group are gathered."""
    order = W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    top = table(spark, folder, "supplier").withColumn("pos", F.row_number().over(order)).filter("pos <= 5")
    rows = top.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("pos", "s_name"))).alias("m"))
    return rows.select("s_nationkey", F.array_join("m.s_name", ",").alias("best"))


@query("""SELECT p_partkey, round(score, 4) AS score FROM (SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'bolt', 'ring'])) / 3.0 + CASE WHEN contains(p_name, 'red bolt') THEN 0.5 ELSE 0 END AS score FROM part) WHERE score >= 0.4""")
def token_overlap_match(spark: SparkSession, folder: str) -> DataFrame:
    target = F.array(F.lit("red"), F.lit("bolt"), F.lit("ring"))
    score = F.size(F.array_intersect(F.split("p_name", " "), target)) / 3.0 + F.when(F.col("p_name").contains("red bolt"), 0.5).otherwise(0)
    return table(spark, folder, "part").select("p_partkey", F.round(score, 4).alias("score")).filter("score >= 0.4")


@query("""SELECT k AS p_partkey, json FROM (SELECT p_partkey AS k, '{"key":' || p_partkey || ',"name":"' || p_name || '"}' AS json FROM part)""")
def export_json(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.to_json(F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))).alias("json"))


@query("SELECT p_partkey, p_name, p_brand, replace(p_name, ' ', ', ') AS tags FROM part WHERE p_size >= 10")
def export_flat(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").filter("p_size >= 10").select("p_partkey", "p_name", "p_brand", F.array_join(F.split("p_name", " "), ", ").alias("tags"))
