"""Feeds, observed loads, field-level changes, layouts and canned queries over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.changes import field_changes as changes_of
from orrery.operators.layout import layout_2d as places_of
from orrery.plans.canned import register_functions, run_canned
from orrery.queries.news import NEWS, _view
from orrery.queries.registry import query
from orrery.sources.feeds import read_feeds
from orrery.sources.loads import observed_load
from orrery.sources.tables import table
from orrery.storage import table_path

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_DAY = "DATE '2024-01-01' + CAST(length(html) % 300 AS INT)"


@query(f"""SELECT page_id, CASE WHEN broken THEN NULL ELSE trim(title) END AS title, CASE WHEN broken THEN NULL ELSE url END AS link, CASE WHEN broken THEN NULL ELSE 'On ' || page_id END AS summary,
    CASE WHEN broken OR length(html) % 5 = 0 THEN NULL ELSE CAST(day AS TIMESTAMP) END AS published, broken AS damaged, CASE WHEN contains(url, 'https') THEN 'atom' ELSE 'rss' END AS kind
    FROM (SELECT *, contains(url, '#') AS broken, 'No. ' || page_id || {_TITLE.replace("regexp_extract(html, '<title>([^<]*)</title>', 1)", "regexp_extract(html, '<title>([^<&]*)', 1)")} AS title, {_DAY} AS day FROM pages)""")
def feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as RSS and Atom files and read back: two date formats, dates that are missing, markup in texts, damaged items."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    esc = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    title = F.concat(F.lit("No. "), "page_id", F.regexp_extract("html", "<title>([^<&]*)", 1))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.length("html") % 300).cast("int"))
    dated, atom = F.length("html") % 5 != 0, F.col("url").contains("https")
    end = F.when(F.col("url").contains("#"), F.lit("<open>")).otherwise(F.lit(""))
    text = F.concat(F.lit("&lt;p&gt;On  &lt;b&gt;"), "page_id", F.lit("&lt;/b&gt;&lt;/p&gt;"), end)
    rss = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), esc, F.lit("</link><description>"), text, F.lit("</description>"),
                   F.when(dated, F.concat(F.lit("<pubDate>"), F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 00:00:00 +0000</pubDate>"))).otherwise(""), F.lit("</item>"))
    entry = F.concat(F.lit("<entry><title>"), title, F.lit('</title><link rel="self" href="x"/><link href="'), F.replace(esc, F.lit('"'), F.lit("&quot;")), F.lit('"/><summary>'), text, F.lit("</summary>"),
                     F.when(dated, F.concat(F.lit("<updated>"), F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z</updated>"))).otherwise(""), F.lit("</entry>"))
    where = {kind: table_path(spark, kind) for kind in ("rss", "atom")}
    pages.filter(~atom).select(rss).write.text(where["rss"])
    pages.filter(atom).select(entry).write.text(where["atom"])
    found = read_feeds(spark, where["rss"], where["atom"])
    # the summary holds the number alone; titles may begin with digits, which run into it
    number = F.regexp_extract(F.coalesce("summary", "damaged"), r"(?s)^(?:On |.*&lt;b&gt;)(\d+)", 1).cast("long")
    return found.select(number.alias("page_id"), "title", "link", "summary", "published", F.col("damaged").isNotNull().alias("damaged"), "kind")


@query("""WITH k AS (SELECT * FROM orders WHERE o_totalprice > 50000) SELECT (SELECT count(*) FROM orders) AS read, (SELECT count(*) FROM k) AS kept, (SELECT count(DISTINCT o_custkey) FROM k) AS written,
    (SELECT min(o_custkey) FROM k) AS first_key, (SELECT max(o_custkey) FROM k) AS last_key""")
def observed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What a load of large orders, one a customer, saw while it wrote."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_totalprice")
    seen = observed_load(rows, F.col("o_totalprice") > 50000, "o_custkey", table_path(spark, "load"), {"first_key": F.min("o_custkey"), "last_key": F.max("o_custkey")})
    return spark.createDataFrame([tuple(seen.values())], ", ".join(f"{k} long" for k in seen))


_OLD = "SELECT c_custkey, c_name, c_mktsegment, CAST(round(c_acctbal) AS BIGINT) AS balance FROM {} WHERE c_acctbal < 9000"
_NEW = """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_name) ELSE c_name END AS c_name, CASE WHEN c_acctbal < 500 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
    CAST(round(c_acctbal) AS BIGINT) + CASE WHEN c_nationkey < 6 THEN 10 ELSE 0 END AS balance FROM {} WHERE c_acctbal > -500"""
_FIELDS = ("c_name", "c_mktsegment", "balance")


@query(f"""WITH o AS ({_OLD.format('customer')}), n AS ({_NEW.format('customer')}), j AS (SELECT * FROM o JOIN n USING (c_custkey))
    SELECT c_custkey, 'added' AS change, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value FROM n ANTI JOIN o USING (c_custkey)
    UNION ALL SELECT c_custkey, 'removed', NULL, NULL, NULL FROM o ANTI JOIN n USING (c_custkey) """
       + " ".join(f"UNION ALL SELECT c_custkey, 'changed', '{f}', CAST(o.{f} AS VARCHAR), CAST(n.{f} AS VARCHAR) FROM o JOIN n USING (c_custkey) WHERE o.{f} IS DISTINCT FROM n.{f}" for f in _FIELDS))
def field_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of all customers, field by field."""
    customer = table(spark, folder, "customer")
    old, new = (spark.sql(v.format("{customer}"), customer=customer) for v in (_OLD, _NEW))
    return changes_of(old, new, ["c_custkey"], _FIELDS)


@query()
def layout_2d(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors on the plane of most variance."""
    return places_of(table(spark, folder, "embeddings"), "vec_id", "embedding")


@query("SELECT p_partkey, p_type, p_size FROM part WHERE p_size <= 20 AND p_retailprice < 1200 AND p_type NOT IN ('ECONOMY', 'PROMO')")
def canned_launch(spark: SparkSession, folder: str) -> DataFrame:
    return run_canned(spark, folder, "launch-candidates", size=20)


@query("SELECT split_part(p_name, ' ', 1) AS mechanism, p_brand AS sector, count(*) AS n FROM part GROUP BY ALL HAVING count(*) <= 4")
def canned_sparse_cells(spark: SparkSession, folder: str) -> DataFrame:
    return run_canned(spark, folder, "sparse-cells", most=4)


@query("SELECT vec_id, label FROM embeddings WHERE label = 7")
def canned_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return run_canned(spark, folder, "cluster-members", cluster_id=7)


@query(f"""WITH t AS (SELECT id, regexp_extract_all(t, '(?i)\\d+(?:[.,]\\d+)? ?(?:millionen|million|mio|mrd|milliarden|billion|m|k)?\\b') AS m FROM ({NEWS}) WHERE t IS NOT NULL)
    SELECT id, count(*) AS n FROM (SELECT id, unnest(m) AS x FROM t) GROUP BY id""")
def amount_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts of news as rows of a table function, counted by article."""
    register_functions(spark)
    news = _view(spark, folder, NEWS).select("id", "t")
    return spark.sql("SELECT id, count(*) AS n FROM {news} n, LATERAL amount_mentions(n.t) a GROUP BY id", news=news)
