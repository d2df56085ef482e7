"""Exports written and read back: each query returns what its files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import lexicon as L
from orrery.functions import scoring as S
from orrery.queries.companies import _CLASS, _FORM, _STARTUPS, CLIMATE, D_SCORED, RELEVANCE, _startups, d_any, d_list, d_word, described
from orrery.queries.registry import query
from orrery.sources import exports as X
from orrery.sources.tables import table
from orrery.storage import stage, table_path

# what the fixed layout needs and the view of companies has not, in SQL of both engines
_RECORD = """CAST(id AS STRING) AS id, 'DE-' || CAST(id AS STRING) AS company_number, 'HRB ' || CAST(id * 7 AS STRING) AS native_company_number, name, form AS legal_form, status AS current_status,
    'Amtsgericht ' || trim(city) AS registry_court, CASE WHEN form IN ('KG', 'OHG') THEN 'HRA' WHEN form IS NOT NULL THEN 'HRB' END AS registry_type, registered AS registration_date, city,
    CAST(CAST(capital AS DECIMAL(18, 2)) AS STRING) AS capital_amount, 'EUR' AS capital_currency, CAST(ai AS STRING) AS ai_robotics_score"""
_MATCHED = d_list([(k, d_word("t", k)) for k in RELEVANCE.keywords] + [(f"[{g}]", d_any("t", p)) for g, p in RELEVANCE.groups.items()] + [(f"[climate] {k}", d_word("t", k)) for k in CLIMATE.keywords])


def company_records(spark: SparkSession, folder: str) -> DataFrame:
    t, w = F.col("t"), F.col("w")
    rows = described(spark, folder).withColumn("form", S.legal_form(F.col("name")))
    rows = rows.withColumn("matched_keywords", F.concat(L.matched(t, w, RELEVANCE), L.matched(t, w, CLIMATE, "[climate] ")))
    return rows.selectExpr(*_split(_RECORD), "matched_keywords", "tech AS tech_categories")


def _split(columns: str) -> list[str]:
    """A list of columns cut at the commas outside brackets."""
    parts, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _text(columns: str) -> str:
    return ", ".join(f"nullif({c}, '') AS {c}" for c in columns.split())


@query(f"""SELECT {_text(' '.join(c for c in X.COMPANY_FIELDS if c not in ('state', 'website', 'source', 'first_seen_date', 'matched_keywords', 'tech_categories')))},
    nullif(array_to_string({_MATCHED}, ', '), '') AS matched_keywords, nullif(array_to_string(tech, ', '), '') AS tech_categories, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS website,
    CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS first_seen_date FROM (SELECT {_RECORD}, t, tech FROM (SELECT *, {_FORM} AS form FROM ({D_SCORED})))""")
def export_companies(spark: SparkSession, folder: str) -> DataFrame:
    """All companies in the fixed layout of 19 fields, lists as text; fields that no table has are empty."""
    where = table_path(spark, "companies")
    X.write_csv(X.Report(company_records(spark, folder), X.COMPANY_FIELDS), where)
    return X.read_csv(spark, where, X.COMPANY_FIELDS)


_CHANGES = """SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS company_id, c_name AS company_name, CASE WHEN o_orderstatus = 'F' THEN 'increase' ELSE 'decrease' END AS event_type,
    CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) AS amount, CAST(CAST(o_orderdate AS DATE) AS STRING) AS event_date FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
EVENT_FIELDS = ("id", "company_id", "company_name", "event_type", "amount", "event_date")


@query(_CHANGES.replace("{", "").replace("}", ""))
def export_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events beside the name of their company."""
    rows = spark.sql(_CHANGES, orders=table(spark, folder, "orders"), customer=table(spark, folder, "customer"))
    where = table_path(spark, "events")
    X.write_csv(X.Report(rows, EVENT_FIELDS), where)
    return X.read_csv(spark, where, EVENT_FIELDS)


_WIDE = f"SELECT s.*, {_CLASS} AS startup_classification FROM ({_STARTUPS}) s"


@query(f"""SELECT CAST(id AS VARCHAR) AS id, nullif(name, '') AS name, nullif(city, '') AS city, registered AS registration_date, CAST(CAST(capital AS DECIMAL(18, 2)) AS VARCHAR) AS capital_amount,
    CAST(ai AS VARCHAR) AS ai_robotics_score, CAST(score AS VARCHAR) AS startup_score, startup_classification, CAST(NULL AS VARCHAR) AS website, nullif(purpose, '') AS purpose
    FROM (SELECT d.*, w.score, w.startup_classification FROM ({D_SCORED}) d JOIN ({_WIDE}) w ON d.id = w.id) WHERE ai >= 3 AND startup_classification = 'startup' ORDER BY ai DESC, id LIMIT 10000""")
def export_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Startups of a relevance of three or more, the most relevant first, equal ones by the id's text, with their whole purpose; at most 10,000, as the export has it."""
    rows = _startups(spark, folder).select(F.col("id").cast("string").alias("id"), "name", "city", F.col("registered").alias("registration_date"), F.col("capital").cast("decimal(18, 2)").alias("capital_amount"),
        F.col("ai").alias("ai_robotics_score"), F.col("score").alias("startup_score"), F.col("classification").alias("startup_classification"), "purpose")
    scored = stage(rows, "scored")  # scores are taken once, not again in the filter and in the order
    where = table_path(spark, "selected")
    X.write_csv(X.selected(scored, "ai_robotics_score", 3, "startup_classification", "startup"), where)
    return X.read_csv(spark, where, X.SCORED_FIELDS)


_OFFICERS = "SELECT s_suppkey AS officer, s_name AS name, s_nationkey AS company FROM supplier"


@query(f"""WITH c AS (SELECT n_nationkey AS key, n_name AS name FROM nation), o AS ({_OFFICERS}), m AS (SELECT 'companies' AS part, count(*) AS n FROM c UNION ALL SELECT 'officers', count(*) FROM o)
    SELECT r.part, '2024-01-31T00:00:00' AS exported_at, m.n AS count, key, name, company FROM (SELECT 'companies' AS part, CAST(key AS BIGINT) AS key, name, CAST(NULL AS BIGINT) AS company FROM c
      UNION ALL SELECT 'officers', officer, name, company FROM o) r JOIN m ON r.part = m.part""")
def export_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON export with its envelope: every record beside the manifest's line of its part."""
    parts = {
        "companies": table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")),
        "officers": table(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("company")),
    }
    where = table_path(spark, "bundle")
    manifest = X.write_bundle(parts, where, "2024-01-31T00:00:00")
    one = X.read_part(spark, where, "companies", "key long, name string").withColumns({"part": F.lit("companies"), "company": F.lit(None).cast("long")})
    two = X.read_part(spark, where, "officers", "key long, name string, company long").withColumn("part", F.lit("officers"))
    return one.unionByName(two).join(manifest, "part").select("part", "exported_at", "count", "key", "name", "company")


@query("""SELECT 'all_companies' AS report, count(*) AS n FROM customer UNION ALL SELECT 'new_companies', count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING min(o_orderdate) >= TIMESTAMP '1996-01-01')
    UNION ALL SELECT 'statistics', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'investments', count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    UNION ALL SELECT 'investor_portfolios', count(DISTINCT l_suppkey) FROM lineitem""")
def export_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """The five files of the scheduled export, and the rows that each one holds when it is read again."""
    customer, orders, lines, supplier = (table(spark, folder, t) for t in ("customer", "orders", "lineitem", "supplier"))
    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_seen")).filter(F.col("first_seen") >= F.lit("1996-01-01").cast("timestamp"))
    deals = lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    reports = {
        "all_companies": X.Report(customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), order=(F.col("c_custkey"),)),
        "new_companies": X.Report(first, order=(F.desc("first_seen"), F.col("o_custkey"))),
        "statistics": X.Report(customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("capital"))),
        "investments": X.Report(deals),
        "investor_portfolios": X.Report(lines.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("companies"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))),
    }
    where = table_path(spark, "reports")
    written = X.write_reports(reports, where)
    read = [X.read_csv(spark, f"{where}/{name}", reports[name].rows.columns).agg(F.count("*").alias("n")).select(F.lit(name).alias("report"), "n") for name in written]
    found = read[0]
    for more in read[1:]:
        found = found.unionByName(more)
    return found


@query("""SELECT mechanism, sector, CAST(count(DISTINCT p_partkey) AS VARCHAR) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS mechanism, p_type AS sector FROM part) GROUP BY mechanism, sector""")
def export_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The matrix of mechanisms and sectors as CSV, the fullest cells first."""
    cells = table(spark, folder, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("mechanism"), F.col("p_type").alias("sector"))
    counts = cells.groupBy("mechanism", "sector").agg(F.count_distinct("p_partkey").alias("n"))
    where = table_path(spark, "matrix")
    X.write_csv(X.Report(counts, ("mechanism", "sector", "n"), (F.desc("n"), F.col("mechanism"), F.col("sector"))), where)
    return X.read_csv(spark, where, ("mechanism", "sector", "n"))
