"""Search, browse, join, set and aggregation queries as SQL. ``as of`` dates are fixed, never the clock."""

from pyspark.sql import DataFrame, SparkSession

from orrery.operators.nearest import nearest_rows
from orrery.queries.registry import query
from orrery.queries.sqltext import define
from orrery.sources.tables import table

# -- scans, filters, pages --------------------------------------------------------------------------------------
define("scan_projection", "SELECT p_partkey, p_name, p_brand FROM {part} WHERE p_size <= 10")
define("company_search", """
    SELECT s.s_suppkey, s.s_name, n.n_name, s.s_acctbal FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
    WHERE lower(s.s_name) LIKE '%7%' AND s.s_acctbal >= 0 ORDER BY s.s_acctbal DESC, s.s_suppkey LIMIT 20 OFFSET 1""")
define("browse_filter", """
    SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM {orders}
    WHERE o_orderstatus IN ('O', 'F') AND year(o_orderdate) = 1997
      AND (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')
      AND coalesce(nullif(o_custkey % 3, 2), 0) = 0""")
define("sorted_page", """
    SELECT c.c_custkey, c.c_mktsegment, c.c_acctbal, t.total, CAST(ceil(t.total / 25.0) AS BIGINT) AS pages
    FROM {customer} c CROSS JOIN (SELECT count(*) AS total FROM {customer}) t
    ORDER BY c.c_mktsegment ASC NULLS LAST, c.c_acctbal DESC, c.c_custkey LIMIT 25 OFFSET 50""")
define("launch_loose", """
    SELECT p_partkey, p_type, p_size, p_retailprice FROM {part}
    WHERE p_size <= 25 AND p_retailprice < 1200 AND p_type NOT IN ('ECONOMY', 'PROMO')""")
define("launch_strict", """
    SELECT p_partkey, p_type, p_size, p_retailprice FROM {part}
    WHERE p_size <= 15 AND p_retailprice < 1100 AND p_type = (SELECT min(p_type) FROM {part})""")
define("match_flag", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN 1 ELSE 0 END AS matched FROM {customer}""")
define("date_range", """
    SELECT o_orderkey, o_orderdate, o_totalprice FROM {orders}
    WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-02-01 00:00:00'""")
define("in_list", """
    SELECT event_id, event_type, user_id FROM {events} WHERE event_type IN ('error', 'signup') AND value IS NOT NULL""")
define("stale_selector", """
    SELECT c.c_custkey, c.c_acctbal, l.last_order FROM {customer} c
    LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM {orders} GROUP BY o_custkey) l ON c.c_custkey = l.o_custkey
    WHERE l.last_order IS NULL OR l.last_order < TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 90 DAYS""",
    """SELECT c.c_custkey, c.c_acctbal, l.last_order FROM customer c
    LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) l ON c.c_custkey = l.o_custkey
    WHERE l.last_order IS NULL OR l.last_order < TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 90 DAY""")
define("work_queue", """
    SELECT c.c_custkey, c.c_acctbal, l.last_order FROM {customer} c
    LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM {orders} GROUP BY o_custkey) l ON c.c_custkey = l.o_custkey
    WHERE c.c_acctbal > 0 AND (l.last_order IS NULL OR l.last_order < TIMESTAMP '2001-05-03 00:00:00')
    ORDER BY c.c_acctbal DESC, l.last_order ASC NULLS FIRST, c.c_custkey LIMIT 100""")
define("keyset_page", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 50""")
define("point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_custkey = 42")
define("daily_counts", """
    SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM {events}
    WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY CAST(ts AS DATE), event_type""")

# -- joins ------------------------------------------------------------------------------------------------------
define("join_inner_recent", """
    SELECT o.o_orderkey, o.o_orderdate, o.o_totalprice, c.c_name, c.c_mktsegment FROM {orders} o
    JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE o.o_orderdate >= TIMESTAMP '2001-07-02 00:00:00'""")
define("priority_queue", """
    SELECT o.o_orderkey, o.o_orderpriority, o.o_orderdate, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
    WHERE o.o_orderstatus = 'P' ORDER BY o.o_orderpriority, o.o_orderdate, o.o_orderkey LIMIT 50""")
define("join_filtered_topk", """
    SELECT s.s_suppkey, s.s_name, n.n_name, s.s_acctbal FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
    WHERE s.s_acctbal > 1000 AND n.n_regionkey <> 0 ORDER BY s.s_acctbal DESC, s.s_suppkey LIMIT 25""")
define("unnotified_join", """
    SELECT e.event_id, e.ts, e.user_id, c.c_name FROM {events} e JOIN {customer} c ON e.user_id = c.c_custkey
    WHERE e.event_type = 'error'""")
define("history_join", """
    SELECT o.o_orderkey, o.o_orderstatus, c.c_name, o.o_orderdate FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
    WHERE o.o_orderstatus = 'F' AND c.c_acctbal < 0""")
define("bridge_join", """
    SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name, l.l_quantity FROM {lineitem} l
    JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey WHERE year(l.l_shipdate) = 1998""")
define("left_join_optional", """
    SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM {customer} c
    LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000""")
define("alert_join", """
    SELECT e.event_id, e.event_type, e.value, c.c_mktsegment FROM {events} e
    LEFT JOIN {customer} c ON e.user_id = c.c_custkey AND c.c_acctbal > 0 WHERE e.event_type = 'purchase'""")
define("left_count", """
    SELECT n.n_nationkey, n.n_name, count(s.s_suppkey) AS suppliers FROM {nation} n
    LEFT JOIN {supplier} s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_name""")
define("wide_profile", """
    SELECT c.c_custkey, c.c_name, n.n_name AS nation, p.n_name AS parent, r.r_name AS region FROM {customer} c
    LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN {nation} p ON p.n_nationkey = CAST(floor(n.n_nationkey / 5) AS INT)
    LEFT JOIN {region} r ON n.n_regionkey = r.r_regionkey""")
define("self_join_parent", """
    SELECT c.n_nationkey, c.n_name, p.n_name AS parent FROM {nation} c
    LEFT JOIN {nation} p ON p.n_nationkey = CAST(floor(c.n_nationkey / 5) AS INT) AND p.n_nationkey <> c.n_nationkey""")
define("siblings", """
    SELECT b.n_nationkey, b.n_name, count(s.s_suppkey) AS suppliers FROM {nation} a
    JOIN {nation} b ON floor(a.n_nationkey / 5) = floor(b.n_nationkey / 5) AND a.n_nationkey <> b.n_nationkey
    LEFT JOIN {supplier} s ON s.s_nationkey = b.n_nationkey WHERE a.n_nationkey = 7
    GROUP BY b.n_nationkey, b.n_name ORDER BY suppliers DESC, b.n_nationkey LIMIT 10""")
define("anti_join_targets", """
    SELECT p.p_brand, min(p.p_name) AS first_name, count(*) AS n FROM {part} p
    LEFT JOIN (SELECT DISTINCT l_partkey FROM {lineitem} WHERE year(l_shipdate) = 1995) l ON p.p_partkey = l.l_partkey
    WHERE l.l_partkey IS NULL GROUP BY p.p_brand""")
define("anti_join_not_in", """
    SELECT p_partkey, p_name FROM {part}
    WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND year(l_shipdate) = 1995)""")
_CENTS = "CAST(round({0}.c_acctbal * 100) AS BIGINT)"
# whole cents until one last division, so that both engines give the same double
define("scalar_subquery", f"""
    SELECT c.c_custkey, c.c_mktsegment, CAST({_CENTS.format('c')} * (SELECT count(*) FROM {{customer}} x WHERE x.c_mktsegment = c.c_mktsegment)
      - (SELECT CAST(sum({_CENTS.format('x')}) AS BIGINT) FROM {{customer}} x WHERE x.c_mktsegment = c.c_mktsegment) AS DOUBLE)
      / CAST(100 * (SELECT count(*) FROM {{customer}} x WHERE x.c_mktsegment = c.c_mktsegment) AS DOUBLE) AS above
    FROM {{customer}} c""")
define("gap_drill", """
    SELECT DISTINCT b.p_partkey, b.p_name, b.p_brand, CASE WHEN b.p_brand = a.p_brand THEN 'brand' ELSE 'mechanism' END AS shared
    FROM {part} a JOIN {part} b ON (split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1)) <> (a.p_brand = b.p_brand)
    WHERE a.p_partkey = 1 AND (b.p_brand = a.p_brand OR split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1))""")
define("having_overlap", """
    SELECT md5(text) AS text_hash, count(DISTINCT source) AS n_sources, min(doc_id) AS first_doc FROM {documents}
    GROUP BY md5(text) HAVING count(DISTINCT source) > 1""")
define("containment_join", """
    SELECT n.n_nationkey, n.n_name, r.r_regionkey FROM {nation} n JOIN {region} r
    ON n.n_regionkey = r.r_regionkey AND r.r_name <> '' AND contains(lower(n.n_name), lower(substr(r.r_name, 1, 1)))""")
define("new_children", """
    SELECT o.o_orderkey, coalesce(l.first_ship, o.o_orderdate) AS effective FROM {orders} o
    LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM {lineitem} GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
    WHERE NOT EXISTS (SELECT 1 FROM {events} e WHERE e.user_id = o.o_custkey AND e.event_type = 'error')""")

# -- aggregates -------------------------------------------------------------------------------------------------
define("group_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type")
define("topk_groups", """
    SELECT user_id, count(*) AS n FROM {events} WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10""")
define("histogram_exact", "SELECT p_size, count(*) AS n FROM {part} GROUP BY p_size")
define("histogram_bucketed", """
    SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN c_acctbal >= 7500 THEN 'high' WHEN c_acctbal >= 2500 THEN 'medium'
      WHEN c_acctbal >= 0 THEN 'low' ELSE 'negative' END AS bucket FROM {customer}) t GROUP BY bucket""")
define("histogram_null_bucket", """
    SELECT bucket, count(*) AS n, min(coalesce(score, -1)) AS least FROM (
      SELECT score, CASE WHEN score IS NULL THEN 'none' WHEN score >= 30 THEN 'high' ELSE 'low' END AS bucket
      FROM (SELECT nullif(p_size, 10) AS score FROM {part}) a) b GROUP BY bucket ORDER BY least, bucket""")
define("conditional_agg", """
    SELECT l_returnflag, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS up,
      CAST(sum(CASE WHEN l_quantity <= 25 THEN 1 ELSE 0 END) AS BIGINT) AS down,
      round(100.0 * avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 2) AS discounted_pct FROM {lineitem} GROUP BY l_returnflag""")
define("flag_matrix", """
    SELECT big, late, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS big,
      CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN year(o_orderdate) >= 1999 THEN 1 ELSE 0 END AS late FROM {orders}) t
    WHERE late IS NOT NULL GROUP BY big, late""")
define("group_sum", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderstatus")
define("portfolio_agg", """
    SELECT l.l_suppkey, count(DISTINCT l.l_partkey) AS parts, round(avg(l.l_discount), 4) AS avg_discount, max(l.l_shipdate) AS last_ship
    FROM {lineitem} l GROUP BY l.l_suppkey""")
define("labelled_counts", """
    SELECT 'customers' AS label, count(*) AS n FROM {customer} UNION ALL SELECT 'orders', count(*) FROM {orders}
    UNION ALL SELECT 'lineitems', count(*) FROM {lineitem} UNION ALL SELECT 'parts', count(*) FROM {part}""")
define("group_breakdown", """
    SELECT split_part(p.p_name, ' ', 1) AS mechanism, count(DISTINCT l.l_orderkey) AS orders_n FROM {lineitem} l
    JOIN {part} p ON l.l_partkey = p.p_partkey WHERE l.l_returnflag = 'R'
    GROUP BY split_part(p.p_name, ' ', 1) ORDER BY orders_n DESC, mechanism LIMIT 12""")
define("label_precision", """
    SELECT d.lang, count(*) AS n, round(avg(CAST(l.quality AS DOUBLE)), 6) AS rate FROM {labels} l
    JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY d.lang""")
define("outcome_counts", """
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'ok'
      ELSE concat('value_', CAST(CAST(floor(value / 10) AS INT) AS VARCHAR(10))) END AS outcome FROM {events}) t GROUP BY outcome""")
define("column_coverage", """
    SELECT count(*) AS n, round(100.0 * avg(CASE WHEN l.quality IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS quality_pct,
      round(100.0 * avg(CASE WHEN l.toxic = 1 THEN 1.0 ELSE 0.0 END), 4) AS toxic_pct,
      round(100.0 * avg(CASE WHEN d.lang IS NOT NULL AND d.lang <> '' THEN 1.0 ELSE 0.0 END), 4) AS lang_pct
    FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""")
define("group_null_label", """
    SELECT coalesce(nullif(p_type, 'PROMO'), '(none)') AS kind, count(*) AS n FROM {part} GROUP BY coalesce(nullif(p_type, 'PROMO'), '(none)')""")
define("yield_report", """
    SELECT event_type, round(sum(value), 2) AS total, CAST(sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) AS BIGINT) AS near_zero,
      round(100.0 * sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) / count(*), 2) AS near_zero_pct FROM {events} GROUP BY event_type""")
define("quality_checks", """
    SELECT 'duplicate_text' AS checked, count(*) AS n FROM (SELECT md5(text) FROM {documents} GROUP BY md5(text) HAVING count(*) > 1) a
    UNION ALL SELECT 'orphan_orders', count(*) FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o.o_custkey)
    UNION ALL SELECT 'empty_text', count(*) FROM {documents} WHERE text IS NULL OR text = ''""")
define("distinct_picklist", "SELECT DISTINCT p_brand FROM {part} ORDER BY p_brand")

# -- windows and ranks ------------------------------------------------------------------------------------------
define("lag_previous", """
    SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous
    FROM {orders}""")
define("capital_diff", """
    SELECT o_custkey, o_orderkey, round(o_totalprice - prev, 2) AS change_amount,
      CASE WHEN prev IS NULL THEN 'first' WHEN abs(o_totalprice - prev) >= 10000 OR (prev > 0 AND abs(o_totalprice - prev) / prev >= 0.1) OR prev = 0
        THEN CASE WHEN o_totalprice > prev THEN 'increase' ELSE 'decrease' END ELSE 'insignificant' END AS change_type
    FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM {orders}) t""")
define("topk_per_group", """
    SELECT p_brand, mechanism, n, CAST(pos AS BIGINT) AS pos FROM (
      SELECT p_brand, mechanism, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, mechanism) AS pos FROM (
        SELECT p_brand, split_part(p_name, ' ', 1) AS mechanism, count(*) AS n FROM {part} GROUP BY p_brand, split_part(p_name, ' ', 1)) a) b
    WHERE pos <= 6""")
define("stratified_sample", """
    SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR(20))), doc_id) AS pos
      FROM {documents}) t WHERE pos <= 20""", """
    SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS pos
      FROM documents) t WHERE pos <= 20""")
define("dedupe_best", """
    SELECT doc_id, n_chars, source FROM (SELECT doc_id, n_chars, source, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS pos
      FROM {documents}) t WHERE pos = 1""")
define("per_source_cap", """
    SELECT source, doc_id, pos FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS pos
      FROM {documents}) t WHERE pos <= 50""")
define("priority_dedupe", """
    SELECT k, origin, amount FROM (SELECT k, origin, amount, row_number() OVER (PARTITION BY k ORDER BY rank_no, amount DESC) AS pos FROM (
      SELECT s_suppkey AS k, 'supplier' AS origin, s_acctbal AS amount, 1 AS rank_no FROM {supplier}
      UNION ALL SELECT c_custkey, 'customer', c_acctbal, 2 FROM {customer}
      UNION ALL SELECT p_partkey, 'part', p_retailprice, 3 FROM {part}) u) t WHERE pos = 1""")
@query("""
    SELECT c_custkey, s_suppkey, diff FROM (SELECT c.c_custkey, s.s_suppkey, round(abs(c.c_acctbal - s.s_acctbal), 2) AS diff,
      row_number() OVER (PARTITION BY c.c_custkey ORDER BY abs(c.c_acctbal - s.s_acctbal), s.s_suppkey) AS pos
      FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey WHERE c.c_acctbal > 9000) t WHERE pos = 1""")
def best_match(spark: SparkSession, folder: str) -> DataFrame:
    """The supplier of the nation with the nearest balance: only the nearest below and above can be it."""
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    customers = table(spark, folder, "customer").filter("c_acctbal > 9000").select("c_custkey", "c_nationkey", "c_acctbal")
    return nearest_rows(customers, suppliers, ("c_custkey", "c_nationkey", "c_acctbal"), ("s_suppkey", "s_nationkey", "s_acctbal"))


# -- tag matrices -----------------------------------------------------------------------------------------------
define("axis_totals", """
    SELECT 'mechanism' AS axis, split_part(p_name, ' ', 1) AS tag, count(DISTINCT p_partkey) AS n FROM {part} GROUP BY split_part(p_name, ' ', 1)
    UNION ALL SELECT 'brand', p_brand, count(DISTINCT p_partkey) FROM {part} GROUP BY p_brand""")
define("sparse_cells", """
    SELECT split_part(p_name, ' ', 1) AS mechanism, p_brand AS sector, count(DISTINCT p_partkey) AS n FROM {part} WHERE p_size <= 10
    GROUP BY split_part(p_name, ' ', 1), p_brand HAVING count(DISTINCT p_partkey) <= 2""")
define("semi_join_thresholds", """
    SELECT mechanism, sector, n FROM (SELECT split_part(p_name, ' ', 1) AS mechanism, p_brand AS sector, count(DISTINCT p_partkey) AS n FROM {part}
      GROUP BY split_part(p_name, ' ', 1), p_brand) c
    WHERE n <= 10 AND mechanism IN (SELECT split_part(p_name, ' ', 1) FROM {part} GROUP BY split_part(p_name, ' ', 1) HAVING count(*) >= 5)
      AND sector IN (SELECT p_brand FROM {part} GROUP BY p_brand HAVING count(*) >= 5)""")
define("empty_cells", """
    WITH p AS (SELECT split_part(p_name, ' ', 1) AS m, p_brand AS s FROM {part} WHERE p_size <= 3),
    mt AS (SELECT m, count(*) AS m_total FROM p GROUP BY m HAVING count(*) >= 3),
    st AS (SELECT s, count(*) AS s_total FROM p GROUP BY s HAVING count(*) >= 3)
    SELECT mt.m AS mechanism, st.s AS sector, m_total, s_total FROM mt CROSS JOIN st
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.m = mt.m AND p.s = st.s)""")
define("proven_gaps", """
    WITH c AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS m, p_brand AS s FROM {part} WHERE p_size <= 4),
    strong AS (SELECT m, count(*) AS k FROM c GROUP BY m HAVING count(*) >= 2),
    active AS (SELECT s, count(*) AS a FROM c GROUP BY s HAVING count(*) >= 2)
    SELECT strong.m AS mechanism, active.s AS sector, k * a AS weight FROM strong CROSS JOIN active
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.m = strong.m AND c.s = active.s)""")
define("timeline_topn", """
    WITH c AS (SELECT year(l.l_shipdate) AS yr, split_part(p.p_name, ' ', 1) AS m, count(*) AS n FROM {lineitem} l
      JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY year(l.l_shipdate), split_part(p.p_name, ' ', 1)),
    top AS (SELECT m FROM c GROUP BY m ORDER BY sum(n) DESC, m LIMIT 3),
    years AS (SELECT DISTINCT yr FROM c)
    SELECT years.yr, top.m AS mechanism, coalesce(c.n, 0) AS n FROM years CROSS JOIN top LEFT JOIN c ON c.yr = years.yr AND c.m = top.m""")

# -- rules ------------------------------------------------------------------------------------------------------
define("amount_bins", """
    SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'unknown' WHEN o_totalprice < 25000 THEN 'pre-seed' WHEN o_totalprice < 100000 THEN 'seed'
      WHEN o_totalprice < 250000 THEN 'series-a' ELSE 'growth' END AS round_type FROM {orders}""")
define("opportunity_score", """
    SELECT p_partkey, niche, era, moat, least(niche + era + moat + shape, 100) AS score FROM (SELECT p_partkey,
      CASE WHEN p_size <= 10 THEN 30 WHEN p_size <= 30 THEN 18 ELSE 3 END AS niche,
      CASE WHEN p_retailprice < 1000 THEN 25 WHEN p_retailprice < 1500 THEN 15 ELSE 3 END AS era,
      CASE p_type WHEN 'ECONOMY' THEN 25 WHEN 'STANDARD' THEN 15 ELSE 8 END AS moat,
      CASE WHEN p_partkey % 2 = 0 THEN 30 ELSE 10 END AS shape FROM {part}) t""")
define("rescore_diff", """
    SELECT CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS changed, CAST(sum(CASE WHEN a < 3 AND b >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS gained,
      CAST(sum(CASE WHEN a >= 3 AND b < 3 THEN 1 ELSE 0 END) AS BIGINT) AS lost FROM (SELECT CASE WHEN c_acctbal > 5000 THEN 3 ELSE 1 END AS a,
      CASE WHEN c_acctbal > 4000 AND c_mktsegment <> 'AUTOMOBILE' THEN 4 ELSE 1 END AS b FROM {customer}) t""")

# -- state ------------------------------------------------------------------------------------------------------
define("upsert_latest", """
    SELECT user_id, event_id, event_type, value FROM (SELECT user_id, event_id, event_type, value,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM {events}) t WHERE pos = 1""")
# what came before is told by a date in the data, not by the key
define("insert_ignore", """
    WITH base AS (SELECT * FROM {orders} WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'),
    fresh AS (SELECT * FROM {orders} WHERE o_orderdate >= TIMESTAMP '1997-06-01 00:00:00')
    SELECT o_orderkey, o_custkey, o_totalprice FROM base
    UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM fresh d WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.o_orderkey = d.o_orderkey)""")
define("merge_max", """
    SELECT l_partkey, l_suppkey, max(l_discount) AS confidence, count(*) AS notes FROM {lineitem} GROUP BY l_partkey, l_suppkey""")
define("merge_coalesce", """
    SELECT coalesce(n.k, b.k) AS k, coalesce(n.v, b.v) AS v, greatest(coalesce(n.flag, 0), coalesce(b.flag, 0)) AS flag
    FROM (SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal END AS v, 0 AS flag FROM {customer} WHERE c_acctbal < 6000) n
    FULL JOIN (SELECT c_custkey AS k, c_acctbal AS v, 1 AS flag FROM {customer} WHERE c_acctbal >= 1000) b ON n.k = b.k""")
define("fill_missing", """
    SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.lang END, s.lang) AS lang FROM {documents} d
    LEFT JOIN (SELECT source, min(lang) AS lang FROM {documents} GROUP BY source) s ON d.source = s.source""")
define("upsert_preserve", """
    SELECT n.o_orderkey, n.o_totalprice, coalesce(b.first_seen, n.o_orderdate) AS first_seen FROM {orders} n
    LEFT JOIN (SELECT o_orderkey, o_orderdate - INTERVAL '1' DAY AS first_seen FROM {orders} WHERE o_orderkey % 2 = 0) b ON n.o_orderkey = b.o_orderkey""")
define("change_feed", """
    SELECT event_id, user_id, prev AS old_value, event_type AS new_value FROM (
      SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events}) t
    WHERE prev IS NOT NULL AND prev <> event_type""")
define("watermark_state", """
    SELECT source, max(doc_id) AS high_water, count(*) AS seen, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY source""")
define("replace_children", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} l WHERE l_orderkey % 10 <> 0
    UNION ALL SELECT o_orderkey, 1, CAST(0 AS DOUBLE) FROM {orders} WHERE o_orderkey % 10 = 0""")
define("cascade_delete", """
    SELECT l.l_orderkey, l.l_linenumber FROM {lineitem} l WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'F')""")
define("late_filter", """
    SELECT event_id, ts FROM {events} WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-24 00:00:00'""")
define("session_counts", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '12' HOUR
      OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS opens FROM {events}),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no FROM g)
    SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n FROM s GROUP BY user_id, session_no""")

# -- marks, samples, reports ------------------------------------------------------------------------------------
define("bulk_flags", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS starred, CASE WHEN c_acctbal < 0 THEN concat('overdrawn, ', c_mktsegment) ELSE '' END AS notes
    FROM {customer}""")
define("seeded_sample", """
    SELECT doc_id, source FROM (SELECT doc_id, source, md5(concat('seed-7-', CAST(doc_id AS STRING))) AS h FROM {documents}) t ORDER BY h, doc_id LIMIT 5""")
define("text_report", """
    SELECT line_no, line FROM (SELECT 1 AS line_no, concat('Companies: ', CAST(count(*) AS STRING)) AS line FROM {supplier}
      UNION ALL SELECT 2, concat('With capital: ', CAST(sum(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END) AS STRING)) FROM {supplier}
      UNION ALL SELECT 3, concat('Events: ', CAST(count(*) AS STRING), ', users: ', CAST(count(DISTINCT user_id) AS STRING)) FROM {events}
      UNION ALL SELECT 10 + r_regionkey, concat('  ', r_name, ': ', CAST(n AS STRING)) FROM (SELECT r.r_regionkey, r.r_name, count(s.s_suppkey) AS n FROM {region} r
        LEFT JOIN {nation} n ON n.n_regionkey = r.r_regionkey LEFT JOIN {supplier} s ON s.s_nationkey = n.n_nationkey GROUP BY r.r_regionkey, r.r_name) q) t ORDER BY line_no""")
