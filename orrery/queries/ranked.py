"""Ranks, gaps and medians over whole tables without one task that holds them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.ranking import global_rank
from orrery.queries.registry import query
from orrery.queries.sqltext import define
from orrery.sources.tables import table

_NAMES = re.compile(r"\{(\w+)\}")


def _duck(text: str) -> str:
    return _NAMES.sub(r"\1", text)


def _sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: table(spark, folder, t) for t in set(_NAMES.findall(text))})


_GAPS = """
    WITH p AS (SELECT DISTINCT p_partkey, split_part(p_name, ' ', 1) AS m, p_brand AS s, CAST(CASE WHEN p_size <= 10 THEN 1 ELSE 0 END AS DOUBLE) AS solo FROM {part}),
    total AS (SELECT count(*) AS pairs FROM p),
    mt AS (SELECT m, count(*) AS mn, avg(solo) AS solo FROM p GROUP BY m),
    st AS (SELECT s, count(*) AS sn FROM p GROUP BY s),
    cell AS (SELECT m, s, count(*) AS n FROM p GROUP BY m, s),
    scored AS (SELECT mt.m AS mechanism, st.s AS sector, mt.mn, st.sn, coalesce(cell.n, 0) AS actual,
      CAST(mt.mn AS DOUBLE) * st.sn / total.pairs AS expected, mt.solo
      FROM mt CROSS JOIN st CROSS JOIN total LEFT JOIN cell ON cell.m = mt.m AND cell.s = st.s),
    graded AS (SELECT mechanism, sector, mn, sn, actual, round(expected, 4) AS expected,
      round(greatest(0.0, expected - actual) * ln(1 + mn) * ln(1 + sn) * (1 + solo), 4) AS score FROM scored)
    SELECT mechanism, sector, mn AS mechanism_total, sn AS sector_total, actual, expected, score FROM graded WHERE score > 0"""


@query(f"SELECT *, row_number() OVER (ORDER BY score DESC, mechanism, sector) AS gap_rank FROM ({_duck(_GAPS)})")
def gap_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Cells that expectation fills more than the data, ranked by score."""
    return global_rank(_sql(spark, folder, _GAPS), [F.desc("score"), F.asc("mechanism"), F.asc("sector")], "gap_rank")


_TOP = """SELECT {tag} AS k, count(*) AS n FROM {{part}} GROUP BY {tag} ORDER BY n DESC, k LIMIT 5"""
_M, _S = "split_part(p_name, ' ', 1)", "p_brand"


@query(f"""WITH p AS (SELECT {_M} AS m, {_S} AS s FROM part),
    mt AS (SELECT m, row_number() OVER (ORDER BY count(*) DESC, m) - 1 AS mi FROM p GROUP BY m),
    st AS (SELECT s, row_number() OVER (ORDER BY count(*) DESC, s) - 1 AS si FROM p GROUP BY s)
    SELECT p.m AS mechanism, p.s AS sector, CAST(mi AS BIGINT) AS mi, CAST(si AS BIGINT) AS si, count(*) AS n
    FROM p JOIN mt ON p.m = mt.m JOIN st ON p.s = st.s WHERE mi < 5 AND si < 5 GROUP BY p.m, p.s, mi, si""")
def heatmap_topn(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the five most frequent tags of each axis; only these five are numbered."""
    axes = []
    for tag, name, place in ((_M, "mechanism", "mi"), (_S, "sector", "si")):
        top = _sql(spark, folder, _TOP.format(tag=tag))
        numbered = top.withColumn(place, (F.row_number().over(W.orderBy(F.desc("n"), "k")) - 1).cast("long"))  # five rows
        axes.append(numbered.select(F.col("k").alias(name), place))
    cells = table(spark, folder, "part").selectExpr(f"{_M} AS mechanism", f"{_S} AS sector")
    cells = cells.join(F.broadcast(axes[0]), "mechanism").join(F.broadcast(axes[1]), "sector")
    return cells.groupBy("mechanism", "sector", "mi", "si").agg(F.count("*").alias("n"))


_KEYS = 1024


@query("""
    WITH k AS (SELECT o_orderkey AS k, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS nxt FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
    SELECT min(k) AS last_before_gap FROM k WHERE nxt - k > 3""")
def frontier_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Last filled key before the first gap of more than three (other orders are misses): gaps inside blocks of keys, and between a block and the next."""
    keys = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    keys = keys.distinct().withColumn("block", F.floor(F.col("k") / _KEYS))
    nxt = F.lead("k").over(W.partitionBy("block").orderBy("k"))
    inside = keys.withColumn("nxt", nxt).filter(F.col("nxt") - F.col("k") > 3).select("k")
    edges = keys.groupBy("block").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    after = edges.select((F.col("block") - 1).alias("block"), F.col("first").alias("nxt"))
    end = edges.agg(F.max("last").alias("end"))  # one row
    between = edges.join(after, "block", "left").join(F.broadcast(end)).filter(
        (F.col("last") < F.col("end")) & (F.col("nxt").isNull() | (F.col("nxt") - F.col("last") > 3))
    )
    return inside.union(between.select("last")).agg(F.min("k").alias("last_before_gap"))


# every type meets every user: cells are counted, not made
define("grid_progress", """
    SELECT t.event_type, max(u.users) AS cells, count(e.user_id) AS done
    FROM (SELECT DISTINCT event_type FROM {events}) t CROSS JOIN (SELECT count(DISTINCT user_id) + max(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS users FROM {events}) u
    LEFT JOIN (SELECT DISTINCT event_type, user_id FROM {events} WHERE value > 50) e ON t.event_type = e.event_type GROUP BY t.event_type""", """
    SELECT g.event_type, count(*) AS cells, CAST(sum(CASE WHEN e.n IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS done
    FROM (SELECT t.event_type, u.user_id FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT DISTINCT user_id FROM events) u) g
    LEFT JOIN (SELECT event_type, user_id, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type, user_id) e
      ON g.event_type = e.event_type AND g.user_id = e.user_id GROUP BY g.event_type""")

# the median comes from counts by year, not from an order of all rows
define("era_metrics", """
    WITH y AS (SELECT c.c_nationkey AS k, CASE WHEN o.o_custkey % 4 = 0 THEN NULL ELSE year(o.o_orderdate) END AS yr
      FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey),
    h AS (SELECT k, yr, count(*) AS n FROM y GROUP BY k, yr),
    r AS (SELECT k, yr, n, sum(n) OVER (PARTITION BY k ORDER BY yr) AS upto, sum(n) OVER (PARTITION BY k) AS dated FROM h WHERE yr IS NOT NULL),
    m AS (SELECT k, min(yr) AS year_min, max(yr) AS year_max, min(CASE WHEN upto >= CAST(floor(dated / 2) AS BIGINT) + 1 THEN yr END) AS median_year,
      sum(CASE WHEN yr < 1997 THEN n ELSE 0 END) AS early, sum(CASE WHEN yr BETWEEN 1997 AND 1999 THEN n ELSE 0 END) AS middle,
      sum(CASE WHEN yr > 1999 THEN n ELSE 0 END) AS late, max(dated) AS dated FROM r GROUP BY k)
    SELECT m.k AS nation, round(CAST(dated AS DOUBLE) / a.n, 4) AS coverage, year_min, median_year, year_max, CAST(early AS BIGINT) AS early,
      CAST(middle AS BIGINT) AS middle, CAST(late AS BIGINT) AS late,
      CASE WHEN dated < 5 OR CAST(dated AS DOUBLE) / a.n < 0.4 THEN 'unknown' WHEN late > early AND late > middle THEN 'current'
        WHEN early >= middle THEN 'legacy' ELSE 'mixed' END AS era
    FROM m JOIN (SELECT k, sum(n) AS n FROM h GROUP BY k) a ON m.k = a.k""", """
    WITH y AS (SELECT c.c_nationkey AS k, CASE WHEN o.o_custkey % 4 = 0 THEN NULL ELSE year(o.o_orderdate) END AS yr
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
    r AS (SELECT k, yr, row_number() OVER (PARTITION BY k ORDER BY yr) AS pos, count(*) OVER (PARTITION BY k) AS dated FROM y WHERE yr IS NOT NULL),
    m AS (SELECT k, min(yr) AS year_min, max(yr) AS year_max, max(CASE WHEN pos = CAST(floor(dated / 2) AS BIGINT) + 1 THEN yr END) AS median_year,
      sum(CASE WHEN yr < 1997 THEN 1 ELSE 0 END) AS early, sum(CASE WHEN yr BETWEEN 1997 AND 1999 THEN 1 ELSE 0 END) AS middle,
      sum(CASE WHEN yr > 1999 THEN 1 ELSE 0 END) AS late, max(dated) AS dated FROM r GROUP BY k)
    SELECT m.k AS nation, round(CAST(dated AS DOUBLE) / a.n, 4) AS coverage, year_min, median_year, year_max, CAST(early AS BIGINT) AS early,
      CAST(middle AS BIGINT) AS middle, CAST(late AS BIGINT) AS late,
      CASE WHEN dated < 5 OR CAST(dated AS DOUBLE) / a.n < 0.4 THEN 'unknown' WHEN late > early AND late > middle THEN 'current'
        WHEN early >= middle THEN 'legacy' ELSE 'mixed' END AS era
    FROM m JOIN (SELECT k, count(*) AS n FROM y GROUP BY k) a ON m.k = a.k""")


@query("""SELECT start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start, event_type FROM events) GROUP BY start, event_type""")
def sliding_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of two hours that begin every hour."""
    events = table(spark, folder, "events")
    return events.groupBy(F.window("ts", "2 hours", "1 hour")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS opens FROM events),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS finish, count(*) AS n FROM s GROUP BY user_id, no""")
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions end where a user is silent for twelve hours."""
    sessions = table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")
