"""Entity resolution, vectors, sources, sinks and streams over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.operators.aliases import canonical_tag, tag_aliases
from orrery.operators.graph import connected_components
from orrery.operators.ratios import Ratios, four_digits, of_rows, ratio_pairs
from orrery.operators.similarity import cascade, fuzzy_join, indel_ratio, token_set_ratio, token_sort
from orrery.operators.vectors import group_tfidf, knn, representatives, similar, term_counts
from orrery.queries.registry import query
from orrery.queries.sqltext import indel_sql, letter_masks
from orrery.queries.textual import DOC_TOK
from orrery.sources.tables import spread, table
from orrery.storage import stage, table_path
from orrery.streaming import jobs
from orrery.streaming.jobs import deduplicated, file_stream, run_once, run_update, upsert_batches


# -- fuzzy matching -----------------------------------------------------------------------------------------------------------
_SORTED = "array_to_string(list_sort(string_split_regex(trim(lower({})), '\\s+')), ' ')"


@query(f"""SELECT s_suppkey, {indel_sql('m', 'a', 'b')} AS ratio FROM (SELECT s_suppkey, lower(s_name) AS a, {letter_masks('lower(s_name)')} AS m, lower(n_name) AS b
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def fuzzy_ratio(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation")
    suppliers = table(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.select("s_suppkey", F.round(indel_ratio(F.lower("s_name"), F.lower("n_name")), 4).alias("ratio"))


@query(f"""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), x AS (SELECT p_partkey, {_SORTED.format("w[-1] || ' ' || w[-2] || 'x'")} AS x FROM w),
    y AS (SELECT DISTINCT p_name, {_SORTED.format('p_name')} AS y FROM part), d AS (SELECT x, {letter_masks('x')} AS m FROM (SELECT DISTINCT x FROM x)),
    s AS (SELECT x, p_name, {indel_sql('m', 'x', 'y')} AS similarity FROM d, y),
    r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY similarity DESC, p_name) AS pos FROM s WHERE similarity >= 0.85)
    SELECT p_partkey, p_name, similarity FROM x JOIN r ON x.x = r.x WHERE pos = 1""")
def fuzzy_best(spark: SparkSession, folder: str) -> DataFrame:
    """Best token-sorted match of each noisy part name among the distinct names."""
    part = table(spark, folder, "part")
    noisy = part.select("p_partkey", token_sort(F.concat(F.reverse(F.split("p_name", " "))[0], F.lit(" "), F.reverse(F.split("p_name", " "))[1], F.lit("x"))).alias("noisy"))
    names = part.select("p_name").distinct().select("p_name", token_sort(F.col("p_name")).alias("plain"))
    return fuzzy_join(noisy, names, "noisy", "plain", [], 0.85, 1, ["p_partkey", "p_name"]).select("p_partkey", "p_name", "similarity")


@query(f"""WITH c AS (SELECT c_custkey, c_nationkey AS g, regexp_extract(c_name, '([0-9]+)$', 1) AS a FROM customer), d AS (SELECT *, {letter_masks('a')} AS m FROM c),
    s AS (SELECT s_suppkey, s_nationkey AS g, regexp_extract(s_name, '([0-9]+)$', 1) AS b FROM supplier),
    p AS (SELECT c_custkey, s_suppkey, {indel_sql('m', 'a', 'b')} AS similarity FROM d JOIN s ON d.g = s.g)
    SELECT c_custkey, s_suppkey, similarity FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY similarity DESC, s_suppkey) AS pos FROM p WHERE similarity >= 0.85) WHERE pos <= 10""")
def fuzzy_range_join(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select("c_custkey", F.regexp_extract("c_name", r"(\d+)$", 1).alias("c_no"), F.col("c_nationkey").alias("nation"))
    s = table(spark, folder, "supplier").select("s_suppkey", F.regexp_extract("s_name", r"(\d+)$", 1).alias("s_no"), F.col("s_nationkey").alias("nation"))
    return fuzzy_join(c, s, "c_no", "s_no", ["nation"], 0.85, 10, ["c_custkey", "s_suppkey"]).select("c_custkey", "s_suppkey", "similarity")


def _name_scores(found: Ratios, at: np.ndarray, to: np.ndarray, rows: pa.RecordBatch) -> Callable[[slice], tuple[np.ndarray, list[np.ndarray]]]:
    """Exact 1.0, containment 0.9, else the ratio from 0.5 on."""
    ratios, number, left, right = found
    value = np.array([four_digits(r) if r >= 0.49995 else 0.0 for r in ratios])[number]
    a, b = (np.array([len(n or "") for n in own]) for own in (left, right))
    for i, j in np.argwhere(np.array(ratios)[number] * (a[:, None] + b) >= 2 * b - 1e-6).tolist():  # all of b is matched
        if left[i] is not None and right[j] is not None and right[j] in left[i]:
            value[i, j] = 1.0 if right[j] == left[i] else 0.9

    def told(some: slice) -> tuple[np.ndarray, list[np.ndarray]]:
        scores = of_rows(value, at, to, some).ravel()
        kept = scores >= 0.5
        return kept, [scores[kept]]

    return told


@query()
def name_similarity_join(spark: SparkSession, folder: str) -> DataFrame:
    """Exact 1.0, containment 0.9, else the sequence ratio, within a nation; names that occur often in a tile are compared once for it."""
    c = table(spark, folder, "customer").select("c_custkey", F.lower("c_name").alias("a"), F.col("c_nationkey").alias("nation"))
    s = table(spark, folder, "supplier").select("s_suppkey", F.lower("s_name").alias("b"), F.col("s_nationkey").alias("nation"))
    return ratio_pairs(c, s, ("c_custkey", "s_suppkey"), ("a", "b"), ["nation"], "similarity double", _name_scores)


@query("""SELECT k, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, max(conf) AS confidence FROM (SELECT c_nationkey AS k, 'customer' AS origin, 0.9 AS conf FROM customer WHERE c_acctbal > 9000
    UNION ALL SELECT s_nationkey, 'supplier', 0.8 FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT CAST(user_id % 25 AS INT), 'event', 0.6 FROM events WHERE event_type = 'error') GROUP BY k""")
def detect_union(spark: SparkSession, folder: str) -> DataFrame:
    one = table(spark, folder, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("origin"), F.lit(0.9).alias("conf"))
    two = table(spark, folder, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("origin"), F.lit(0.8).alias("conf"))
    three = table(spark, folder, "events").filter("event_type = 'error'").select((F.col("user_id") % 25).cast("int").alias("k"), F.lit("event").alias("origin"), F.lit(0.6).alias("conf"))
    return one.unionByName(two).unionByName(three).groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"), F.max("conf").alias("confidence"))


_FORM = "regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS raw FROM pages), c AS (SELECT raw, count(*) AS occurrences FROM t GROUP BY raw),
    f AS (SELECT *, CASE WHEN k NOT IN ('', 'unknown', 'n-a', 'na', 'none', 'null') THEN k END AS form FROM (SELECT *, {_FORM.format('raw')} AS k FROM c)),
    v AS (SELECT form AS canonical FROM f WHERE form IS NOT NULL GROUP BY form HAVING 250 * sum(occurrences) >= (SELECT sum(occurrences) FROM c)), y AS (SELECT *, {_SORTED.format("replace(canonical, '-', ' ')")} AS y FROM v),
    x AS (SELECT form, x, {letter_masks('x')} AS m FROM (SELECT DISTINCT form, {_SORTED.format("replace(form, '-', ' ')")} AS x FROM f WHERE form IS NOT NULL AND form NOT IN (SELECT canonical FROM v))),
    s AS (SELECT form, canonical, {indel_sql('m', 'x', 'y')} AS score FROM x JOIN y ON abs(length(x) - length(y)) <= 0.26 * (length(x) + length(y))),
    r AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY score DESC, canonical) AS pos FROM s WHERE score >= 0.75)
    SELECT f.raw, coalesce(r.canonical, f.form) AS canonical, CASE WHEN v.canonical IS NOT NULL THEN 1.0 ELSE coalesce(r.score, 0.0) END::DOUBLE AS score,
    CASE WHEN f.form IS NULL THEN 'dropped' WHEN v.canonical IS NOT NULL THEN 'exact' WHEN r.form IS NOT NULL THEN 'fuzzy' ELSE 'invented' END AS method, occurrences
    FROM f LEFT JOIN v ON f.form = v.canonical LEFT JOIN (SELECT * FROM r WHERE pos = 1) r ON f.form = r.form""")
def tag_alias_map(spark: SparkSession, folder: str) -> DataFrame:
    """Link texts of pages to the forms that make a 250th of them or more."""
    links = table(spark, folder, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), 1)).alias("raw"))
    raw = stage(links.groupBy("raw").agg(F.count("*").alias("occurrences")), "raw")
    counts = raw.groupBy(canonical_tag(F.col("raw")).alias("canonical")).agg(F.sum("occurrences").alias("n"))
    total = raw.agg(F.sum("occurrences").alias("total"))  # one row
    frequent = counts.crossJoin(F.broadcast(total)).filter("250 * n >= total and canonical is not null")
    return tag_aliases(raw, frequent, 0.75)


@query(f"""WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part), w AS (SELECT tag || 'z' AS raw FROM t UNION ALL SELECT tag FROM t),
    x AS (SELECT raw, {letter_masks('raw')} AS m FROM (SELECT DISTINCT raw FROM w)), s AS (SELECT raw, tag AS canonical, {indel_sql('m', 'raw', 'tag')} AS similarity FROM x, t),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY similarity DESC, canonical) AS pos FROM s WHERE similarity >= 0.8) WHERE pos = 1)
    SELECT w.raw, canonical, similarity, CASE WHEN similarity = 1 THEN 'exact' WHEN similarity IS NOT NULL THEN 'fuzzy' ELSE 'kept' END AS method FROM w LEFT JOIN r ON w.raw = r.raw""")
def alias_build(spark: SparkSession, folder: str) -> DataFrame:
    """Raw tags to frequent ones: exact, fuzzy, or kept as they are."""
    raw = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    noisy = raw.select(F.concat("tag", F.lit("z")).alias("raw")).unionByName(raw.select(F.col("tag").alias("raw")))
    targets = raw.select(F.col("tag").alias("canonical"))
    found = fuzzy_join(noisy, targets, "raw", "canonical", [], 0.8, 1, ["raw", "canonical"]).select("raw", "canonical", "similarity")
    return noisy.select("raw").join(found, "raw", "left").withColumn("method", F.when(F.col("similarity") == 1, "exact").when(F.col("similarity").isNotNull(), "fuzzy").otherwise("kept"))


# -- vectors --------------------------------------------------------------------------------------------------------------------
_KNN = """SELECT vec_id, neighbor, similarity, rank FROM (SELECT a.vec_id, b.vec_id AS neighbor, round(s, 4) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(s, 9) DESC, b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id, LATERAL (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s)) WHERE rank <= 5"""


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = knn(table(spark, folder, "embeddings"), "vec_id", "embedding", 5)
    return found.select(F.col("id").alias("vec_id"), "neighbor", F.round("similarity", 4).alias("similarity"), "rank")


@query(_KNN)
def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbours(spark, folder)


@query(f"SELECT k.vec_id, k.rank, k.neighbor, e.label FROM ({_KNN}) k JOIN embeddings e ON k.neighbor = e.vec_id WHERE k.rank = 1")
def knn_lookup(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("neighbor"), "label")
    return _neighbours(spark, folder).filter("rank = 1").join(labels, "neighbor").select("vec_id", "rank", "neighbor", "label")


@query("""WITH c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
    d AS (SELECT e.label, e.vec_id, round(sum(e.x * c.m), 4) AS similarity FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY e.label, e.vec_id)
    SELECT label, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM d) WHERE rank <= 5""")
def cluster_representatives(spark: SparkSession, folder: str) -> DataFrame:
    return representatives(table(spark, folder, "embeddings"), "vec_id", "embedding", "label", 5).withColumnRenamed("id", "vec_id")


@query(f"""WITH t AS (SELECT lang, {DOC_TOK} AS t FROM documents),
    tf AS (SELECT lang, term, count(*) AS tf FROM (SELECT lang, unnest(t || list_transform(range(1, greatest(1, len(t))), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM t) GROUP BY lang, term),
    n AS (SELECT count(DISTINCT lang) AS n FROM tf), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) <= 0.75 * (SELECT n FROM n)),
    w AS (SELECT lang, tf.term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df ON tf.term = df.term, n),
    s AS (SELECT w.lang, w.term, round(w / norm, 4) AS weight FROM w JOIN (SELECT lang, sqrt(sum(w * w)) AS norm FROM w GROUP BY lang) x ON w.lang = x.lang)
    SELECT lang, term, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM s) WHERE rank <= 8""")
def cluster_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """Words and pairs of words; a term of more than three quarters of the groups says nothing about one."""
    words = spread(table(spark, folder, "documents").select("lang", "text")).select("lang", X.tokens(F.col("text")).alias("t"))
    return group_tfidf(term_counts(words, "lang", "t"), "lang", "term", 8, max_df=0.75)


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4),
    r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
    SELECT node AS vec_id, min(reach) AS component FROM r GROUP BY node""")
def similarity_components(spark: SparkSession, folder: str) -> DataFrame:
    links = stage(similar(table(spark, folder, "embeddings"), "vec_id", "embedding", 0.4), "links")
    return connected_components(links, "id", "up").withColumnRenamed("node", "vec_id")


_DENSE = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.x, b.x) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    core AS (SELECT a FROM p WHERE s >= 0.35 GROUP BY a HAVING count(*) >= 3),
    e AS (SELECT p.a, p.b FROM p JOIN core x ON p.a = x.a JOIN core y ON p.b = y.a WHERE s >= 0.35),
    r(node, reach) AS (SELECT a, a FROM core UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
    c AS (SELECT node, min(reach) AS cluster FROM r GROUP BY node)"""


def _dense(vectors: DataFrame, least: float, neighbours: int) -> DataFrame:
    """``(vec_id, cluster)`` of core vectors: components among those with so many neighbours."""
    near = similar(vectors, "vec_id", "embedding", least)
    core = near.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= neighbours).select(F.col("id").alias("vec_id"))
    cores = stage(vectors.join(core, "vec_id", "left_semi"), "cores")
    found = connected_components(stage(similar(cores, "vec_id", "embedding", least), "links"), "id", "up")
    found = found.withColumnRenamed("node", "vec_id")
    return cores.select("vec_id").join(found, "vec_id", "left").select("vec_id", F.coalesce("component", "vec_id").alias("cluster"))


@query(f"{_DENSE} SELECT v.vec_id, coalesce(c.cluster, -1) AS cluster FROM v LEFT JOIN c ON v.vec_id = c.node")
def density_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Core points have three near neighbours or more; clusters are components of core points; the rest is noise (-1)."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = _dense(vectors, 0.35, 3)
    return vectors.select("vec_id").join(found, "vec_id", "left").select("vec_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


@query(f"""{_DENSE.replace('0.35', '0.3')}, big AS (SELECT cluster FROM c GROUP BY cluster HAVING count(*) >= 25), m AS (SELECT c.node, c.cluster FROM c JOIN big ON c.cluster = big.cluster),
    f AS (SELECT p.a, p.b FROM p JOIN m x ON p.a = x.node JOIN m y ON p.b = y.node WHERE s >= 0.33 AND x.cluster = y.cluster),
    q(node, reach) AS (SELECT node, node FROM m UNION SELECT q.node, f.b FROM q JOIN f ON q.reach = f.a)
    SELECT q.node AS vec_id, m.cluster AS parent, min(q.reach) AS cluster FROM q JOIN m ON q.node = m.node GROUP BY q.node, m.cluster""")
def sub_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of 25 core points or more cut again, by a closer similarity and within the cluster."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = stage(_dense(vectors, 0.3, 3), "clusters")
    big = found.groupBy("cluster").count().filter("count >= 25").select("cluster")
    inside = stage(vectors.join(found.join(big, "cluster", "left_semi"), "vec_id"), "inside")
    links = stage(similar(inside, "vec_id", "embedding", 0.33, within="cluster"), "links")
    parts = connected_components(links, "id", "up").select(F.col("node").alias("vec_id"), "component")
    return inside.join(parts, "vec_id", "left").select("vec_id", F.col("cluster").alias("parent"), F.coalesce("component", "vec_id").alias("cluster"))


# -- sources and sinks ------------------------------------------------------------------------------------------------------------
@query("SELECT event_id, event_type, value FROM events WHERE event_id % 10 <> 3")
def jsonl_scan(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines written and read again; damaged and blank lines are dropped."""
    events = table(spark, folder, "events")
    line = F.when(F.col("event_id") % 10 == 3, F.lit('{"event_id": ')).otherwise(F.to_json(F.struct("event_id", "event_type", "value")))
    where = table_path(spark, "lines")
    events.select(line.alias("value")).write.text(where)
    return spark.read.schema("event_id long, event_type string, value double").option("mode", "DROPMALFORMED").json(where)


@query("SELECT s_suppkey, s_name, 'x|y' AS aliases FROM supplier")
def csv_list_import(spark: SparkSession, folder: str) -> DataFrame:
    where = table_path(spark, "csv")
    table(spark, folder, "supplier").select("s_suppkey", "s_name", F.lit("x;;y;x").alias("aliases")).write.option("header", True).csv(where)
    rows = spark.read.schema("s_suppkey long, s_name string, aliases string").option("header", True).csv(where)
    return rows.withColumn("aliases", F.array_join(F.array_distinct(F.filter(F.split("aliases", ";"), lambda a: a != "")), "|"))


@query("SELECT page_id, 'Item ' || page_id AS title, url AS link, md5('Item ' || page_id || url) AS item_hash FROM pages")
def feed_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Feed items in XML: title, link, hash."""
    item = F.concat(F.lit("<item><title>Item "), "page_id", F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link></item>"))
    rows = table(spark, folder, "pages").select("page_id", F.from_xml(item, "title string, link string").alias("x"))
    return rows.select("page_id", "x.title", "x.link", F.md5(F.concat("x.title", "x.link").cast("binary")).alias("item_hash"))


# -- streams --------------------------------------------------------------------------------------------------------------------------
def _span(events: DataFrame) -> str:
    """A delay that no event of the table exceeds, so that none counts as late."""
    days = events.agg(F.date_diff(F.max("ts"), F.min("ts"))).first()[0]
    return f"{(days or 0) + 1} days"


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Events that arrive twice count once, in whatever order their files come."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    stream = file_stream(events.unionByName(events).repartition(4, "event_id"), "twice")
    return run_once(deduplicated(stream, "event_id", "ts", _span(events)), "once").select("event_id", "user_id", "event_type")


@query()
def token_bucket_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files hold whole users in order of time, so that no batch brings a user's earlier events later."""
    events = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events = events.repartition(4, "user_id").sortWithinPartitions("ts")
    return run_update(jobs.token_bucket(file_stream(events, "requests"), "user_id", "ts", 0.05, 2.0), "buckets", "user_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE user_id IS NOT NULL),
    s(user_id, k, sec, tokens, allowed) AS (SELECT user_id, k, sec, CAST(1 AS DOUBLE), 1 FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.k, e.sec, least(2.0, s.tokens + (e.sec - s.sec) * 0.05 / 3600) - CASE WHEN least(2.0, s.tokens + (e.sec - s.sec) * 0.05 / 3600) >= 1 THEN 1 ELSE 0 END,
        s.allowed + CASE WHEN least(2.0, s.tokens + (e.sec - s.sec) * 0.05 / 3600) >= 1 THEN 1 ELSE 0 END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
    SELECT user_id, max(k) AS n, max(allowed)::BIGINT AS allowed FROM s GROUP BY user_id""")
def token_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """The same recurrence over each user's ordered events, in batch."""
    return jobs.token_bucket_batch(table(spark, folder, "events"), "user_id", "ts", 0.05, 2.0)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type")
def tumbling_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS pos FROM events) WHERE pos = 1")
def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Micro-batches merged into a table: the latest event of each user."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type").repartition(5, "event_id")
    return upsert_batches(spark, file_stream(events, "updates", 1), table_path(spark, "latest"), "user_id", "event_id")


@query("""SELECT user_id AS company, count(*) AS mentions, round(max(value), 2) AS amount FROM events WHERE event_type = 'purchase' AND value > 20 AND ts >= TIMESTAMP '2024-01-08' AND user_id IN (SELECT c_custkey FROM customer) GROUP BY user_id""")
def news_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Fresh, relevant, unseen items matched to companies and merged, as one stream over files."""
    items = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")).repartition(3, "event_id")
    stream = file_stream(items.unionByName(items.filter("event_id % 2 = 0")).repartition(3, "event_id"), "items", 3)
    fresh = stream.filter("ts >= timestamp'2024-01-08 00:00:00' AND event_type = 'purchase' AND value > 20")
    seen = run_once(deduplicated(fresh, "event_id", "ts", _span(items)), "news")
    known = seen.join(table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")
    return known.groupBy(F.col("user_id").alias("company")).agg(F.count("*").alias("mentions"), F.round(F.max("value"), 2).alias("amount"))
