"""Every query with SQL returns the rows of that SQL; the others return rows."""

import decimal
import math
import random
import re
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import types as T

from orrery.operators.similarity import fuzzy_join, name_tokens
from orrery.queries import names, registry
from orrery.storage import table_path
from orrery.streaming.jobs import file_stream, latest, upsert_batches

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    return value if value is None or isinstance(value, (int, str)) else str(value)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, data, name):
    frame = registry.queries()[name](spark, data)
    got = sorted(repr(tuple(plain(v) for v in row)) for row in frame.collect())
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    at = [names.index(c) for c in frame.columns]
    want = sorted(repr(tuple(plain(row[i]) for i in at)) for row in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_returns_rows(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_streamed_bucket_equals_batch(spark, data):
    batch = {(r.user_id, r.n, r.allowed) for r in registry.queries()["token_bucket"](spark, data).collect()}
    stream = {(r.user_id, r.n, r.allowed) for r in registry.queries()["token_bucket_stream"](spark, data).collect()}
    assert stream == batch


def test_name_similarity_covers_all_customers(spark, tmp_path):
    names = ["Anna Berg", "anna berg", "Dr. Anna Berg jr", "Bern", "zzz", "", None, "Gina Abern", "Q" * 40]
    customers = [(150 + 10 * k, n, k % 2) for k, n in enumerate(names * 2)]
    suppliers = [(k, n, k % 2) for k, n in enumerate(["ANNA BERG", "Berg", "abna gern", "", None, "zz top"] * 2)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    want = set()
    for c, a, m in customers:
        for s, b, n in suppliers:
            if m == n:
                x, y = (a or "").lower(), (b or "").lower()
                ratio = round(SequenceMatcher(None, x, y).ratio(), 4)
                known = a is not None and b is not None
                score = 1.0 if known and x == y else 0.9 if known and y in x else ratio
                if score >= 0.5:
                    want.add((c, s, score))
    got = registry.queries()["name_similarity_join"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.c_custkey, r.s_suppkey, r.similarity) for r in got} == want


def plain_indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.8, 0.85, 0.95])
def test_fuzzy_join_loses_no_pair(spark, threshold):
    draw = random.Random(7)
    base = ["".join(draw.choice("abcde ") for _ in range(draw.randint(1, 16))) for _ in range(120)]
    noisy = ["".join(c for c in b if draw.random() > 0.12) + draw.choice(["", "x", "ab"]) for b in base]
    left = [(k, n, k % 2) for k, n in enumerate([*noisy, "", None])]
    right = [(k, n, k % 2) for k, n in enumerate([*base, "", None])]
    pairs = fuzzy_join(
        spark.createDataFrame(left, "i long, a string, g int"), spark.createDataFrame(right, "j long, b string, g int"), "a", "b", ["g"], threshold, 10_000, ["i", "j"]
    ).collect()
    want = {(i, j) for i, a, g in left for j, b, h in right if g == h and a and b and round(plain_indel(a, b), 4) >= threshold}
    assert {(r.i, r.j) for r in pairs if r.a and r.b} == want and len(pairs) == len({(r.i, r.j) for r in pairs})


@pytest.mark.parametrize("threshold", [0.2, 0.75, 0.85, 0.99])
def test_tokens_of_a_name_are_few(spark, threshold):
    rows = spark.createDataFrame([("abcdefghij" * 8,), ("Ünïcödé" * 4,), ("aaaa",), ("",), (None,)], "name string")
    for r in rows.withColumn("t", name_tokens(threshold)("name")).collect():
        assert len(r.t) <= max(1, 2 * len(r.name or "")) and len({t.token for t in r.t}) == len(r.t)
    with pytest.raises(ValueError):
        fuzzy_join(rows, rows.withColumnRenamed("name", "other"), "name", "other", [], 0.0, 1, ["name", "other"])


def test_fuzzy_queries_against_all_pairs(spark, data):
    known = registry.queries()
    customers = {r.c_custkey: (r.c_name, r.c_nationkey) for r in spark.read.parquet(f"{data}/customer.parquet").collect()}
    others = {r.s_suppkey: (r.s_name, r.s_nationkey) for r in spark.read.parquet(f"{data}/supplier.parquet").collect()}
    number = lambda n: re.search(r"(\d+)$", n).group(1)
    want = set()
    for c, (a, m) in customers.items():
        hits = sorted((-round(plain_indel(number(a), number(b)), 4), s) for s, (b, n) in others.items() if m == n and round(plain_indel(number(a), number(b)), 4) >= 0.85)
        want |= {(c, s, -r) for r, s in hits[:10]}
    assert {tuple(r) for r in known["fuzzy_range_join"](spark, data).collect()} == want
    nations = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{data}/nation.parquet").collect()}
    ratios = {r.s_suppkey: r.ratio for r in known["fuzzy_ratio"](spark, data).collect()}
    assert ratios == {s: round(plain_indel(b.lower(), nations[n].lower()), 4) for s, (b, n) in others.items()}
    parts = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{data}/part.parquet").collect()}
    best = {r.p_partkey: (r.p_name, r.similarity) for r in known["fuzzy_best"](spark, data).collect()}
    plain = {n: " ".join(sorted(n.lower().split())) for n in parts.values()}
    for k, n in parts.items():
        words = n.split(" ")[::-1]
        noisy = " ".join(sorted(f"{words[0]} {words[1]}x".lower().split()))
        hits = sorted((-round(plain_indel(noisy, t), 4), o) for o, t in plain.items() if round(plain_indel(noisy, t), 4) >= 0.85)
        assert best.get(k) == ((hits[0][1], -hits[0][0]) if hits else None)
    tags = {w for n in parts.values() for w in n.split(" ")}
    for r in known["alias_build"](spark, data).collect():
        hits = sorted((-round(plain_indel(r.raw, t), 4), t) for t in tags if round(plain_indel(r.raw, t), 4) >= 0.8)
        assert (r.canonical, r.similarity) == ((hits[0][1], -hits[0][0]) if hits else (None, None))
        assert r.method == ("kept" if not hits else "exact" if hits[0][0] == -1 else "fuzzy")


def test_match_confidence_against_plain_rules(spark, data):
    rows = {(r.s_suppkey, r.c_custkey): r for r in names.match_rows(spark, data).collect()}
    found = registry.queries()["match_confidence"](spark, data).collect()
    assert len(found) == len(rows) > 0
    for r in found:
        o = rows[r.s_suppkey, r.c_custkey]
        sim = SequenceMatcher(None, o.officer.strip(), o.profile.strip()).ratio()
        score = 0.5 if sim >= 0.95 else 0.4 if sim >= 0.85 else 0.25 if sim >= 0.7 else sim * 0.3
        text, words = o.text.lower(), [w for w in o.company.split(" ") if len(w) > 3]
        score += 0.3 if o.company in text else 0.15 if words and words[0] in text else 0.0
        if o.city and o.place:
            near = o.city.lower() in o.place.lower() or o.place.lower() in o.city.lower()
            score += 0.2 if near else 0.1 if "germany" in o.place.lower() else 0.0
        elif o.city:
            score += 0.15 if o.city.lower() in text else 0.0
        assert abs(r.confidence - min(1.0, score)) < 1e-4


def test_upserts_keep_untouched_buckets(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet").select("user_id", "event_id", "event_type")
    parts = events.repartition(6, "event_id")
    target = table_path(spark, "upserts")
    upsert_batches(spark, file_stream(parts, "six", 1), target, "user_id", "event_id", buckets=64)
    found = spark.read.parquet(target)
    assert found.select("version").distinct().count() == 6
    got = {tuple(r) for r in latest(spark, target, T.StructType([*parts.schema.fields, T.StructField("bucket", T.IntegerType())])).select(*parts.columns).collect()}
    want = {}
    for r in sorted(events.collect(), key=lambda r: r.event_id):
        want[r.user_id] = tuple(r)
    assert got == set(want.values())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
