"""Field-level changes, layouts, feeds, loads and canned queries against plain versions."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators.changes import apply_changes, field_changes
from orrery.operators.layout import layout_2d, principal_axes
from orrery.plans import canned
from orrery.sources.feeds import any_date, read_feeds
from orrery.sources.loads import observed_load
from orrery.storage import table_path


def test_field_changes_against_plain_rows(spark):
    old = [(1, "a", 1.0), (2, None, 2.0), (3, "c", None), (4, "d", float("nan")), (5, "e", 5.0)]
    new = [(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0), (4, "d", float("nan")), (6, "f", 6.0)]
    kind = "k long, name string, value double"
    got = field_changes(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), ["k"], ["name", "value"])
    want = {(2, "changed", "name", None, "b"), (3, "changed", "name", "c", None), (3, "changed", "value", None, "3.0"), (5, "removed", None, None, None), (6, "added", None, None, None)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    history = apply_changes(got.withColumn("version", F.lit(1)), got, 2)
    assert history.count() == 2 * len(want) and apply_changes(history, got, 2).count() == 2 * len(want)  # a version once
    assert field_changes(got.limit(0), got.limit(0), ["k"], ["field"]).count() == 0


def test_layout_against_plain_components(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    x = np.stack(list(rows.values()))
    x = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(x.T @ x / len(x))
    places = layout_2d(vectors, "vec_id", "embedding")
    got = {r.vec_id: (r.x, r.y) for r in places.collect()}
    for k, axis in enumerate((axes[:, -1], axes[:, -2])):
        want = dict(zip(rows, x @ axis * np.sign(axis[np.abs(axis).argmax()])))
        assert max(abs(want[i] - got[i][k]) for i in rows) < 1e-5
    con, frame = duckdb.connect(), places.toPandas()  # noqa: F841
    found = con.execute("SELECT var_pop(x), var_pop(y), covar_pop(x, y) FROM frame").fetchone()
    assert np.allclose(found, [values[-1], values[-2], 0], atol=1e-5)


def test_layout_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 0.0]), (4, [3.0, 2.5]), (4, [3.0, 2.5])], "k long, v array<double>")
    got = {r.k: r.x for r in layout_2d(rows, "k", "v").collect()}
    assert got[2] is None and got[3] is None and got[1] is not None and layout_2d(rows.limit(0), "k", "v").count() == 0
    assert principal_axes(rows.limit(0), "v")[0].size == 0


def test_feeds_of_both_kinds(spark, tmp_path):
    rss, atom = tmp_path / "rss", tmp_path / "atom"
    rss.mkdir(), atom.mkdir()
    (rss / "a.xml").write_text(
        """<rss version="2.0" xmlns:dc="d"><channel><title>feed</title><item><title> One </title><link>http://a/1</link><description><![CDATA[<p>Hi  <b>you</b></p>]]></description>
        <pubDate>Tue, 02 Jan 2024 10:00:00 +0100</pubDate></item><item><title>Two</title><link>http://a/2</link><dc:date>2024-01-03</dc:date></item><item><title>Three</x></item></channel></rss>"""
    )
    (atom / "b.xml").write_text(
        """<feed xmlns="x"><title>other</title><entry><title>Four</title><link rel="self" href="http://b/self"/><link rel="alternate" href="http://b/4"/><updated>2024-02-01T00:00:00Z</updated></entry>
        <entry><title>Five</title><link href="http://b/5"/><published>2024-02-02T03:00:00+03:00</published><updated>2024-03-01T00:00:00Z</updated><summary>x</summary></entry></feed>"""
    )
    got = {(r.kind, r.title, r.link, r.summary, str(r.published)) for r in read_feeds(spark, str(rss), str(atom)).filter("damaged is null").select("kind", "title", "link", "summary", F.col("published").cast("string")).collect()}
    assert got == {
        ("rss", "One", "http://a/1", "Hi you", "2024-01-02 09:00:00"), ("rss", "Two", "http://a/2", None, "2024-01-03 00:00:00"),
        ("atom", "Four", "http://b/4", None, "2024-02-01 00:00:00"), ("atom", "Five", "http://b/5", "x", "2024-02-02 00:00:00"),
    }
    assert read_feeds(spark, str(rss)).filter("damaged is not null").count() == 1
    with pytest.raises(ValueError):
        read_feeds(spark)


def test_six_date_formats(spark):
    texts = ["Tue, 02 Jan 2024 00:00:00 +0000", "02 Jan 2024 00:00:00 +0000", "2024-01-02T00:00:00Z", "2024-01-02 00:00:00", "02.01.2024", "2024-01-02", "soon", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.d for r in rows.select("k", any_date(F.col("t")).cast("string").alias("d")).orderBy("k").collect()]
    assert got == ["2024-01-02 00:00:00"] * 6 + [None, None]


def test_observed_counts_equal_counted_ones(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    where = table_path(spark, "load")
    seen = observed_load(orders, F.col("o_totalprice") > 100000, "o_custkey", where, {"most": F.max("o_custkey")})
    kept = orders.filter("o_totalprice > 100000")
    assert seen == {"read": orders.count(), "kept": kept.count(), "written": kept.select("o_custkey").distinct().count(), "most": kept.agg(F.max("o_custkey")).first()[0]}
    assert spark.read.parquet(where).count() == seen["written"]


def test_canned_queries(spark, data):
    for name in canned.CATALOGUE:
        assert canned.run_canned(spark, data, name).columns
    assert canned.run_canned(spark, data, "cell", mechanism="x' OR 'a' = 'a", sector="b").count() == 0  # bound, not pasted
    with pytest.raises(KeyError):
        canned.run_canned(spark, data, "nothing")
    with pytest.raises(TypeError):
        canned.run_canned(spark, data, "cell", size=3)
