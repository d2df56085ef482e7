"""Odd inputs and larger tables, as found in round 3."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import blocks, vectors
from orrery.operators.similarity import fuzzy_join, pairs_of_copies
from orrery.queries import registry


def oracle(folder, name, *tables, edit=lambda sql: sql):
    """Rows of a query's SQL over a folder of tables."""
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'' if str(folder).startswith('/root') else '/*.parquet'}')")
    found = con.execute(edit(registry.oracle_sql()[name]))
    columns = [c[0] for c in found.description]
    return columns, sorted(map(repr, found.fetchall()))


def same_rows(rows, want):
    columns, found = want
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows.collect()) == found


def test_feed_titles_that_begin_with_digits(spark, tmp_path):
    page = "<html><title>{}</title></html>"
    rows = [(1, "http://a/x", page.format("90904537960215852590 b")), (2, "https://a/#y", page.format("77")), (3, "https://a/?p=<b>9</b>", page.format(" 5")), (4, "http://a/#<b>8</b>", page.format(""))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same_rows(registry.queries()["feed_files"](spark, str(tmp_path)), oracle(tmp_path, "feed_files", "pages"))


def test_selected_export_cut_among_equals(spark, data, monkeypatch):
    from orrery.queries import exports

    whole = exports.X.selected
    for limit in (1, 2, 3, 5, 8, 13, 21):
        monkeypatch.setattr(exports.X, "selected", lambda *a, n=limit: whole(*a, limit=n))
        same_rows(registry.queries()["export_selected"](spark, data), oracle(data, "export_selected", "documents", edit=lambda sql, n=limit: sql.replace("LIMIT 10000", f"LIMIT {n}")))


def test_copies_are_scored_once(spark):
    left = spark.createDataFrame([(k, k % 2, ("a", None, "")[k % 3]) for k in range(60)] + [(99, None, "a")], "i long, g int, x string")
    right = spark.createDataFrame([(k, k % 2, ("a", "b", None)[k % 3]) for k in range(30)], "j long, g int, y string")
    told = spark.sparkContext.accumulator(0)
    plain = [(a.i, b.j, f"{a.x}{b.y}") for a in left.collect() for b in right.collect() if a.g == b.g]

    def score(pairs):
        seen = pairs.rdd.map(tuple).count()
        told.add(seen)
        return pairs.withColumn("s", F.concat(F.coalesce("x", F.lit("None")), F.coalesce("y", F.lit("None"))))

    got = pairs_of_copies(left, right, "i", "j", ["g"], score).collect()
    assert sorted(map(tuple, got)) == sorted(plain)
    assert told.value == 2 * 3 * 3


def test_match_confidence_scores_copies_once(spark, data, tmp_path):
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        rows = spark.read.parquet(f"{data}/{name}.parquet")
        rows.unionByName(rows.withColumn(key, F.col(key) + 100_000)).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{data}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    one = {(r[0], r[1]): tuple(r)[2:] for r in registry.queries()["match_confidence"](spark, data).collect()}
    found = registry.queries()["match_confidence"](spark, str(tmp_path))
    assert "sequence_ratio" not in found._jdf.queryExecution().toString()  # scores are read, not taken again for each copy
    two = found.collect()
    assert len(two) == 4 * len(one) > 0
    assert all(one[r.s_suppkey % 100_000, r.c_custkey % 100_000] == (r.similarity, r.confidence) for r in two)


def test_best_match_of_odd_balances(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    balances = [9001.0, 9001.25, 9001.25, 9500.0, 12000.0, None, nan, inf, 1e300, 9000.0]
    customers = [(k, k % 3, b) for k, b in enumerate(balances * 3)] + [(90, None, 9999.0), (91, 3, 9999.0), (92, 4, 9999.0)]
    suppliers = [(5, 0, 9001.25), (3, 0, 9001.25), (4, 0, 9000.75), (1, 0, 9501.0), (2, 0, 9499.0), (7, 1, 1e-20), (6, 1, 2e-20), (8, 2, None), (9, 2, nan), (10, 2, -inf), (11, 2, 8.0), (12, 3, None), (13, None, 1.0)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = registry.queries()["best_match"](spark, str(tmp_path))
    same_rows(found, oracle(tmp_path, "best_match", "customer", "supplier"))


def test_fuzzy_join_of_many_copies(spark):
    """20,000 copies on each side are 400 million pairs, of which each row keeps two."""
    left = spark.range(20_000).select(F.col("id").alias("i"), F.lit("same name").alias("a"))
    right = spark.range(20_000).select((F.col("id") + 7).alias("j"), F.lit("same names").alias("b"))
    found = fuzzy_join(left, right, "a", "b", [], 0.8, 2, ["i", "j"])
    assert found.groupBy("j", "pos").count().sort("pos").collect() == [(7, 1, 20_000), (8, 2, 20_000)]


@pytest.mark.parametrize("same", [True, False])
def test_blocks_equal_all_pairs(same, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 64)
    monkeypatch.setattr(blocks, "COLUMNS", 100)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(330, 12))
    x[40:150], x[7] = x[40], 0  # copies, and a vector without a direction
    x = blocks.unit(pd.Series(list(x)))
    y = x if same else blocks.unit(pd.Series(list(draw.normal(size=(250, 12)))))
    ids, others = np.arange(len(x)), np.arange(len(y)) + (0 if same else 300)
    sims = x @ y.T
    sims[ids[:, None] == others[None, :]] = -2
    order = np.lexsort((np.broadcast_to(others, sims.shape), -np.round(sims, 9)), axis=1)[:, :4]
    got = blocks.nearest(x, ids, y, others, 4)
    assert got["id"].tolist() == np.repeat(ids, 4).tolist() and got["neighbor"].tolist() == others[order.ravel()].tolist()
    counts, up = blocks.close(x, y, 0.6, same)
    near = (sims if same else x @ y.T) >= 0.6
    n = len(counts)
    links = near if same else np.block([[np.zeros((len(x), len(x)), bool), near], [near.T, np.zeros((len(y), len(y)), bool)]])
    least = np.arange(n)
    while not np.array_equal(least, best := np.minimum(least, np.where(links, least, n).min(axis=1))):
        least = best
    assert counts.tolist() == links.sum(axis=1).tolist()
    assert len(set(zip(least, up, strict=True))) == len(set(least)) == len(set(up))


def test_vectors_are_sent_to_few_tiles(spark):
    rows = spark.range(300_000).select("id", F.lit(None).cast("array<float>").alias("v"))
    assert vectors._tiles(rows, "id", "v")[1] == 19
