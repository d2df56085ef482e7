"""Findings of the third report: bounds, growth and costs of queries at size, each beside a plain version."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orrery.functions import extract as E
from orrery.functions import headlines as H
from orrery.functions import lexicon as L
from orrery.operators.clusters import recursive_clusters
from orrery.operators.vectors import knn
from orrery.sources.tables import spread
from test_clustering import plain_clusters, plain_knn, unit


def nested(seed=4):
    """Blobs of blobs of blobs, and vectors of no blob."""
    draw = np.random.default_rng(seed)
    blobs = [a + b + c + 0.01 * draw.normal(size=(8, 6)) for a in 3 * unit(draw.normal(size=(2, 6))) for b in 0.9 * unit(draw.normal(size=(3, 6))) for c in 0.25 * unit(draw.normal(size=(2, 6)))]
    return np.concatenate([*blobs, 3 * draw.normal(size=(20, 6))])


def test_clusters_in_one_task_and_in_tiles(spark):
    """whatever part of the clusters is finished in one task, the result is that of all pairs."""
    x = nested()
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    want = sorted(plain_clusters(x, 0.5, 3, 8, 0.04), key=str)
    assert max(r[3] for r in want) >= 2
    for cut in (16_384, 60):
        assert sorted(map(tuple, recursive_clusters(rows, "k", "v", 0.5, 3, 8, 0.04, cut=cut).collect()), key=str) == want


def test_words_by_their_letters(spark):
    """Patterns that begin with the keyword find what the spaced words hold, and a group's pattern of one word is read so too."""
    texts = ["from", "a from, b", "xfrom from_ fromage", "Of  the", "of-the", "of the9", "often the", "éfrom from", "the of the of", "fromfrom from", "", "of\nthe\n", "AI", "ai\n", "mail ai.", "äai", "œai ai"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumns({"low": F.lower("t"), "w": L.spaced(F.col("t"))})
    form = f"(^|[^{L.LETTERS}])ai($|[^{L.LETTERS}])"
    assert L._ONE_WORD.fullmatch(form)
    for word in ("from", "of the", "ai"):
        got = rows.select("t", L.has_word(F.col("low"), word).alias("a"), F.col("w").contains(f" {word} ").alias("b")).collect()
        assert [r.t for r in got if r.a != r.b] == [] and any(r.b for r in got)
    got = rows.select(L.any_pattern(F.col("t"), (form, "^x")).alias("a"), F.col("low").rlike(f"{form}|^x").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and any(r.b for r in got)


def test_names_are_looked_for_where_their_verbs_are(spark):
    """the guard of a pattern changes no name."""
    texts = ["Acme Labs raises $5m", "no verb here at all", "Alpha Beta erhält 2 Mio", "raises", "x raises", "Acme: 5 Mio", "12 closes raises", None, "Berlin-based Foo secures 3", "Startup Foo Bar"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (*E.COMPANY_PATTERNS, *H.name_patterns()):
        got = rows.select(E.found_after(F.col("t"), p).alias("a"), E.found(F.col("t"), p).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]


def test_large_files_are_dealt_over_all_cores(spark, tmp_path):
    """one file of one row group is no single task, however large."""
    pd.DataFrame({"k": range(1000), "t": ["x" * 50] * 1000}).to_parquet(tmp_path / "one.parquet")
    assert spread(spark.read.parquet(str(tmp_path / "one.parquet"))).rdd.getNumPartitions() >= 4
    import orrery.sources.tables as tables
    before, tables.SHARE = tables.SHARE, 100
    try:
        assert spread(spark.read.parquet(str(tmp_path / "one.parquet"))).rdd.getNumPartitions() > 4
    finally:
        tables.SHARE = before


def test_neighbours_of_the_rows_asked_for(spark):
    """rows that are asked for find their neighbours among all rows."""
    x = nested()
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None)], "k long, v array<double>")
    got = {}
    for r in knn(rows, "k", "v", 3, asked=F.col("k") % 10 == 0).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor)
    want = plain_knn(x, 3)
    assert got == {k: want[k] for k in range(0, len(x), 10)}
