"""Pruned neighbours, clusters of any depth and the news job against plain versions."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from orrery.operators.clusters import recursive_clusters
from orrery.operators.neighbours import pruned_knn, text_vectors
from orrery.storage import table_path
from orrery.streaming.news import TABLES, read_output, run_news_job


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def blobs(n_blobs, each, spread, seed=0, size=8):
    draw = np.random.default_rng(seed)
    return np.concatenate([c + spread * draw.normal(size=(each, size)) for c in 3 * unit(draw.normal(size=(n_blobs, size)))])


def plain_knn(x, k):
    x = unit(x)
    sims = np.round(x @ x.T, 9)
    np.fill_diagonal(sims, -2)
    return {i: sorted(range(len(x)), key=lambda j: (-sims[i, j], j))[:k] for i in range(len(x))}


def test_pruned_neighbours_equal_all_pairs(spark):
    x = np.concatenate([blobs(12, 25, 0.05), np.repeat(blobs(1, 1, 0, 9), 60, axis=0)])  # a group of copies
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "k long, v array<double>")
    found, pairs = pruned_knn(rows, "k", "v", 4, pivots=14, tile=20)
    got = defaultdict(dict)
    for r in found.collect():
        got[r.id][r.rank] = r.neighbor
    assert {i: [m[k] for k in sorted(m)] for i, m in got.items()} == plain_knn(x, 4)
    assert (p := pairs.first()).visited < 0.6 * p.pairs
    assert pruned_knn(rows.limit(0), "k", "v", 4)[0].count() == 0


def test_pruned_neighbours_of_few(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k long, v array<double>")
    assert {(r.id, r.neighbor, r.rank) for r in pruned_knn(rows, "k", "v", 5)[0].collect()} == {(1, 2, 1), (2, 1, 1)}


def test_text_vectors(spark):
    rows = spark.createDataFrame([(1, "red apples and pears"), (2, "red apples and plums"), (3, "quantum chromodynamics lectures"), (4, ""), (5, None)], "k long, t string")
    got = {r.k: r.vector for r in text_vectors(rows, "k", F.col("t"), 512).collect()}
    assert got[4] is None and got[5] is None and abs(np.linalg.norm(got[1]) - 1) < 1e-9
    assert np.dot(got[1], got[2]) > np.dot(got[1], got[3])


def plain_clusters(x, least, neighbours, most, step, top=0.999):
    sims = unit(x) @ unit(x).T
    np.fill_diagonal(sims, -1)
    waiting, found, next_id, depth = {-1: list(range(len(x)))}, [], 0, 0
    while least <= top and waiting:
        later = {}
        for cluster in sorted(waiting):
            ids = waiting[cluster]
            core = [i for i in ids if sum(sims[i, j] >= least for j in ids) >= neighbours]
            part, left = [], set(core)
            for i in core:
                if i in left:
                    left.discard(i)
                    todo, own = [i], []
                    while todo:
                        own.append(a := todo.pop())
                        near = [b for b in left if sims[a, b] >= least]
                        left.difference_update(near)
                        todo += near
                    part.append(sorted(own))
            if depth and len(part) < 2:
                if cluster >= 0:
                    later[cluster] = ids
                continue
            for own in sorted(part):
                found += [(i, next_id, None if cluster < 0 else cluster, depth) for i in own]
                if len(own) > most:
                    later[next_id] = own
                next_id += 1
        waiting, depth, least = later, depth + 1, least + step
    return found


def test_clusters_of_any_depth(spark):
    """Blobs of blobs of blobs."""
    draw = np.random.default_rng(4)
    x = np.concatenate([a + b + c + 0.01 * draw.normal(size=(8, 6)) for a in 3 * unit(draw.normal(size=(2, 6))) for b in 0.9 * unit(draw.normal(size=(3, 6))) for c in 0.25 * unit(draw.normal(size=(2, 6)))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    got = recursive_clusters(rows, "k", "v", 0.5, 3, 8, 0.04)
    want = plain_clusters(x, 0.5, 3, 8, 0.04)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and max(r[3] for r in want) >= 2
    assert recursive_clusters(rows.limit(0), "k", "v", 0.5, 3, 8).count() == 0


# -- the news job ---------------------------------------------------------------------------------------------------------
START = datetime(2024, 1, 10)


def extract(batch):
    parts = F.split("title", r"\|")
    return batch.select("link", parts[0].alias("company"), parts[1].try_cast("double").alias("amount"), F.when(parts[2] == "", F.array().cast("array<string>")).otherwise(F.split(parts[2], ",")).alias("investors"), "published")


def outputs(spark, where):
    return {name: Counter(map(tuple, read_output(spark, where, name).collect())) for name in TABLES}


def test_news_job_goes_on_and_repeats_nothing(spark):
    source, where = table_path(spark, "in"), table_path(spark, "out")
    kind = "link string, title string, published timestamp"
    companies = spark.createDataFrame([("acme",), ("beta",)], "company string")

    def arrive(*rows):
        spark.createDataFrame([(a, t, None if d is None else START + timedelta(days=d)) for a, t, d in rows], kind).coalesce(1).write.mode("append").parquet(source)

    def run():
        run_news_job(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source), companies, extract, where)
        return outputs(spark, where)

    arrive(("u1", "acme|5e6|x,y", 0), ("u1", "acme|5e6|x,y", 0), ("u2", "beta|2e7|", 1), (None, "acme|1|", 1), ("u9", "acme|1|", None))
    first = run()
    assert sum(first["mentions"].values()) == 2 and first["investments"] == Counter({("acme", "x", 5e6, "u1"): 1, ("acme", "y", 5e6, "u1"): 1})
    assert first["alerts"] == Counter({("beta", "u2", "large round"): 1}) and sum(first["events"].values()) == 2
    assert run() == first  # nothing new
    arrive(("u1", "acme|5e6|x,y", 0), ("u3", "gone||z", 12))
    second = run()
    assert sum(second["mentions"].values()) == 3 and second["alerts"][("gone", "u3", "unknown company")] == 1 and second["investments"] == first["investments"]
    arrive(("u4", "acme|1e6|", -20), ("u5", "acme|1e6|", 13))  # the first is later than the watermark allows
    third = run()
    assert {m[0] for m in third["mentions"]} == {"u1", "u2", "u3", "u5"}


def test_a_repeated_batch_changes_nothing(spark):
    """A failure after two of the four tables are written: the next start repeats the batch."""
    source, where = table_path(spark, "in"), table_path(spark, "out")
    kind = "link string, title string, published timestamp"
    spark.createDataFrame([(f"u{k}", f"acme|{k}e6|x", START) for k in range(1, 5)], kind).coalesce(1).write.parquet(source)
    companies = spark.createDataFrame([("acme",)], "company string")
    stream = spark.readStream.schema(kind).parquet(source)
    broken = companies.select(F.when(F.col("company") == "acme", F.raise_error(F.lit("lost"))).cast("string").alias("company"))
    try:
        run_news_job(stream, broken, extract, where)
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    else:
        raise AssertionError("the job should have failed")
    assert read_output(spark, where, "mentions").count() == 4  # written before the failure
    run_news_job(spark.readStream.schema(kind).parquet(source), companies, extract, where)
    found = outputs(spark, where)
    assert sum(found["mentions"].values()) == 4 and sum(found["events"].values()) == 4 and sum(found["investments"].values()) == 4
