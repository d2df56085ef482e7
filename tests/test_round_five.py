"""Findings of the third report that were still open: bounds and growth of steps, each beside a plain version."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import fulltext, hierarchy, vectors
from orrery.operators.neighbours import cells_of, knn_in_cells
from test_clustering import plain_knn, unit
from test_hierarchy import groups


def plain_tree(x, k):
    """The minimum spanning tree of mutual reachability by all edges in order."""
    d = np.round(np.sqrt(np.maximum(0, 2 - 2 * unit(x) @ unit(x).T)), 6)
    core = np.sort(np.where(np.eye(len(x), dtype=bool), np.inf, d), axis=1)[:, k - 1]
    edges = sorted((max(d[i, j], core[i], core[j]), i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
    up, tree = list(range(len(x))), []
    for w, i, j in edges:
        a, b = i, j
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        if a != b:
            up[a] = b
            tree.append((w, i, j))
    return core, tree


@pytest.mark.parametrize("tile, few", [(40, 0), (40, 100), (500, 100)])
def test_spanning_tree_from_pairs_of_tiles(spark, monkeypatch, tile, few):
    """the tree from the trees of tiles and of their pairs is that of all edges, ties included."""
    monkeypatch.setattr(hierarchy, "FEW", few)
    x = groups()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = hierarchy.spanning_tree(cells_of(rows, 12, tile), 3).collect()
    assert sorted(map(tuple, found)) == sorted(plain_tree(x, 3)[1])


def test_tree_of_two_sides():
    """a tree of edges between two sides and of known ones."""
    x = unit(np.concatenate([groups(), np.repeat(groups()[:1], 9, axis=0)]))
    core, want = plain_tree(x, 3)
    side = np.random.default_rng(1).integers(0, 2, len(x))
    known = [np.flatnonzero(side == s) for s in (0, 1)]
    inner = [(hierarchy.tree_of(x[at], core[at]), at) for at in known]
    given = tuple(np.concatenate(c) for c in zip(*[(w, at[lo], at[hi]) for (w, lo, hi), at in inner]))
    assert sorted(zip(*map(np.ndarray.tolist, hierarchy.tree_of(x, core, side, given)))) == sorted((float(w), i, j) for w, i, j in want)


def test_no_copy_of_a_vector_for_each_cell(spark):
    """a vector is staged once with the tiles it visits, and near cells share a tile."""
    x = np.random.default_rng(5).normal(size=(400, 24))  # nothing can be pruned
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    cells = cells_of(rows, 20, 100)
    assert len(cells.tiles) > 10 and 1 + max(max(t) for t in cells.tiles) <= 8
    found, pairs = knn_in_cells(cells, 3)
    got = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor)
    assert got == plain_knn(x, 3) and pairs.first().pairs <= 64


@pytest.mark.parametrize("few", [0, 7, 1000])
def test_clusters_far_inside_one_another(spark, few):
    """a chain of clusters is scored in one task, or in rounds down to ``few``; the choice is the same."""
    rows = [(100 + d, 101 + d if d < 20 else None, float(d % 7) + 1) for d in range(21)] + [(50 + d, 101 + d, 1.5 * (d % 3)) for d in range(20)]
    score, best = {}, {}
    for c, up, stable in sorted(rows):
        below = [score[x] for x, y, _ in rows if y == c]
        score[c] = max(stable, sum(below))
        best[c] = c if not below or stable >= sum(below) else None
    up = {c: y for c, y, _ in rows}
    best = {c: b if up[c] is not None else None for c, b in best.items()}
    want = {}
    for c in best:
        way, at = [], c
        while at is not None:
            way.append(at)
            at = up[at]
        want[c] = next((a for a in reversed(way) if best[a] is not None), None)
    got = hierarchy._selected(spark.createDataFrame(rows, "cluster long, parent long, stability double"), few).collect()
    assert {r.cluster: r.best for r in got} == want


def test_index_rows_are_terms_of_batches(spark, monkeypatch, tmp_path):
    """What is shuffled and sorted is a row a term of a batch; repeated keys and stems meet in the search."""
    texts = [(k % 50, f"Running runs: run{k % 7} the-THE é{'x' * (k % 3)} {k}") for k in range(120)] + [(7, None), (8, ""), (None, "the ..")]
    rows = spark.createDataFrame(texts, "k long, text string").coalesce(1)
    index = fulltext.build_index(rows, "k", F.col("text"), f"file://{tmp_path}/one", stems=True)
    terms = [[w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w] for _, t in texts]
    assert spark.read.parquet(f"file://{tmp_path}/one/term").count() == len({w for t in terms for w in t})
    monkeypatch.setattr(fulltext, "BATCH", 1)
    small = fulltext.build_index(rows, "k", F.col("text"), f"file://{tmp_path}/two", stems=True)
    want = Counter((w, k) for (k, _), t in zip(texts, terms) for w in t)
    for one in (index, small):
        assert {(r.term, r.key): r.tf for r in one.postings().groupBy("term", "key").agg(F.sum("tf").alias("tf")).collect()} == want
        assert one.totals().first().asDict() == {"texts": 50, "terms": sum(want.values())}
    for asked, stemmed in (("the run3", False), ("running", True)):
        a, b = (fulltext.search_ranked(i, asked, 20, stemmed).collect() for i in (index, small))
        assert a == b and len(a) == 20


def test_terms_held_are_bounded(spark, monkeypatch):
    """F16: a task passes its terms on when it holds many, and the counts are the same."""
    rows = spark.createDataFrame([("a" if k % 3 else None, [f"w{k % 11}", f"x{k}", "y"]) for k in range(300)] + [("b", None)], "g string, w array<string>").coalesce(1)
    want = sorted(map(tuple, vectors.term_counts(rows, "g", "w").collect()), key=str)
    monkeypatch.setattr(vectors, "HELD", 20)
    assert sorted(map(tuple, vectors.term_counts(rows, "g", "w").collect()), key=str) == want
