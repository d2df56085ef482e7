"""Findings of the fourth report, each beside a plain version."""

import random
import time
from difflib import SequenceMatcher

import numpy as np
import pytest

from orrery.operators import ratios, similarity
from orrery.operators.clusters import recursive_clusters
from orrery.operators.similarity import fuzzy_join
from orrery.queries import names, registry
from test_clustering import plain_clusters


def test_clusters_that_are_never_split(spark):
    """a cluster that a task cannot split gives no rows, not columns of no type."""
    x = np.concatenate([np.repeat([[1.0, 0.0, 0.0]], 8, axis=0), np.repeat([[0.0, 1.0, 0.0]], 9, axis=0), [[0.0, 0.0, 1.0]]])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    want = sorted(plain_clusters(x, 0.5, 3, 5, 0.1), key=str)
    assert len(want) == 17
    assert sorted(map(tuple, recursive_clusters(rows, "k", "v", 0.5, 3, 5, 0.1, cut=10).collect()), key=str) == want


def plain_letters(left, right):
    return [[sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()) for b in right] for a in left]


@pytest.mark.parametrize("letters, most", [("ab", 10), ("abc ", 25), ("abcdefghijklmnop é😀\0", 70), ("01", 64), ("a", 30)])
@pytest.mark.parametrize("few", [2, 512])
def test_matches_of_all_pairs_at_once(letters, most, few, monkeypatch):
    """runs, ties of runs and what is left beside them are those of the standard library, long names too."""
    monkeypatch.setattr(ratios, "FEW", few)
    monkeypatch.setattr(ratios, "PAIRS", 300)
    draw = random.Random(most)
    left, right = (sorted({"".join(draw.choice(letters) for _ in range(draw.randint(0, most))) for _ in range(40)}) for _ in range(2))
    right += ["a" * 210, "\0", ""]
    assert ratios.matched_letters(left, right).tolist() == plain_letters(left, right)
    assert ratios.matched_letters([], right).shape == (0, len(right))
    assert ratios.matched_letters([""], [""]).tolist() == [[0]]


def test_many_pairs_of_numbered_names_take_seconds():
    """a million pairs that the library, pair by pair, compares in half a minute."""
    draw = random.Random(5)
    left, right = (sorted(f"{w}#{k:09d}" for k in draw.sample(range(1_000_000), 1000)) for w in ("customer", "supplier"))
    start = time.time()
    got = ratios.matched_letters(left, right)
    assert time.time() - start < 10
    a, b = draw.sample(range(1000), 30), draw.sample(range(1000), 30)
    assert got[np.ix_(a, b)].tolist() == plain_letters([left[k] for k in a], [right[k] for k in b])


def test_name_similarity_of_tiles(spark, tmp_path, monkeypatch):
    """tiles, their ends and copies of names over several tiles lose and repeat no pair; nulls of a nation meet nobody."""
    for name, value in (("ROWS", 7), ("BATCH", 20), ("SALTS", 2), ("SOME", 3)):
        monkeypatch.setattr(ratios, name, value)
    draw = random.Random(2)
    texts = ["".join(draw.choice("anbe ") for _ in range(draw.randint(0, 9))) for _ in range(25)] + [None, "Same", "same", "same"] * 5
    customers = [(k, n, (0, 1, None)[k % 3]) for k, n in enumerate(texts * 2)]
    suppliers = [(k, n, (1, 0, 2, None)[k % 4]) for k, n in enumerate(texts)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    want = []
    for c, a, m in customers:
        for s, b, n in suppliers:
            if m == n and m is not None:
                x, y = (a or "").lower(), (b or "").lower()
                known = a is not None and b is not None
                score = 1.0 if known and x == y else 0.9 if known and y in x else round(SequenceMatcher(None, x, y).ratio(), 4)
                want += [(c, s, score)] if score >= 0.5 else []
    assert sorted(map(tuple, registry.queries()["name_similarity_join"](spark, str(tmp_path)).collect())) == sorted(want)


def test_match_confidence_of_tiles(spark, tmp_path, monkeypatch):
    """nations without a name or with two, null names and tiles of few rows: the pairs and scores of `match_rows`."""
    for name, value in (("ROWS", 3), ("BATCH", 10), ("SOME", 2)):
        monkeypatch.setattr(ratios, name, value)
    nations = [(0, "GERMANY"), (1, None), (2, "FRANCE"), (2, "PERU"), (2, "PERU")]
    draw = random.Random(9)
    customers = [(k, None if k == 5 else f" Cust{'omer' * (k % 2)}#{k % 40}", k % 4, draw.choice(["FURNITURE", "AB CD", ""]), draw.choice([-5.0, 1000.0, 3000.0, 5500.0, 8000.0, None])) for k in range(60)]
    suppliers = [(k, None if k == 6 else f" Supplier#{k % 20}", k % 3) for k in range(45)]
    spark.createDataFrame(nations, "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    want = []
    for o in names.match_rows(spark, str(tmp_path)).collect():
        sim = SequenceMatcher(None, (o.officer or "").strip(" "), (o.profile or "").strip(" ")).ratio()
        score = 0.5 if sim >= 0.95 else 0.4 if sim >= 0.85 else 0.25 if sim >= 0.7 else sim * 0.3
        text, words = o.text.lower(), [w for w in o.company.split(" ") if len(w) > 3]
        score += 0.3 if o.company and o.company in text else 0.15 if words and words[0] in text else 0.0
        if o.city and o.place:
            near = o.city.lower() in o.place.lower() or o.place.lower() in o.city.lower()
            score += 0.2 if near else 0.1 if "germany" in o.place.lower() else 0.0
        elif o.city:
            score += 0.15 if o.city.lower() in text else 0.0
        want.append((o.s_suppkey, o.c_custkey, ratios.four_digits(sim), ratios.four_digits(min(1.0, score))))
    found = registry.queries()["match_confidence"](spark, str(tmp_path))
    assert "MapInArrow" in found._jdf.queryExecution().toString()  # tiles meet, not pairs
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 100


def test_letters_of_pairs_at_once():
    """the table of all pairs of a batch is that of each, whatever their lengths."""
    draw = random.Random(1)
    left = ["".join(draw.choice("ab cdé😀") for _ in range(draw.randint(0, most))) for most in (5, 16, 17, 63, 64, 70) for _ in range(60)]
    right = draw.sample(left, len(left)) + ["", "", "a", "a"]
    left += ["", "a", "\0", "a\0"]
    assert similarity.indels(left, right).tolist() == [similarity.indel(a, b) for a, b in zip(left, right, strict=True)]


@pytest.mark.parametrize("threshold", [0.5, 0.85])
@pytest.mark.parametrize("keys", [0, 5, 64])
def test_names_that_share_most_letters(spark, threshold, keys, monkeypatch):
    """names found by the letters that they share are those found by rare tokens, and those of all pairs."""
    monkeypatch.setattr(similarity, "KEYS", keys)
    draw = random.Random(3)
    left = ["".join(draw.choice("0012") for _ in range(draw.randint(0, 9))) for _ in range(120)]
    right = ["".join(c for c in a if draw.random() > 0.15) + draw.choice(["", "1"]) for a in left]
    one = spark.createDataFrame([(k, a, k % 2) for k, a in enumerate([*left, "", None])], "i long, a string, g int")
    two = spark.createDataFrame([(k, b, k % 2) for k, b in enumerate([*right, "", None])], "j long, b string, g int")
    want = {(i, j) for i, a in enumerate([*left, ""]) for j, b in enumerate([*right, ""]) if i % 2 == j % 2 and round(similarity.indel(a, b), 4) >= threshold}
    got = [(r.i, r.j) for r in fuzzy_join(one, two, "a", "b", ["g"], threshold, 10_000, ["i", "j"]).collect()]
    assert set(got) == want and len(got) == len(want)


def test_numbers_are_not_met_by_common_tokens(spark, data):
    """numbers of nine digits share zeros, which are no keys."""
    found = registry.queries()["fuzzy_range_join"](spark, data)._jdf.queryExecution().toString()
    assert "part#" in found and "token#" not in found
