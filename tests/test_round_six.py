"""Findings still open after the third session: register matches of words that are in many names, blocks of collocations."""

import random
import time

from pyspark.sql import functions as F

from orrery.llm import collocations
from orrery.operators.linking import overlap_matches, shared_parts
from orrery.queries.companies import FIRST_WORDS
from orrery.queries.linking import _TARGET, STOP


def test_a_word_of_all_names_makes_no_pairs(spark):
    n = 20_000  # pairs of a target and an entry that share a word: 400 million
    targets = spark.range(n).select(F.concat(F.lit("The a"), "id").alias("target"))
    register = spark.range(n).select("id", F.concat(F.lit("the b"), "id", F.lit(" GmbH")).alias("name"), (F.col("id") % 7 == 5).alias("active"))
    began = time.perf_counter()
    found = overlap_matches(targets, register, "target", F.col("name"), "id", F.col("active"), STOP)
    got = found.groupBy("id", "score").count().collect()
    assert [tuple(r) for r in got] == [(5, 0.6, n)]
    assert time.perf_counter() - began < 60


def test_parts_equal_all_substrings(spark):
    rng = random.Random(5)
    make = lambda n: [" ".join(rng.choice(["a", "ab", "b", "ba", "gmbh", "\tc", "cab "]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for inner in (make(30) + [" ab"], ["a", "ab b", "ba gmbh"], []):
        outer = make(40) + ["gmbh", " "]
        own = [set(w.split()) - set(STOP) for w in outer]
        most, lengths = max((len(t.split()) for t in inner), default=0), {len(t) for t in inner}
        want = {(k, t[s:e], len(own[k] & set(t[s:e].split()))) for k, t in enumerate(outer) for s in range(len(t)) for e in range(s + 1, len(t) + 1) if e - s in lengths}
        want = {(k, p, c) for k, p, c in want if c and len(p.split()) <= most and (p in inner)}
        frame = spark.createDataFrame(list(enumerate(outer)), "k int, text string")
        got = shared_parts(frame, "text", STOP, spark.createDataFrame([(t,) for t in inner], "t string"), "t")
        assert {tuple(r) for r in got.collect() if r.part in inner} == want


def test_first_words_stand_for_the_text(spark):
    texts = ["", " ", "a", "a b", "a\nb c", "\n\na", " a b", "a  b", "é,\tx\r y z", "x" * 30_000, "a b" * 9, None]
    for n_chars in (3, 4):
        rows = spark.createDataFrame([(t, n_chars) for t in texts], "text string, n_chars int").coalesce(1)
        target = _TARGET.replace("chr(10)", "char(10)")
        whole = [r.t for r in rows.selectExpr(f"{target} AS t").collect()]
        assert [r.t for r in rows.selectExpr(f"{FIRST_WORDS} AS text", "n_chars").selectExpr(f"{target} AS t").collect()] == whole


def test_blocks_are_full_whatever_the_languages(spark):
    texts = [("one two. three " * 10, f"l{k % 3}") for k in range(90)]
    rows = spark.createDataFrame(texts, "text string, lang string").coalesce(1)
    blocks = collocations.word_occurrences(rows, block_words=200).selectExpr("lang", "aggregate(counts, 0L, (a, x) -> a + x) AS n").collect()
    assert sum(b.n for b in blocks) == 2700 and len(blocks) <= 24  # before: 54
    many = spark.createDataFrame([(t, f"l{k}") for k, (t, _) in enumerate(texts)], "text string, lang string").coalesce(1)
    assert collocations.word_occurrences(many, block_words=200).count() == 90  # one of each language


def test_words_end_at_blanks_and_ends_only(spark):
    odd = ["a\x1cb\x85c\xa0d\u2003e \x00 x", "..a,, b!\x0b\x0cc", " \t", "...", "a.b", "É\u0130A İ", "\t a  b\t. "]
    rows = spark.createDataFrame([(t, "x") for t in odd], "text string, lang string").coalesce(1)
    found = collocations.phrase_counts(collocations.word_occurrences(rows)).collect()
    assert {r.phrase: r.n for r in found} == {"a\x1cb\x85c\xa0d\u2003e": 1, "\x00": 1, "x": 1, "a": 3, "b": 3, "c": 1, "É\u0130a": 1, "İ": 1}
