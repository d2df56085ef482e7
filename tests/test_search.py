"""The stored index against a scan, ranks and stems against plain sums, and dictionaries against every span."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.functions.stem import porter
from orrery.operators import dictionary
from orrery.operators.fulltext import Index, build_index, search_prefixes, search_ranked
from orrery.operators.search import prefix_search
from orrery.queries.search import fts_stemmed
from orrery.storage import table_path

WORDS = re.compile("[a-z0-9]+").findall


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def plain_ranks(texts, asked, top, stemmed=False):
    name = porter if stemmed else str
    terms = {k: [name(w) for w in WORDS((t or "").lower())] for k, t in texts.items()}
    mean = sum(map(len, terms.values())) / len(terms)
    asked = list(dict.fromkeys(name(w) for w in WORDS(asked.lower())))
    df = Counter(w for t in terms.values() for w in set(t))
    scores = {}
    for k, t in terms.items():
        tf = Counter(t)
        parts = [math.log(1 + (len(terms) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in asked if tf[w]]
        if parts:
            scores[k] = round(sum(parts), 6)
    return sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:top]


@pytest.mark.parametrize("words", ["than er", "th*", "e", "no-such-word er", "THE the", "", "!!"])
def test_prefix_search_equals_a_scan(spark, docs, words):
    index = build_index(docs, "doc_id", F.col("text"), table_path(spark, "index"))
    want = {(r.doc_id, r.hits) for r in prefix_search(docs, "doc_id", F.col("text"), " ".join(dict.fromkeys(words.lower().split()))).collect()}
    assert {(r.key, r.hits) for r in search_prefixes(index, words).collect()} == want


def test_index_is_read_again_and_pruned(spark, docs):
    where = table_path(spark, "index")
    built = build_index(docs, "doc_id", F.col("text"), where)
    again = Index(spark, where)
    assert search_prefixes(again, "than").count() == search_prefixes(built, "than").count() > 0
    plan = search_prefixes(again, "than")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,than)" in plan
    ends = again.postings().groupBy(F.input_file_name()).agg(F.min("term").alias("a"), F.max("term").alias("b")).orderBy("a").collect()
    assert all(x.b <= y.a for x, y in zip(ends, ends[1:]))  # files are ranges of terms


@pytest.mark.parametrize("stemmed", [False, True])
def test_ranks_against_plain_sums(spark, docs, stemmed):
    index = build_index(docs, "doc_id", F.col("text"), table_path(spark, "index"), stems=True)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for asked in ("than the er", "ering thes", "nothing-of-this-kind"):
        got = [(r.key, r.score) for r in search_ranked(index, asked, 20, stemmed).orderBy("rank").collect()]
        want = plain_ranks(texts, asked, 20, stemmed)
        assert [k for k, _ in got] == [k for k, _ in want] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got, want))


def test_index_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "Büro ROOM room"), (None, "room")], "k long, text string")
    index = build_index(rows, "k", F.col("text"), table_path(spark, "index"), stems=True)
    assert {(r.key, r.hits) for r in search_prefixes(index, "roo").collect()} == {(3, 2), (None, 1)}
    empty = build_index(rows.limit(0), "k", F.col("text"), table_path(spark, "index"))
    assert search_prefixes(empty, "a").count() == search_ranked(empty, "a", 5).count() == 0


# Examples that the published algorithm gives.
STEMS = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat "
    "troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat "
    "conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal "
    "triplicate triplic formative form formalize formal electriciti electr electrical electr goodness good revival reviv allowance allow inference infer "
    "airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog "
    "communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll"
).split()


def test_stems():
    assert [porter(w) for w in STEMS[::2]] == STEMS[1::2]
    assert porter("at") == "at" and porter("x86ing") == "x86ing" and porter("") == ""


def test_stemmed_query(spark, data, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [r.doc_id for r in fts_stemmed(spark, data).orderBy("rank").collect()] == [k for k, _ in plain_ranks(texts, "ering thes", 50, True)]


# -- dictionaries ---------------------------------------------------------------------------------------------------------
def plain_matches(text, names, longest):
    words = WORDS((text or "").lower())
    found = [(i + 1, len(p), k) for k, n in names if (p := WORDS((n or "").lower())) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    if not longest:
        return found
    kept, end = [], 0
    for start in sorted({m[0] for m in found}):
        if start > end:
            size = max(n for s, n, _ in found if s == start)
            kept += [m for m in found if m[:2] == (start, size)]
            end = start + size - 1
    return kept


@pytest.mark.parametrize("longest", [True, False])
@pytest.mark.parametrize("most", [dictionary.MOST_NAMES, 3])
def test_names_against_every_span(spark, longest, most):
    draw = random.Random(7)
    alphabet = ["a", "b", "c", "alpha", "Beta"]
    names = [(k, " ".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 5)))) for k in range(40)] + [(90, "..."), (91, None), (92, "a-b"), (93, "a b")]
    texts = [(k, draw.choice([" ", "-", ", "]).join(draw.choice(alphabet) for _ in range(draw.randrange(0, 40)))) for k in range(60)] + [(100, None), (1, "a b"), (None, "beta a")]
    found = dictionary.find_names(
        spark.createDataFrame(texts, "key long, text string"), "key", F.col("text"), spark.createDataFrame(names, "words long, name string"), "words", "name", longest, most
    )
    want = Counter((k, *m) for k, t in texts for m in plain_matches(t, names, longest))
    assert Counter(map(tuple, found.collect())) == want and found.columns == ["key", "start", "words", "name_id"]


def test_names_of_empty_tables(spark):
    texts, names = spark.createDataFrame([(1, "a b")], "k long, t string"), spark.createDataFrame([("x", "a")], "id string, name string")
    assert dictionary.find_names(texts.limit(0), "k", F.col("t"), names, "id", "name").count() == 0
    assert dictionary.find_names(texts, "k", F.col("t"), names.limit(0), "id", "name").count() == 0


def test_thousands_of_names_in_one_pass():
    names = [(k, [f"w{k % 97}", f"w{k % 89}", f"w{k % 83}"]) for k in range(5000)]
    own = dictionary.Automaton(names)
    by_words = defaultdict(list)
    for k, w in names:
        by_words[tuple(w)].append(k)
    draw = random.Random(1)
    words = [f"w{draw.randrange(97)}" for _ in range(3000)] + names[7][1] + names[4321][1]
    want = sorted((i + 1, 3, k) for i in range(len(words) - 2) for k in by_words.get(tuple(words[i : i + 3]), []))
    assert sorted(own.matches(words)) == want and want
