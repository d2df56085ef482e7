import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.functions import extract as E
from orrery.functions import lexicon as L
from orrery.functions import scoring as S
from orrery.functions import text as X
from orrery.operators import vectors
from orrery.operators.aliases import tag_aliases
from orrery.operators.graph import connected_components
from orrery.operators.ranking import global_rank
from orrery.operators.similarity import indel
from orrery.operators.vectors import knn, similar


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abcd", max_size=30), st.text("abcd", max_size=30))
def test_indel_is_twice_the_common_subsequence(a, b):
    want = 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
    assert indel(a, b) == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (None, 1), (10, 11), (11, 12), (12, 13), (13, 14), (14, 10)]
    rows = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in connected_components(rows, "a", "b").collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 8, 9: 8, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_normalisers(spark):
    row = spark.range(1).select(
        X.normalize_name(F.lit("Acme-Soft GmbH & Co. KG")).alias("a"),
        X.normalize_tag(F.lit(" Web Apps ")).alias("b"),
        X.normalize_tag(F.lit("business")).alias("c"),
        X.normalize_person(F.lit("Dr. Prof. Ada  Lovelace")).alias("d"),
        X.host_of(F.lit("HTTPS://www.Example.com:8080/x?y")).alias("e"),
        X.german_number(F.lit("1.234.567,89")).alias("f"),
        X.german_number(F.lit("none")).alias("g"),
    ).first()
    assert tuple(row) == ("acme soft", "web-app", "business", "ada lovelace", "example.com", 1234567.89, None)


def test_knn_of_ties(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id long, v array<double>")
    found = {(r.id, r["rank"]): r.neighbor for r in knn(rows, "id", "v", 2).collect()}
    assert found == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 1, (3, 2): 2}


def test_global_rank(spark):
    rows = spark.createDataFrame([(k * 7919 % 1000, k) for k in range(1000)] + [(None, -1)], "v long, k long").repartition(5)
    found = {r.k: r.rank for r in global_rank(rows, [F.asc_nulls_last("v")], "rank").collect()}
    assert found[-1] == 1001 and all(found[k] == k * 7919 % 1000 + 1 for k in range(1000))


def test_lexicon(spark):
    lexicon = L.Lexicon(("ki", "künstliche intelligenz", "robot"), ("robot",), {"AI": (r"\.ai",)})
    texts = ["Künstliche  Intelligenz, KI!", "KIesel robotik", "x.ai ROBOT-Robot", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", L.spaced(F.col("t")))
    got = rows.select(L.relevance(F.col("t"), F.col("w"), lexicon).alias("s"), L.matched(F.col("t"), F.col("w"), lexicon).alias("m")).collect()
    assert [(r.s, r.m) for r in got] == [(2, ["ki", "künstliche intelligenz"]), (0, []), (4, ["robot", "[AI]"]), (0, []), (0, [])]


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "lex.json").write_text(
        '{"category": "b", "priority": 1, "keywords": ["One ", "two"], "exclude": ["Four"]}\n{"category": "a", "keywords": ["one", "three", "four", ""]}\n'
    )
    rows = L.read_lexicon(spark, f"file://{tmp_path}")
    assert L.from_table(rows) == {"b": ["one", "two"], "a": ["three"]}


def test_legal_forms(spark):
    names = ["Acme GmbH & Co. KG", "Management Plus", "Foo gGmbH", "Bar UG (haftungsbeschränkt)", "e.V. Haus", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    loose, whole = ([r[0] for r in rows.select(S.legal_form(F.col("n"), whole_words=w)).collect()] for w in (False, True))
    assert loose == ["GmbH & Co. KG", "AG", "gGmbH", "UG (haftungsbeschränkt)", "e.V.", None]
    assert whole == ["GmbH & Co. KG", None, "gGmbH", "UG (haftungsbeschränkt)", "e.V.", None]


def test_extraction_of_hostile_texts(spark):
    rows = spark.createDataFrame([(1, "Bestellt als Geschäftsführer: Prof. Dr. Eva Öz-Maß, *01.01.1980; ; x und Otto Kern. Abberufen Prokurist: Otto Kern."), (2, ""), (3, None), (4, "Vorstand: : ;")], "id long, t string")
    found = {(r.id, r.officer, r.role, r.action) for r in E.officers(rows, "id", F.col("t")).collect()}
    assert found == {(1, "Prof. Dr. Eva Öz-Maß", "Geschäftsführer", "appointed"), (1, "Otto Kern", "Geschäftsführer", "appointed"), (1, "Otto Kern", "Prokurist", "dismissed")}
    amounts = [r[0] for r in spark.createDataFrame([("EUR 1.000,50 und 2.000 Euro, 1.000,50 EUR",), ("0 EUR ... EUR",), ("",)], "t string").select(E.capital_amounts(F.col("t"))).collect()]
    assert [sorted(a) for a in amounts] == [[1000.5, 2000.0], [], []]


def test_similar_forest(spark):
    draw = np.random.default_rng(0)
    base = draw.normal(size=(40, 8))
    x = np.concatenate([base, base[:20] + draw.normal(size=(20, 8)) * 0.3])
    rows = spark.createDataFrame([(k, [float(v) for v in r], k % 2) for k, r in enumerate(x)], "id long, v array<double>, g int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for within in (None, "g"):
        near = (unit @ unit.T >= 0.7) & ~np.eye(len(x), dtype=bool)
        if within:
            near &= (np.arange(len(x)) % 2)[:, None] == np.arange(len(x)) % 2
        for tile in (1024, 16):
            vectors.TILE = tile
            found = similar(rows, "id", "v", 0.7, within)
            got = {r.id: r.n for r in found.groupBy("id").agg(F.sum("n").alias("n")).collect()}
            assert got == {k: int(n) for k, n in enumerate(near.sum(axis=1)) if n}
            parts = {r.node: r.component for r in connected_components(found, "id", "up").collect()}
            label = list(range(len(x)))
            for _ in range(len(x)):
                label = [min([label[k], *[label[j] for j in np.flatnonzero(near[k])]]) for k in range(len(x))]
            assert parts == {k: label[k] for k in got}
    vectors.TILE = 1024


def test_tag_aliases(spark):
    tags = [("SaaS Subscription", 5), ("saas_subscription", 2), ("subscription-saas", 1), ("subscriptionn saas", 1), ('["market place"]', 3), ("***", 4), ("", 1), (None, 2), ("N/A", 1), ("novel", 1)]
    raw = spark.createDataFrame([(t, n, "x") for t, n in tags], "raw string, occurrences long, form string")
    words = spark.createDataFrame([("saas-subscription",), ("market-place",), ("market-place",), (None,)], "canonical string")
    got = {r.raw: (r.canonical, r.score, r.method, r.occurrences) for r in tag_aliases(raw, words, 0.85).collect()}
    assert got == {
        "SaaS Subscription": ("saas-subscription", 1.0, "exact", 5), "saas_subscription": ("saas-subscription", 1.0, "exact", 2), "subscription-saas": ("saas-subscription", 1.0, "fuzzy", 1),
        "subscriptionn saas": ("saas-subscription", 0.9714, "fuzzy", 1), '["market place"]': ("market-place", 1.0, "exact", 3), "***": (None, 0.0, "dropped", 4), "": (None, 0.0, "dropped", 1),
        None: (None, 0.0, "dropped", 2), "N/A": (None, 0.0, "dropped", 1), "novel": ("novel", 0.0, "invented", 1),
    }
    assert tag_aliases(raw.limit(0), words).count() == 0 and {r.method for r in tag_aliases(raw, words.limit(0)).collect()} == {"invented", "dropped"}
