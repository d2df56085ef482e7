"""Links between names against all pairs, exports with odd values, the grid of searches, rules of people and headlines."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from orrery.functions import headlines as H
from orrery.functions import people as P
from orrery.functions.websites import website_confidence
from orrery.operators import workgrid
from orrery.operators.linking import contained_names, first_links, overlap_matches
from orrery.queries.linking import STOP
from orrery.queries.people import NO_COMPANY, RULES
from orrery.sources import exports as X
from orrery.storage import table_path

ODD = ["plain", "a, b", 'say "x"', "two\nlines", " kept ", "ümlaut;", None, ""]


# -- exports ---------------------------------------------------------------------------------------------------------------------
def test_odd_values_come_back(spark):
    rows = spark.createDataFrame([(k, v, [v or "", "z"]) for k, v in enumerate(ODD)], "id long, name string, tags array<string>").withColumn("more", F.lit(1))
    where, fields = table_path(spark, "odd"), ("name", "missing", "tags", "id")
    assert X.write_csv(X.Report(rows, fields, (F.col("id"),)), where) == len(ODD)
    got = X.read_csv(spark, where, fields).collect()
    assert [r.name for r in got] == [v or None for v in ODD] and {r.missing for r in got} == {None}
    assert [r.tags for r in got] == [f"{v or ''}, z" for v in ODD] and [r.id for r in got] == [str(k) for k in range(len(ODD))]


def test_empty_exports(spark):
    empty = spark.createDataFrame([], "id long, name string")
    where = table_path(spark, "none")
    assert X.write_reports({"one": X.Report(empty), "two": X.Report(empty, order=(F.col("id"),))}, where) == {"one": 0, "two": 0}
    manifest = X.write_bundle({"companies": empty}, f"{where}/bundle", "2024-01-31")
    assert [tuple(r) for r in manifest.collect()] == [("2024-01-31", "companies", 0)]


def test_bundles_need_a_manifest(spark):
    rows = spark.createDataFrame([(1, None), (2, "b")], "key long, name string")
    where = table_path(spark, "bundle")
    rows.write.json(f"{where}/companies")
    with pytest.raises(AnalysisException):
        X.read_part(spark, where, "companies", rows.schema)
    X.write_bundle({"companies": rows}, f"{where}/whole", "now")
    assert sorted(tuple(r) for r in X.read_part(spark, f"{where}/whole", "companies", rows.schema).collect()) == [(1, None), (2, "b")]


def test_selection(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, 7, "a"), (3, 7, "a"), (4, 9, "b"), (5, None, "a")], "id long, score int, kind string")
    report = X.selected(rows, "score", 5, "kind", "a", limit=2)
    assert [r.id for r in report.rows.collect()] == [2, 3]
    assert X.selected(rows, "score", 5, limit=None).rows.count() == 4


# -- names in names ------------------------------------------------------------------------------------------------------------------
def _names(rng, n):
    words = ["max", "müller", "acme", "co.", "&", "und", "gmbh", "ag", "beta", "be", "labs", "max", "e"]
    return [rng.choice(["", " "]).join([""] + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))]).title() for _ in range(n)]


def test_containment_equals_all_pairs(spark):
    rng = random.Random(3)
    people, names = _names(rng, 60) + [None, "", "!!"], _names(rng, 120) + [None, "Max-Müller, Acme"]
    told = lambda s: " ".join(re.sub(r"[^\w]+", " ", (s or "").lower()).split())
    want = {(p, n) for p in people if p and told(p) for n in names if n and f" {told(p)} " in f" {told(n)} "}
    got = contained_names(spark.createDataFrame([(p,) for p in people], "who string"), spark.createDataFrame([(n, 1) for n in names], "firm string, who int"), "who", "firm")
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("seed,least", [(1, 0.4), (2, 0.4), (3, 0.75), (4, 1.0)])
def test_overlap_equals_all_pairs(spark, seed, least):
    rng = random.Random(seed)
    targets, register = _names(rng, 80) + [None, ""], [(k, n, rng.choice([True, False, None])) for k, n in enumerate(_names(rng, 150) + [None, ""])]

    def score(t, name, active):
        a, b = set(t.lower().split()), set((name or "").lower().split())
        if not (a & b) - set(STOP):
            return 0.0
        inside = t.lower() in name.lower() or name.lower() in t.lower()
        return math.floor((len((a & b) - set(STOP)) / len(a) + 0.5 * inside + 0.1 * bool(active)) * 1e4 + 0.5) / 1e4

    want = {}
    for t in {t for t in targets if t and t.split()}:
        best = max(((score(t, n, a), -k) for k, n, a in register if n is not None), default=(0, 0))
        if best[0] >= least:
            want[t] = (-best[1], best[0])
    frame = spark.createDataFrame(register, "id long, name string, active boolean")
    found = overlap_matches(spark.createDataFrame([(t,) for t in targets], "target string"), frame, "target", F.col("name"), "id", F.col("active"), STOP, least)
    got = {r.target: (r.id, r.score) for r in found.collect()}
    assert got == want


def test_overlap_of_nothing(spark):
    none = spark.createDataFrame([], "id long, name string, active boolean")
    some = spark.createDataFrame([("Acme",)], "target string")
    assert overlap_matches(some, none, "target", F.col("name"), "id", F.col("active"), STOP).count() == 0
    with pytest.raises(ValueError):
        overlap_matches(some, none, "target", F.col("name"), "id", F.col("active"), STOP, 0.1)


def test_first_links_are_kept(spark):
    people = spark.createDataFrame([("Anna Berg", 0.9), ("anna berg", 0.2), ("Otto Kern", 0.4), ("Eva Steinbach", 0.5), (None, 0.9)], "person string, sure double")
    firms = spark.createDataFrame([("Anna Berg",), ("anna bergs",), ("otto kern",), ("eva  steinbach",), (None,)], "firm string")
    nobody = spark.createDataFrame([], "person string")
    got = first_links(people, firms, "person", "firm", "sure", nobody)
    assert sorted((r.person, r.firm) for r in got.collect()) == [("anna berg", "anna berg"), ("eva steinbach", "eva  steinbach")]
    assert first_links(people, firms, "person", "firm", "sure", got).count() == 0


# -- the grid ------------------------------------------------------------------------------------------------------------------------
def test_grid(spark):
    words, states = spark.createDataFrame([("ai",), ("ml",), ("ai",)], "keyword string"), spark.createDataFrame([("BE",), ("BY",)], "state string")
    grid = workgrid.cells([(words, None), (words, states), (words.limit(1), None)])
    assert grid.count() == 6 and workgrid.progress(grid).agg(F.sum("open"), F.sum("completed")).first() == (6, 0)
    at = lambda d: dt.datetime(2024, 1, d)
    tried = [("ai", None, at(1), True, 7), ("ai", None, at(2), False, 0), ("ai", "BE", at(1), False, 0), ("ml", "BY", at(1), False, 0), ("ml", "BY", at(2), False, 0), ("ml", "BY", at(3), False, 0), ("none", None, at(1), True, 9)]
    after = workgrid.attempted(grid, spark.createDataFrame(tried, "keyword string, state string, at timestamp, ok boolean, results long"))
    assert {(r.keyword, r.state): (r.status, r.tries, r.results) for r in after.collect()} == {
        ("ai", None): ("completed", 2, 7), ("ml", None): ("pending", 0, None), ("ai", "BE"): ("retry", 1, None),
        ("ai", "BY"): ("pending", 0, None), ("ml", "BE"): ("pending", 0, None), ("ml", "BY"): ("failed", 3, None),
    }
    assert [(r.keyword, r.state) for r in workgrid.upcoming(after, 10).collect()] == [("ml", None), ("ai", "BY"), ("ml", "BE"), ("ai", "BE")]
    assert [tuple(r) for r in workgrid.progress(after).orderBy("phase").collect()] == [(1, 2, 1, 0, 1, 7, 50.0), (2, 4, 0, 1, 3, 0, 0.0)]


# -- rules ---------------------------------------------------------------------------------------------------------------------------
HEADLINES = {
    "Acme: Series A": "Acme", "one.five sichert sich 3 Mio": "one.five", "Heute hat Acme Labs gestern 3 Mio eingesammelt": "Acme Labs gestern", "Ärzte haben 2 Mio eingesammelt": "Ärzte",
    "co-reactive nabs $5m": "co-reactive", "KI-Startup Beta": "Beta", "Gründer von Gamma": "Gamma", "Runde für Delta wird": "Delta", "Fonds investierte in Epsilon": "Epsilon",
    "Zeta gets €5 million": "Zeta", "Unbekannt erhält 3; Startup Eta": "Eta", "x erhält 3": None, "nothing here": None, "": None, None: None,
}


def test_headlines(spark):
    rows = spark.createDataFrame([(t,) for t in HEADLINES], "t string").withColumn("c", H.headline_company(F.col("t"), NO_COMPANY))
    assert {r.t: r.c for r in rows.collect()} == HEADLINES


def test_feed_dates(spark):
    day, clock = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 3, 10, 20, 30)
    want = {"Wed, 03 Jan 2024 10:20:30 +0100": clock, "Wed, 03 Jan 2024 10:20:30 GMT": clock, "2024-01-03T10:20:30+01:00": clock, "2024-01-03T10:20:30Z": clock, " 2024-01-03 10:20:30 ": clock, "2024-01-03": day,
            "2024-02-31": None, "soon": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", F.date_format(H.feed_date(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("d"), H.too_old(F.col("t"), F.lit("2024-01-10 10:20:30").cast("timestamp")).alias("old"))
    got = {r.t: (r.d, r.old) for r in rows.collect()}
    assert got == {t: (d and str(d), d == day) for t, d in want.items()}


def test_people(spark):
    rows = spark.createDataFrame([
        (1, "Anna Berg", "Co-Founder & CTO | ex-Google | ex-BCG", "Berlin"), (2, "A", "ex-N26 Director, ex-n26", ""), (3, None, None, None),
        (4, "Otto - Kern", "Head of Robotics, ex-Meta Platforms and ex-Unknown", "Lyon"), (5, "Eva Stein", "x" * 200, "Wien, Deutschland"), (6, "Eva Stein", "stealthy x", None),
    ], "id long, name string, headline string, location string")
    tags = P.person_tags(F.col("name"), F.col("headline"), F.col("location"), RULES)
    got = {r.id: tuple(r)[1:] for r in rows.select("id", *[c.alias(n) for n, c in tags.items()]).collect()}
    assert got == {
        1: ("berlin", "co-founder", ["google", "bcg"], "faang", [], "weak", "clean"),
        2: (None, "executive", ["n26"], "unicorn", [], "weak", "junk"),
        3: (None, "other", [], None, [], "weak", "junk"),
        4: ("other", "executive", ["unknown"], "other", ["robotics"], "weak", "junk"),
        5: ("germany_other", "other", [], None, [], "weak", "junk"),
        6: (None, "other", [], None, [], "weak", "clean"),
    }
    sure = P.profile_confidence(F.col("headline"), F.col("location"), F.lit(4), {"stealth": ("next",), "founder": ("founder",)}, ("wien",), ("deutschland",))
    assert {r.id: r.s for r in rows.select("id", sure.alias("s")).collect()} == {1: 0.19, 2: 0.16, 3: 0.16, 4: 0.16, 5: 0.24, 6: 0.41}


def test_websites(spark):
    rows = spark.createDataFrame([("acme labs", "acme-x.de", 0.8, "see /Impressum"), ("acme labs", "myacme.de", 0.5, None), ("acme labs", "acme.de", 1.0, "domain FOR sale"), (None, None, None, None)], "b string, h string, r double, t string")
    sure = website_confidence(F.col("b"), F.col("h"), F.col("r"), F.col("t"), ("domain for sale",), ("/impressum",))
    assert [r.s for r in rows.select(sure.alias("s")).collect()] == [0.8, 0.3, 0.0, 0.0]
