import pytest

from orrery.plans.filters import FilterSpec, flagged, page, search
from orrery.sources import sinks
from orrery.storage import table_path

ROWS = [(1, "Acme AG", "Berlin", 5, ["a", "b"], True), (2, None, "Köln", None, ["b"], None), (3, "Beta", None, 7, None, False), (4, "acme2", "berlin", 7, [], True)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, name string, city string, score int, tags array<string>, seen boolean")


def ids(frame):
    return [r.id for r in frame.orderBy("id").collect()]


@pytest.mark.parametrize("spec,want", [
    (FilterSpec(), [1, 2, 3, 4]),
    (FilterSpec(contains={("name", "city"): "ACME"}), [1, 4]),
    (FilterSpec(contains={("name", "city"): "berlin"}, at_least={"score": 6}), [4]),
    (FilterSpec(has_tag={"tags": "b"}), [1, 2]),
    (FilterSpec(flags={"seen": False}), [2, 3]),
    (FilterSpec(none_of={"city": ["Berlin"]}), [2, 4]),
    (FilterSpec(one_of={"score": [5, 7]}, at_most={"score": 6}, equals={"city": "Berlin"}), [1]),
])
def test_specs(rows, spec, want):
    assert ids(search(rows, spec)) == want
    assert [r.id for r in flagged(rows, spec).filter("matched = 1").orderBy("id").collect()] == want


def test_empty_search_and_pages(rows):
    assert ids(search(rows, FilterSpec(), empty_if_unset=True)) == []
    order = [r.id for n in (1, 2) for r in page(rows, "score", ["score"], "id", n, 2, descending=True).collect()]
    assert order == [3, 4, 1, 2]
    with pytest.raises(ValueError):
        page(rows, "name; drop", ["score"], "id", 1, 2)


def test_sinks(spark, rows):
    where = table_path(spark, "csv")
    sinks.export_csv(rows, ["id", "tags"], where)
    assert {(r.id, r.tags) for r in spark.read.option("header", True).csv(where).collect()} == {("1", "a, b"), ("2", "b"), ("3", None), ("4", None)}
    where = table_path(spark, "json")
    sinks.export_json_lines(rows, where, "2024-01-31")
    assert spark.read.json(where).filter("exported_at = '2024-01-31' AND record.id > 0").count() == 4
    where = table_path(spark, "dump")
    counts = sinks.dump({"companies": rows}, where)
    assert counts == {"companies": 4} and ids(sinks.restore(spark, where, counts)["companies"]) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        sinks.restore(spark, where, {"companies": 5})
