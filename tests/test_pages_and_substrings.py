"""Deep pages and substring search against the plain operators, and what they read."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import relational, substring_index
from tessera.operators.pages import PageTable
from tessera.operators.substring_index import SubstringIndex, trigrams


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(6)
    return spark.createDataFrame([(i, r.choice([None, 1.5, 2.0, 7.0, float(i % 50)]), f"t{i % 7}") for i in range(2000)], "id long, x double, t string").repartition(5)


@pytest.mark.parametrize("sort_by, descending", [("x", True), ("x", False), ("t", True), ("id", False)])
def test_pages_equal_sorting(rows, tmp_path, sort_by, descending):
    table = PageTable.build(rows, f"{tmp_path}/p", sort_by, descending, ranges=12)
    again = PageTable(rows.sparkSession, f"{tmp_path}/p")
    for number, size in ((1, 20), (2, 33), (60, 33), (61, 33), (62, 33), (7, 100), (1, 5000)):
        want = relational.page(rows, sort_by, descending, number, size).collect()
        assert again.page(number, size).collect() == want
    assert table.total == 2000
    assert len(table.parts(50, 20)) <= 2 < len(table.ranges)
    plan = table.page(50, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [__part" in plan or "PartitionFilters: [isnotnull(__part" in plan or "PartitionFilters: [(__part" in plan


def test_pages_of_nothing_and_wrong_columns(rows, tmp_path):
    with pytest.raises(ValueError, match="sort_by"):
        PageTable.build(rows, f"{tmp_path}/a", "t", allowed=("x",))
    empty = PageTable.build(rows.limit(0), f"{tmp_path}/b", "x")
    assert empty.page(1).count() == 0
    with pytest.raises(ValueError, match="1 or more"):
        empty.page(0)


def test_trigrams():
    assert trigrams("Abcd") == ["abc", "bcd"]
    assert trigrams("ab%cde_f") == ["cde"]
    assert trigrams("ab") == []


def test_substrings_equal_scans(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    words = ["Straße", "invoice", "İstanbul", "ΑΣ", "report", "x%y", "日本語", "a_b", "rare needle here"]
    texts = [" ".join(r.choice(words[:8]) for _ in range(r.randint(0, 9))) for _ in range(900)]
    texts[123] = texts[500] = words[8]
    docs = spark.createDataFrame([(i, t, f"s{i // 100}") for i, t in enumerate(texts)] + [(900, None, None), (901, "", "")], "id long, text string, source string")
    index = SubstringIndex(spark, f"{tmp_path}/i", docs.schema, ["text", "source"], rows=32)
    assert index.search(["abc"]).count() == 0
    index.insert(docs.filter("id < 600"), "id")
    index.insert(docs.filter("id >= 600"), "id")
    for named in (2000, 1):
        monkeypatch.setattr(substring_index, "NAMED", named)
        for queries in (["invoice"], ["NEEDLE"], ["istanbul"], ["STRASSE"], ["straße"], ["ας"], ["日本語"], ["needle", "s8"], ["in%ice r"], ["a_b"], ["ab"], ["needle", "nowhere"], ["nowhere"]):
            want = docs.filter(F.lit(False))
            for q in queries:
                want = want.union(docs.filter(relational.contains_any_case(["text", "source"], q)))
            assert sorted(x.id for x in index.search(queries).collect()) == sorted({x.id for x in want.collect()})
    assert index.scans(["ab"])
    assert not index.scans(["needle"])
    monkeypatch.setattr(substring_index, "NAMED", 2000)
    assert index._within(["needle"]).count() <= 64  # two blocks of 32 rows
    assert index._within(["nowhere"]).count() == 0
    plan = index._within(["needle"])._jdf.queryExecution().executedPlan().toString()
    assert "In(block" in plan or "EqualTo(block" in plan
