"""The vector index against brute force: recall, exactness, inserts, and what a search reads."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vector_index
from tessera.operators.vector_index import VectorIndex


def truth(keys, x, queries, most):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = np.round(unit @ unit[keys.index(q)], 9)
        order = sorted(range(len(keys)), key=lambda i: (-s[i], keys[i]))[:most]
        out[q] = [keys[i] for i in order]
    return out


def clustered(n, size, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, size))
    return centres[r.integers(0, 20, n)] + 0.4 * r.normal(size=(n, size))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    x = clustered(4000, 32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<float>").repartition(4)
    folder = f"{tmp_path_factory.mktemp('vectors')}/index"
    return VectorIndex.build(df, "id", "v", folder, 32, cells=40, parts=8, sample=2000), df, x.astype(np.float32).astype(np.float64), folder


def found(hits):
    out = {}
    for r in hits.orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append(r.key)
    return out


def test_recall_of_100_queries(made):
    index, df, x, _ = made
    queries = list(range(0, 4000, 40))
    want = truth(list(range(4000)), x, queries, 10)
    got = found(index.search(df.filter("id % 40 = 0"), "id", "v", most=10, probes=8, rerank=100))
    assert len(queries) == 100
    assert sum(len(set(got[q]) & set(want[q])) for q in queries) / 1000 >= 0.9
    assert found(index.search(df.filter("id % 40 = 0"), "id", "v", most=10, probes=2, exact=True)) == want


def test_search_reads_its_cells(made):
    index, _, _, _ = made
    some = index.rows([3, 5])
    assert {r.cell for r in some.select("cell").distinct().collect()} == {3, 5}
    scan = next(line for line in some._jdf.queryExecution().executedPlan().toString().splitlines() if "Scan parquet" in line)
    assert "PartitionFilters: [isnotnull(cell" in scan or "PartitionFilters: [cell" in scan
    assert "3,5" in scan.replace(" ", "")


def test_insert_leaves_what_is_there(spark, made):
    index, df, x, folder = made
    before = set(index.rows().inputFiles())
    more = spark.createDataFrame([(10_000, x[0].tolist()), (10_001, [0.0] * 32), (10_002, None), (10_003, [1.0]), (10_004, [math.nan] * 32)], "id long, v array<float>")
    index.insert(more, "id", "v")
    assert before <= set(index.rows().inputFiles())
    again = VectorIndex(spark, folder)
    assert again.rows().count() == 4001
    got = found(again.search(df.filter("id = 0"), "id", "v", most=2, probes=1))
    assert got == {0: [0, 10_000]}


def test_many_equal_vectors_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "AT_ONCE", 3)
    rows = [(f"k{i:03}", [1.0, 0.0, 0.0, 0.0] if i % 2 else [0.0, float(i + 1), 1.0, 0.5]) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    index = VectorIndex.build(df, "id", "v", f"{tmp_path}/i", 4, cells=50, parts=2)
    got = index.search(df.filter("id < 'k010'"), "id", "v", most=5, exact=True)
    assert got.count() == 50
    assert found(got)["k001"] == [f"k{i:03}" for i in (1, 3, 5, 7, 9)]
    assert index.search(df.limit(0), "id", "v").count() == 0
    assert index.search(df.filter("id = 'k001'"), "id", "v", most=500, threshold=0.999, exact=True).count() == 100
    assert vector_index.recall(got, got) == 1
    with pytest.raises(ValueError, match="no row"):
        VectorIndex.build(df.filter(F.lit(False)), "id", "v", f"{tmp_path}/j", 4)


def test_rows_of_equal_distance_are_ranked_by_key(spark, tmp_path, monkeypatch):
    """Of very many copies the least keys are found, however few hits a task holds."""
    monkeypatch.setattr(vector_index, "HELD", 8)
    monkeypatch.setattr(vector_index, "ROWS", 64)
    rows = [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(400, 0, -1)] + [(1000 + i, [0.0, 1.0, float(i), 3.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    made = VectorIndex.build(df, "id", "v", f"{tmp_path}/index", 4, cells=2, parts=2)
    hits = found(made.search(df.filter("id in (7, 300)"), "id", "v", most=5, probes=2, rerank=20))
    assert hits == {7: [1, 2, 3, 4, 5], 300: [1, 2, 3, 4, 5]}
