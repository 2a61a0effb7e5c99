"""Latent vectors against numpy's decomposition, and against hashed words on labelled texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import latent
from tessera.operators.latent import Latent


@pytest.fixture(scope="module")
def topics(spark):
    """Texts of six topics of forty words each, of which every text has six, and common words."""
    r = random.Random(3)
    stock = [[f"t{k}w{i}" for i in range(40)] for k in range(6)]
    rows = [(i, i % 6, " ".join([*r.sample(stock[i % 6], 6), *(f"common{r.randint(0, 20)}" for _ in range(6))])) for i in range(420)]
    return spark.createDataFrame([*rows, (500, None, None), (501, None, ""), (502, None, "unknownword")], "id long, topic int, text string").repartition(6)


def test_singular_values_equal_numpy(topics):
    model = Latent.fitted(topics, "text", 12, rounds=12)
    rows = []
    for r in topics.collect():
        x = np.zeros(len(model.terms))
        for w in (r.text or "").split():
            if w in model.terms:
                x[model.terms.index(w)] += 1
        x = np.log1p(x) * model.idf
        if x.any():
            rows.append(x / np.linalg.norm(x))
    want = np.linalg.svd(np.array(rows), compute_uv=False)
    assert model.values == pytest.approx(want[:12], rel=0.02)
    assert model.values[:6] == pytest.approx(want[:6], rel=1e-3)
    assert model.right.T @ model.right == pytest.approx(np.eye(12), abs=1e-8)


def neighbours_right(df, name):
    rows = [r for r in df.collect() if r.topic is not None]
    x, topic = np.array([r[name] for r in rows]), np.array([r.topic for r in rows])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return float((topic[s.argmax(1)] == topic).mean())


def test_neighbours_are_better_than_hashed(spark, topics, tmp_path):
    model = Latent.fitted(topics, "text", 8)
    model.save(f"{tmp_path}/model")
    model = Latent.load(spark, f"{tmp_path}/model")
    both = model.embedded(topics, "text", "latent").withColumn("hashed", vectors.hashed(F.col("text"), 384))
    assert neighbours_right(both, "latent") > neighbours_right(both, "hashed") + 0.1
    assert neighbours_right(both, "latent") > 0.9
    none = {r.id: r.latent for r in both.filter("topic is null").collect()}
    assert none == {500: None, 501: None, 502: None}
    assert both.filter("latent is not null and abs(aggregate(latent, 0D, (a, x) -> a + x * x) - 1) > 1e-9").count() == 0


def test_few_directions_and_no_texts(spark):
    few = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c c")], "id long, text string")
    model = Latent.fitted(few, "text", 5)
    assert model.right.shape == (2, 5)
    assert [len(r.v) for r in model.embedded(few, "text", "v").filter("v is not null").collect()] == [5, 5]
    empty = Latent.fitted(few.limit(0), "text", 5)
    assert empty.embedded(few, "text", "v").filter("v is not null").count() == 0


@pytest.mark.parametrize(("rows", "items"), [(1024, 1 << 20), (3, 7), (1, 1)])
def test_products_equal_numpy(monkeypatch, rows, items):
    """Products of slices are those of the whole matrix."""
    monkeypatch.setattr(latent, "ROWS", rows)
    monkeypatch.setattr(latent, "ITEMS", items)
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 12)) * (r.random((40, 12)) < 0.4)
    x[7] = x[39] = 0
    m, total, n = r.normal(size=(12, 4)), np.zeros((12, 4)), (x != 0).sum(1)
    owner, t = np.nonzero(x)
    parts = []
    for own in latent._slices(n):
        low, high = n[: own.start].sum(), n[: own.stop].sum()
        parts.append(latent._times(m, t[low:high], x[owner, t][low:high], n[own]))
        latent._added(total, m, t[low:high], x[owner, t][low:high], n[own])
        assert len(parts[-1]) <= rows
    assert np.concatenate(parts) == pytest.approx(x @ m)
    assert total == pytest.approx(x.T @ (x @ m))


def test_words_are_counted_without_a_shuffle(spark, monkeypatch):
    """No row for each word of each text is shuffled; only terms are grouped, and sums by chunks of terms."""
    plans = []
    table = latent.scratch.Scratch.table
    monkeypatch.setattr(latent.scratch.Scratch, "table", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or table(self, df, name))
    docs = spark.createDataFrame([(1, "b a b"), (2, "a c b"), (3, None), (4, "")], "id long, text string")
    model = Latent.fitted(docs, "text", 2)
    assert model.terms == ["a", "b"]
    assert model.idf == pytest.approx([1.0, 1.0])  # of two texts with words
    assert len(plans) == 2
    assert not any("Exchange" in p for p in plans)
