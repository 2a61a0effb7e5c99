"""The table of n-grams in parts: the same features as from the whole table, and texts aren't shuffled."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import shared, toxicity


def test_parts_give_what_the_whole_table_gives(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("abcdeя ж🙂 ") for _ in range(r.randint(0, 300)))) for i in range(200)] + [(200, None), (201, ""), (202, "a"), (203, "zz " * 40)]
    df = spark.createDataFrame(rows, "k long, __text string").repartition(3)
    count = toxicity.counts(df.filter("k < 60").select((F.col("k") % 2).alias("__y"), "__text"))
    table = shared.written(toxicity.keyed(toxicity.ratios(count)), "test")
    whole = {x.k: (x["__a"], x["__b"], x["__c"]) for x in toxicity.featured(df, table).collect()}
    monkeypatch.setattr(toxicity, "PASS_BYTES", 2000)
    for part_bytes in (1, 16 * 1000, 1 << 20):
        parts = toxicity.featured(df, table, 0, part_bytes)
        got = {x.k: (x["__a"], x["__b"], x["__c"]) for x in parts.collect()}
        assert got.keys() == whole.keys()
        assert np.allclose([got[k] for k in whole], list(whole.values()), atol=1e-6)
        assert "hashpartitioning" not in parts._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_pairs_are_packed_in_runs(most):
    counts = {-1: 50, 0: 3, 5: 9, 6: 2, 1023: 4}
    part = toxicity._packed(counts, most)
    assert len(part) == 1 << toxicity.PAIR_BITS and (np.diff(part) >= 0).all() and (np.diff(part) <= 1).all()
    for p in set(part.tolist()):
        own = [n for k, n in counts.items() if k >= 0 and part[k] == p]
        assert sum(own) <= most or len(own) == 1
