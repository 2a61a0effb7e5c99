"""Queries against their SQL on tables with odd rows: empty, blank and null texts, white space of all kinds, scores that are
equal only when they are rounded."""

import math

import numpy as np
import pytest
from oracle import same

from tessera.catalogue import ORACLES, QUERIES

TEXTS = ["", " ", "\n \n", None, "a", "a\x0bb\x0c c d e　f\t\r\n g", "x" * 9999 + " \n y", " in (one) \\ line ", "<a> & b\n\n\nc", "🙂 é\n#"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = [(i, t, "en", "a.org", len(t or "")) for i, t in enumerate(x for x in TEXTS for _ in range(3))]
    docs += [(100, "a b", "en", "", 3), (101, "a b", "", "a.org", 3), (102, "a b", None, "a.org", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/all")
    rows = [[1.0] + [0.0] * 63]
    for s in (0.9000001, 0.9000004, 0.4757384996, 0.4757385004, 0.7, 0.7, 0.2500004, 0.2500001, 0.24999996):
        rows.append([s, math.sqrt(1 - s * s)] + [0.0] * 62)
    rows += np.random.default_rng(3).normal(size=(40, 64)).tolist()
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{folder}/vectors")
    read = lambda name: next(p for p in (tmp_path_factory.getbasetemp() / folder / name).iterdir() if p.suffix == ".parquet")
    tables = tmp_path_factory.mktemp("tables")
    (tables / "documents.parquet").write_bytes(read("all").read_bytes())
    (tables / "embeddings.parquet").write_bytes(read("vectors").read_bytes())
    return str(tables)


@pytest.mark.parametrize("name", ["embedding_text", "office_files_read", "vector_index_exact"])
def test_odd_rows_equal_sql(spark, odd, name):
    same(QUERIES[name](spark, odd), ORACLES[name], odd)
