"""Project names: as the patterns say, and of runs of any length."""

import random
import re

from pyspark.sql import functions as F

from tessera.catalogue import QUERIES
from tessera.functions import enrich, fixed


def by_patterns(text):
    out = set()
    for pattern, groups in fixed.PROJECT_PATTERNS:
        for m in re.finditer(pattern, text):
            out.add(" ".join(x for x in m.groups()[:groups] if x is not None).strip())
    return sorted(out)


def test_projects_equal_their_patterns(spark):
    r = random.Random(8)
    words = ["Foo", "Ba", "Project", "Agent", "Projects", "API", "APIs", "Dự án", "Hệ thống", "Hệ", "x", "Abcđe", "Projectđ", "Agent1", "API_", "A", "FooBar", "System.", "Engine-Agent", "12", "Platform", "_Foo"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\n", "\t "]) for _ in range(r.randint(1, 14))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", enrich.projects(F.col("t")).alias("p")).collect()
    assert all(list(x.p) == by_patterns(x.t) for x in got)
    assert sum(" " in p for x in got for p in x.p) > 2000


def test_long_runs_of_names(spark):
    """A run of some thousand words took a stack frame for each and ended the executor."""
    run = "Abcde " * 20_000
    rows = [(0, run), (1, run + "System"), (2, run + "Project " + run), (3, run + "API")]
    got = {x.i: x.p for x in spark.createDataFrame(rows, "i int, t string").select("i", enrich.projects(F.col("t")).alias("p")).collect()}
    assert got == {0: [], 1: [run + "System"], 2: [run + "Project"], 3: ["API", run + "API"]}


def test_graph_of_long_runs_of_names(spark, tmp_path):
    """The graph ended with an error where a text had such a run."""
    docs = [(0, "Abcde " * 20_000, "en", "a.org", 120_000), (1, "Foo Project on 01/02/2026", "en", "a.org", 25)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "Abcde " * 5000)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.what, r.kind): r.n for r in QUERIES["graph_from_tables"](spark, str(tmp_path)).collect()}
    assert got["node", "document"] == 2 and got["node", "communication"] == 1
