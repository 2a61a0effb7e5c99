"""Stems by published examples, postings, and ranks by brute force over positions."""

import math
import random
import re

import numpy as np
import pytest

from tessera.functions import stems
from tessera.functions.stems import stem
from tessera.operators import fulltext

# The sample of words and stems that is published with the algorithm.
SAMPLE = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency
consist consistent consist consistently consist consisting consist consists consist consolation consol consolations
consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted
consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir
conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl
constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave
knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly
knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock
knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
""".split()
# By the rules, step by step.
MORE = {
    "skis": "ski", "dying": "die", "gently": "gentl", "news": "news", "generate": "generat", "generically": "generic", "communism": "communism",
    "arsenal": "arsenal", "hopping": "hop", "hoping": "hope", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi",
    "by": "by", "say": "say", "cry": "cri", "youth": "youth", "luxuriating": "luxuri", "proceed": "proceed", "herrings": "herring", "agreed": "agre",
    "feed": "feed", "rational": "ration", "relational": "relat", "geology": "geolog", "worthlessly": "worthless", "worthlessness": "worthless", "idiots": "idiot",
    "formative": "format", "adoption": "adopt", "bowl": "bowl", "roll": "roll", "controll": "control", "probate": "probat", "rate": "rate", "'tis": "tis", "boy's": "boy",
}


def test_stems():
    pairs = list(zip(SAMPLE[::2], SAMPLE[1::2], strict=True))
    assert len(pairs) == 80
    assert [(w, stem(w)) for w, _ in pairs] == pairs
    assert {w: stem(w) for w in MORE} == MORE


def rank_by_force(positions):
    """Pair by pair, as the rank is published."""
    if len(positions) == 1:
        return sum(0.1 / (j + 1) ** 2 for j in range(len(positions[0]))) / 1.64493406685
    res = -1.0
    for i in range(len(positions)):
        for k in range(i):
            for x in positions[i]:
                for y in positions[k]:
                    if d := abs(x - y):
                        w = math.sqrt(0.1 * 0.1 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
                        res = w if res < 0 else 1 - (1 - res) * (1 - w)
    return max(res, 0)


def test_ranks_by_force():
    r = random.Random(3)
    for size, terms in [(5, 1), (12, 2), (60, 3), (600, 2)] * 8:
        free = list(range(1, size + 1))
        r.shuffle(free)
        cuts = sorted(r.sample(range(1, size), terms - 1))
        positions = [sorted(free[a:b])[:40] for a, b in zip([0, *cuts], [*cuts, size], strict=True)]
        assert fulltext.rank([np.array(p) for p in positions]) == pytest.approx(rank_by_force(positions), abs=1e-12)


def test_index_by_force(spark, tmp_path):
    r = random.Random(9)
    stock = ["connect", "connected", "connections", "relation", "relational", "the", "of", "Running", "runs", "été", "x1"]
    texts = {i: " ".join(r.choice(stock) + r.choice(["", ",", "."]) for _ in range(r.randint(0, 60))) for i in range(80)} | {80: None, 81: "", 82: "the of"}
    docs = spark.createDataFrame(list(texts.items()), "id long, t string")
    index = fulltext.PostingsIndex(spark, f"{tmp_path}/postings", buckets=8)
    index.insert(docs.filter("id < 50"), "id", "t")
    index.insert(docs.filter("id >= 50"), "id", "t")
    index.insert(docs.filter("id = 3"), "id", "t")  # twice counts once
    for query in ("connecting", "connection of relations", "the connects runs relate", "of the", "missing connect"):
        terms = fulltext.query_stems(query)
        want = []
        for i, t in texts.items():
            stems = [stem(w) if w not in fulltext.ENGLISH_STOP_WORDS else None for w in re.findall(r"\w+", (t or "").lower())]
            at = [[p for p, s in enumerate(stems, 1) if s == term] for term in terms]
            if terms and all(at):
                want.append((i, round(rank_by_force(at), 9)))
        want.sort(key=lambda x: (-x[1], x[0]))
        assert [(x.key, round(x.score, 9)) for x in index.search(query, 1000).collect()] == want
        assert [(x.id, round(x.score, 9)) for x in fulltext.search(docs, query, "t", "id", 1000).collect()] == want
    plan = index.postings(["connect"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert "EqualTo(term,connect)" in plan or "In(term" in plan


def test_postings_are_found_without_a_shuffle(spark, tmp_path):
    """Blocks hold what a loop over words gives, whatever their size; rows of one key are one text in one insertion."""
    r = random.Random(4)
    stock = ["connect", "connected", "the", "runs", "running", "été", "x1", "worthless"]
    texts = [(k % 25, " ".join(r.choice(stock) for _ in range(r.randint(0, 40)))) for k in range(40)] + [(30, None), (31, ""), (32, "the the"), (33, "x1 " * 300)]
    docs = spark.createDataFrame(texts, "id long, t string").coalesce(1)
    want = {}
    for k, t in texts:
        for p, w in enumerate((t or "").split(), 1):
            if w not in fulltext.ENGLISH_STOP_WORDS:
                want.setdefault((k, stem(w)), []).append(p)
    want = {k: sorted(v) for k, v in want.items()}
    most, fulltext.TOKENS = fulltext.TOKENS, 64
    try:
        small = {(x.key, x.term): x.positions for x in fulltext.postings(docs, "id", "t").collect()}
    finally:
        fulltext.TOKENS = most
    assert small == want
    assert {(x.key, x.term): x.positions for x in fulltext.postings(docs, "id", "t").collect()} == want
    assert "Exchange" not in fulltext.blocks(docs, "id", "t")._jdf.queryExecution().executedPlan().toString()
    index = fulltext.PostingsIndex(spark, f"{tmp_path}/postings", buckets=4)
    index.insert(docs, "id", "t")
    index.insert(docs, "id", "t")
    assert {(x.key, x.positions[0]) for x in index.postings(["connect"]).collect()} == {(k, v[0]) for (k, t), v in want.items() if t == "connect"}
    assert {x.key: x.score for x in index.search("worthless", 100).collect()} == pytest.approx({k: round(rank_by_force([v]), 9) for (k, t), v in want.items() if t == "worthless"})


def test_words_that_no_step_changes_are_left_early(monkeypatch):
    """What is left early is what all steps would leave, and it is left before any of them."""
    r = random.Random(8)
    endings = [e for e in (*stems.STEP_2, *stems.STEP_3, *stems.STEP_4, *stems.PLURAL, *stems.PAST, *stems.OWNED, "y", "e", "ll", "")]
    made = ["".join(r.choice("abehiklostuyxz'9é") for _ in range(r.randint(1, 7))) + r.choice(endings) for _ in range(3000)]
    short = [stem(w) for w in made]
    stem.cache_clear()
    monkeypatch.setattr(stems, "LAST", frozenset({w[-1] for w in made} | {""}))
    assert short == [stem(w) for w in made]
    stem.cache_clear()
    monkeypatch.undo()
    monkeypatch.setattr(stems, "_regions", lambda w: 1 / 0)
    assert [stem(w) for w in ("c17x5", "kayaq", "'étoilé")] == ["c17x5", "kayaq", "étoilé"]
