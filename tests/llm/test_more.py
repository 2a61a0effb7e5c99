"""Queries against brute force, clashing columns, odd rows of every stage, and hostile inputs."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import BYTE, ODD, WORD, documents, odd_documents, ratio_by_force
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, chat, decontaminate, dom, html_text, labelled_pages, pieces, quality, queries, rules, simhash, tokencount, tokenfile, toxicity

# ---- registered queries by brute force ---------------------------------------------------------


def most_by_force(lib, letters, text):
    """Tokens of each line, token by token and character by character."""
    ends, at = [], 0
    for line in text.split("\n"):
        at += len(line) + 1
        ends.append(at)
    if ends[-1] - 1 == (ends[-2] if len(ends) > 1 else 0) and len(ends) > 1:
        ends.pop()  # nothing follows the last line break
    line_of = lambda i: next(k for k, e in enumerate(ends) if i < e)
    of_byte = [i for i, c in enumerate(text) for _ in range(len(c.encode()))]
    total, at = [0] * len(ends), 0
    for i in lib.encode(text, add_special_tokens=False).ids:
        n = len(lib.id_to_token(i))
        characters = sorted(set(of_byte[at : at + n]))
        at += n
        votes = Counter(line_of(c) for c in characters)
        total[min(votes, key=lambda k: (-votes[k], k))] += 1
    return total


def test_op1_by_force(spark, sf_dir):
    lib = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in tokencount.op1_token_counts(spark, sf_dir).collect()}
    texts = dict(documents(spark, sf_dir))
    assert set(got) == set(texts)
    short = [k for k, t in texts.items() if len(t) < 3000]
    assert len(short) > 100
    for k in short:
        want = most_by_force(lib, None, texts[k])
        assert list(got[k].section_tokens) == want
        assert (got[k].n_tokens, got[k].n_sections, got[k].most_tokens) == (sum(want), len(want), max(want))


def test_op2_and_op9_by_library(spark, sf_dir):
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    two = {r.doc_id: r for r in bpe.op2_bpe_round_trip(spark, sf_dir).collect()}
    nine = {r.doc_id: r for r in tokenfile.op9_token_file(spark, sf_dir).collect()}
    start = 0
    for k, t in sorted(documents(spark, sf_dir)):
        ids = byte.encode(t, add_special_tokens=False).ids
        back = byte.decode(ids, skip_special_tokens=False)
        assert tuple(two[k]) == (k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        ids = np.array([*word.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(nine[k]) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def score_by_force(net, text):
    """The network's forward pass, byte by byte in plain Python."""
    p = {k: v.astype(np.float64).tolist() for k, v in net.p.items()}
    width, half = quality.STRIDE * quality.GROUPS, quality.HALF
    halves = -(-(len(text) + width) // (half * quality.STRIDE))
    data = list(text) + [0] * (half * quality.STRIDE * halves + width)
    tops = []
    for h in range(halves):
        best = [-math.inf] * quality.FILTERS
        for j in range(h * half, (h + 1) * half):
            out = [0.0] * quality.FILTERS
            for k in range(width):
                g, s = divmod(k, quality.STRIDE)
                for d, e in enumerate(p["embed"][data[j * quality.STRIDE + k]]):
                    row = p["filters"][g][s * quality.DIM + d]
                    out = [o + e * w for o, w in zip(out, row, strict=True)]
            best = [max(b, o) for b, o in zip(best, out, strict=True)]
        tops.append([max(0.0, b + c) for b, c in zip(best, p["bias"], strict=True)])
    pairs = [[max(x) for x in zip(a, b, strict=True)] for a, b in zip(tops, tops[1:], strict=False)] or tops
    z = [sum(c) / len(pairs) for c in zip(*pairs, strict=True)] + [max(c) for c in zip(*(pairs + [tops[-1]]), strict=True)]
    h = [max(0.0, sum(a * w[i] for a, w in zip(z, p["w1"], strict=True)) + p["b1"][i]) for i in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * w for a, w in zip(h, p["w2"], strict=True)) + p["b2"][0])))


def test_network_equals_plain_python():
    r = random.Random(4)
    net = quality.Network(5)
    texts = [bytes(r.randint(1, 255) for _ in range(n)) for n in (0, 1, 7, 119, 120, 121, 300, 700)]
    assert net.score(texts).tolist() == pytest.approx([score_by_force(net, t) for t in texts], abs=1e-5)
    assert net.score(texts[3:5]).tolist() == pytest.approx(net.score(texts)[3:5].tolist())  # whatever is beside
    long = bytes(r.randint(97, 122) for _ in range(3 * quality.RUN + 77))
    lay = quality.Layout([long])
    whole = net._pooled(lay.buffer, lay.last()).max(axis=1)
    assert np.allclose(net._maxima(lay), whole, atol=1e-5)


def test_toxicity_score_equals_plain_python(spark):
    r = random.Random(12)
    rows = [(i, "".join(r.choice("abcd "[: 4 + i % 2]) + r.choice("xyя ") for _ in range(r.randint(3, 90))), i % 2) for i in range(60)] + [(60, None, 0), (61, "", 1), (62, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    labels = df.select("doc_id", "toxic")
    model = toxicity.fit(df, labels)
    learned = {x.doc_id for x in df.filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(4)) != 0).collect()}
    count = Counter()
    chars = lambda t: [PAD for PAD in [toxicity.PAD] * (toxicity.LENGTH - 2)] + list(" " + " ".join((t or "").lower().split(" ")) + " ")

    def grams(t):
        c = "".join(chars(t))
        while "  " in c:
            c = c.replace("  ", " ")
        return [c[i : i + toxicity.LENGTH] for i in range(len(c) - toxicity.LENGTH + 1)]

    for i, t, y in rows:
        if i in learned:
            count.update((y, g) for g in grams(t))
    ratio = ratio_by_force(count, toxicity.LENGTH, len({g[-1] for _, g in count}) + 1)

    def score(t):
        x = [ratio(g) for g in grams(t)]
        values = [sum(x) / len(x) if x else 0.0]
        for size in toxicity.SEGMENTS:
            starts = range(0, max(1, len(x) - size // 2), size // 2)
            values.append(max((sum(x[a : a + size]) / max(len(x[a : a + size]), size // 2) for a in starts), default=0.0) if x else 0.0)
        z = sum(v * w for v, w in zip(values, model.weights[:-1], strict=True)) + model.weights[-1]
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    for sent in (1 << 26, 0):
        got = {x.doc_id: x.score for x in toxicity.scored(df, model, sent_bytes=sent).collect()}
        assert len(got) == len(rows)
        for i, t, _ in rows:
            assert got[i] == pytest.approx(score(t), abs=1e-3)


# ---- clashing columns and odd rows -------------------------------------------------------------

CLASHES = ["__score", "__t", "__of", "__words", "__at", "__row", "__bad", "__key", "__gone", "__again", "__kept", "__lost", "__host", "n_words", "base_failed", "kept", "k", "t", "p", "fp", "row", "id", "n", "f", "c", "h", "gone", "host", "component_id", "score", "a b", "x.y"]


def test_stages_keep_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = docs.select("*", *(F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in CLASHES))
    wide = wide.unionByName(wide.filter("doc_id % 50 = 0"))
    plain = docs.unionByName(docs.filter("doc_id % 50 = 0"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns
        rows = [r.asDict() for r in out.collect()]
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHES)
        small = [tuple(r) for r in stage(spark, plain, sf_dir).collect()]
        assert sorted(tuple(r[c] for c in plain.columns) for r in rows) == sorted(small)
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf_dir).count() == wide.count()


def test_stages_of_odd_rows(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(60_000))
    odd = odd_documents(spark).selectExpr("*", "cast(length(text) as long) as n_chars").unionByName(spark.createDataFrame([(100, long, "h", "en", 1, len(long)), (100, long, "h", "en", 1, len(long)), (None, None, None, None, None, None)], "doc_id long, text string, source string, score string, fp int, n_chars long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        n = out.count()
        assert n <= odd.count()
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
        if name == "quality_rules":
            assert {r.doc_id for r in out.collect()} >= {100}
        if name == "decontamination":
            assert out.filter("text is null").count() == 2
        if name == "byte_pairs":
            assert n == odd.count()


def test_keys_of_text(spark):
    rows = [("a", "some words here " * 30), ("b", "some words here " * 30), (None, "other words"), ("a", "some words here " * 30)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("source", F.lit("h"))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {"a": "a", "b": "a", None: None}
    assert sorted(str(r.doc_id) for r in simhash.representatives(df).collect()) == ["None", "a"]
    assert bpe.round_trip(df, BYTE).count() == tokencount.section_tokens(df, BYTE).count() == 4
    items = spark.createDataFrame([("q30", "some words here some words"), ("q4", "other")], "item_id string, text string")
    for sent in (1 << 20, 0):
        got = {r.doc_id: (r.n_items, r.contaminated, r.items_sha256) for r in decontaminate.overlap(df, items, sent_bytes=sent).collect()}
        assert got["a"] == (1, True, hashlib.sha256(b"q30").hexdigest())
        assert got[None] == (1, True, hashlib.sha256(b"q4").hexdigest())
    assert rules.judged(df).count() == 4
    turns = spark.createDataFrame([("u", 0, "user", "x"), ("u", 1, "assistant", "y")], "conv_id string, turn long, role string, text string")
    got = chat.read_back(chat.format_paths(chat.conversations(chat.reply_trees(turns)))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [("u", 2, 1)]
    with pytest.raises(ValueError, match="integer key"):
        tokenfile.encoded(df, WORD, 2)


def test_joins_of_hot_keys(spark):
    from tessera.llm import graph, shared

    left = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50).alias("u"), F.col("id").alias("v"))
    right = left.groupBy("u").agg(F.max("v").alias("m"), F.count("*").alias("n"))
    want = sorted(map(tuple, left.join(right.drop("n"), "u").collect()))
    for limit in (1 << 20, 64, 0):
        got = shared.joined_evenly(left, right, "u", hot=100, limit=limit)
        assert got.columns == ["u", "v", "m"]
        assert sorted(map(tuple, got.collect())) == want
    edges = spark.range(400).select((F.col("id") % 7 * 1000).alias("a"), F.col("id").alias("b"))
    same = {r.node: r.root for r in graph.components(edges).collect()}
    assert same == {r.node: r.root for r in graph.components(edges, few=0).collect()}
    assert len(set(same.values())) == 7


# ---- pages by layout ---------------------------------------------------------------------------


@pytest.mark.parametrize(("layout", "least"), [("blocks", 0.98), ("table", 0.98), ("short", 0.95), ("plain", 0.95)])
def test_precision_and_recall_by_layout(layout, least):
    model = html_text.trained()
    hit = found = wanted = 0
    for source, blocks in labelled_pages.pages(200, seed=77, layout=layout):
        got = set(model.extract(re.sub(r' data-y="\d"', "", source)).split("\n")) - {""}
        want = {" ".join(b.split()) for b in blocks}
        hit, found, wanted = hit + len(got & want), found + len(got), wanted + len(want)
    assert hit / found >= least
    assert hit / wanted >= least


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        ('<nav><a href="/">Home</a> <a href="/n">News</a></nav><article><p>Rain fell all day in the valley.</p><form><label>Mail</label><input><button>Send</button></form><section class="comments"><p>So true.</p></section></article>', "Rain fell all day in the valley."),
        ('<div class="menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div><div class="content"><p>One short paragraph.</p></div><form action="/c"><label>Name</label><textarea></textarea></form><div class="comment"><p>Nice</p></div>', "One short paragraph."),
        ('<table width="100%"><tr><td width="150"><a href="/">Home</a><br><a href="/n">News</a></td><td><h2>Old layout</h2><p>This page was made with tables, as was usual then. It has two sentences.</p></td></tr><tr><td colspan="2">Copyright 1999 someone</td></tr></table>', "Old layout\nThis page was made with tables, as was usual then. It has two sentences."),
        ('<div><a href="/">Home</a> | <a href="/a">About</a></div><div><h1>Plain page</h1><p>Some text without any class names at all. Another sentence.</p></div><div><p>&copy; 2020 Someone</p></div>', "Plain page\nSome text without any class names at all. Another sentence."),
    ],
)
def test_pages_by_hand(source, wanted):
    assert html_text.trained().extract(f"<html><body>{source}</body></html>") == wanted


# ---- hostile inputs ----------------------------------------------------------------------------


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a '\"", "<div>", "<p><button>", "<ul><li><b>", "</p>", "<!x", "<table><tr><td>", "<p><button><div>", "&", "<textarea>", "x > ", "<!-- "])
def test_long_pages(unit):
    for tail in ("", ">", '">'):
        source = unit * (1_000_000 // len(unit)) + tail
        begin = time.monotonic()
        dom.parse(source)
        assert time.monotonic() - begin < 15


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnop", "é", "0 "])
def test_long_words(letters):
    r = random.Random(3)
    text = "".join(r.choice(letters) for _ in range(200_000))
    own, lib = bpe.Encoder(BYTE), Tokenizer.from_file(BYTE)
    begin = time.monotonic()
    ids, counts = own.encode([text, "x y"])
    assert time.monotonic() - begin < 20
    assert ids[: counts[0]].tolist() == lib.encode(text, add_special_tokens=False).ids
    assert own.decode(ids[: counts[0]]) == text


def test_long_texts_are_taken_by_runs(monkeypatch):
    r = random.Random(7)
    text = "".join(r.choice(["ab", " ", "\n", "'s", "é", "1", "  ", "\t", "<|endoftext|>", "x" * 40]) for _ in range(20_000))
    monkeypatch.setattr(pieces, "RUN", 1000)
    assert "".join(pieces.runs(text, 1000)) == text
    assert len(list(pieces.runs(text, 1000))) > 20
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    own, other = bpe.Encoder(BYTE, remembered=50), tokenfile.WordEncoder(WORD, remembered=50)
    ids, counts = own.encode(["a", text, ""])
    assert ids[counts[0] : counts[0] + counts[1]].tolist() == byte.encode(text, add_special_tokens=False).ids
    assert list(own.decoded(ids, counts)) == ["a", text, ""]
    ids, counts = other.encode(["a", text, ""], 2)
    assert ids[counts[0] : counts[0] + counts[1]].tolist() == [*word.encode(text, add_special_tokens=False).ids, 2]


def test_memory_of_long_texts():
    text = np.random.default_rng(0).integers(97, 123, 4_000_000, dtype=np.uint8).tobytes()
    net = quality.Network(3)
    tracemalloc.start()
    net.score([text])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 100 << 20


def test_colliding_slots():
    """Pieces whose first slots are equal get numbers of their own, and keep them when the table grows."""
    known = pieces.Known()
    known._sized(4)
    points = np.arange(1, 4001, dtype=np.uint32)
    starts = np.arange(4000)
    first, new = known.numbers(points, starts, starts + 1)
    assert sorted(first.tolist()) == list(range(4000)) == sorted(range(len(new)))
    again, none = known.numbers(points, starts, starts + 1)
    assert (again == first).all()
    assert len(none) == 0


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "doc_id % 2 as quality")
    assert len(quality.sample(docs, labels, "quality", 100)) == 50
    assert len(quality.sample(docs, labels, "quality", 20)) == 20
    assert len(quality.sample(docs, labels, "quality", 100, size=10_500)) == 10


def test_bushy_trees(spark):
    """A chain with a thousand leaves at its end: paths are made of the chosen branches only."""
    rows = [(1, i, i - 1 if i else None, "user", f"m{i}", 0.0) for i in range(40)] + [(1, 100 + i, 39, "assistant", f"leaf {i}", float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = chat.conversations(df, 3).orderBy("rank").collect()
    assert [(r.leaf, r["rank"], len(r.turns)) for r in got] == [(1099, 1, 41), (1098, 2, 41), (1097, 3, 41)]
    assert [t.text for t in got[0].turns] == [*(f"m{i}" for i in range(40)), "leaf 999"]
    best = chat.conversations(df).collect()
    assert [(r.leaf, [t.text for t in r.turns]) for r in best] == [(1099, [t.text for t in got[0].turns])]


def test_queries_have_docstrings():
    for name, q in queries.QUERIES.items():
        assert q.__doc__, name
    assert all(f.__doc__ for _, f in corpus_pipeline.STAGES)
    assert html_text.main_text.__doc__
    assert ODD[0] is None
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE
