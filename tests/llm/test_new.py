"""Operators 11 to 13 against SQL, brute force and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hand_pages import PAGES
from oracle import same
from pyspark.sql import functions as F
from test_llm import BYTE, ODD, WORD, odd_documents, overlap_by_force
from tokenizers import Tokenizer

from tessera.llm import bpe, chat, decontaminate, divergence, html_text, labelled_pages, linededup, pieces, queries, rules, tokenfile, trie

# ---- line deduplication (12) -------------------------------------------------------------------


def lines_by_force(rows, min_chars=10, min_documents=2):
    """Of (key, text) rows: lines, dropped lines and what stays."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(lower)
    order = lambda d: (d is None, d or 0)
    seen = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add(d)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if not (len(k := key(x)) >= min_chars and len(seen[k]) >= min_documents and min(seen[k], key=order) != d)]
        out.append((d, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return sorted(out, key=lambda r: (order(r[0]), r))


@pytest.mark.parametrize("sent", [linededup.SENT_BYTES, 0])
def test_lines_by_force(spark, sent):
    r = random.Random(5)
    stock = ["  A Common Line \x0b", "a common line", "ÄÖÜ äöü ßß", "äöü äöü ßß", "ÄÖÜ ÄÖÜ ßß", "short", "", " ", " nine char", "exactly 10", "İı lines of other letters", "x" * 50, "other\rline of text", "\x1cnot a blank here"]
    texts = ["\n".join(r.choice(stock) for _ in range(r.randint(0, 12))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*ODD, *texts, "line\n" * 300 + "a common line\n" * 300])]
    rows += [(3, "another text of three\na common line"), (3, "x"), (None, "a common line\nnull alone here\nnull alone here"), (None, "null alone here"), (-5, "a common line\n\n")]
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, `k.h` int, row string")
    for k in (2, 3):
        got = linededup.deduplicated(docs, min_documents=k, counts=("had", "lost"), sent_bytes=sent).collect()
        order = lambda x: (x[0] is None, x[0] or 0, x)
        assert sorted([(x.doc_id, x.had, x.lost, x.text) for x in got], key=order) == lines_by_force(rows, min_documents=k)
        assert all((x["k.h"], x.row) == (1, "z") for x in got)


def test_lines_of_odd_tables(spark):
    assert linededup.deduplicated(odd_documents(spark).limit(0)).columns == odd_documents(spark).columns
    assert linededup.deduplicated(odd_documents(spark).limit(0)).count() == 0
    got = linededup.deduplicated(odd_documents(spark), counts=("a", "b")).collect()
    assert len(got) == len(ODD) + 3
    assert all(x.b == 0 for x in got)  # repeated rows are one document, and nothing else is alike


@pytest.mark.parametrize("name", ["op12_line_dedup", "op13_source_divergence"])
def test_new_queries_by_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


# ---- source divergence (13) --------------------------------------------------------------------


def divergence_by_force(rows, min_documents, top):
    """Of (lang, source, text) rows, cell by cell in Python's integers."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(a or "", b or "", [w.translate(lower) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= min_documents}
        counts = {g: Counter(w for d in mine if d[1] == g for w in d[2] if w in kept) for g in {d[1] for d in mine}}
        p = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        whole = sum(counts.values(), Counter())
        for g, c in counts.items():
            pairs = [(s, sum(abs(p(c, w) - p(o, w)) for w in kept)) for s, o in counts.items() if s != g]
            terms = [(w, p(c, w) - p(whole, w)) for w in c if p(c, w) > p(whole, w)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, g, part, w, v, k + 1) for k, (w, v) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("heavy, block, held", [(4, 256, 200_000), (1, 4, 7), (1000, 3, 50)])
def test_divergence_by_force(spark, monkeypatch, heavy, block, held):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "LEAST_TERMS", 5)
    monkeypatch.setattr(divergence, "CELLS", 20)
    monkeypatch.setattr(divergence, "POSTINGS", 40)
    r = random.Random(heavy)
    words = ["the", "The", "été", "ÉTÉ", "ﬁn", "z", "日本", *(f"w{chr(97 + k)}" for k in range(26))]
    rows = [(r.choice(["en", "fr", None]), r.choice([None, *(f"s{k}" for k in range(11))]), " ".join(r.choice(words[: 3 + k % 30]) for _ in range(r.randint(0, 25)))) for k in range(300)]
    rows += [("xx", "one", "alone"), ("yy", "a", None), ("yy", "b", "1 2 3"), ("yy", "c", ""), ("en", "empty", "12"), ("en", "s1", "the-the_the " * 2000)]
    docs = spark.createDataFrame([(*row, 1, "t") for row in rows], "lang string, source string, text string, n int, term string")
    for min_documents in (3, 30):
        got = divergence.divergence(docs, min_documents=min_documents, top=7, heavy=heavy)
        assert sorted(map(tuple, got.collect())) == divergence_by_force(rows, min_documents, 7)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_parts_of_sums_by_force():
    """Dense tiles, one-sided sums and posting pairs, number by number."""
    r = np.random.default_rng(3)
    zx, zy = r.integers(1, 9, 5), r.integers(1, 9, 4)
    x, y = r.integers(1, 50, (5, 30)), r.integers(1, 50, (4, 30))
    want = np.array([[sum(abs(int(a) - int(b)) - abs(int(zx[i]) - int(zy[j])) for a, b in zip(x[i], y[j], strict=True)) for j in range(4)] for i in range(5)])
    assert (divergence.dense_sums(x, y, zx, zy) == want).all()
    has_x, has_y = r.random((5, 30)) < 0.3, r.random((4, 30)) < 0.3
    x, y = np.where(has_x, x, zx[:, None]), np.where(has_y, y, zy[:, None])
    (tx, gx), (ty, gy) = np.nonzero(has_x.T), np.nonzero(has_y.T)
    sums = divergence.one_sided(gx, x[gx, tx], zx, zy) + divergence.one_sided(gy, y[gy, ty], zy, zx).T
    for at_once in (1, 7, 1 << 20):
        assert (sums + divergence.posting_pairs(tx, gx, x[gx, tx], ty, gy, y[gy, ty], zx, zy, at_once) == divergence.dense_sums(x, y, zx, zy)).all()


# ---- prefix tries (11) -------------------------------------------------------------------------


def trie_by_force(rows, whole=False):
    """Of (conv_id, turn, role, text) rows: the nodes, by dictionaries of prefixes."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = 0 if whole else zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(int(c / 100) * 100, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie_rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


def odd_conversations(seed=1):
    r = random.Random(seed)
    rows = []
    for c in [*range(-3, 60), *range(100, 160), *range(305, 330), 1000, 1001]:
        for t in range(r.choice([1, 2, 3, 5, 8])):
            rows.append((c, r.choice([t, t, None, 0]), r.choice(["user", "assistant", "", None]), r.choice(["a", "bb", "", None, "é" * 3])))
    rows += [(7, 1, "user", "x")] * 3 + [(None, 1, "user", "no conversation")]
    rows += [(c, t, "user", f"turn {t}") for c in (200, 201, 277) for t in range(40)]
    return rows


@pytest.mark.parametrize("heavy, packed, chained", [(2000, 100_000, 1024), (3, 10, 4), (1, 1, 1), (20, 50, 7)])
def test_trie_by_force(spark, monkeypatch, heavy, packed, chained):
    monkeypatch.setattr(trie, "CHUNK", 20)
    rows = odd_conversations(heavy)
    turns = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, c int").repartition(5)
    assert trie_rows(trie.prefix_trie(*trie.rebuilt(turns), heavy, packed, chained)) == trie_by_force(rows)
    if heavy == 3:
        assert trie_rows(trie.prefix_trie(*trie.whole(turns), heavy, packed, chained)) == trie_by_force(rows, whole=True)


def test_trie_of_nothing(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(*trie.rebuilt(turns)).count() == 0


def test_op11_by_force(spark, sf_dir):
    rows = list(map(tuple, spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert trie_rows(trie.op11_prefix_trie(spark, sf_dir)) == trie_by_force(rows)


def test_louds_of_random_forests():
    r = np.random.default_rng(2)
    for count in (1, 2, 9, 200):
        parent = np.array([r.integers(-1, i) if i else -1 for i in range(count)])
        shuffled = r.permutation(count)
        mixed = np.full(count, -1)
        mixed[shuffled] = np.where(parent < 0, -1, shuffled[parent])
        order = r.permutation(count)
        found, bits = trie.louds(mixed, order)
        up, degree, spans = trie.navigated(bits)
        assert sorted(found) == list(range(count))
        assert [found[p] if p >= 0 else -1 for p in up] == [mixed[i] for i in found]
        assert degree.tolist() == [int((mixed == i).sum()) for i in found]
        assert spans[-1][1] == count
        assert all(order[found[i]] < order[found[i + 1]] for i in range(count - 1) if up[i] == up[i + 1])


# ---- pieces of tokens (1, 2, 9) ----------------------------------------------------------------


def same_as_library(path, texts):
    lib, own = Tokenizer.from_file(path), (bpe.Encoder(path) if path == BYTE else tokenfile.WordEncoder(path))
    ids, counts = own.encode(texts)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    at = np.concatenate([[0], np.cumsum(counts)])
    assert len(counts) == len(texts)
    return [t for t, w, a, b in zip(texts, want, at[:-1], at[1:], strict=True) if ids[a:b].tolist() != w]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_whose_hashes_agree(path):
    """Thue-Morse words and their complements agree under every polynomial hash modulo 2**64."""
    texts = []
    for size in (1024, 2048):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
        texts += [word, word.translate(str.maketrans("ab", "ba")), f"x {word} y {word.translate(str.maketrans('ab', 'ba'))}"]
    own = pieces.Known()
    points = pieces.code_points("".join(texts[:2]))
    numbers, new = own.numbers(points, np.array([0, 1024]), np.array([1024, 2048]))
    assert numbers.tolist() == [0, 1]
    assert new.tolist() == [0, 1]
    assert pieces.hashes(points, np.array([0, 1024]), np.array([1024, 2048]))[0] == pieces.hashes(points, np.array([1024]), np.array([2048]))[0]
    assert same_as_library(path, texts) == []
    assert same_as_library(path, [*texts[::-1], *texts]) == []


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_long_random_pieces(path):
    r = random.Random(8)
    texts = ["".join(r.choices("abcdeé", k=r.randint(50, 400))) for _ in range(10_000)]
    assert same_as_library(path, texts) == []


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_code_point(path):
    """Letters, numbers, blanks, normal forms and case are the library's, also of what is newer than Python's tables."""
    points = [*range(1, 0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200)]
    assert same_as_library(path, [f"a{c} {c}1{c}b" for c in map(chr, points)]) == []


# ---- what earlier operators left open (3, 6, 10) -----------------------------------------------


@pytest.mark.parametrize("sent", [1 << 24, 0])
def test_overlap_compares_words(spark, sent):
    """Words whose hashes agree, in windows of one word, of 13, and on both sides."""
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    y = x.translate(str.maketrans("ab", "ba"))
    docs = [(0, f"w1 w2 {x} w3"), (1, f"w1 w2 {y} w3"), (2, " ".join([x, y] * 20)), (3, " ".join([x] * 40)), (4, f"{x} a b c d e f g h i j k l m"), (5, f"{y} a b c d e f g h i j k l m"), (6, None), (7, ""), (8, x.upper())]
    items = [(1, y), (2, " ".join([x, y] * 7)), (3, f"{y} a b c d e f g h i j k l m n"), (4, " ".join([y] * 13)), (5, None), (6, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlap(d, b, sent_bytes=sent).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == overlap_by_force(docs, items)
    assert next(r for r in got if r.doc_id == 0).n_hit == 0


def test_chat_keeps_a_null_key(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (None, 1, "assistant", "</s>"), (None, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op6_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(got) == {None, 1, -1}
    assert (got[None].n_turns, got[None].loss_chars) == (2, 4)
    assert got[None].turns_sha256 == hashlib.sha256(b"user\n\nassistant\n</s>\n").hexdigest()


def test_names_with_dots_and_backticks(spark):
    docs = spark.createDataFrame([(1, "a b " * 60, "h")], ["d.`k", "t.x", "s`"])
    benchmark = spark.createDataFrame([("i", "z")], ["i.d", "t`"])
    assert rules.judged(docs, "t.x", "s`", "d.`k").first()["n_words"] == 120
    assert rules.accepted(docs, "t.x", "s`", "d.`k").columns == docs.columns
    assert decontaminate.overlap(docs, benchmark, "t.x", "d.`k", "t`", "i.d").first()["n_words"] == 120
    assert linededup.deduplicated(docs, "d.`k", "t.x").first() == docs.first()
    assert decontaminate.clean(docs, benchmark.withColumnsRenamed({"t`": "text", "i.d": "item_id"}), "t.x", "d.`k").count() == 1


# ---- main text of pages (5) --------------------------------------------------------------------


def test_pages_that_no_grammar_made():
    model = html_text.trained()
    hit = found = wanted = 0
    for source, blocks in PAGES:
        got, want = Counter(b for b in model.extract(source).split("\n") if b), Counter(blocks)
        hit, found, wanted = hit + (got & want).total(), found + got.total(), wanted + want.total()
    assert len(PAGES) >= 40
    assert hit / wanted >= 0.95
    assert hit / found >= 0.95


def test_bare_pages_of_the_grammar():
    model = html_text.trained()
    hit = found = wanted = 0
    for source, blocks in labelled_pages.pages(200, seed=77, layout="bare"):
        got, want = set(model.extract(re.sub(r' data-y="\d"', "", source)).split("\n")) - {""}, {" ".join(b.split()) for b in blocks}
        hit, found, wanted = hit + len(got & want), found + len(got), wanted + len(want)
    assert hit / found >= 0.95
    assert hit / wanted >= 0.95


@pytest.mark.parametrize("count", [1, 2, 5, 10, 30, 100])
def test_long_and_short_articles(count):
    text = "Rain fell all day in the valley. Nobody went out."
    model = html_text.trained()
    for around in ("<body><h1>A day of rain</h1>{}</body>", "<article><h1>A day of rain</h1>{}</article>", "<h1>A day of rain</h1>{}"):
        assert model.extract(around.format(f"<p>{text}</p>" * count)) == "\n".join(["A day of rain", *[text] * count])
    links = "".join(f"<li><a href='/{i}'>page {i}</a></li>" for i in range(min(count, 30)))
    assert model.extract(f"<html><body><article><p>{text}</p><ul>{links}</ul></article></body></html>").startswith(text)


def test_chat_sends_no_table(spark, monkeypatch):
    """However well a table is compressed, it isn't broadcast; rounds need no jobs of their own for counts, and trees of one
    branch no second climb."""
    tables, write = [], chat.shared.written

    def watched(df, name, *args, **more):
        tables.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name, *args, **more)

    monkeypatch.setattr(chat.shared, "written", watched)
    chain = spark.range(64).selectExpr("id % 2 as tree", "id div 2 as node", "if(id < 2, null, id div 2 - 1) as parent", "'user' as role", "string(id) as text")
    got = chat.conversations(chain)
    tables.append(("result", got._jdf.queryExecution().executedPlan().toString()))
    assert [n for n, _ in tables] == ["climb"] * 6 + ["branches", "result"]
    assert not [n for n, plan in tables if "Broadcast" in plan]
    assert {r.tree: [int(t.text) for t in r.turns] for r in got.collect()} == {0: list(range(0, 64, 2)), 1: list(range(1, 64, 2))}


@pytest.mark.parametrize("branches", [1, 2, 3])
def test_chat_of_single_and_many_branches(spark, branches):
    """Random forests, in which some trees have one branch, against a walk over each."""
    r = random.Random(branches)
    rows = [(t, i, (i - 1 if t % 3 == 0 else r.randrange(i)) if i else None, "user", f"{t} {i}", float(r.randrange(3))) for t in range(12) for i in range(r.randint(1, 20))]
    rows += [(3, 100, 99, "user", "lost", 9.0), (20, 1, 2, "user", "circle", 1.0), (20, 2, 1, "user", "circle", 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    want = {}
    for tree in range(12):
        of = {n: (p, s) for t, n, p, _, _, s in rows if t == tree and n != 100}
        paths = []
        for leaf in of.keys() - {p for p, _ in of.values()}:
            path = [leaf]
            while of[path[-1]][0] is not None:
                path.append(of[path[-1]][0])
            paths.append((-sum(of[n][1] for n in path) / len(path), -len(path), leaf, path[::-1]))
        want |= {(tree, leaf, k): [f"{tree} {n}" for n in path] for k, (_, _, leaf, path) in enumerate(sorted(paths)[:branches], 1)}
    assert {(x.tree, x.leaf, x["rank"]): [t.text for t in x.turns] for x in chat.conversations(df, branches).collect()} == want
