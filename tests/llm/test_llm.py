"""The operators against brute force, round trips, the tokenizers library, and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from oracle import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, chat, decontaminate, dom, html_text, labelled_pages, quality, queries, rules, shared, simhash, tokencount, tokenfile, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "x", "it's 'sa '' 's \n's x'll'd !'re  a\t\tb \n\n c  ", "<|endoftext|>a<|endoftext|> b", "aaaa aaaaaaa", "a b　 c 12３٣ x²", "\U0001f600‍ x́ — “q”'ve", "\x1c\x1d a\x85b", "ΑΣ İstanbul Å", "line\n" * 40, "word " * 30_000]


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "h", "en", 1) for i, t in enumerate(ODD)] + [(3, "x", "h", "en", 1), (3, "x", "h", "en", 1), (None, "no key", None, "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, fp int")


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def random_texts(alphabet, n=1500, seed=4):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(n)]


# ---- tokens (1, 2, 9) --------------------------------------------------------------------------


def test_byte_bpe_equals_library(spark, sf_dir):
    lib, own = Tokenizer.from_file(BYTE), bpe.Encoder(BYTE, remembered=500)
    texts = [t or "" for t in ODD] + random_texts("ab 's'trelvdm\n\t é1٣!<|>") + [t for _, t in documents(spark, sf_dir)[:60]]
    for part in (texts[:900], texts[900:]):
        ids, counts = own.encode(part)
        at = 0
        for t, n in zip(part, counts.tolist(), strict=True):
            want = lib.encode(t, add_special_tokens=False).ids
            assert ids[at : at + n].tolist() == want
            assert own.decode(ids[at : at + n]) == lib.decode(want, skip_special_tokens=False)
            at += n


def test_op2_digests(spark, sf_dir):
    lib = Tokenizer.from_file(BYTE)
    for row in bpe.round_trip(odd_documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]), BYTE).collect():
        ids = lib.encode(ODD[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((ODD[row.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip(odd_documents(spark), BYTE).count() == len(ODD) + 3
    assert bpe.round_trip(odd_documents(spark).limit(0), BYTE).count() == 0
    assert {r.doc_id: len(r.ids) for r in bpe.encode_documents(odd_documents(spark), BYTE).collect()}[1] == 0


def test_token_spans_equal_library(spark, sf_dir):
    lib, own = Tokenizer.from_file(BYTE), bpe.Encoder(BYTE)
    texts = ["héllo wörld 日本語 \U0001f600 x", "<|endoftext|>é b", "", "a\nb\n\nc "] + [t for _, t in documents(spark, sf_dir)[:30]]
    _, first, end, counts = tokencount.token_spans(own, texts)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        want = lib.encode(t, add_special_tokens=False).offsets  # these leave out spaces before words
        for (a, b), (x, y) in zip(zip(first[at : at + n], end[at : at + n], strict=True), want, strict=True):
            assert b == y
            assert not t[a:x].strip()
        at += n


@pytest.mark.parametrize(("rule", "wanted"), [("first", [2, 0, 1]), ("most", [1, 1, 1]), ("share", [1.25, 0.75, 1])])
def test_boundary_rules(rule, wanted):
    found = tokencount.allocated(np.array([0, 3, 7]), np.array([3, 7, 9]), np.array([0, 4, 7, 9]), rule)
    assert found.tolist() == wanted


def test_section_tokens(spark):
    rows = tokencount.section_tokens(odd_documents(spark), BYTE).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        assert sum(r.section_tokens) == pytest.approx(r.n_tokens)
        assert len(r.section_tokens) == len(r.section_starts) >= 1
    both = tokencount.field_tokens(odd_documents(spark), ["source", "text"], BYTE, rule="share").collect()
    assert all(r.tokens_source + r.tokens_text == pytest.approx(r.n_tokens) for r in both)
    with pytest.raises(ValueError):
        tokencount.section_tokens(odd_documents(spark), BYTE, rule="none")


def test_word_bpe_equals_library(spark, sf_dir):
    lib, own = Tokenizer.from_file(WORD), tokenfile.WordEncoder(WORD, remembered=500)
    texts = [t or "" for t in ODD] + random_texts("ab 's'trelvdmΣσİÉÅ\n\t é1٣!<|>ß\x00\x85ǅ") + [t for _, t in documents(spark, sf_dir)[:40]]
    for part in (texts[:900], texts[900:]):
        ids, counts = own.encode(part, 2)
        at = 0
        for t, n in zip(part, counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == [*lib.encode(t, add_special_tokens=False).ids, 2]
            at += n


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 70_000])
def test_huffman_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 49_000).astype(np.uint32)
    lengths = tokenfile.code_lengths(np.bincount(ids, minlength=49_408))
    assert lengths.max(initial=0) <= tokenfile.MAX_BITS
    code = tokenfile.Code(lengths)
    stream, offsets, _ = code.pack(ids)
    assert (code.unpack(stream, offsets, n) == ids).all()


def test_huffman_lengths_are_optimal_and_limited():
    counts = np.array([1 << i for i in range(20)])
    free = tokenfile.code_lengths(counts, 30)
    assert sum(2.0 ** -int(x) for x in free) == 1
    assert free.max() == 19
    assert tokenfile.code_lengths(counts, 6).max() == 6
    assert tokenfile.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]


def test_damaged_block_is_found():
    code = tokenfile.Code(tokenfile.code_lengths(np.array([3, 2, 1])))
    block = tokenfile.packed(code, [1, None], [2, 1], np.array([0, 1, 2], np.uint32), 5)
    keys, counts, ids, before = tokenfile.unpacked(code, block)
    assert (keys, counts.tolist(), ids.tolist(), before) == ([1, None], [2, 1], [0, 1, 2], 5)
    with pytest.raises(ValueError):
        tokenfile.unpacked(code, block[:-1] + bytes([block[-1] ^ 128]))


def test_token_files(spark, sf_dir, tmp_path):
    lib = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokenfile.write_tokens(docs, str(tmp_path / "f"), WORD, block=5000)
    got = {r.doc_id: r for r in tokenfile.read_digests(spark, str(tmp_path / "f")).collect()}
    start = 0
    for key, text in sorted(documents(spark, sf_dir)):
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    odd = odd_documents(spark)
    tokenfile.write_tokens(odd, str(tmp_path / "odd"), WORD)
    rows = sorted(tokenfile.read_tokens(spark, str(tmp_path / "odd")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, 3, *range(4, len(ODD))]
    tokenfile.write_tokens(odd.limit(0), str(tmp_path / "none"), WORD)
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).count() == 0


# ---- decontamination (3) -----------------------------------------------------------------------


def overlap_by_force(docs, items, span=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows[tuple(w[j : j + n])].add(i)
    out = {}
    for key, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[k]
        out[key] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("sent", [1 << 24, 0])
def test_overlap_equals_brute_force(spark, sent):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("abAé") for _ in range(n))
    docs = [(i, text(r.randint(0, 60))) for i in range(150)] + [(400, None), (401, ""), (402, "9 " * 3000)]
    items = [(i, text(r.randint(0, 16) + 4 * (i % 2))) for i in range(12)] + [(50, None), (11, "a b A é a b A é a b A é a b")]
    want = overlap_by_force(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlap(d.selectExpr("*", "'x' as n_hit"), b, sent_bytes=sent).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert decontaminate.overlap(d, b.limit(0), sent_bytes=sent).filter("n_hit > 0").count() == 0
    assert decontaminate.overlap(d.limit(0), b, sent_bytes=sent).count() == 0


@pytest.mark.parametrize("sent", [1 << 24, 0])
def test_overlap_of_repeated_words(spark, sent):
    """Periodic texts, and items of one to three words, in every place that they occur."""
    r = random.Random(9)
    items = [(1, "spam"), (2, "ha ha"), (3, "0 " * 16), (4, "x y z " * 9), (5, "one two three"), (6, "a b " * 20), (7, "n " * 12), (8, "q " * 40 + "r " * 40), (9, "q " * 13)]
    docs = ["spam " * 50, "ha " * 30, "ha", " ".join(f"w{i}" for i in range(900)) + " 0" * 100 + " " + " ".join(f"v{i}" for i in range(900)), "x y z " * 40, "one two three " * 7, "a b " * 35 + "c", "n " * 30 + "m " + "n " * 11, "q " * 200 + "r " * 25, ("q " * 39 + "s ") * 5]
    docs += [" ".join(r.choice(["0", "q", "x y z", "a b", "ha", "n", "spam"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    docs += [" ".join((r.choice(["0", "q", "x y z", "a b", "n"]) + " ") * r.randint(1, 30) for _ in range(12)) for _ in range(60)]
    docs = list(enumerate(docs))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlap(spark.createDataFrame(docs, "doc_id long, text string"), b, sent_bytes=sent).collect()
    want = overlap_by_force(docs, items)
    assert [want[i][1] for i in (0, 1, 3, 4)] == [50, 30, 100, 120]
    assert {x.doc_id: tuple(x)[1:] for x in got} == want


@pytest.mark.parametrize("sent", [1 << 24, 0])
def test_overlap_of_generated_cases(spark, sent):
    """Ten thousand documents: periodic ones, repeated phrases, a few words, planted and cut windows."""
    r = random.Random(21)
    words = [f"v{i}" for i in range(40)]
    items = []
    for i in range(40):
        unit = [r.choice(words[: r.choice([2, 3, 40])]) for _ in range(r.randint(1, 20))]
        items.append((f"q{i}", " ".join((unit * r.randint(1, 4))[: r.randint(1, 30)])))
    docs = []
    for i in range(10_000):
        parts = []
        for _ in range(r.randint(0, 4)):
            w = r.choice(items)[1].split()
            a = r.randint(0, max(0, len(w) - 13))
            kind = r.random()
            parts += w if kind < 0.3 else w[a : a + r.randint(1, 16)] * r.randint(1, 3) if kind < 0.7 else [r.choice(words[: r.choice([2, 3, 40])]) for _ in range(r.randint(1, 15))]
        docs.append((f"d{i}", " ".join(parts)))
    want = overlap_by_force(docs, items)
    got = decontaminate.overlap(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"), sent_bytes=sent).collect()
    wrong = [x.doc_id for x in got if tuple(x)[1:] != want[x.doc_id]]
    assert len(got) == 10_000
    assert wrong == []
    assert sum(x.n_hit > 0 for x in got) > 3000


def test_op3_on_tables(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = overlap_by_force(documents(spark, sf_dir), items)
    got = decontaminate.op3_benchmark_overlap(spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if not v[4]}
    assert kept.columns == docs.columns


# ---- near-duplicates (8) -----------------------------------------------------------------------


def fingerprint_by_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_force(pairs, bits):
    ids, fps = [p[0] for p in pairs], [p[1] for p in pairs]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, k in enumerate(ids)}


def test_op8_on_tables(spark, sf_dir):
    rows = simhash.op8_simhash_near_duplicates(spark, sf_dir).collect()
    docs = documents(spark, sf_dir)
    want = {k: fingerprint_by_force(t) for k, t in docs}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == want
    assert {r.doc_id: r.component_id for r in rows} == classes_by_force(list(want.items()), 2)


@pytest.mark.parametrize(("compared", "bits"), [(64, 2), (2, 2), (2, 1), (2, 3)])
def test_links_are_exact(spark, monkeypatch, compared, bits):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    r = random.Random(bits)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(40)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from tessera.llm import graph

    stars = {x.node: x.root for x in graph.components(simhash.links(df, bits)).collect()}
    want = classes_by_force([(s, u) for s, u in zip(signed, fps, strict=True)], bits)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({s: stars.get(s, s) for s in signed}) == groups(want)


@pytest.mark.parametrize(("compared", "walked"), [(2, 8192), (2, 10), (64, 64)])
def test_crowded_signatures_are_walked(spark, monkeypatch, compared, walked):
    """Without a forest 200 variants of one text made 528 rows for each signature of each."""
    from tessera.llm import graph

    r = random.Random(walked)
    base = r.getrandbits(64)
    fps = [*{base ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for _ in range(200)}]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    monkeypatch.setattr(simhash, "COMPARED", compared)
    monkeypatch.setattr(simhash, "WALKED", walked)
    if walked == 8192:
        monkeypatch.setattr(simhash, "_crowded_links", None)
    stars = {x.node: x.root for x in graph.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    want = classes_by_force([*zip(signed, fps, strict=True)], 2)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({s: stars.get(s, s) for s in signed}) == groups(want)


def test_broadcasts_are_small(spark):
    """A million rows of 32 bytes are more than the driver should hold."""
    assert not shared.fits(spark.range(200_000), 32)


def test_near_duplicates_of_odd_rows(spark):
    odd = odd_documents(spark)
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) + 3
    by = {r.doc_id: r.component_id for r in rows}
    assert by[0] == by[1] == by[2] == 0  # no words: one class
    assert by[None] is None
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({v for v in by.values() if v is not None})
    assert ids.count(None) == 1
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    assert simhash.representatives(odd.limit(0)).count() == 0


# ---- quality rules (10) ------------------------------------------------------------------------


def test_op10_equals_oracle(spark, sf_dir):
    same(rules.op10_quality_rules(spark, sf_dir), rules.ORACLE, sf_dir)


def test_line_frequency(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, own(i) + "\nthe SAME  footer line", "h") for i in range(40)]
    rows += [(100 + i, f"only{i}\nthe same footer line " + "\nthe same footer line" * 20, "h") for i in range(3)]
    rows += [(200 + i, own(7), "h") for i in range(30)]  # copies aren't boilerplate
    rows += [(300, None, "h"), (301, "", None), (302, own(302), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert rules.frequent_lines(df, min_documents=3).count() == 1
    for sent in (1 << 20, 0):
        got = {r.doc_id: r for r in rules.judged(df, min_documents=3, sent_bytes=sent).collect()}
        assert all(got[i].kept for i in [*range(40), *range(200, 230), 302])
        assert not any(got[i].kept for i in [100, 101, 102, 300, 301])
        assert [got[i].n_lost_words for i in (0, 100, 200, 300)] == [4, 84, 0, 0]
        kept = rules.accepted(df, min_documents=3, sent_bytes=sent)
        assert kept.columns == df.columns
        left = {r.doc_id: r.text for r in kept.collect()}
        assert set(left) == {k for k, r in got.items() if r.kept}
        assert left[5] == own(5)
        assert left[302] == own(302)
    assert rules.judged(df.limit(0)).count() == 0
    assert rules.accepted(df.limit(0)).count() == 0
    assert rules.judged(odd_documents(spark)).count() == len(ODD) + 3


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_line_frequency_equals_oracle(spark, tmp_path, sent):
    """A table on which the verdict isn't the base rules': by SQL that compares lines as text."""
    r = random.Random(8)
    menu = [f"Menu  Line {i} of This host" for i in range(30)]
    rows = []
    for i in range(300):
        body = " ".join(f"w{r.randint(0, 5000)}" for _ in range(r.choice([8, 60, 200])))
        lines = [*r.sample(menu, r.randint(0, 14)), body, *r.sample(menu, 2)]
        rows.append((i, "\n".join(x if r.random() < 0.5 else x.upper() + " " for x in lines), r.choice(["a", "a", "b", None])))
    rows += [(400 + i, rows[3][1], "a") for i in range(200)] + [(700, None, "a"), (701, "", None), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "t"))
    import duckdb
    from oracle import rows as unordered

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    for limits in ((3, 2, 80), (20, 5, 30), (50, 2, 80)):
        names = dict(zip(("min_documents", "line_percent", "depleted_percent"), limits, strict=True))
        got, want = unordered(rules.judged(df, sent_bytes=sent, **names).toPandas()), unordered(con.sql(rules.oracle(*limits)).df())
        assert got == want
    depleted = rules.judged(df, min_documents=3, depleted_percent=30, sent_bytes=sent).filter("not kept and not base_failed").count()
    assert depleted > 10


def test_menu_of_short_pages(spark):
    """Six menu lines on two hundred unrelated pages of one paragraph: all six are found."""
    menu = [f"menu entry number {i}" for i in range(6)]
    rows = [(i, "\n".join([*menu, f"page {i} says {i * 7} and ends"]), "h") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert rules.frequent_lines(df).count() == 6


def test_lines_of_template_pages(spark):
    """Pages of one template are different documents, and exact copies of one text a single one."""
    r = random.Random(5)
    shared_lines = [f"shared line {i} of the template" for i in range(100)]
    pages = ["\n".join([f"own {i}", *r.sample(shared_lines, 20)]) for i in range(600)]
    rows = [(i, t, "h") for i, t in enumerate(pages)] + [(1000 + i, "the very same text", "h") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    on = lambda t: {x for x in shared_lines if x in t.split("\n")}
    seen = Counter(x for t in pages for x in on(t))
    want = {x for x, n in seen.items() if n > 50 and n * 100 > 2 * 601}
    assert len(want) == 100
    assert rules.frequent_lines(df).count() == 100
    gone = {r.doc_id for r in rules.judged(df).filter("100 * n_lost_words > 80 * n_words").collect()}
    assert gone == set(range(600))


def test_repeated_windows(spark):
    rows = [(1, "a b c a b c"), (2, "a a a a"), (3, "a b"), (4, "a b c d e f"), (5, "x a b c y a b c z")]
    got = {r.doc_id: r.n_repeat_words for r in rules.base_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 6, 2: 4, 3: 0, 4: 0, 5: 6}


def test_op10_has_no_python(spark, sf_dir):
    plan = rules.op10_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- classifiers (4, 7) ------------------------------------------------------------------------


@pytest.mark.parametrize(("query", "label", "folds", "held", "least"), [("op4_toxicity", "toxic", 5, 0, 0.9), ("op7_quality_classifier", "quality", 3, 1, 0.95)])
def test_held_out_accuracy(spark, query, label, folds, held, least):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES[query](spark, sf)
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = rows.collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all((zlib.crc32(str(r.doc_id).encode()) % folds == held) == r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    test = [(r.predicted, marks[r.doc_id]) for r in found if r.held_out and r.doc_id in marks]
    assert sum(a == b for a, b in test) / len(test) >= least


def test_classifiers_of_odd_rows(spark):
    odd = odd_documents(spark)
    for labels in ([], [(4, 1, 1)], [(4, 1, 1), (5, 0, 0), (5, 0, 0), (6, None, None), (None, 1, 1)]):
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = quality.fit(odd, marks)
        assert all(0 <= r.score <= 1 for r in quality.scored(odd.drop("score"), model).collect())
        model = toxicity.fit(odd, marks)
        assert all(0 <= r.score <= 1 for r in toxicity.scored(odd.drop("score"), model).collect())


def test_network_gradient():
    r = np.random.default_rng(0)
    texts = [bytes(r.integers(97, 123, n, np.uint8)) for n in (0, 5, 300, 900)]
    y = np.array([0.0, 1, 0, 1])
    net = quality.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: float(-np.mean(np.where(y == 1, np.log(p := net.score(texts)), np.log(1 - p))))
    g = net.gradient(texts, y)
    for name, at in (("w1", (0, 0)), ("filters", (1, 2, 3)), ("bias", (4,)), ("embed", (100, 1)), ("w2", (2,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        high = loss()
        net.p[name][at] = old - 1e-5
        low = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((high - low) / 2e-5, abs=2e-4)


def test_kneser_ney_probabilities_sum_to_one(spark):
    """Over all characters that there can be, after every context of every order, in both classes."""
    r = random.Random(6)
    train = [(y, "".join(r.choice("abcdя"[: 3 + 2 * y]) for _ in range(30))) for y in (0, 1, 0, 1)]
    count = toxicity.counts(spark.createDataFrame(train, "__y long, __text string"))
    rows = toxicity.smoothed(count).collect()
    grams = {x.gram: (x.p0, x.p1) for x in rows if not x["of"]}
    contexts = {x.gram: (x.p0, x.p1) for x in rows if x["of"]}
    letters = {g for g in grams if len(g) == 1}
    size = len(letters) + 1  # and one that was never seen

    def prob(context, c, y):
        if context + c in grams:
            return grams[context + c][y]
        if not context:
            return contexts[""][y] / size
        return contexts.get(context, (1, 1))[y] * prob(context[1:], c, y)

    assert len(contexts) > 50
    for context in contexts:
        for y in (0, 1):
            assert sum(prob(context, c, y) for c in [*letters, "?"]) == pytest.approx(1)


def ratio_by_force(count, length, size, d=0.75):
    """Kneser-Ney of each class straight from its counts, for any n-gram."""
    def prob(types, gram):
        if not gram:
            return 1 / size
        own = {g: n for g, n in types[len(gram)].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return prob(types, gram[1:])
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * prob(types, gram[1:])

    both = []
    for y in (0, 1):
        types = {length: {g: n for (z, g), n in count.items() if z == y}}
        for k in range(length - 1, 0, -1):
            types[k] = Counter(g[1:] for g in types[k + 1])
        both.append(types)
    return lambda gram: float(np.log(prob(both[1], gram) / prob(both[0], gram)))


def test_ratios_equal_brute_force(spark):
    r = random.Random(2)
    train = [(y, "".join(r.choice("abcя ж"[: 4 + 2 * y]) for _ in range(40))) for y in (0, 1, 0)]
    count = Counter()
    for y, t in train:
        s, at, _ = toxicity.grams([t])
        count.update((y, "".join(map(chr, s[p : p + toxicity.LENGTH]))) for p in at.tolist())
    df = spark.createDataFrame(train, "__y long, __text string")
    found = toxicity.counts(df)
    assert {(x.y, x.gram): x.n for x in found.collect()} == count
    size = len({g[-1] for _, g in count}) + 1
    want = ratio_by_force(count, toxicity.LENGTH, size)
    table = toxicity.keyed(toxicity.ratios(found, size=size)).toArrow()
    key = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    assert len(set(key.tolist())) == len(key)
    s, at, _ = toxicity.grams(["abca яжca  bбa", "жжжaaя"])
    got = toxicity.Lookup(key[order], table.column("ratio").to_numpy().astype(np.float32)[order]).ratio(s, at)
    assert got.tolist() == pytest.approx([want("".join(map(chr, s[p : p + toxicity.LENGTH]))) for p in at.tolist()], abs=1e-4)


@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_long_expressions_of_any_script(spark, sent):
    """Expressions that folding to 26 letters or four characters can't tell apart."""
    plain, bad = "абвгд", "ыьэюя"
    fold = lambda t: "".join(chr(ord(c) + 26) for c in t)
    r = random.Random(3)
    words = ["".join(r.choice(plain) for _ in range(6)) for _ in range(60)]
    toxic = ["".join(r.choice(bad) for _ in range(6)) for _ in range(6)]
    clean = ["".join(fold(c) for c in t) for t in toxic]
    rows = [(i, " ".join(r.choices(words, k=30) + r.choices(toxic if i % 2 else clean, k=4)), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    model = toxicity.fit(df.filter("doc_id < 300"), df.filter("doc_id < 300").select("doc_id", "toxic"))
    got = {x.doc_id: x.score for x in toxicity.scored(df, model, sent_bytes=sent).collect()}
    assert len(got) == 400
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(300, 400))
    more = df.withColumn("text", F.concat("text", F.lit(" "), F.reverse("text")))
    assert toxicity.ratios(toxicity.counts(more.select(F.col("toxic").alias("__y"), F.col("text").alias("__text")))).count() > toxicity.ratios(toxicity.counts(df.select(F.col("toxic").alias("__y"), F.col("text").alias("__text")))).count()


# ---- HTML (5) ----------------------------------------------------------------------------------


def test_extraction_of_unseen_layouts():
    model = html_text.trained()
    hit = found = wanted = 0
    for source, blocks in labelled_pages.pages(300, seed=99):
        got = model.extract(re.sub(r' data-y="\d"', "", source)).split("\n")
        want = [" ".join(b.split()) for b in blocks]
        hit += len(set(got) & set(want))
        found, wanted = found + len(set(got)), wanted + len(set(want))
    assert hit / found > 0.97
    assert hit / wanted > 0.97


def test_marginals_equal_enumeration():
    model = html_text.trained()
    page = dom.parse("<div class='post'><p>One two three.</p><ul><li><a href='/'>x</a></li></ul></div>")
    n = len(page.tag)
    weights = np.zeros((2, n))
    total = 0.0
    import itertools
    import math

    for ys in itertools.product((0, 1), repeat=n - 1):
        y = (0, *ys)
        w = 1.0
        for i in range(1, n):
            reach = html_text.TEXT_REACH if page.tag[i] == "#" else 12.0
            e = max(-reach, min(reach, sum(model.ratio.get(f, 0.0) for f in html_text.features(page, i))))
            moves = model.pass_on.get(model.kind(page.tag[i]), model.pass_on[""])
            w *= moves[y[page.parent[i]]][y[i]] * (math.exp(e) if y[i] else 1)
        total += w
        for i in range(n):
            weights[y[i], i] += w
    assert model.marginals(page)[1:] == pytest.approx((weights[1] / total)[1:].tolist(), rel=1e-4, abs=1e-7)


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        ("<p>a &amp; b<p>c<script>var x='<p>no</p>';</script>", ["a & b", "c"]),
        ("<ul><li>one<li>two</ul>tail", ["one", "two", "tail"]),
        ("x < y <b>bold</b>text<br>next", ["x < y boldtext next"]),
        ("<!-- <p>no</p> --><td>a<td>b", ["a", "b"]),
        ("<p title='a > b'>t</p><div hidden>h</div><title>no</title>", ["t"]),
        ("<p>unclosed <i", ["unclosed <i"]),
        ("", []),
    ],
)
def test_parser(source, wanted):
    page = dom.parse(source)
    assert [t for tag, t in zip(page.tag, page.text, strict=True) if tag == "#"] == wanted


def test_op5_on_tables(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html_text.op5_html_text(spark, sf_dir).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, "u", None, "t"), (2, "u", "", "t"), (2, "u", "<p>" * 3000 + "deep", "t"), (None, None, "&" * 50_000, "t")], "page_id long, url string, html string, text string")
    got = html_text.main_text(odd).collect()
    assert len(got) == 4
    assert [r.text for r in got][:2] == ["", ""]
    assert html_text.main_text(odd.limit(0)).count() == 0


# ---- chat (6) ----------------------------------------------------------------------------------


def test_template_is_reversible():
    r = random.Random(2)
    pieces = ["\\", "[INST]", "[/INST]", "</s>", "<s>", "\n", "a", "[", "\\n", "<<SYS>>", "<</SYS>>"]
    for _ in range(2000):
        turns = [(r.choice(["user", "assistant", "a\nb\\n", "<s>[INST]", ""]), "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))) for _ in range(r.randint(1, 4))]
        out, mask = chat.formatted(turns)
        assert chat.parsed(out) == turns
        assert "".join(chat.unescaped(out[a:b]) for a, b in mask) == "".join(t for role, t in turns if role == "assistant")


def test_op6_on_tables(spark, sf_dir):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in chat.op6_chat_formatting(spark, sf_dir).collect()}
    assert set(got) == set(turns)
    for k, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        assert got[k].n_turns == len(t)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "a", 0.5), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "c", 2.0), (1, 4, 2, "user", "d", 0.0), (1, 5, 9, "user", "lost", 9.0), (2, 1, None, None, None, None), (3, 1, 2, "u", "circle", 1.0), (3, 2, 1, "u", "circle", 1.0), (3, 3, 2, "u", "below", 1.0)]
    rows += [(4, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    found = sorted(tuple(r) for r in chat.paths(df).collect())
    assert [r for r in found if r[0] < 4] == [(1, 3, 0, 1), (1, 3, 1, 3), (1, 4, 0, 1), (1, 4, 1, 2), (1, 4, 2, 4), (2, 1, 0, 1)]
    assert [r[3] for r in found if r[0] == 4] == list(range(70))
    assert {(r.tree, r.leaf) for r in chat.conversations(df).collect()} == {(1, 3), (2, 1), (4, 69)}
    assert {(r.tree, r.leaf, r["rank"]) for r in chat.conversations(df, 2).collect()} == {(1, 3, 1), (1, 4, 2), (2, 1, 1), (4, 69, 1)}
    assert chat.paths(df.limit(0)).count() == 0


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "user", "gone"), (2, 5, "assistant", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'t' as tree", "1 as node")
    got = {r.conv_id: r.n_turns for r in chat.read_back(chat.format_paths(chat.conversations(chat.reply_trees(df)))).collect()}
    assert got == {1: 3, 2: 1}


def test_intermediate_tables_go(spark):
    from tessera.llm import shared

    shared.remove_written(spark)
    df = shared.written(spark.range(3).toDF("x"), "three")
    assert df.count() == 3
    assert shared.fits(df, 8, 24)
    assert not shared.fits(df, 8, 16)
    assert shared.remove_written(spark) == 1
    assert shared.remove_written(spark) == 0


# ---- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "byte_pairs"]
    kept = {n: None for n in names}
    for n, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        kept[n] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[n] <= set(before)
        if n == "near_duplicates":
            classes = classes_by_force([(k, fingerprint_by_force(t)) for k, t in before.items()], 2)
            assert kept[n] == set(classes.values())
        if n == "quality_rules":
            judged = {r.doc_id for r in rules.op10_quality_rules(spark, sf_dir).filter("kept").collect()}
            assert kept[n] == judged
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in last} == kept["decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == kept["decontamination"]
