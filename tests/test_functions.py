"""Literal cases of text functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import enrich, similarity, text, vectors


def value(spark, column, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return row.select(column(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (text.clean, "08:30 - 09:00 Daily Standup <b>cùng</b> nhóm&nbsp;dự án\r\nTiếp theo\t\t", "08:30 - 09:00 Daily Standup cùng nhóm dự án\nTiếp theo"),
        (text.remove_html, "a &amp;lt;b&amp;gt; &#7845; x", "a <b> ấ x"),
        (text.punctuation, "Hello ,world .Next\nline: ok [x]", "Hello, world. Next\nline: ok x"),
        (text.clean, "<script>var t=1;</script>hi", "var t=1; hi"),
        (text.normalize_numbers, "01/06/2026 1,234,567 1.2.26", "01-06-2026 1234567 1-2-26"),
        (lambda c: text.normalize(c, unicode=False), "08:30 , pi 3.14 ok !yes", "08: 30, pi 3. 14 ok! yes"),
        (text.clean, None, ""),
        (text.clean, "", ""),
        (text.clean, " \t\n ", ""),
        (text.nfc, "á", "á"),
        (text.character_references, "x&#65;&#0;&#99999999999;y&#;", "xA��y&#;"),
        (text.clean_mail_text, "﻿A\r\n-----\r\n\r\n\r\n\r\n  b &amp; c  \x00", "A\n\nb c"),
        (text.clean_subject, " a&amp;b \n c ", "a b c"),
        (text.extension, "A.B.PDF", ".pdf"),
        (text.extension, ".profile", ""),
        (text.clean_filename, " Report.PDF\x01 ", "Report.pdf"),
        (text.normalize_filename, "my  report (1).txt", "my_report_1.txt"),
        (text.file_category, "x.XLSX", "spreadsheet"),
        (text.media_type, "x.unknown", "application/octet-stream"),
        (text.safe_filename, "a b/ü.txt", "a_b_ü.txt"),
        (text.clean_date, "Tue, 30 Jun 2026 11:42:32 +0700", "2026-06-30T11:42:32+07:00"),
        (text.clean_date, "Tue, 30 Jun 2026 11:42:32 GMT", "2026-06-30T11:42:32+00:00"),
        (text.clean_date, "yesterday", "yesterday"),
        (text.clean_date, "", None),
        (enrich.language, "short", "unknown"),
        (enrich.language, "được những ngày này", "vi"),
        (enrich.language, "plain english words", "en"),
    ],
)
def test_text(spark, function, given, wanted):
    assert value(spark, function, given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ('"Ann B" <Ann@X.org>', ("Ann B", "ann@x.org")),
        ("Ann (ann@x.org)", ("Ann ", "ann@x.org")),
        ("nobody", ("nobody", "")),
        (None, ("", "")),
    ],
)
def test_sender(spark, given, wanted):
    found = value(spark, text.clean_sender, given)
    assert (found.name.strip(), found.email) == (wanted[0].strip(), wanted[1])


def test_entities_with_a_group_report_it(spark):
    assert value(spark, lambda c: enrich.entities(c, "phone"), "call +84 912 345 678 or 0912345678") == ["09", "84 "]
    assert value(spark, lambda c: enrich.entities(c, "currency"), "cost $ 5.50 US$7") == ["$7"]


def test_versions_and_files(spark):
    assert value(spark, enrich.versions, "v1.2.3 pi 3.14 2.0-rc1") == ["version:2.0-rc1", "version:3.14", "version:v1.2.3"]
    assert value(spark, enrich.file_references, "see a-b.py and x.md") == ["file_type:md", "file_type:py"]


def test_ranked_orders_by_count_then_first_place(spark):
    found = value(spark, lambda c: enrich.ranked(enrich.words(c)), "b a a c b d")
    assert [(r.word, r["count"]) for r in found] == [("b", 2), ("a", 2), ("c", 1), ("d", 1)]
    assert value(spark, lambda c: enrich.ranked(enrich.words(c)), "") == []
    assert value(spark, lambda c: enrich.ranked(enrich.words(c)), None) == []


def test_projects_and_topics(spark):
    assert value(spark, enrich.projects, "The Data Platform uses Docker") == ["Docker", "The Data Platform"]
    assert value(spark, enrich.topics, "Invoice for the budget") == ["business", "finance"]
    assert value(spark, lambda c, n: enrich.concepts(c, n)["traits"], "Docker v1.0", "x") == ["Docker", "technology", "version:v1.0"]


def test_dates_sorted(spark):
    assert value(spark, enrich.dates, "on 2026-01-02 and 1/2/26 in May, Ngày 3/4/2026") == ["1/2/26", "2026-01-02", "3/4/2026", "May", "Ngày 3/4/2026"]


def test_readability(spark):
    assert tuple(value(spark, enrich.readability, "One two. Three!")) == (2, 1.5, 3.67)
    assert tuple(value(spark, enrich.readability, None)) == (0, 0.0, 0.0)


def test_raw_text_warnings(spark):
    assert value(spark, lambda c: enrich.raw_text_validation(c)["warnings"], "a!!!!") == ["short", "symbols"]
    assert value(spark, lambda c: enrich.raw_text_validation(c)["valid"], " ") is False


def test_similarity(spark):
    assert value(spark, similarity.text_similarity, "one two three four five six seven", "one two three four five six eight") == pytest.approx(2 / 4)
    assert value(spark, lambda a, b: similarity.jaccard(similarity.token_set(a), similarity.token_set(b)), "a b c d", "a b c e") == pytest.approx(0.6)
    assert value(spark, similarity.text_similarity, "few words", "few words") == 0.0


def test_scores(spark):
    score = lambda r, s: enrich.response_scores(r, F.array(s), F.array(s))
    found = value(spark, score, "the sky is not blue", "the sky is not blue")
    assert found.attribution == 0.0
    assert found.entity_grounding == 0.0
    assert found.contradiction == pytest.approx(0.6)
    assert found.overall == pytest.approx(0.18)
    assert value(spark, lambda r: enrich.attribution_score(r, F.array().cast("array<string>")), "x") == 1.0


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    assert row.select(vectors.cosine(F.col("a"), F.col("b")).alias("v")).first().v == pytest.approx(0.96)
    v = value(spark, lambda c: vectors.hashed(c, 8), "one two two")
    assert sum(x * x for x in v) == pytest.approx(1.0)
    assert value(spark, lambda c: vectors.hashed(c, 8), "") is None


def test_metadata_validation(spark):
    df = spark.createDataFrame([("", None, "x", [("1", "", 0)])], "id string, subject string, sender string, a array<struct<id:string,filename:string,size:bigint>>")
    v = df.select(enrich.metadata_validation(F.col("id"), F.col("subject"), F.col("sender"), F.col("a")).alias("v")).first().v
    assert not v.valid
    assert v.errors == ["email_id is empty", "attachment 1: filename is empty"]
    assert v.warnings == ["subject is empty", "attachment 1: size is 0 or negative"]


@pytest.mark.parametrize(
    "given",
    ["2026-06-30T11:42:32Z", "2026-06-30T11:42:32+0000", "2026-06-30T11:42:32.000000+0000", "2026-06-30T11:42:32", "Tue, 30 Jun 2026 11:42:32 +0000"],
)
def test_parse_time(spark, given):
    assert str(value(spark, text.parse_time, given)) == "2026-06-30 11:42:32"


def test_parse_time_of_nothing(spark):
    assert value(spark, text.parse_time, "soon") is None


def test_members_of_equal_sets(spark):
    from tessera.operators import dedup

    rows = [(1, "A b c d e f"), (2, "a B c d e, f!"), (3, "a b c d e g"), (4, None), (5, "few"), (6, "A b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_key for r in dedup.set_members(df, "doc_id", similarity.shingles, "text").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1}


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Ann <a@x.org>, B <b@y.org>", ["Ann <a@x.org>", "B <b@y.org>"]),
        ('"Doe, Jane" <jane@x.org>,bob@y.org , ', ['"Doe, Jane" <jane@x.org>', "bob@y.org"]),
        ("only a name", ["only a name"]),
        ('a "quote never ends, b@x.org', ['a "quote never ends', "b@x.org"]),
        ("", []),
        (None, []),
    ],
)
def test_addresses(spark, given, wanted):
    assert value(spark, text.addresses, given) == wanted


@pytest.mark.parametrize("given", ["plain", "", 'quote " and \\ back', "tab\t line\n return\r bell\x07 del\x7f", "ünï ấ 日本 \U0001f600 \u2028", "\b\f/", None])
def test_canonical_json(spark, given):
    found = value(spark, lambda c: text.canonical_json({"z": c, "a": F.lit("x"), "n": F.lit(7)}, numbers=("n",)), given)
    assert found == json.dumps({"z": given, "a": "x", "n": 7}, sort_keys=True)


def test_similar_pairs_of_common_elements(spark, monkeypatch):
    """Every set has the same common elements; the order by frequency finds the same pairs."""
    from tessera.operators import dedup

    r = random.Random(1)
    rows = [(i, " ".join([*(f"common{j}" for j in range(8)), *(f"w{r.randint(0, 30)}" for _ in range(12))])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, t string")
    pairs = lambda: sorted((x.a, x.b, round(x.similarity, 6)) for x in dedup.similar_pairs(df, "id", similarity.token_hashes, "t", 0.6).collect())
    first = pairs()
    monkeypatch.setattr(dedup, "COMMON", 5)
    assert pairs() == first
    sets = {i: frozenset(t.split()) for i, t in rows}
    least = {}
    for i, s in sets.items():
        least.setdefault(s, i)
    keys = sorted(least.values())
    want = [(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in keys for b in keys if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.6]
    assert first == want
    assert len(want) > 5


def test_vectors_of_models(spark):
    made = value(spark, lambda c: vectors.sound(F.from_json(c, "array<double>"), 2), "[3, 4]")
    assert [round(x, 9) for x in made] == [0.6, 0.8]
    for broken in ("[3, 4, 5]", "[0, 0]", "[null, 1]", "nothing"):
        assert value(spark, lambda c: vectors.sound(F.from_json(c, "array<double>"), 2), broken) is None


def test_hashed_counts_words(spark):
    rng = random.Random(5)
    said = [rng.choice("abcdefgh") for _ in range(400)]
    slots = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(16))).first()[0] for w in set(said)}
    want = [0.0] * 16
    for w in said:
        want[slots[w]] += 1
    length = sum(x * x for x in want) ** 0.5
    assert value(spark, lambda c: vectors.hashed(c, 16), " ".join(said)) == pytest.approx([x / length for x in want])


def test_projects(spark):
    from tessera.functions import enrich

    said = "Our Data Platform and the Blue Sky Project run on Docker; see Nền tảng. Release Alpha 12 Project uses RAG."
    assert value(spark, enrich.projects, said) == sorted({"Our Data Platform", "Blue Sky Project", "Docker", "Alpha 12 Project", "RAG"})
    assert value(spark, enrich.projects, None) == []


def test_concepts_search_a_text_once(spark):
    """Projects were searched nine times over, and for traits, keywords and projects each time anew."""
    plan = spark.createDataFrame([("a", "b")], "t string, n string").select(enrich.concepts(F.col("t"), F.col("n")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("|Kubernetes)") == 1
    text = "Data Flow Project and Foo 12 Projects, Foo 3 Platform; Red  Green System"
    assert value(spark, enrich.projects, text) == ["Data Flow Project", "Foo 12", "Foo 3 Platform", "Red  Green System"]
    ranked = value(spark, lambda c: enrich.ranked(F.split(c, " ")), "b a b c a d")
    assert [(r["word"], r["count"], r["first"]) for r in ranked] == [("b", 2, 0), ("a", 2, 1), ("c", 1, 3), ("d", 1, 5)]
    assert value(spark, lambda c: enrich.ranked(F.filter(F.split(c, " "), lambda w: w == "z")), "b") == []


def test_mail_texts_are_cleaned_once_a_row(spark, sf_dir):
    """What cleaning makes is used four times and made once."""
    from tessera.catalogue.registry import QUERIES

    plan = QUERIES["mail_text_pipeline"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{3,}$") == 1


def test_sets_of_members_are_made_once(spark):
    """No text is read again where rows meet the first of their class; the least key names it."""
    from tessera.functions import similarity
    from tessera.operators import dedup

    df = spark.createDataFrame([(3, "a b c d e f"), (2, "A b c d e f"), (5, "a b"), (4, None), (1, "f e d c b a")], "id long, text string")
    found = dedup.set_members(df, "id", similarity.shingle_hashes, "text")
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 5)]
