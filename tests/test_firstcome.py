"""First-come selection against the loop it stands for."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import firstcome


def shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def by_loop(records, attachments):
    """Removed records and duplicate attachments, one after the other, compared with what stayed."""
    ids, hashes, texts, removed, dups = set(), {}, [], {}, {}
    for r, email in sorted(records):
        if email and email in ids:
            removed[r] = "duplicate_email_id"
            continue
        own = sorted(a for a in attachments if a[1] == r)
        for seq, _, h, t in own:
            if h and h in hashes:
                dups[seq] = ("duplicate_content_exact_hash", hashes[h], 1.0)
                continue
            if t and len(t) > 50:
                s = shingles(t)
                near = next(((k, len(s & o) / len(s | o)) for k, o in texts if s and o and len(s & o) / len(s | o) > 0.9), None)
                if near:
                    dups[seq] = ("duplicate_text_similarity", near[0], round(near[1], 6))
                    continue
                texts.append((seq, s))
            if h:
                hashes[h] = seq
        if own and all(a[0] in dups for a in own):
            removed[r] = "all_attachments_are_duplicates"
            continue
        ids.add(email)
    return removed, dups


def sample(seed, n=150):
    r = random.Random(seed)
    stems = [[f"w{r.randint(0, 999)}" for _ in range(140)] for _ in range(5)]
    texts = []
    for _ in range(n):
        w = list(r.choice(stems))
        at = r.randint(0, 20)
        for k in range(r.choice([0, 0, 1, 1, 2])):  # chains: similar to neighbours, not to their neighbours
            w[min(139, at + 30 * k)] = f"v{r.randint(0, 30)}"
        texts.append(r.choice([" ".join(w), " ".join(w), " ".join(w[at // 4 :]), "short text", None, "", "one two three " * 20, ", . ; " * 20]))
    attachments = [(i, r.randint(0, n // 2), r.choice(["", None, f"h{r.randint(0, n)}"]), t) for i, t in enumerate(texts)]
    # attachments follow the order of their records
    attachments = [(i, *a[1:]) for i, a in enumerate(sorted(attachments, key=lambda a: a[1]))]
    records = [(k, r.choice([None, "", f"m{r.randint(0, n // 4)}"])) for k in range(n // 2 + 3)]
    return records, attachments


@pytest.mark.parametrize("seed, crowded", [(1, 500), (2, 500), (3, 4), (4, 2)])
def test_equals_the_loop(spark, monkeypatch, seed, crowded):
    monkeypatch.setattr(firstcome, "CROWDED", crowded)
    monkeypatch.setattr(firstcome, "AT_ONCE", 3)
    records, attachments = sample(seed)
    rec = spark.createDataFrame(records, "seq long, email_id string")
    att = spark.createDataFrame(attachments, "seq long, record_seq long, content_hash string, cleaned_text string")
    gone, dups = firstcome.deduplicated_records(rec, att)
    want_gone, want_dups = by_loop(records, attachments)
    assert {r.seq: r.reason for r in gone.collect()} == want_gone
    assert {r.seq: (r.reason, r.similar_to, round(r.similarity, 6)) for r in dups.collect()} == want_dups
    assert {"duplicate_content_exact_hash", "duplicate_text_similarity"} == {d[0] for d in want_dups.values()}
    assert {"duplicate_email_id", "all_attachments_are_duplicates"} == set(want_gone.values())


def test_chain_keeps_its_third(spark):
    base = [f"w{i}" for i in range(150)]
    second, third = list(base), list(base)
    second[20] = third[20] = "x"
    third[60] = "y"
    rows = [(1, None, " ".join(base)), (2, None, " ".join(second)), (3, None, " ".join(third))]
    att = spark.createDataFrame(rows, "seq long, content_hash string, cleaned_text string")
    found = {r.seq: r.stays for r in firstcome.attachment_selection(att, 0.92).run().collect()}
    assert found == {1: True, 2: False, 3: True}


def test_large_cluster_of_variants(spark):
    """Every one of 20,000 variants is similar to the first; pairs follow those that stay, not the square."""
    base = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.when(i == F.col("seq") % 200, F.concat(F.lit("v"), F.col("seq"))).otherwise(F.concat(F.lit("w"), i)))
    att = spark.range(20_000).withColumnRenamed("id", "seq").select("seq", F.lit("").alias("content_hash"), F.array_join(base, " ").alias("cleaned_text"))
    picked = firstcome.attachment_selection(att, 0.9)
    out = picked.run()
    stay = out.filter("stays").count()
    assert stay < 50
    assert out.count() == 20_000
    assert sum(links.count() for links in picked.links) < 2_000_000
    assert len(picked.rounds) < 20


def test_parities_rule_out_only_what_is_not_similar(spark):
    """Every pair that shared a prefix element met the whole sets; now only pairs that the bound leaves."""
    import random

    from tessera.operators import dedup

    r = random.Random(3)
    base = [r.getrandbits(63) - (1 << 62) for _ in range(300)]
    sets = []
    for i in range(60):
        gone = r.choice([0, 2, 5, 12, 20, 40, 150])
        sets.append((i, sorted([*base[gone:], *(r.getrandbits(63) for _ in range(r.choice([0, gone])))])))
    df = dedup.with_parities(spark.createDataFrame(sets, "key long, set array<long>").withColumn("n", F.size("set")))
    both = df.alias("a").join(df.alias("b"), F.col("a.key") < F.col("b.key")).select(F.col("a.key").alias("x"), F.col("b.key").alias("y"), dedup.may_be_similar("a", "b", 0.9).alias("maybe")).collect()
    of = {k: set(s) for k, s in sets}
    share = lambda x, y: len(of[x] & of[y]) / len(of[x] | of[y])
    assert all(p.maybe for p in both if share(p.x, p.y) >= 0.9)
    far = [p for p in both if share(p.x, p.y) < 0.6]
    assert far and not any(p.maybe for p in far)
