"""Quality rules by cross-document line frequency (operator 10), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared

#: What separates words.
BLANKS = r"[\x20\x09-\x0D]+"
#: A line is removed where more than MIN_DOCUMENTS documents of its host and more than LINE_PERCENT
#: per cent of them have it; a document goes where over DEPLETED_PERCENT per cent of its words did.
MIN_DOCUMENTS, LINE_PERCENT, DEPLETED_PERCENT = 50, 2, 80
#: Bytes of frequent lines, and frequent lines of one host, up to which they are broadcast as a list for each
#: host; and keys over which a hot one is spread where they are joined.
SENT_BYTES, LISTED, SALTS = 8 << 20, 4096, 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null and empty texts have no words: all counts are 0 and base_failed is true.
    """
    t = F.coalesce(F.col(shared.quoted(text)), F.lit(""))
    out = docs.withColumns({"__text": t, "__words": words_of(t)})
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("__words")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumns({"__lines": lines, "__windows": hashes})
    windows = F.col("__windows")
    # Only texts with a repeated window are sorted by window; there equal windows are neighbours.
    ordered = F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("__ordered", ordered)
    pairs = F.filter(F.arrays_zip(F.col("__ordered").alias("a"), F.slice("__ordered", 2, F.greatest(F.size("__ordered"), F.lit(0))).alias("b")), lambda x: x["a"]["h"] == x["b"]["h"])
    starts = F.array_distinct(F.flatten(F.transform(pairs, lambda x: F.array(x["a"]["i"], x["b"]["i"]))))
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    symbols = "#*$%&|<>"
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("__text") - F.length(F.translate("__text", symbols, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.greatest(F.coalesce(covered, F.lit(0)), F.lit(0)).cast("long"),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__text", "__words", "__lines", "__windows", "__ordered")


def normal_lines(text: Column) -> Column:
    """The lines of a text that have a word, as structs of a hash (of the line in lower case, its blanks
    as one space) and the number of words."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), BLANKS, " "))), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w")))


def _texts(docs: DataFrame, text: str, host: str) -> DataFrame:
    """Host, text hash and distinct line hashes of each distinct text of a host: exact copies are one
    document, here before anything is shuffled or counted."""
    t = F.coalesce(F.col(shared.quoted(text)), F.lit(""))
    rows = docs.select(F.col(shared.quoted(host)).alias("host"), F.xxhash64(t).alias("of"), F.array_distinct(F.transform(normal_lines(t), lambda x: x["h"])).alias("hs"))
    return rows.groupBy("host", "of").agg(F.first("hs").alias("hs"))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", min_documents: int = MIN_DOCUMENTS, percent: int = LINE_PERCENT) -> DataFrame:
    """host and h: the lines that more than ``min_documents`` distinct documents of a host have, and more
    than ``percent`` per cent of them. Written: what else is made of it reads no document again.

    Counts are summed in tasks before they are shuffled, so the commonest line is a row a task. A
    document counts itself under a null hash, which gives the documents of each host in the same pass.
    """
    each = _texts(docs, text, host).select("host", F.explode(F.concat("hs", F.array(F.lit(None).cast("long")))).alias("h"))
    counts = each.groupBy("host", "h").agg(F.count("*").alias("n")).filter((F.col("n") > min_documents) | F.col("h").isNull())
    counts = shared.written(counts, "lines")
    hosts = counts.filter("h is null").select(F.col("host").alias("on"), F.col("n").alias("all"))
    often = counts.filter("h is not null")
    often = often.join(hosts, often["host"].eqNullSafe(hosts["on"])).filter(F.col("n") * 100 > F.col("all") * percent)
    return shared.written(often.select("host", "h"), "frequent")


def _marked(rows: DataFrame, often: DataFrame, sent_bytes: int) -> DataFrame:
    """``rows`` (with __host, __t and __salt) and the array __bad of frequent lines: all of the host where they
    are few enough to be broadcast (counted first), else those of the text (null: none).

    Beyond that the lines of distinct texts are joined; lines and texts that are in very many rows are
    spread over SALTS keys.
    """
    if shared.fits(often, 24, sent_bytes) and often.groupBy("host").count().filter(F.col("count") > LISTED).isEmpty():
        lists = often.groupBy(F.col("host").alias("__on")).agg(F.sort_array(F.collect_list("h")).alias("__bad"))
        return rows.join(F.broadcast(lists), rows["__host"].eqNullSafe(lists["__on"]), "left").drop("__on")
    texts = _texts(rows, "__t", "__host")
    lines = texts.select(F.col("host").alias("__on"), "of", F.pmod("of", F.lit(SALTS)).alias("s"), F.explode("hs").alias("__h"))
    salted = often.withColumn("salt", shared.salts(SALTS))
    hit = lines.join(salted, lines["__on"].eqNullSafe(salted["host"]) & (lines["__h"] == salted["h"]) & (lines["s"] == salted["salt"]))
    bad = hit.groupBy("__on", F.col("of").alias("__of")).agg(F.sort_array(F.collect_list("h")).alias("__bad"))
    bad = bad.withColumn("__s", shared.salts(SALTS))
    on = rows["__host"].eqNullSafe(bad["__on"]) & (F.xxhash64(rows["__t"]) == bad["__of"]) & (rows["__salt"] == bad["__s"])
    return rows.join(bad, on, "left").drop("__on", "__of", "__s")


def _lost(text: str, bad: str) -> Column:
    """Words of the lines of ``text`` that are ``bad``."""
    lines = normal_lines(F.col(shared.quoted(text)))
    hit = F.filter(lines, lambda x: F.array_contains(bad, x["h"]))
    return F.when(F.col(bad).isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(hit, F.lit(0).cast("long"), lambda a, x: a + x["w"]))


def _verdicts(docs: DataFrame, keep: Column, text: str, host: str, key: str, min_documents: int, line_percent: int, depleted_percent: int, sent_bytes: int) -> DataFrame:
    """``keep``, __t, __bad and the base statistics of every row, and whether the rules keep it."""
    often = frequent_lines(docs, text, host, min_documents, line_percent)
    rows = docs.select(keep, F.coalesce(F.col(shared.quoted(text)), F.lit("")).alias("__t"), F.col(shared.quoted(host)).alias("__host"), F.pmod(F.xxhash64(F.col(shared.quoted(key))), F.lit(SALTS)).alias("__salt"))
    rows = _marked(rows, often, sent_bytes).withColumn("__lost", _lost("__t", "__bad"))
    stats = base_statistics(rows, "__t")
    return stats.withColumn("__kept", ~F.col("base_failed") & (F.col("__lost") * 100 <= F.col("n_words") * depleted_percent))


def judged(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", min_documents: int = MIN_DOCUMENTS, line_percent: int = LINE_PERCENT, depleted_percent: int = DEPLETED_PERCENT, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Statistics and verdict of every row of ``docs``: key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and n_lost_words, those of lines above the limits.

    Null and empty texts fail the base rules. Repeated rows each keep their row, and count as one
    document in line frequencies. Rows of a null host form a host. Extra columns are ignored.
    """
    found = _verdicts(docs, F.col(shared.quoted(key)).alias("__key"), text, host, key, min_documents, line_percent, depleted_percent, sent_bytes)
    # As in :func:`accepted`: a filter on the verdict would else be pushed below the statistics and repeat them for each word.
    found = found.withColumn("__at", F.monotonically_increasing_id())
    kept = (F.col("__kept") & (F.col("__at") >= 0)).alias("kept")
    return found.select(F.col("__key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept, F.col("__lost").alias("n_lost_words"))


def without_lines(text: str, bad: str) -> Column:
    """``text`` without the lines whose hashes are in the array ``bad``; other lines stay as they are."""
    h = lambda x: F.xxhash64(F.trim(F.regexp_replace(F.lower(x), BLANKS, " ")))
    return F.when(F.col(bad).isNull(), F.col(shared.quoted(text))).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(bad, h(x))), "\n"))


def accepted(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", length: str | None = None, min_documents: int = MIN_DOCUMENTS, line_percent: int = LINE_PERCENT, depleted_percent: int = DEPLETED_PERCENT, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, their texts without the lines above the limits.

    All other columns, whatever their names, are as they were, but for ``length``, which is set to the
    code points of the text that stays. Null and empty texts go; repeated rows stay, both of them.
    """
    row = F.struct(*[F.col(shared.quoted(c)) for c in docs.columns if c != text]).alias("__row")
    found = _verdicts(docs, row, text, host, key, min_documents, line_percent, depleted_percent, sent_bytes)
    # Catalyst would push a plain filter below the steps of the statistics and repeat them in it, once
    # for each word; past an id that isn't deterministic it pushes none.
    found = found.withColumn("__at", F.monotonically_increasing_id()).filter(F.col("__kept") & (F.col("__at") >= 0))
    found = found.withColumn("__t", without_lines("__t", "__bad"))
    column = lambda c: F.col("__t") if c == text else F.length("__t").cast(docs.schema[c].dataType) if c == length else F.col("__row").getField(c)
    return found.select(*[column(c).alias(c) for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; see :func:`judged`."""
    return judged(shared.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def oracle(min_documents: int = MIN_DOCUMENTS, line_percent: int = LINE_PERCENT, depleted_percent: int = DEPLETED_PERCENT) -> str:
    """The same rules as SQL: lines are compared as text, documents of a host are its distinct texts."""
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM docs),
windows AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
            FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)),
twice AS (SELECT rid, win FROM windows GROUP BY rid, win HAVING count(*) > 1),
covered AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + o AS p FROM windows JOIN twice USING (rid, win), (VALUES (0), (1), (2)) t(o)) GROUP BY rid),
raw_lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
lines AS (SELECT rid, source, text, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM raw_lines JOIN docs USING (rid)),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM docs GROUP BY source),
often AS (SELECT l.source, l.line FROM (SELECT source, line, count(DISTINCT text) AS n FROM lines WHERE line <> '' GROUP BY source, line) l
          JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE l.n > {min_documents} AND l.n * 100 > h.n * {line_percent}),
lost AS (SELECT rid, sum(len(string_split(l.line, ' ')))::BIGINT AS n FROM lines l JOIN often o ON l.line = o.line AND l.source IS NOT DISTINCT FROM o.source GROUP BY rid),
stats AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                 (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
                 coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost_words
          FROM docs JOIN words USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_lost_words * 100 <= n_words * {depleted_percent} AS kept, n_lost_words
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
"""


ORACLE = oracle()
