"""Text operators on documents, pages and conversations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.catalogue.registry import query, sql_list
from tessera.functions import enrich, fixed, text
from tessera.operators import chunk, dedup, schedule

WORD = r"[\p{L}\p{N}\p{M}_]"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: White space of any kind, as RE2 writes it.
_SPACE = r"[\t-\r\x{85}\p{Z}]"


def _all(c: str, *pairs: tuple[str, str]) -> str:
    """Replacements one after the other, as SQL."""
    for pattern, by in pairs:
        c = f"regexp_replace({c}, '{pattern}', {by if by.startswith(chr(99) + 'hr(') else chr(39) + by + chr(39)}, 'g')"
    return c


def _strip(c: str) -> str:
    return _all(c, (f"^{_SPACE}+|{_SPACE}+$", ""))


def _punctuation(c: str, signs: str) -> str:
    """One space behind signs and none before: RE2 looks neither ahead nor behind, so signs that a digit
    touches are hidden first, and the one blank that stays next to a digit is fenced off."""
    hidden = [(s, chr(0xE000 + i)) for i, s in enumerate(signs)]
    for s, h in hidden:
        c = _all(c, (f"([0-9])[{s}]", f"\\1{h}"), (f"[{s}]([0-9])", f"{h}\\1"))
    some = f"([{signs}])"
    c = _all(c, (f"([0-9]{_SPACE}){_SPACE}*{some}", "\\1\uE100\\2"), (f"{_SPACE}+{some}", "\\1"), (some, "\\1\uE101"))
    c = _all(c, (f"\uE101{_SPACE}*({_SPACE}[0-9])", " \\1"), (f"\uE101{_SPACE}*", " "), ("\uE100", ""))
    for s, h in hidden:
        c = _all(c, (h, s))
    return c


def _clean(c: str) -> str:
    """Entity-table cleaning of a text without numeric references."""
    c = _all(c, ("<[^>]+>", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&[a-zA-Z]+;", " "))
    c = _all(f"nfc_normalize({c})", ("\\r\\n", "chr(10)"), ("\\r", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), (_CONTROL, ""), (r"[{}\[\]]", ""))
    c = _punctuation(_punctuation(c, ".,!?;"), ":")
    return _strip(_all(c, ("[ \\t]+", " "), ("\\n ", "chr(10)"), (" \\n", "chr(10)")))


def _clean_mail(c: str) -> str:
    marks = "[\uFEFF\u200B\u200C\u200D]"
    c = _all(c, (marks, ""), ("\\r\\n", "chr(10)"), ("\\r", "chr(10)"), (_CONTROL, ""), ("&[#a-zA-Z0-9]+;", " "), ("\\n{3,}", "chr(10) || chr(10)"))
    lines = f"list_transform(string_split({c}, chr(10)), lambda x: {_all(_strip('x'), ('[ \\t]+', ' '))})"
    return _strip(f"array_to_string(list_filter({lines}, lambda x: NOT regexp_matches(x, '^[\\t-\\r\\x{{85}}\\p{{Z}}\\-_=*#]{{3,}}$')), chr(10))")


def _numbers(c: str) -> str:
    """Dates with dashes; commas before three digits go: two rounds over fenced digits find all."""
    c = _all(c, ("([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{2,4})", "\\1-\\2-\\3"))
    return _all(c, *[("([0-9]),([0-9]{3})", "\\1\uE102\\2")] * 2, ("\uE102", ""))


def _normal(c: str) -> str:
    c = f"translate(translate(nfc_normalize({c}), '０１２３４５６７８９', '0123456789'), '–—‘’“”•‣◦⁃', '--''''\"\"****')"
    return _strip(_all(c, (f"{_SPACE}+([.,;:!?])", "\\1"), ("([.,;:!?])([A-Za-z0-9À-ɏ])", "\\1 \\2"), ("[ \\t]+", " ")))


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '{_CONTROL}', '', 'g'), '[ \t]+', ' ', 'g'), '\n ', chr(10), 'g'), ' \n', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS cleaned FROM documents""")
def text_control_newline_clean(t):
    c = text.whitespace(text.without_controls(text.newlines(text.filled(F.col("text")))))
    return t("documents").select("doc_id", F.md5(c).alias("cleaned"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&[a-zA-Z]+;', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n ', chr(10), 'g'), ' \n', chr(10), 'g'))) AS stripped FROM pages""")
def html_strip_basic(t):
    return t("pages").select("page_id", F.md5(text.whitespace(text.remove_html(F.col("html"), numeric=False))).alias("stripped"))


@query(f"""SELECT page_id, sha256(c) AS digest, length(html) AS original_length, length(c) AS cleaned_length, length(html) - length(c) AS chars_removed, round((length(html) - length(c)) / greatest(length(html), 1) * 100, 2) AS reduction_pct
FROM (SELECT page_id, html, {_clean("html")} AS c FROM pages)""", longs=("original_length", "cleaned_length", "chars_removed"))
def clean_pages(t):
    c = text.clean(F.col("html"))
    return t("pages").select("page_id", F.sha2(c, 256).alias("digest"), text.clean_statistics(F.col("html"), c).alias("s")).select("page_id", "digest", "s.*")


@query(rf"""SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0 AS valid, length(text) AS length, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count,
round(length(regexp_replace(text, '[\x00-\x7f]', '', 'g')) / greatest(length(text), 1), 4) AS non_ascii_ratio, len(regexp_extract_all(text, '{WORD}+')) AS word_count,
length(regexp_replace(text, '[\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g')) AS symbol_count FROM documents""", longs=("length", "line_count", "word_count", "symbol_count"))
def raw_text_validation(t):
    return t("documents").select("doc_id", enrich.raw_text_validation(F.col("text")).alias("v")).select("doc_id", "v.valid", "v.length", "v.line_count", "v.non_ascii_ratio", "v.word_count", "v.symbol_count")


@query(rf"""WITH docs AS (SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '{WORD}+'), 1) AS i FROM docs WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20),
c AS (SELECT doc_id, word, count(*) AS n, min(i) AS first FROM w WHERE length(word) >= 3 AND word NOT IN ({sql_list(fixed.KEYWORD_STOP_WORDS)}) AND NOT regexp_matches(word, '^\d+$') GROUP BY doc_id, word)
SELECT doc_id, word, n AS "count", r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM c) WHERE r <= 10""")
def text_keywords_topn(t):
    docs = dedup.first_by(t("documents").select("doc_id", "text").withColumn("checksum", F.sha2("text", 256)), ["checksum"], "doc_id")
    top = F.slice(enrich.ranked(enrich.keyword_tokens(F.col("text"))), 1, 10)
    return docs.select("doc_id", F.posexplode(top).alias("p", "k")).select("doc_id", "k.word", F.col("k.count").cast("long").alias("count"), (F.col("p") + 1).cast("long").alias("rank"))


@query(rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '{WORD}+'), 1) AS i FROM documents),
c AS (SELECT doc_id, word, count(*) AS n, min(i) AS first FROM w WHERE length(word) > 2 AND word NOT IN ({sql_list(dict.fromkeys(fixed.CONCEPT_STOP_WORDS))}) GROUP BY doc_id, word)
SELECT doc_id, word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM c) WHERE r <= 20 AND n >= 2""")
def concept_keywords(t):
    return t("documents").select("doc_id", F.explode(enrich.concept_keywords(F.col("text"))).alias("word"))


def _topic_sql() -> str:
    cases = []
    for topic in sorted(fixed.TOPICS):
        hits = " OR ".join(f"contains(l, '{w.lower()}')" for w in fixed.TOPICS[topic])
        cases.append(f"CASE WHEN {hits} THEN '{topic}' END")
    return f"SELECT doc_id, array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), ',') AS topics FROM (SELECT doc_id, lower(text) AS l FROM documents)"


@query(_topic_sql())
def topic_tags(t):
    return t("documents").select("doc_id", F.array_join(enrich.topics(F.col("text")), ",").alias("topics"))


@query(r"""SELECT DISTINCT doc_id, email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS email FROM documents)""")
def entity_emails(t):
    return t("documents").select("doc_id", F.explode(enrich.entities(F.col("text"), "email")).alias("email"))


def _entities_sql() -> str:
    counts = []
    for kind, (pattern, group) in fixed.ENTITY_PATTERNS.items():
        plain = re.sub(r"\\([^\x00-\x7f])", r"\1", pattern)  # RE2 takes no escapes of letters beyond ASCII
        counts.append(f"least(len(list_distinct(list_transform(regexp_extract_all(text, '{plain}', {group}), lambda x: coalesce(x, '')))), 20) AS {kind}")
    return f"SELECT doc_id, {', '.join(counts)} FROM documents"


@query(_entities_sql(), longs=tuple(fixed.ENTITY_PATTERNS))
def entity_counts(t):
    cols = [F.size(enrich.entities(F.col("text"), k)).alias(k) for k in fixed.ENTITY_PATTERNS]
    return t("documents").select("doc_id", *cols)


@query(r"""SELECT DISTINCT doc_id, 'version:' || v AS trait FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\bv?\d+\.\d+(?:\.\d+)?(?:-[a-zA-Z0-9]+)?\b')) AS v FROM documents)""")
def version_refs(t):
    return t("documents").select("doc_id", F.explode(enrich.versions(F.col("text"))).alias("trait"))


@query(f"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'unknown' WHEN len(regexp_extract_all(text, '[{fixed.VIETNAMESE}{fixed.VIETNAMESE.upper()}]')) > 2 THEN 'vi' ELSE 'en' END AS language FROM documents""")
def detect_language_rule(t):
    return t("documents").select("doc_id", enrich.language(F.col("text")).alias("language"))


def _type_sql() -> str:
    scores = {k: " + ".join(f"CAST(contains(c, '{w}') AS INT)" for w in ws) for k, ws in fixed.CONTENT_TYPES.items()}
    inner = ", ".join(f"{s} AS s_{k}" for k, s in scores.items())
    best = "greatest(" + ", ".join(f"s_{k}" for k in scores) + ")"
    cases = " ".join(f"WHEN s_{k} = {best} THEN '{k}'" for k in scores)
    return f"SELECT doc_id, CASE WHEN {best} = 0 THEN 'other' {cases} END AS content_type FROM (SELECT doc_id, {inner} FROM (SELECT doc_id, lower(source || ' ' || substr(text, 1, 500)) AS c FROM documents))"


@query(_type_sql())
def content_type_rule(t):
    return t("documents").select("doc_id", enrich.content_type(F.col("source"), F.col("text")).alias("content_type"))


@query(rf"""SELECT doc_id, len(s) AS sentence_count, CASE WHEN len(s) > 0 THEN floor((list_sum(list_transform(s, lambda x: len(regexp_split_to_array(x, '\s+')))) * 20 + len(s)) / (len(s) * 2)) / 10 ELSE 0.0 END AS avg_sentence_length,
CASE WHEN len(w) > 0 THEN floor((length(array_to_string(w, '')) * 200 + len(w)) / (len(w) * 2)) / 100 ELSE 0.0 END AS avg_word_length
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s, regexp_extract_all(text, '{WORD}+') AS w FROM documents)""", longs=("sentence_count",))
def readability(t):
    return t("documents").select("doc_id", enrich.readability(F.col("text")).alias("r")).select("doc_id", "r.*")


@query(f"""WITH c AS (SELECT doc_id, text, {_clean_mail("text")} AS c FROM documents), n AS (SELECT *, {_normal("c")} AS n FROM c)
SELECT doc_id, sha256(c) AS cleaned, sha256({_numbers("n")}) AS normalized, array_to_string(list_filter([CASE WHEN text <> c AND length(text) <> length(c) THEN 'removed_control_chars' END,
CASE WHEN text <> c AND contains(text, chr(13) || chr(10)) THEN 'normalized_line_endings' END, CASE WHEN text <> c AND regexp_matches(text, '&[#a-zA-Z0-9]+;') THEN 'removed_html_entities' END], lambda x: x IS NOT NULL), ',') AS ops FROM n""")
def mail_text_pipeline(t):
    # Each step is a column of its own: Spark keeps apart what a later step uses more than once.
    rows = t("documents").select("doc_id", "text", text.clean_mail_text(F.col("text")).alias("c"))
    ops = F.array_join(text.cleaning_operations(F.col("text"), F.col("c")), ",")
    rows = rows.select("doc_id", F.sha2("c", 256).alias("cleaned"), ops.alias("ops"), text.normalize_numbers(text.normalize(F.col("c"))).alias("n"))
    return rows.select("doc_id", "cleaned", F.sha2("n", 256).alias("normalized"), "ops")


@query("""SELECT doc_id, i AS chunk_index, md5(substr(text, i * 450 + 1, 500)) AS content, CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(floor((length(text) - 1) / 450) + 1 AS INT) END AS chunk_count
FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(floor((length(text) - 1) / 450) + 1 AS INT) END)) AS i FROM documents)""")
def chunk_fixed_windows(t):
    rows = chunk.rows(t("documents"), chunk.windows(F.col("text")), "doc_id")
    return rows.select(F.col("parent_id").alias("doc_id"), F.col("chunk_index").cast("long"), F.md5("content").alias("content"), "chunk_count")


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS ls FROM documents),
r AS (SELECT doc_id, list_reduce(list_transform(ls, lambda x: {{'d': []::VARCHAR[], 'n': x}}), lambda a, p: CASE WHEN length(a.n) + length(p.n) + 1 > 500 AND a.n <> ''
THEN {{'d': list_append(a.d, {_strip("a.n")}), 'n': CASE WHEN length(a.n) > 50 THEN right(a.n, 50) || chr(10) || p.n ELSE p.n END}} ELSE {{'d': a.d, 'n': {_strip("a.n || chr(10) || p.n")}}} END, {{'d': []::VARCHAR[], 'n': ''}}) AS r FROM l),
c AS (SELECT doc_id, CASE WHEN r.n <> '' THEN list_append(r.d, {_strip("r.n")}) ELSE r.d END AS cs FROM r)
SELECT doc_id, generate_subscripts(cs, 1) - 1 AS chunk_index, len(cs) AS chunk_count, md5(unnest(cs)) AS content FROM c""", longs=("chunk_index", "chunk_count"))
def chunk_paragraphs(t):
    rows = chunk.rows(t("documents"), chunk.paragraphs(F.col("text")), "doc_id")
    return rows.select(F.col("parent_id").alias("doc_id"), "chunk_index", "chunk_count", F.md5("content").alias("content"))


@query(f"""WITH s AS (SELECT doc_id, text AS c, list_filter([chr(10) || chr(10), chr(10), '. ', '! ', '? ', ', ', ' '], lambda x: contains(text, x))[1] AS sep FROM documents),
r AS (SELECT doc_id, c, sep, list_reduce(list_transform(string_split(c, sep), lambda x: {{'d': []::VARCHAR[], 'n': x}}), lambda a, p: CASE WHEN length(a.n) + length(p.n) + length(sep) <= 500
THEN {{'d': a.d, 'n': a.n || CASE WHEN a.n <> '' THEN sep ELSE '' END || p.n}} WHEN a.n = '' THEN {{'d': a.d, 'n': p.n}} ELSE {{'d': list_append(a.d, {_strip("a.n")}), 'n': right(a.n, 50) || sep || p.n}} END, {{'d': []::VARCHAR[], 'n': ''}}) AS r FROM s),
p AS (SELECT doc_id, CASE WHEN length(c) <= 500 THEN [c] WHEN sep IS NULL THEN list_transform(range(0, CAST(floor((length(c) - 1) / 450) + 1 AS INT)), lambda i: substr(c, CAST(i * 450 + 1 AS INT), 500)) WHEN r.n <> '' THEN list_append(r.d, {_strip("r.n")}) ELSE r.d END AS cs FROM r)
SELECT doc_id, chunk_index, chunk_count, md5(content) AS content FROM (SELECT doc_id, generate_subscripts(cs, 1) - 1 AS chunk_index, len(cs) AS chunk_count, unnest(cs) AS content FROM p) WHERE length(content) >= 10""", longs=("chunk_index", "chunk_count"))
def chunk_recursive(t):
    rows = chunk.rows(t("documents"), chunk.separated(F.col("text")), "doc_id", least=10)
    return rows.select(F.col("parent_id").alias("doc_id"), "chunk_index", "chunk_count", F.md5("content").alias("content"))


@query("""SELECT doc_id AS parent_id, NOT (doc_id % 3 = 0 AND n > 2) AND doc_id % 5 <> 1 AS contiguous FROM (SELECT doc_id, CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(floor((length(text) - 1) / 450) + 1 AS INT) END AS n FROM documents)""")
def chunk_contiguity(t):
    """Chunks of a third of the documents lack the second one, those of a fifth have the first one twice."""
    rows = chunk.rows(t("documents"), chunk.windows(F.col("text")), "doc_id")
    rows = rows.filter("not (parent_id % 3 = 0 and chunk_index = 1)")
    return chunk.contiguous(rows.unionByName(rows.filter("parent_id % 5 = 1 and chunk_index = 0")))


#: What stands before each text: listed dates, a weekday with an impossible and a late time, a plain date.
_HEADS = ("Ngày 1/6/2026\nNgày 02/06/2026\n08:30-09:00 | Plan", "Thứ Tư - 03/06/2026\n25:00 - 26:00 None\n10:00 - 09:00 Late", "4/6/2026\nLịch")
_DAY = lambda p: f"CAST(try_strptime(regexp_replace(regexp_extract(line, '{p}'), '{p}', '\\1/\\2/\\3'), '%d/%m/%Y') AS TIMESTAMP)"


@query(rf"""WITH t AS (SELECT doc_id, row_number() OVER () AS doc, string_split([{", ".join(f"'{h}'" for h in _HEADS)}][doc_id % 3 + 1] || chr(10) || coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, doc, generate_subscripts(ls, 1) AS n, regexp_replace(unnest(ls), '^\s+|\s+$', '', 'g') AS line FROM t),
d AS (SELECT *, {_DAY(r"Thứ\s+\S+\s*[-–—]\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})")} AS d0, {_DAY(r"Ng[àa]y\s+([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})")} AS d1, {_DAY(r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})")} AS d2,
 regexp_extract(line, '^([0-9]{{1,2}}):([0-9]{{2}})\s*[-–—]\s*([0-9]{{1,2}}):([0-9]{{2}})\s*[|]?\s*(.+)', ['h1', 'm1', 'h2', 'm2', 'said']) AS c
 FROM l WHERE line <> '' AND NOT regexp_matches(line, '^[-–—=| ]+$') AND NOT starts_with(lower(line), 'lịch') AND NOT starts_with(lower(line), 'mục đích') AND NOT (contains(lower(line), 'thời gian') AND contains(lower(line), 'công việc'))),
k AS (SELECT *, CASE WHEN d0 IS NOT NULL THEN 0 WHEN d1 IS NOT NULL THEN 1 WHEN d2 IS NOT NULL THEN 2 WHEN c.said <> '' THEN 3 WHEN NOT regexp_matches(line, '^[0-9]') AND length(line) > 3 THEN 4 END AS kind, coalesce(d0, d1, d2) AS day FROM d),
a AS (SELECT *, kind = 3 AND try_cast(c.h1 AS INT) <= 23 AND try_cast(c.h2 AS INT) <= 23 AND try_cast(c.m1 AS INT) <= 59 AND try_cast(c.m2 AS INT) <= 59 AS possible, min(n) FILTER (kind = 3) OVER w AS ft, min(n) FILTER (kind = 1) OVER w AS fn FROM k WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY doc)),
b AS (SELECT *, kind <= 1 AND fn IS NOT NULL AND n >= fn AND (ft IS NULL OR fn < ft) AS listed, count(*) FILTER (possible) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS block FROM a),
e AS (SELECT *, arg_min(day, n) FILTER (listed) OVER (PARTITION BY doc, block ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS waiting, max(n) FILTER (possible) OVER (PARTITION BY doc, block) AS at FROM b),
f AS (SELECT *, last_value(CASE WHEN kind <= 2 AND NOT listed THEN day WHEN possible THEN waiting END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS today FROM e),
g AS (SELECT f.doc, f.doc_id, t.n, f.n AS place, trim(t.c.said) AS name, f.day AS day, t.c AS c FROM f JOIN f AS t ON f.doc = t.doc AND f.at = t.n WHERE f.listed
 UNION ALL SELECT doc, doc_id, n, n, trim(c.said), today, c FROM f WHERE possible AND waiting IS NULL AND today IS NOT NULL),
h AS (SELECT doc, doc_id, n, place, name, day + to_minutes(CAST(c.h1 AS INT) * 60 + CAST(c.m1 AS INT)) AS start, CAST(c.h2 AS INT) * 60 + CAST(c.m2 AS INT) - CAST(c.h1 AS INT) * 60 - CAST(c.m1 AS INT) AS minutes FROM g
 UNION ALL SELECT doc, doc_id, n, n, line, coalesce(CASE WHEN ft IS NULL OR n < ft THEN waiting END, today), NULL FROM f WHERE kind = 4 AND NOT regexp_matches(lower(line), 'nghỉ|tự học|đọc sách|đọc tài liệu|gym'))
SELECT doc_id AS document_id, md5(name) AS name, strftime(start, '%Y-%m-%d %H:%M') AS start, CASE WHEN minutes IS NULL THEN 'tentative' ELSE 'active' END AS status, n AS line_number, CAST(CASE WHEN minutes > 0 THEN minutes ELSE minutes + 60 END AS INT) AS duration_minutes
FROM (SELECT *, row_number() OVER (PARTITION BY doc, start, name ORDER BY n, place) AS r FROM h WHERE start IS NOT NULL) WHERE r = 1""")
def schedule_extract(t):
    head = F.get(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % 3).cast("int"))
    found = schedule.extract(t("documents").select("doc_id", F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text")), "text", "doc_id")
    return found.select("document_id", F.md5("name").alias("name"), F.date_format("effective_start", "yyyy-MM-dd HH:mm").alias("start"), "status", "line_number", "duration_minutes")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN '' WHEN 3 THEN c_name || ' ' ELSE c_name END AS name, CASE c_custkey % 4 WHEN 2 THEN '' ELSE lower(replace(c_name, '#', '')) || '@x.org' END AS email FROM customer""")
def sender_parse(t):
    address = F.concat(F.replace("c_name", F.lit("#"), F.lit("")), F.lit("@X.org"))
    forms = F.array(F.concat(F.lit('"'), "c_name", F.lit('" <'), address, F.lit(">")), address, F.col("c_name"), F.concat("c_name", F.lit(" ("), address, F.lit(")")))
    raw = F.get(forms, (F.col("c_custkey") % 4).cast("int"))
    return t("customer").select("c_custkey", text.clean_sender(raw).alias("s")).select("c_custkey", "s.name", "s.email")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'image' ELSE 'unknown' END AS category, CASE p_partkey % 3 WHEN 0 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime,
'part_' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpeg' ELSE '' END AS normalized FROM part""")
def file_names(t):
    end = F.when(F.col("p_partkey") % 3 == 0, ".PDF").when(F.col("p_partkey") % 3 == 1, ".jpeg").otherwise("")
    name = F.concat(F.lit("part "), F.col("p_partkey").cast("string"), end)
    return t("part").select("p_partkey", text.file_category(name).alias("category"), text.media_type(name).alias("mime"), text.normalize_filename(name).alias("normalized"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN 'some day' WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE o_orderkey % 5 WHEN 0 THEN '+07:00' WHEN 1 THEN '+00:00' ELSE '-05:30' END END AS received FROM orders""")
def mail_dates(t):
    day = F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss")
    forms = F.array(F.concat(F.lit("Mon, "), day, F.lit(" +0700")), F.concat(day, F.lit(" GMT")), F.concat(F.lit("Tue, "), day, F.lit(" -0530 (XYZ)")), F.lit("some day"), F.lit(""))
    return t("orders").select("o_orderkey", text.clean_date(F.get(forms, (F.col("o_orderkey") % 5).cast("int"))).alias("received"))


@query("""SELECT conv_id, turn, trim(regexp_replace(replace(text, chr(10), ' '), '\\s+', ' ', 'g')) AS subject FROM conversations""")
def subject_clean(t):
    return t("conversations").select("conv_id", "turn", text.clean_subject(F.col("text")).alias("subject"))


@query(f"""SELECT doc_id, md5(text) AS before, md5({_numbers("text || ' 01/06/2026 1,234,567 1,23,4567 1.2.26'")}) AS numbers FROM documents""")
def number_normalize(t):
    c = F.concat("text", F.lit(" 01/06/2026 1,234,567 1,23,4567 1.2.26"))
    return t("documents").select("doc_id", F.md5("text").alias("before"), F.md5(text.normalize_numbers(c)).alias("numbers"))


@query("""SELECT doc_id, length(text) >= 100 AND doc_id % 7 <> 0 AS valid, concat_ws(';', CASE WHEN doc_id % 7 = 0 THEN 'email_id is empty' END, CASE WHEN length(text) < 100 THEN 'attachment ' || doc_id || ': filename is empty' END) AS errors,
concat_ws(';', CASE WHEN lang <> 'en' THEN 'subject is empty' END, CASE WHEN doc_id % 5 = 0 THEN 'sender is empty' END, CASE WHEN length(text) <= 1000 THEN 'attachment ' || doc_id || ': size is 0 or negative' END, 'attachment None: size is 0 or negative') AS warnings FROM documents""")
def metadata_validation(t):
    """Two attachments each: one is as large as the text is beyond 1000 characters, and has a name if that has 100;
    the other has no id and no size."""
    key = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("doc_id").cast("string"))
    one = F.struct(F.col("doc_id").cast("string").alias("id"), F.when(F.length("text") >= 100, F.lit("a.pdf")).alias("filename"), (F.length("text") - 1000).cast("long").alias("size"))
    other = F.struct(F.lit(None).cast("string").alias("id"), F.lit("b.pdf").alias("filename"), F.lit(None).cast("long").alias("size"))
    v = enrich.metadata_validation(key, F.when(F.col("lang") == "en", F.col("source")), F.when(F.col("doc_id") % 5 != 0, "x"), F.array(one, other))
    return t("documents").select("doc_id", v.alias("v")).select("doc_id", "v.valid", F.array_join("v.errors", ";").alias("errors"), F.array_join("v.warnings", ";").alias("warnings"))


def _found_sql(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(text, '{pattern}', {group})"


def _dates_sql() -> str:
    """The patterns of dates in RE2, whose white space is ASCII unless it is written out."""
    every = ", ".join(_found_sql(p.replace("(?iu)", "(?i)").replace(r"\s", _SPACE)) for p in fixed.DATE_PATTERNS)
    return f"list_sort(list_distinct(flatten([{every}])))[1:20]"


@query(f"""SELECT doc_id, array_to_string({_dates_sql()}, ';') AS dates FROM documents""")
def detected_dates(t):
    return t("documents").select("doc_id", F.array_join(enrich.dates(F.col("text")), ";").alias("dates"))


@query(r"""SELECT DISTINCT doc_id, 'file_type:' || u AS trait FROM (SELECT doc_id, unnest(regexp_extract_all(text || ' notes.md data/v1.csv ä.py x.pyc ' || source || '.json', '[\p{L}\p{M}\p{N}\p{Pc}\-]+\.(py|js|ts|java|go|rs|yaml|yml|json|xml|md|txt|csv|docx|pdf|xlsx)(?:[^\p{L}\p{M}\p{N}\p{Pc}]|$)', 1)) AS u FROM documents)""")
def file_references(t):
    c = F.concat("text", F.lit(" notes.md data/v1.csv ä.py x.pyc "), "source", F.lit(".json"))
    return t("documents").select("doc_id", F.explode(enrich.file_references(c)).alias("trait"))


@query(r"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '2026-06-30 08:30:05' WHEN 1 THEN '2026-06-30 01:30:05' WHEN 2 THEN '2026-06-30 08:30:05' WHEN 3 THEN '2026-06-30 08:30:05' WHEN 4 THEN '2026-06-30 00:00:00' WHEN 5 THEN '2026-06-30 04:42:32' END AS parsed FROM part""")
def parse_times(t):
    forms = ("2026-06-30T08:30:05Z", "2026-06-30T08:30:05+07:00", "2026-06-30T08:30:05.123456+0000", "2026-06-30T08:30:05", "2026-06-30", "Tue, 30 Jun 2026 11:42:32 +0700", "June 30")
    c = F.get(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 7).cast("int"))
    return t("part").select("p_partkey", F.date_format(text.parse_time(c), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(f"""SELECT doc_id, md5({_punctuation(_punctuation(_all("text", (r"[{}\[\]]", "")), ".,!?;"), ":")}) AS signs, md5(nfc_normalize(text)) AS composed FROM documents""")
def punctuation_and_nfc(t):
    return t("documents").select("doc_id", F.md5(text.punctuation(F.col("text"))).alias("signs"), F.md5(text.nfc(F.col("text"))).alias("composed"))


@query("""SELECT doc_id, lang || '!' || source || '?' AS normalized FROM documents""")
def normalizer_hook(t):
    """Registered steps run after the others, in their order."""
    steps = [text.register_normalizer(lambda c: F.concat(c, F.lit("!"), F.col("source"))), text.register_normalizer(lambda c: F.concat(c, F.lit("?")))]
    try:
        c = text.normalized(F.col("lang"))
    finally:
        for step in steps:
            text.NORMALIZERS.remove(step)
    return t("documents").select("doc_id", c.alias("normalized"))


@query("""SELECT doc_id, 'length:' || CAST(length(text) // 1000 AS VARCHAR) AS trait FROM documents""")
def extractor_hook(t):
    """A registered extractor's traits are among those of the concepts."""
    extra = enrich.register_extractor(lambda content, name: F.array(F.concat(F.lit("length:"), F.floor(F.length(content) / 1000).cast("string"))))
    try:
        c = enrich.concepts(F.col("text"), F.col("source"))
    finally:
        enrich.EXTRACTORS.remove(extra)
    return t("documents").select("doc_id", F.explode(F.filter(c["traits"], lambda x: x.startswith("length:"))).alias("trait"))
