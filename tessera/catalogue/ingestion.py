"""Objects, readers, mail, calendar and sinks, on objects that are made of the tables' rows."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalogue.registry import query
from tessera.functions import text
from tessera.operators import dedup, observe, quality, relational, vector_index
from tessera.plans import api, silver
from tessera.sources import files, mail, sinks

_ENDS = (".txt", ".CSV", ".pdf", "", ".docx", ".Json")
_END = "[" + ", ".join(f"'{e}'" for e in _ENDS) + "][doc_id % 6 + 1]"


def _objects(t):
    """Documents as objects: of six extensions; tables as CSV, other contents as they are."""
    end = F.get(F.array(*map(F.lit, _ENDS)), (F.col("doc_id") % 6).cast("int"))
    table = F.concat(F.lit('a,"b\nc"\n'), F.col("doc_id").cast("string"), F.lit(","), "source", F.lit("\n"))
    content = F.when(F.col("doc_id") % 6 == 1, table).when(F.col("doc_id") % 6 == 5, F.lit('{"other": 1}')).otherwise(F.col("text"))
    key = F.concat(F.lit("dir/"), "doc_id", end)
    rows = t("documents").select("doc_id", F.concat(F.lit("file:/x/"), key).alias("uri"), F.lit("box").alias("bucket"), key.alias("object_key"), F.concat("doc_id", end).alias("filename"), F.lit("2024-01-01").cast("timestamp").alias("modified"), content.cast("binary").alias("content"))
    return rows.withColumn("size_bytes", F.octet_length("content").cast("long"))


@query(f"""SELECT doc_id, lower({_END}) AS extension, CASE lower({_END}) WHEN '.txt' THEN 'text/plain' WHEN '.csv' THEN 'text/csv' WHEN '.pdf' THEN 'application/pdf' WHEN '.json' THEN 'application/json'
WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS mime_type, 'store://box/dir/' || doc_id || {_END} AS source,
sha256(CASE doc_id % 6 WHEN 1 THEN 'a,"b' || chr(10) || 'c"' || chr(10) || doc_id || ',' || source || chr(10) WHEN 5 THEN '{{"other": 1}}' ELSE text END) AS checksum FROM documents""")
def object_metadata(t):
    return files.with_metadata(_objects(t)).select("doc_id", "extension", "mime_type", "source", "checksum")


@query("SELECT doc_id, 'dir/' || doc_id || '.CSV' AS object_key FROM documents WHERE doc_id % 6 = 1")
def objects_of_extension(t):
    return files.listed(files.with_extension(_objects(t), ".csv")).select("doc_id", "object_key")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'calendar' WHEN 2 THEN 'email' WHEN 3 THEN 'calendar' ELSE 'document' END AS kind FROM documents""")
def object_types(t):
    made = ('{"id": "m", "threadId": "t"}', '{"items": [{"id": "e"}]}', '[{"id": "m"}, {"id": "n"}]', '{"summary": "s", "start": {"date": "2024-01-01"}}', '{"other": 1}', "{broken")
    content = F.get(F.array(*map(F.lit, made)), (F.col("doc_id") % 6).cast("int"))
    rows = t("documents").select("doc_id", F.concat("doc_id", F.lit(".json")).alias("filename"), content.cast("binary").alias("content"))
    return rows.select("doc_id", files.source_type(rows).alias("kind"))


@query("""SELECT doc_id, md5(CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN 'a | b' || chr(10) || 'c' || chr(10) || doc_id || ' | ' || source ELSE '' END) AS text, CASE doc_id % 6 WHEN 4 THEN 'BadZipFile' ELSE '' END AS error FROM documents""")
def documents_read(t):
    found = files.document_text(files.with_metadata(_objects(t)))
    return found.select("doc_id", F.md5("text").alias("text"), F.coalesce(F.substring_index("read_error", ":", 1), F.lit("")).alias("error"))


@F.pandas_udf(T.BinaryType())
def _packed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Texts as the smallest real files of their kind, a paragraph, row or shown string for each line."""

    def zipped(parts: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, part in parts.items():
                z.writestr(name, part)
        return out.getvalue()

    def docx(lines: list[str]) -> bytes:
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
        return zipped({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})

    def xlsx(lines: list[str]) -> bytes:
        main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        rows = "".join(f'<row><c r="A{i}" t="s"><v>{i - 1}</v></c><c r="C{i}"><v>{i}</v></c></row>' for i in range(1, len(lines) + 1))
        strings = "".join(f"<si><t>{escape(x)}</t></si>" for x in lines)
        return zipped({
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Lines" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/one.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{main}">{strings}</sst>',
            "xl/worksheets/one.xml": f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>',
        })

    def pdf(lines: list[str]) -> bytes:
        shown = "\n".join("(" + re.sub(r"([()\\])", r"\\\1", x) + ") Tj T*" for x in lines)
        packed = zlib.compress(f"BT /F1 12 Tf\n{shown}\nET".encode())
        head = f"%PDF-1.4\n1 0 obj\n<< /Length {len(packed)} /Filter /FlateDecode >>\nstream\n".encode()
        return head + packed + b"\nendstream\nendobj\n%%EOF\n"

    make = {".docx": docx, ".xlsx": xlsx, ".pdf": pdf}
    for kinds, texts in batches:
        for begin, end in files.slices(texts):
            yield pd.Series([None if t is None else make[k](t.split("\n") if t else []) for k, t in zip(kinds.iloc[begin:end], texts.iloc[begin:end], strict=True)])


_PLAIN = "regexp_replace(text, '[^ -~\\n]', '?', 'g')"


@query(rf"""WITH d AS (SELECT doc_id, list_filter(string_split({_PLAIN}, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)
SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN array_to_string(ls, chr(10)) WHEN 1 THEN array_to_string(list_prepend('=== Sheet: Lines ===', list_transform(ls, lambda x, i: x || ' |  | ' || i)), chr(10)) ELSE trim(array_to_string(ls, chr(10)), ' ') END) AS text, true AS read FROM documents JOIN d USING (doc_id)""")
def office_files_read(t):
    """Every document as a real DOCX, XLSX or PDF file, read again."""
    plain = F.regexp_replace("text", r"[^ -~\n]", "?")
    lines = F.array_join(F.filter(F.split(plain, "\n"), lambda x: F.trim(x) != ""), "\n")
    kind = F.when(F.col("doc_id") % 3 == 0, ".docx").when(F.col("doc_id") % 3 == 1, ".xlsx").otherwise(".pdf")
    some = F.col("text").isNotNull() | (kind == ".xlsx")  # a sheet without lines has its name
    rows = t("documents").select("doc_id", kind.alias("extension"), some.alias("some"), _packed(kind, F.when(some, F.coalesce(lines, F.lit("")))).alias("content"))
    found = files.document_text(rows)
    return found.select("doc_id", F.when(F.col("some"), F.md5("text")).alias("text"), F.col("read_error").isNull().alias("read"))


@query("SELECT doc_id, md5(reverse(text)) AS text FROM documents")
def reader_hook(t):
    """A reader of an extension of one's own, registered for this query."""
    rows = t("documents").select("doc_id", F.lit(".rev").alias("extension"), F.col("text").cast("binary").alias("content"))
    files.register_reader(".rev", lambda c: F.reverse(c.cast("string")))
    found = files.document_text(rows, (".rev",)).select("doc_id", F.md5("text").alias("text"))
    files.READERS.pop(".rev")
    return found


@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user'")
def json_lines_round_trip(t):
    """Two backups into one folder, read back."""
    rows = t("conversations").select("conv_id", "turn", "role", "text")
    folder = vector_index.new_folder(rows.sparkSession, "backup")
    sinks.json_lines(rows, folder)
    sinks.json_lines(rows.filter("role = 'user'"), folder)
    return files.jsonl(rows.sparkSession, folder, "conv_id long, turn long, role string, text string")


@query("SELECT o_orderkey AS id, o_totalprice AS price, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 'second ' || o_orderkey END AS VARCHAR) AS note FROM orders")
def migrated_table(t):
    """A stored table that gets a column between two batches."""
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    folder, spark = vector_index.new_folder(rows.sparkSession, "migrated"), rows.sparkSession
    sinks.append(rows.filter("id % 2 = 1"), folder)
    wider = rows.filter("id % 2 = 0").withColumn("note", F.concat(F.lit("second "), "id"))
    sinks.migrate(spark, folder, wider.schema)
    sinks.append(wider, folder)
    return sinks.current(spark, folder)


def _mails(t):
    """Conversations' turns as mails in JSON: headers, a plain text in parts, three levels of attachments."""
    n = F.concat_ws("x", "conv_id", "turn")
    head = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    data = F.translate(F.regexp_replace(F.base64(F.col("text").cast("binary")), r"[\r\n=]", ""), "+/", "-_")
    body = lambda d, size: F.struct(d.alias("data"), F.lit(size).alias("size"))
    leaf = lambda name, kind: F.struct(F.lit(kind).alias("mimeType"), F.lit(name).alias("filename"), body(F.lit(None).cast("string"), 7).alias("body"))
    deep = F.struct(F.lit("multipart/mixed").alias("mimeType"), F.lit("").alias("filename"), body(F.lit(None).cast("string"), 0).alias("body"), F.array(leaf("deep.Xlsx", "x/y"), leaf("photo.png", "image/png")).alias("parts"))
    plain = F.struct(F.lit("text/plain").alias("mimeType"), F.lit("").alias("filename"), body(data, 1).alias("body"), F.array().cast(deep_kind()).alias("parts"))
    file = F.struct(F.lit("application/pdf").alias("mimeType"), F.lit("a.PDF").alias("filename"), body(F.lit(None).cast("string"), 9).alias("body"), F.array(deep).cast(deep_kind()).alias("parts"))
    headers = F.array(head("subject", F.concat(F.lit("Re: "), n)), head("From", F.concat(F.lit('"Ann '), n, F.lit('" <A'), n, F.lit("@X.org>"))), head("To", F.lit('Bob <b@x.org>, "D, C" <C@y.org>, e@z.org')), head("Cc", F.lit("")), head("Date", F.lit("Tue, 30 Jun 2026 11:42:32 +0700")))
    mailed = F.struct(n.alias("id"), F.col("conv_id").cast("string").alias("threadId"), F.struct(F.lit("multipart/mixed").alias("mimeType"), headers.alias("headers"), F.array(plain, file).alias("parts")).alias("payload"))
    return t("conversations").select("conv_id", "turn", F.to_json(mailed).cast("binary").alias("content"))


def deep_kind() -> str:
    leaf = "struct<mimeType:string,filename:string,body:struct<data:string,size:int>>"
    return f"array<struct<mimeType:string,filename:string,body:struct<data:string,size:int>,parts:array<{leaf}>>>"


@query("""SELECT conv_id || 'x' || turn AS message_key, CAST(conv_id AS VARCHAR) AS thread_id, 'Re: ' || conv_id || 'x' || turn AS subject, 'Ann ' || conv_id || 'x' || turn AS sender_name, 'a' || conv_id || 'x' || turn || '@x.org' AS sender_email,
'Bob=b@x.org;D, C=c@y.org;=e@z.org' AS recipients, 0 AS n_cc, '2026-06-30 04:42:32' AS received, md5(text) AS body FROM conversations""", longs=("n_cc",))
def mail_messages(t):
    rows = mail.messages(_mails(t))
    people = F.array_join(F.transform("recipients", lambda p: F.concat(p["name"], F.lit("="), p["email"])), ";")
    return rows.select("message_key", "thread_id", "subject", "sender_name", "sender_email", people.alias("recipients"), F.size("cc").alias("n_cc"), F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received"), F.md5("body").alias("body"))


@query("""SELECT conv_id || 'x' || turn AS message_key, u.i AS attachment_index, u.f AS filename, u.s AS size FROM conversations, (VALUES (0, 'a.PDF', 9), (1, 'deep.Xlsx', 7)) u(i, f, s)""", longs=("attachment_index", "size"))
def mail_attachments(t):
    return mail.allowed_attachments(mail.messages(_mails(t)).select("message_key", "attachments")).select("message_key", "attachment_index", "filename", "size")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS event_key, 'Order ' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d 08:30:00') ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS starts, o_orderkey % 2 = 1 AS is_all_day, 'ann@x.org' AS organizer, 1 AS guests FROM orders""", longs=("guests",))
def calendar_events(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    start = F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.concat(day, F.lit("T08:30:00Z"))).alias("dateTime"), F.when(F.col("o_orderkey") % 2 == 1, day).alias("date"))
    person = lambda e: F.struct(F.lit(e).alias("email"))
    item = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("summary"), start.alias("start"), person("ann@x.org").alias("organizer"), F.array(person("bob@x.org")).alias("attendees"))
    found = mail.events(t("orders").select(F.to_json(F.struct(F.array(item).alias("items"))).cast("binary").alias("content")))
    return found.select("event_key", "title", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("starts"), "is_all_day", F.col("organizer_email").alias("organizer"), F.size("attendees").alias("guests"))


@query("""SELECT CAST(count_if(doc_id % 6 IN (0, 1, 2, 3, 4)) AS BIGINT) AS documents, CAST(count_if(doc_id % 6 = 5) AS BIGINT) AS others, (SELECT count(*) FROM conversations) AS communications, (SELECT 2 * count(*) FROM conversations) AS files FROM documents""")
def silver_tables(t):
    """Entity tables of documents and mails together, counted."""
    docs = _objects(t).drop("doc_id")
    mails = _mails(t)
    key = F.concat(F.lit("mail/"), "conv_id", F.lit("-"), "turn", F.lit(".json"))
    mails = mails.select(F.concat(F.lit("file:/x/"), key).alias("uri"), F.lit("box").alias("bucket"), key.alias("object_key"), F.regexp_extract(key, "([^/]*)$", 1).alias("filename"), F.lit("2024-01-01").cast("timestamp").alias("modified"), "content", F.octet_length("content").cast("long").alias("size_bytes"))
    found = silver.run(docs.unionByName(mails))
    kept = found["documents"].agg(F.count_if(~F.col("source").endswith(".Json")).alias("documents"), F.count_if(F.col("source").endswith(".Json")).alias("others"))
    null = F.lit(None).cast("long")
    rows = [kept.withColumns({"communications": null, "files": null})]
    for name in ("communications", "files"):
        rows.append(found[name].agg(F.count("*").alias(name)).withColumns({c: null for c in ("documents", "others", "communications", "files") if c != name}))
    whole = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return whole.agg(*[F.max(c).alias(c) for c in ("documents", "others", "communications", "files")])


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'store ' || doc_id WHEN doc_id % 3 = 0 THEN 'mirror ' || doc_id WHEN doc_id % 5 = 0 THEN 'folder ' || doc_id END AS content FROM documents""")
def tiered_fetch(t):
    ids = t("documents").select("doc_id")
    tier = lambda n, name: ids.filter(F.col("doc_id") % n == 0).withColumn("content", F.concat(F.lit(name + " "), "doc_id"))
    return files.first_available(ids, "doc_id", tier(2, "store"), tier(3, "mirror"), tier(5, "folder"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.5 AND o_orderkey % 2 = 0")
def raw_query(t):
    rows = t("orders")
    return files.query(rows.sparkSession, "SELECT o_orderkey, o_totalprice FROM {raw_orders} WHERE o_totalprice > :low AND o_orderkey % :m = 0", {"raw_orders": rows}, low=100000.5, m=2)


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 2 THEN NULL ELSE len(embedding) END AS n, CASE WHEN vec_id % 3 = 2 THEN NULL ELSE round(CAST(embedding[1] AS DOUBLE), 4) END AS first FROM embeddings""")
def vector_backfill(t):
    """A third of the vectors is a column, a third inside JSON, a third nowhere."""
    own = F.col("embedding").cast("array<float>")
    rows = t("embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, own).alias("embedding_vector"), F.when(F.col("vec_id") % 3 == 1, F.to_json(F.struct(own.alias("embedding_vector")))).alias("metadata"))
    v = F.col("embedding_vector")
    return sinks.vectors_from_json(rows).select("vec_id", F.when(v.isNotNull(), F.size(v)).cast("long").alias("n"), F.round(F.get(v, F.lit(0)).cast("double"), 4).alias("first"))


@query("""SELECT event_id, 'INFO' AS level, 'shop' AS component, event_type AS event, CAST(user_id AS VARCHAR) AS correlation_id, props AS data FROM events""")
def log_lines(t):
    rows = t("events")
    out = sinks.log_lines(rows, "INFO", "shop", "x", F.col("ts"), F.col("user_id").cast("string"), F.struct("event_id", "event_type", "props"))
    return out.select("data.event_id", "level", "component", F.col("data.event_type").alias("event"), "correlation_id", F.col("data.props").alias("data"))


@query("""WITH n AS (SELECT 'orders' AS tbl, o_orderkey AS id, o_totalprice AS x FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer),
o AS (SELECT 'orders' AS tbl, o_orderkey AS id, -1.0 AS x FROM orders WHERE o_orderkey % 3 = 0)
SELECT tbl, id, round(x, 2) AS x FROM o UNION ALL SELECT tbl, id, round(x, 2) FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.tbl = n.tbl AND o.id = n.id)""")
def node_insert_if_absent(t):
    orders, customers = t("orders"), t("customer")
    row = lambda df, name, key, x: df.select(F.lit(name).alias("tbl"), F.col(key).alias("id"), F.col(x).cast("double").alias("x"))
    new = row(orders.filter("o_orderkey % 2 = 0"), "orders", "o_orderkey", "o_totalprice").unionByName(row(customers, "customer", "c_custkey", "c_acctbal"))
    old = row(orders.filter("o_orderkey % 3 = 0"), "orders", "o_orderkey", "o_totalprice").withColumn("x", F.lit(-1.0))
    return dedup.insert_if_absent(new, old, ["tbl", "id"], "x").withColumn("x", F.round("x", 2))


@query("""WITH e AS (SELECT l_orderkey AS s, 'contains' AS p, l_partkey AS o, min(l_linenumber) AS w FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2, 3), old AS (SELECT DISTINCT l_orderkey AS s, 'contains' AS p, l_partkey AS o, 0 AS w FROM lineitem WHERE l_linenumber = 1)
SELECT s, p, o, CAST(w AS BIGINT) AS w FROM old UNION ALL SELECT s, p, o, CAST(w AS BIGINT) FROM e WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.s = e.s AND old.o = e.o)""")
def edge_insert_if_absent(t):
    row = lambda df, w: df.select(F.col("l_orderkey").alias("s"), F.lit("contains").alias("p"), F.col("l_partkey").alias("o"), w.cast("long").alias("w"))
    new, old = row(t("lineitem").filter("l_linenumber <= 4"), F.col("l_linenumber")), row(t("lineitem").filter("l_linenumber = 1"), F.lit(0)).distinct()
    return dedup.insert_if_absent(new, old, ["s", "p", "o"], "w")


@query("SELECT doc_id AS id, source AS title, md5(text) AS content, length(text) AS content_length FROM documents WHERE doc_id = 17", longs=("content_length",))
def document_details(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"))
    return api.content(docs, 17).select("id", "title", F.md5("content").alias("content"), "content_length")


@query("SELECT 'session' AS what, true AS ok UNION ALL SELECT 'no_such_table', false")
def catalog_health(t):
    return observe.health(t("region").sparkSession, ["no_such_table"])


@query("SELECT doc_id AS id, source AS path FROM documents WHERE lang = 'en' AND source = 'src3' ORDER BY doc_id")
def filtered_lookup(t):
    return relational.where_equal(t("documents"), lang="en", source="src3").orderBy("doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("path"))


@query("SELECT doc_id, text IN (SELECT text FROM documents WHERE doc_id % 7 = 0) AND text <> '' AS known FROM documents WHERE doc_id % 7 <> 0")
def checksum_probe(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("checksum"), "text")
    new = d.filter("doc_id % 7 != 0")
    known = relational.present(new.filter("text != ''"), d.filter("doc_id % 7 = 0"), "checksum").select("doc_id", F.lit(True).alias("known"))
    return new.select("doc_id").join(known, "doc_id", "left").fillna(False, ["known"])


@query("""SELECT count(*) AS n_chunks, CAST(sum(len) AS BIGINT) AS total_length FROM (SELECT length(substr(text, i * 450 + 1, 500)) AS len FROM (SELECT text, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(floor((length(text) - 1) / 450) + 1 AS INT) END)) AS i FROM documents))""")
def chunk_totals(t):
    from tessera.operators import chunk

    return chunk.summary(chunk.rows(t("documents"), chunk.windows(F.col("text")), "doc_id"))


@query("""SELECT doc_id, md5(text) AS before, md5(regexp_replace(text, '[^A-Za-z0-9_\\-\\.\\p{L}\\p{N}\\p{M}\\p{Pc}]', '_', 'g')) AS after FROM documents""")
def safe_names(t):
    return t("documents").select("doc_id", F.md5("text").alias("before"), F.md5(text.safe_filename(F.col("text"))).alias("after"))


def _ascii_sql(c: str) -> str:
    unit = "printf('\\u%04x', {})"
    above = f"{unit.format('55296 + ((unicode(x) - 65536) >> 10)')} || {unit.format('56320 + ((unicode(x) - 65536) & 1023)')}"
    return f"""'"' || array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN x = '"' THEN '\\"' WHEN x = '\\' THEN '\\\\' WHEN x = chr(10) THEN '\\n' WHEN x = chr(13) THEN '\\r' WHEN x = chr(9) THEN '\\t' WHEN x = chr(8) THEN '\\b' WHEN x = chr(12) THEN '\\f' WHEN x = '' THEN ''
WHEN unicode(x) BETWEEN 32 AND 126 THEN x WHEN unicode(x) < 65536 THEN {unit.format("unicode(x)")} ELSE {above} END), '') || '"'"""


@query(f"""SELECT doc_id, sha256('{{"id": ' || doc_id || ', "lang": ' || CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE '"' || lang || '"' END || ', "text": ' || {_ascii_sql("text")} || '}}') AS checksum FROM documents""")
def canonical_checksum(t):
    fields = {"text": F.col("text"), "id": F.col("doc_id"), "lang": F.when(F.col("doc_id") % 4 != 0, F.col("lang"))}
    return t("documents").select("doc_id", F.sha2(text.canonical_json(fields, numbers=("id",)), 256).alias("checksum"))


@query("""SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS passed FROM documents""")
def blocked_rows(t):
    kind = F.when(F.col("doc_id") % 5 == 0, "thing").otherwise("document")
    ref = F.struct(F.when(F.col("doc_id") % 7 != 0, F.lit("documents")).alias("table"), F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("checksum"))
    rows = t("documents").select("doc_id", kind.alias("type"), ref.alias("source_ref"), F.lit("").alias("name"), F.lit("long enough").alias("embedding_text"))
    good, bad = quality.split_blocked(rows, "silver_to_gold")
    return good.select("doc_id", F.lit(True).alias("passed")).unionByName(bad.select("doc_id", F.lit(False).alias("passed")))


def _files(t):
    return t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("dir/"), "c_name").alias("path"), F.col("c_nationkey").alias("parent_id"))


@query("SELECT c_custkey AS id, 'dir/' || c_name AS path, 'parent' AS way FROM customer WHERE c_nationkey = 7 UNION ALL SELECT c_custkey, 'dir/' || c_name, 'path' FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def file_lookup(t):
    least = t("customer").agg(F.concat(F.lit("dir/"), F.min("c_name")).alias("path"))  # one row
    of = api.files_of(_files(t), 7).withColumn("way", F.lit("parent"))
    return of.unionByName(_files(t).join(F.broadcast(least), "path").withColumn("way", F.lit("path"))).select("id", "path", "way")


@query("SELECT event_id AS id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 25")
def next_events(t):
    rows = t("events").select(F.col("event_id").alias("id"), F.col("ts").alias("start_time"), "event_type")
    return api.events_from(rows, "2024-01-10", 25).select("id", "event_type")


@query("""SELECT doc_id AS attachment_id, length(text) AS raw_chars, CASE WHEN doc_id % 3 <> 0 THEN length(replace(text, ' ', '')) END AS clean_chars FROM documents""", longs=("raw_chars", "clean_chars"))
def attachments_raw_and_clean(t):
    raw = t("documents").select(F.col("doc_id").alias("attachment_id"), F.col("text").alias("raw_text"))
    cleaned = raw.filter("attachment_id % 3 != 0").withColumn("cleaned_text", F.replace("raw_text", F.lit(" "), F.lit("")))
    return silver.raw_and_clean(raw, cleaned).select("attachment_id", "raw_chars", "clean_chars")


@query("""SELECT doc_id, length(text) >= 200 AND lang <> 'en' AS is_valid, array_to_string(list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN lang = 'en' THEN 'language' END], lambda x: x IS NOT NULL), ';') AS errors, CASE WHEN source = 'web' THEN 1 ELSE 0 END AS n_warnings FROM documents""", longs=("n_warnings",))
def validator_hook(t):
    sizes = lambda df: ([F.when(F.length("text") < 200, "short")], [])
    named = lambda df: ([F.when(F.col("lang") == "en", "language")], [F.when(F.col("source") == "web", "web")])
    found = t("documents").transform(quality.validation(sizes, named))
    return found.select("doc_id", "validation.is_valid", F.array_join("validation.errors", ";").alias("errors"), F.size("validation.warnings").alias("n_warnings"))
