"""Readers, sinks, plans and streams on small fixtures."""

import base64
import csv
import io
import json
import zipfile
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas
from tessera.operators import chunk, dedup, graph, quality, relational, schedule, search, telemetry, trace
from tessera.plans import api, gold, silver
from tessera.sources import files, mail, sinks
from tessera.streaming import ingest
from tessera.streaming import telemetry as streams


def docx(paragraphs, table=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}{f'<w:tbl>{rows}</w:tbl>' if rows else ''}</w:body></w:document>")
    return out.getvalue()


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="One" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><x Id="a" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def letter(key="m1", thread="t1", body="Hello <b>there</b> friends"):
    data = base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")
    headers = {"Subject": "Plan &amp; budget", "From": "Ann <Ann@x.org>", "Date": "Tue, 30 Jun 2026 11:42:32 +0000", "To": "Bob <bob@x.org>", "Message-ID": "<1>"}
    parts = [{"mimeType": "text/plain", "filename": "", "body": {"data": data, "size": 3}}, {"mimeType": "application/pdf", "filename": "a.PDF", "body": {"size": 7}}, {"mimeType": "multipart/mixed", "parts": [{"mimeType": "image/png", "filename": "b.png", "body": {"size": 1}}]}]
    return {"id": key, "threadId": thread, "payload": {"mimeType": "multipart/mixed", "headers": [{"name": k, "value": v} for k, v in headers.items()], "parts": parts}}


CALENDAR = {"items": [{"id": "e1", "summary": "Standup", "organizer": {"displayName": "Ann", "email": "ann@x.org"}, "attendees": [{"displayName": "Bob", "email": "bob@x.org"}], "start": {"dateTime": "2026-07-01T08:30:00Z"}, "end": {"dateTime": "2026-07-01T09:00:00Z"}}, {"id": "e2", "summary": "Holiday", "start": {"date": "2026-07-02"}, "end": {"date": "2026-07-03"}}]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("objects")
    (d / "sub").mkdir()
    (d / "plan.docx").write_bytes(docx(["Kế hoạch", " ", "Ngày 01/06/2026", "08:30-09:00 | Họp nhóm"], [["a", "b"]]))
    (d / "t.xlsx").write_bytes(xlsx())
    (d / "n.txt").write_bytes(b"plain \xff text of a note")
    (d / "c.csv").write_text('a,"b\nc"\nd,e\n')
    (d / "bad.docx").write_bytes(b"not a zip")
    (d / "p.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\nstream\nBT (Hello \\(you\\)) Tj ET\nendstream\n")
    (d / "sub" / "m.json").write_text(json.dumps(letter()))
    (d / "many.json").write_text(json.dumps([letter("m2"), letter("m3", "t2")]))
    (d / "cal.json").write_text(json.dumps(CALENDAR))
    (d / "other.json").write_text("{broken")
    return str(d)


def test_listing_and_sniffing(spark, folder):
    rows = files.with_metadata(files.objects(spark, folder))
    found = {r.filename: r.t for r in rows.select("filename", files.source_type(rows).alias("t")).collect()}
    assert found["m.json"] == "email"
    assert found["many.json"] == "email"
    assert found["cal.json"] == "calendar"
    assert found["other.json"] == "document"
    assert files.with_extension(rows, ".TXT").count() == 1
    assert "content" not in files.listed(rows).columns


def test_document_readers(spark, folder):
    rows = files.with_metadata(files.objects(spark, folder))
    found = {r.filename: r.text for r in files.document_text(rows).select("filename", "text").collect()}
    assert found["plan.docx"] == "Kế hoạch\nNgày 01/06/2026\n08:30-09:00 | Họp nhóm\n\na | b"
    assert found["t.xlsx"] == "=== Sheet: One ===\nname |  | 5"
    assert found["n.txt"] == "plain � text of a note"
    assert found["c.csv"] == "a | b\nc\nd | e"
    assert found["p.pdf"] == "Hello (you)"
    assert found["bad.docx"] == ""
    errors = {r.filename: r.read_error for r in files.document_text(rows).select("filename", "read_error").collect()}
    assert errors["bad.docx"].startswith("BadZipFile")
    assert {k for k, v in errors.items() if v} == {"bad.docx"}
    files.register_parser(".CSV", lambda data: data.decode().upper())
    try:
        assert {r.filename: r.text for r in files.document_text(rows).collect()}["c.csv"] == 'A,"B\nC"\nD,E\n'
    finally:
        files.register_parser(".csv", files.csv_text)
    assert list(csv.reader(io.StringIO("a,b")))  # the format itself


def pdf(content, fonts=b"", extra=b""):
    body = zlib.compress(content)
    return b"%PDF-1.5\n1 0 obj\n<< /Type /Page /Resources << /Font << " + fonts + b" >> >> /Contents 2 0 R >>\nendobj\n2 0 obj\n<< /Length " + str(len(body)).encode() + b" /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream\nendobj\n" + extra + b"%%EOF"


def test_pdf():
    cmap = "1 beginbfchar\n<0003> <0020>\nendbfchar\n2 beginbfrange\n<0024> <003D> <0041>\n<0050> <0051> [<1EA5> <00E9>]\nendbfrange".encode()
    table = b"3 0 obj\n<< /Type /Font /ToUnicode 4 0 R >>\nendobj\n4 0 obj\n<< >>\nstream\n" + cmap + b"\nendstream\nendobj\n"
    assert files.pdf_text(pdf(b"BT /F1 12 Tf <0024002500030050> Tj 0 -14 Td [<0051> -20 <0026>] TJ ET", b"/F1 3 0 R", table)) == "AB \u1ea5\n\u00e9C"
    assert files.pdf_text(pdf(b"BT (a\\(b\\)) Tj T* [(c) 5 (d\\101)] TJ (e) ' ET")) == "a(b)\ncdAe"
    packed = b"3 0 " + b"<< /Type /Font /ToUnicode 4 0 R >>"
    held = zlib.compress(packed)
    stored = b"9 0 obj\n<< /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode >>\nstream\n" + held + b"\nendstream\nendobj\n4 0 obj\n<< >>\nstream\n" + cmap + b"\nendstream\nendobj\n"
    assert files.pdf_text(pdf(b"BT /F1 9 Tf <0026> Tj ET", b"/F1 3 0 R", stored)) == "C"
    assert files.pdf_text(b"%PDF-1.4 nothing") == files.pdf_text(b"no pdf") == ""


def test_ingestion_and_graph(spark, folder):
    found = silver.run(files.objects(spark, folder))
    mails = found["communications"].collect()
    assert sorted(m.message_key for m in mails) == ["m1", "m2", "m3"]
    assert [(p.name, p.email) for p in mails[0].recipients] == [("Bob", "bob@x.org")]
    assert mails[0].subject == "Plan & budget"
    assert mails[0].sender_email == "ann@x.org"
    assert mails[0].body == "Hello there friends"
    assert mails[0].attachment_count == 2
    assert {r.filename for r in found["files"].collect()} == {"a.PDF"}
    assert {(e.title, e.is_all_day) for e in found["events"].collect()} == {("Standup", False), ("Holiday", True)}
    built = gold.build(found["documents"], found["communications"], found["events"], dimensions=16)
    predicates = {r.predicate for r in built["gold_edges"].collect()}
    assert {"contains", "sends", "to", "organizes", "participates_in", "same_thread"} <= predicates
    assert built["gold_edges"].filter("source_node_id = target_node_id").count() == 0
    kinds = {r.type for r in built["gold_nodes"].select("type").collect()}
    assert {"document", "communication", "activity", "agent", "event"} <= kinds
    assert built["gold_timeline"].count() >= 5
    pieces = gold.chunks(built["gold_nodes"], 16)
    assert pieces.filter("length(content) < 10").count() == 0
    context = api.retrieve(built["gold_nodes"].withColumn("updated_at", F.lit(None).cast("timestamp")), "standup?", "2026-07-01 00:00:00")
    assert context["search_results"].count() >= 1
    assert any("Standup" in r.section for r in api.prompt_sections(context).collect())
    assert api.answer_sources(context).count() >= 1


def test_blocked_nodes_have_no_edges(spark, tmp_path):
    """Everybody in a list of recipients is an agent; a mail without a checksum breaks its contract, and no
    edge leads to it; what a store has is not added again."""
    people = "array<struct<email:string,name:string>>"
    rows = [("c1", "a" * 64, [("b@x.org", "B"), ("c@x.org", "")]), ("c2", "bad", [("d@x.org", "D")]), ("c3", "b" * 64, [("b@x.org", "other")])]
    comms = spark.createDataFrame(rows, f"id string, checksum string, recipients {people}").selectExpr("id", "'m' as source", "'email' as source_type", "checksum", "concat('Subject ', id) as subject", "id as source_object_id", "'some body of a mail' as body", "cast(null as timestamp) as received_at", "'t' as thread_id", "'a@x.org' as sender_email", "'Ann' as sender_name", "recipients", f"cast(array() as {people}) as cc")
    docs = spark.createDataFrame([], "id string, source string, source_type string, checksum string, title string, source_object_id string, content string, created_time timestamp")
    events = spark.createDataFrame([], f"id string, source string, source_type string, checksum string, title string, source_object_id string, organizer_name string, organizer_email string, attendees {people}, start_time timestamp, end_time timestamp, description string, status string")
    for folder in (None, str(tmp_path / "made")):
        built = gold.build(docs, comms, events, dimensions=8, folder=folder)
        assert built["blocked"].count() == 1
        nodes = {r.id: r for r in built["gold_nodes"].collect()}
        assert {r.name for r in nodes.values() if r.type == "agent"} == {"Ann", "B", "c@x.org"}
        edges = built["gold_edges"].collect()
        assert all(e.source_node_id in nodes and e.target_node_id in nodes for e in edges)
        assert sum(e.predicate == "same_thread" for e in edges) == 1
    store = str(tmp_path / "store")
    for _ in range(2):
        gold.save(built, store)
    assert spark.read.parquet(f"{store}/gold_nodes").count() == len(nodes)
    assert spark.read.parquet(f"{store}/gold_edges").count() == len(edges)


def test_mail_records(spark):
    emails = spark.createDataFrame([("1", "t", "S", "Ann <a@x.org>", "Tue, 30 Jun 2026 11:42:32 +0000"), ("2", "t", None, None, None)], "id string, thread_id string, subject string, sender string, received_at string")
    att = spark.createDataFrame([("1", "a1", "Invoice.PDF", "Payment invoice total 01/06/2026.\r\n" * 20, 2048, bytearray(b"x"))], "email_id string, attachment_id string, filename string, raw_text string, size bigint, data binary")
    found = silver.mail_records(emails, att)
    r = {x.email_id: x for x in found["silver_records"].collect()}
    assert r["1"].content_type == "invoice"
    assert r["1"].detected_dates == ["01-06-2026"]
    assert r["2"].attachment_count == 0
    assert not r["2"].metadata_validation.errors
    assert found["silver_chunks"].filter("email_id = '1'").count() > 1
    assert found["silver_attachments"].first().size_kb == 2.0


def test_sinks(spark, tmp_path):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, "")], "id int, checksum string")
    path = str(tmp_path / "t")
    sinks.insert_if_absent(new, path, ["checksum"], "id")
    sinks.insert_if_absent(new, path, ["checksum"], "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3, 3, 4, 4]
    log = sinks.run_log(spark.createDataFrame([("failed", "x", 1), ("success", None, 2)], "status string, error string, key int"), "p", "2026-01-01 00:00:00", "2026-01-01 00:01:00").first()
    assert (log.status, log.failed_count, log.errors) == ("partial", 1, "x")
    events = sinks.lineage(new, "job", F.lit("a"), F.col("id").cast("string"), F.lit("2026-01-01").cast("timestamp"))
    assert sinks.lineage_counts(events).first().n == 4
    held = spark.createDataFrame([('{"embedding_vector": [1.0, 2.0]}',), (None,)], "metadata string")
    assert [r.embedding_vector for r in sinks.vectors_from_json(held).collect()] == [[1.0, 2.0], None]
    for t in schemas.TABLES:
        assert schemas.schema(t).fields


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Lịch\nNgày 01/06/2026\nNgày 02/06/2026\n08:30-09:00 | Họp\n25:00 - 26:00 x\nThứ Tư - 03/06/2026\n10:00 - 09:00 Late\nSprint Planning\ngym buổi tối", [("Họp", "2026-06-01 08:30:00", "2026-06-01 09:00:00", 4, 30), ("Họp", "2026-06-02 08:30:00", "2026-06-02 09:00:00", 4, 30), ("Late", "2026-06-03 10:00:00", "2026-06-03 10:00:00", 7, 0), ("Sprint Planning", "2026-06-03 00:00:00", None, 8, None)]),
        ("Thứ Hai – 1/6/2026\n8:00–8:45 A\nNgay 3/6\n9:00 - 10:00 | B\nreview notes", [("A", "2026-06-01 08:00:00", "2026-06-01 08:45:00", 2, 45), ("B", "2026-06-03 09:00:00", "2026-06-03 10:00:00", 4, 60), ("review notes", "2026-06-03 00:00:00", None, 5, None)]),
        ("Ngày 5/6/2026\nprepare slides\nNgày 6/6/2026\nThời gian | Công việc\n---\n9:00-9:30 Sync\n9:00-9:30 Sync", [("prepare slides", "2026-06-05 00:00:00", None, 2, None), ("Sync", "2026-06-05 09:00:00", "2026-06-05 09:30:00", 6, 30), ("Sync", "2026-06-06 09:00:00", "2026-06-06 09:30:00", 6, 30)]),
        ("31/02/2026\nno day yet\n9:00 - 9:30 lost\n28/02/2026 x\n9:00 - 9:30 found", [("found", "2026-02-28 09:00:00", "2026-02-28 09:30:00", 5, 30)]),
        ("9:00 - 10:00 no date anywhere\nnor here", []),
        ("", []),
        (None, []),
    ],
)
def test_schedule(spark, text, wanted):
    df = spark.createDataFrame([(1, text), (1, "1/1/2026\nother text")], "id int, t string")
    found = schedule.extract(df, "t", "id")
    cell = lambda v: None if v is None else str(v)
    got = [(r.name, str(r.effective_start), cell(r.effective_end), r.line_number, r.duration_minutes) for r in found.orderBy("line_number", "effective_start").collect() if r.name != "other text"]
    assert got == wanted
    assert {(r.importance, r.status) for r in found.collect()} <= {(1, "tentative"), (2, "active")}
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert schedule.extract(df.limit(0), "t", "id").count() == 0


def test_record_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(60))
    att = spark.createDataFrame([(1, 1, "h1", long), (2, 2, "h1", "x"), (3, 3, "h3", long + " end"), (4, 4, "", "short")], "seq int, record_seq int, content_hash string, cleaned_text string")
    found = {r.seq: r.reason for r in dedup.attachment_duplicates(att).collect()}
    assert found == {2: "duplicate_content_exact_hash", 3: "duplicate_text_similarity"}
    rec = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "seq int, email_id string")
    assert {r.seq: r.reason for r in dedup.record_duplicates(rec, att).collect()} == {2: "all_attachments_are_duplicates", 3: "duplicate_email_id"}


def test_shared_edges_have_a_cap(spark):
    members = spark.createDataFrame([("G" if i % 2 else "g", i) for i in range(300)], "g string, n int")
    assert graph.shared_edges(members, "g", "n", "p", 0.5, cap=100).count() == 100
    assert graph.shared_edges(members.limit(0), "g", "n", "p", 0.5).count() == 0


def test_contracts_split(spark):
    df = spark.createDataFrame([("document", "0" * 64), ("thing", "x")], "type string, c string").withColumns({"source_ref": F.struct(F.lit("documents").alias("table"), F.lit("1").alias("id"), F.col("c").alias("checksum")), "embedding_text": F.lit("long enough text")})
    good, bad = quality.split_blocked(df, "silver_to_gold")
    assert good.count() == 1
    assert {v.field for v in bad.first().violations} == {"type", "source_ref.checksum"}
    mails = spark.createDataFrame([("m1", "t1", ("text/plain", [("Subject", None)]))], "id string, threadId string, payload struct<mimeType:string,headers:array<struct<name:string,value:string>>>")
    said = mails.select(quality.contract_violations(mails, "bronze_to_silver").alias("v")).first().v
    assert [v.message for v in said] == ["fewer than 3 items", "an element without value"]


def test_traces(spark):
    at = "2026-01-01 00:00:0"
    events = spark.createDataFrame([("t", "s", "record_tool_call", at + "1", "c1", None, "search", 0, 0.0, None, None), ("t", "s", "record_tool_retry", at + "2", "c1", None, None, 0, 0.0, None, None), ("t", "s", "complete_tool_call", at + "3", "c1", None, None, 5, 0.1, None, None), ("t", "s", "record_tool_call", at + "1", "c2", None, "x", 0, 0.0, None, None), ("t", "s", "record_plan_step", at + "1", None, "p1", None, 0, 0.0, None, "do"), ("t", "s", "complete_plan_step", at + "2", None, "p1", None, 0, 0.0, None, None)], "trace_id string, session_id string, kind string, at string, call_id string, step_id string, tool string, tokens bigint, cost double, error string, description string").withColumn("at", F.col("at").cast("timestamp"))
    calls = {c.call_id: c for c in trace.tool_calls(events).collect()}
    assert (calls["c1"].status, calls["c1"].retry_count, calls["c1"].latency_ms) == ("success", 1, 2000.0)
    assert calls["c2"].status == "retrying"
    total = trace.totals(trace.tool_calls(events), trace.plan_steps(events), events.select("trace_id", "session_id").distinct()).first()
    assert (total.n_calls, total.tokens, total.completion_rate) == (2, 5, 1.0)
    assert trace.sessions(trace.totals(trace.tool_calls(events), trace.plan_steps(events), events.select("trace_id", "session_id").distinct())).first().n_traces == 1


def test_search_falls_back_to_tokens(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id int, t string")
    assert [r.id for r in search.keyword_search(df, "alpha?", ["t"], [F.asc("id")]).collect()] == [1]
    assert search.keyword_search(df, "?", ["t"], [F.asc("id")]).count() == 0
    assert relational.query_terms("a bc ?") == ["bc"]
    assert search.stem("running") == search.stem("runs") == "run"


def test_chunks_cover_texts(spark):
    df = spark.createDataFrame([(1, "word " * 400), (2, "x" * 1200), (3, ""), (4, None), (5, "a. b. " * 200)], "id int, t string")
    for f in (chunk.windows, chunk.paragraphs, chunk.separated):
        rows = chunk.rows(df, f(F.col("t")), "id")
        assert chunk.contiguous(rows).filter("not contiguous").count() == 0
    assert max(len(r.content) for r in chunk.rows(df.filter("id = 2"), chunk.separated(F.col("t")), "id").collect()) == 500


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.rates(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("rates").collect()))
    want = sorted(map(tuple, telemetry.rate(events, "ts", "event_type").collect()))
    assert got == want


def test_stream_into_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "checksum": "x"}\n{"id": 2, "checksum": "x"}\n')
    rows = ingest.landing(spark, str(tmp_path / "in"), "id int, checksum string")
    for _ in range(2):
        ingest.into_table(rows, str(tmp_path / "out"), ["checksum"], "id", str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_mail_without_parts(spark):
    df = spark.createDataFrame([(json.dumps({"id": "1"}),), ("{bad",), (None,)], "content string")
    rows = mail.messages(df).collect()
    assert [r.body for r in rows if r.message_key == "1"] == [""]


def test_migration_adds_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1)], "id string, n long").write.parquet(path)
    wanted = T.StructType.fromDDL("id string, n long, status string")
    assert sinks.migrate(spark, path, wanted) == ["status"]
    assert sinks.migrate(spark, path, wanted) == []
    assert sinks.current(spark, path).collect()[0].asDict() == {"id": "a", "n": 1, "status": None}


def test_documents_are_read_in_slices_of_bytes(spark):
    sizes = [3, 3, 3, 20, None, 1]
    contents = pd.Series([None if n is None else b"x" * n for n in sizes])
    assert list(files.slices(contents, 6)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(files.slices(pd.Series([], dtype=object), 6)) == []
