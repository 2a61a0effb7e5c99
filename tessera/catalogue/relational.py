"""Relational shapes: filters, pages, counts, key joins, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue.registry import query
from tessera.functions.enrich import words
from tessera.operators import dedup, relational
from tessera.plans import api


@query("""SELECT doc_id AS id, source, lang AS language, length(text) AS content_length FROM documents
WHERE lang = 'en' AND (text ILIKE '%the%' OR source ILIKE '%the%') ORDER BY length(text) DESC NULLS LAST, doc_id LIMIT 20 OFFSET 20""", longs=("content_length",))
def doc_list_page(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", F.col("lang").alias("language"))
    rows, _ = api.list_documents(docs, number=2, q="the", sort_by="content_length", language="en")
    return rows.select("id", "source", "language", "content_length")


@query("SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS total_pages FROM documents WHERE source = 'src3'")
def doc_page_totals(t):
    return relational.page_totals(relational.where_equal(t("documents"), source="src3"), 20)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def doc_counts_by_lang_source(t):
    return relational.count_by(t("documents"), "lang", "source")


@query("""SELECT doc_id AS id, sha256(text) AS checksum, length(sha256(text)) = 64 AS checksum_valid, coalesce(lang, '') <> '' AS language_detected,
length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0 AS has_content, length(text) AS content_length, coalesce(source, '') <> '' AS has_source_id FROM documents""", longs=("content_length",))
def doc_quality_report(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.sha2("text", 256).alias("checksum"), F.lit("completed").alias("processing_status"), F.lit(None).cast("string").alias("error_message"), F.col("lang").alias("language"), F.lit("text/plain").alias("mime_type"), F.col("source").alias("source_object_id"))
    return api.quality_report(docs).select("id", "checksum", "checksum_valid", "language_detected", "has_content", "content_length", "has_source_id")


@query("""SELECT o_orderkey AS id, 'success' AS reader, CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'completed' ELSE 'processing' END AS store FROM orders
WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'failed', 'failed' FROM orders WHERE o_orderstatus = 'F'""")
def pipeline_step_status(t):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("processing")
    rows = t("orders").select(F.col("o_orderkey").alias("id"), status.alias("processing_status"), F.lit("x").alias("error_message"), F.lit(None).cast("timestamp").alias("processed_at"))
    return api.pipeline_steps(rows).select("id", F.col("steps")[0]["status"].alias("reader"), F.col("steps")[4]["status"].alias("store"))


@query("SELECT * EXCLUDE (p) FROM (SELECT d.doc_id, d.source, l.doc_id AS p FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE p IS NULL")
def orphan_docs_without_label(t):
    return relational.absent(t("documents").select("doc_id", "source"), t("labels"), "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def pending_ids(t):
    return t("documents").select("doc_id").exceptAll(t("labels").select("doc_id"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def docs_with_good_label(t):
    return relational.present(t("documents").select("doc_id", "source"), t("labels").filter("quality = 1"), "doc_id")


@query("SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def bronze_silver_compare(t):
    return t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left").fillna(-1, ["quality", "toxic"])


@query("""SELECT event_id, user_id, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 3""")
def json_prop_filter(t):
    return t("events").filter(F.get_json_object("props", "$.k") == "3").select("event_id", "user_id", "event_type")


@query("""SELECT count(*) AS n_rows, CAST(count_if(text IS NULL OR text = '') AS BIGINT) AS text_missing, round(count_if(text IS NULL OR text = '') * 100.0 / greatest(count(*), 1), 4) AS text_missing_pct,
CAST(count_if(lang IS NULL OR lang = '') AS BIGINT) AS lang_missing, round(count_if(lang IS NULL OR lang = '') * 100.0 / greatest(count(*), 1), 4) AS lang_missing_pct FROM documents""")
def missing_rates(t):
    return relational.missing_rates(t("documents"), ["text", "lang"])


@query("""SELECT 'documents' AS tbl, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations""")
def table_counts(t):
    out = None
    for name in ("documents", "events", "conversations"):
        rows = t(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50")
def recent_orders(t):
    return relational.top(t("orders").select("o_orderkey", "o_totalprice", "o_orderdate"), 50, F.desc_nulls_last("o_orderdate"), "o_orderkey")


@query("SELECT conv_id, turn, role, length(text) AS chars FROM conversations WHERE conv_id = 7 ORDER BY turn", longs=("chars",))
def thread_lookup(t):
    return t("conversations").filter("conv_id = 7").orderBy("turn").select("conv_id", "turn", "role", F.length("text").alias("chars"))


@query("""SELECT source_count, processed_count, failed_count, skipped_count, CASE WHEN failed_count = 0 THEN 'success' ELSE 'partial' END AS status,
(SELECT string_agg(CAST(user_id AS VARCHAR), '; ' ORDER BY event_id) FROM (SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20)) AS first_errors
FROM (SELECT count(*) AS source_count, CAST(count_if(event_type = 'purchase') AS BIGINT) AS processed_count, CAST(count_if(event_type = 'error') AS BIGINT) AS failed_count, CAST(count_if(event_type NOT IN ('purchase', 'error')) AS BIGINT) AS skipped_count FROM events)""")
def run_summary(t):
    return relational.run_summary(t("events"), "event_type", "user_id", "event_id", done="purchase", failed="error")


@query("""WITH n AS (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 3 = 0), o AS (SELECT c_custkey AS k, upper(c_name) AS name FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name FROM n FULL OUTER JOIN o ON n.k = o.k""")
def contact_upsert(t):
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return dedup.upsert(c.filter("k % 3 = 0"), c.filter("k % 2 = 0").withColumn("name", F.upper("name")), ["k"])


@query("""WITH old AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0), new AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, sha256(text) AS checksum FROM old UNION ALL SELECT doc_id, sha256(text) FROM new WHERE r = 1 AND text NOT IN (SELECT text FROM old)""")
def insert_if_absent(t):
    rows = t("documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return dedup.insert_if_absent(rows.filter("doc_id % 2 = 1"), rows.filter("doc_id % 2 = 0"), ["checksum"], "doc_id")


@query("""SELECT doc_id, length(text) AS chars FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])worthless([^\\p{L}\\p{N}_]|$)')""", longs=("chars",))
def token_lookup(t):
    return t("documents").filter(F.array_contains(words(F.col("text")), "worthless")).select("doc_id", F.length("text").alias("chars"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1, 2""")
def pricing_summary(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT o_orderkey AS id, 1 AS version, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at FROM orders""")
def history_versions(t):
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit("completed").alias("processing_status"))
    return api.history(rows).select("id", F.explode("versions").alias("v")).select("id", "v.version", "v.created_at")


@query("""SELECT d.doc_id, d.source, l.quality FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) WHERE d.lang = 'de' AND l.quality = 0""")
def filtered_semantic_join(t):
    best = t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 0")
    return t("documents").filter("lang = 'de'").select("doc_id", "source").join(best, "doc_id")


@query("""SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def customers_by_nation(t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""WITH f AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 2 = 0), s AS (SELECT doc_id, lang || '!' AS lang, source || '!' AS source FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(f.doc_id, s.doc_id) AS doc_id, coalesce(s.lang, f.lang) AS lang, coalesce(f.source, s.source) AS source FROM f FULL OUTER JOIN s ON f.doc_id = s.doc_id""")
def record_upsert_some_columns(t):
    d = t("documents").select("doc_id", "lang", "source")
    new = d.filter("doc_id % 3 = 0").select("doc_id", F.concat("lang", F.lit("!")).alias("lang"), F.concat("source", F.lit("!")).alias("source"))
    return dedup.upsert(new, d.filter("doc_id % 2 = 0"), ["doc_id"], ["lang"])


@query("""SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_type = 'signup') - INTERVAL 3 DAY AND ts > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2""")
def since_watermark(t):
    from tessera.sources.files import since

    events = t("events")
    mark = events.filter("event_type = 'signup'").agg((F.max("ts") - F.expr("INTERVAL 3 DAYS")).alias("m"))
    state = mark.select((F.greatest("m", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))).alias("last_crawl_at"))
    return since(events, "ts", state).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, i AS word_index, w AS word FROM (SELECT conv_id, turn, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations))""")
def array_positions(t):
    from tessera.sources.sinks import positions

    rows = t("conversations").select("conv_id", "turn", F.split("text", " ").alias("ws"))
    return positions(rows, "ws", "word_index", "word").withColumn("word_index", F.col("word_index").cast("long"))


@query("""SELECT 'copy' AS job, count(*) AS n FROM documents""")
def lineage_by_job(t):
    from tessera.sources import sinks

    events = sinks.lineage(t("documents"), "copy", F.col("source"), F.col("doc_id").cast("string"), F.lit("2024-01-01").cast("timestamp"))
    return sinks.lineage_counts(events)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey = 5 THEN 'failed' ELSE 'pending' END AS processing_status, CASE WHEN o_orderkey = 5 THEN 'bad' END AS error_message FROM orders""")
def status_update(t):
    from tessera.sources import sinks

    rows = t("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("pending").alias("processing_status"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("timestamp").alias("processed_at"))
    return sinks.set_status(rows, "id", "5", "failed", "bad", "2024-01-01 00:00:00").drop("processed_at")
