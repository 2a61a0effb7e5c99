"""Ingestion plans: raw objects to entity tables, and mail records in five stages.

Each is one lazy plan of DataFrame transforms; nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import enrich, text
from tessera.operators import chunk, graph, quality
from tessera.sources import files, mail


def _checksum(**fields):
    """A digest of the canonical JSON of some fields."""
    return F.sha2(text.canonical_json(fields), 256)


def _iso(name: str):
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")


def typed(objects: DataFrame) -> DataFrame:
    rows = files.with_metadata(objects)
    return rows.withColumn("source_type", files.source_type(rows))


def documents(objects: DataFrame) -> DataFrame:
    """Document rows with clean content, language and checksum of the bytes."""
    rows = files.document_text(typed(objects).filter("source_type = 'document'"))
    content = text.clean(F.col("text"))
    return rows.select(
        graph.node_id(F.lit("documents"), F.col("source")).alias("id"),
        "source",
        "source_type",
        F.col("object_key").alias("source_object_id"),
        F.col("filename").alias("title"),
        content.alias("content"),
        "checksum",
        "mime_type",
        "size_bytes",
        "bucket",
        F.col("object_key").alias("path"),
        F.col("modified").alias("created_time"),
        "read_error",
    ).withColumns({"language": enrich.language(F.col("content")), "processing_status": F.when(F.col("content") != "", "completed").otherwise("failed"), "error_message": F.when(F.col("content") == "", F.coalesce("read_error", F.lit("no text")))}).drop("read_error")


def communications(objects: DataFrame) -> DataFrame:
    rows = mail.messages(typed(objects).filter("source_type = 'email'"))
    rows = rows.withColumns({"subject": text.clean(F.col("subject")), "body": text.clean(F.col("body")), "source_object_id": F.coalesce("message_key", "object_key")})
    rows = rows.withColumn("checksum", _checksum(message_key=F.col("message_key"), subject=F.col("subject"), sender_email=F.col("sender_email"), body=F.col("body"), recipients=F.array_join(F.col("recipients.email"), ", ")))
    return rows.withColumns({"id": graph.node_id(F.lit("communications"), F.col("source"), F.col("source_object_id")), "processing_status": F.lit("completed")})


def events(objects: DataFrame) -> DataFrame:
    rows = mail.events(typed(objects).filter("source_type = 'calendar'"))
    rows = rows.withColumns({"title": text.clean(F.col("title")), "description": text.clean(F.col("description")), "source_object_id": F.coalesce("event_key", "object_key")})
    rows = rows.withColumn("checksum", _checksum(event_key=F.col("event_key"), title=F.col("title"), description=F.col("description"), start_time=_iso("start_time"), end_time=_iso("end_time")))
    return rows.withColumns({"id": graph.node_id(F.lit("events"), F.col("source"), F.col("source_object_id")), "processing_status": F.lit("completed")})


def attached_files(found: DataFrame) -> DataFrame:
    """File rows of communications' attachments; their key is parent and path."""
    rows = mail.allowed_attachments(found.select(F.col("id").alias("parent_id"), "bucket", "source_object_id", "attachments"))
    path = F.concat_ws("/", "source_object_id", "filename")
    return rows.select(graph.node_id(F.lit("files"), F.col("parent_id"), path).alias("id"), "filename", text.extension(F.col("filename")).alias("extension"), "mime_type", F.col("size").alias("size_bytes"), F.lit("").alias("checksum"), "bucket", path.alias("path"), F.lit("communication").alias("parent_type"), "parent_id")


def run(objects: DataFrame) -> dict[str, DataFrame]:
    """Entity tables, rows in quarantine, and validation warnings, by name."""
    docs, comms, meets = documents(objects), communications(objects), events(objects)
    named = {"documents": docs, "communications": comms, "events": meets, "files": attached_files(comms)}
    spec = {"documents": "document", "communications": "communication", "events": "event"}
    problems = None
    for table, schema in spec.items():
        rows = named[table].withColumn("problems", quality.schema_errors(named[table], schema)).filter(F.size("problems") > 0).select(F.lit(table).alias("table"), "id", "problems")
        problems = rows if problems is None else problems.unionByName(rows)
    return named | {"problems": problems}


def mail_records(emails: DataFrame, attachments: DataFrame) -> dict[str, DataFrame]:
    """Validation, cleaning, normalising and enrichment of mails (id, thread_id, subject, sender,
    received_at) and their attachments (email_id, attachment_id, filename, raw_text, size, data)."""
    att = attachments.withColumns({
        "validation": enrich.raw_text_validation(F.col("raw_text")),
        "cleaned_text": text.clean_mail_text(F.col("raw_text")),
        "filename": text.clean_filename(F.col("filename")),
    })
    att = att.withColumn("normalized_text", text.normalized(F.col("cleaned_text")))
    att = att.withColumns({
        "cleaning_ops": text.cleaning_operations(F.coalesce("raw_text", F.lit("")), F.col("cleaned_text")),
        "normalized_filename": text.normalize_filename(F.col("filename")),
        "file_category": text.file_category(F.col("filename")),
        "size_kb": F.round(F.col("size") / 1024, 2),
        "content_hash": F.coalesce(F.sha2("data", 256), F.lit("")),
        "language": enrich.language(F.col("normalized_text")),
        "text_length": F.length("normalized_text"),
        "keywords": F.transform(F.slice(enrich.ranked(enrich.keyword_tokens(F.col("normalized_text"))), 1, 5), lambda r: r["word"]),
    })
    whole = att.groupBy("email_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attachment_id", "normalized_text"))), lambda x: x["normalized_text"]), " ").alias("all_text"), F.count("*").alias("attachment_count"), F.collect_list(F.struct(F.col("attachment_id").alias("id"), "filename", "size")).alias("__a"))
    rec = emails.join(whole, emails["id"] == whole["email_id"], "left").drop("email_id").withColumnRenamed("id", "email_id")
    none = F.array().cast("array<struct<id:string,filename:string,size:bigint>>")
    rec = rec.withColumn("all_text", F.coalesce("all_text", F.lit("")))
    sender = text.clean_sender(F.col("sender"))
    rec = rec.withColumns({
        "metadata_validation": enrich.metadata_validation(F.col("email_id"), F.col("subject"), F.col("sender"), F.coalesce(F.col("__a").cast("array<struct<id:string,filename:string,size:bigint>>"), none)),
        "subject": text.clean_subject(F.col("subject")),
        "sender_name": sender["name"],
        "sender_email": sender["email"],
        "received_at": text.clean_date(F.col("received_at")),
        "attachment_count": F.coalesce("attachment_count", F.lit(0)),
        "language": enrich.language(F.col("all_text")),
        "content_type": enrich.content_type(F.col("subject"), F.col("all_text")),
        "keywords": F.slice(enrich.ranked(enrich.keyword_tokens(F.col("all_text"))), 1, 10),
        "detected_dates": enrich.dates(F.col("all_text")),
        "readability": enrich.readability(F.col("all_text")),
        "total_text_length": F.length("all_text"),
    }).drop("__a", "sender")
    chunks = rec.select("email_id", F.posexplode(chunk.paragraphs(F.col("all_text"))).alias("chunk_index", "text")).withColumn("length", F.length("text"))
    return {"silver_records": rec.drop("all_text"), "silver_texts": rec.select("email_id", "all_text"), "silver_attachments": att.drop("data", "raw_text"), "silver_chunks": chunks}


def raw_and_clean(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Every raw attachment beside its cleaned text (null where it has none), by attachment_id."""
    beside = cleaned.select("attachment_id", "cleaned_text")
    return raw.select("attachment_id", "raw_text").join(beside, "attachment_id", "left").select("attachment_id", "raw_text", "cleaned_text", F.length("raw_text").alias("raw_chars"), F.length("cleaned_text").alias("clean_chars"))
