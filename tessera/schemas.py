"""Schemas of the tables of every layer, as DDL."""

from __future__ import annotations

from pyspark.sql import types as T

_COMMON = "id string, source string, source_type string, source_object_id string"
_TIMES = "processing_status string, error_message string, processed_at timestamp, created_at timestamp, updated_at timestamp"
_PEOPLE = "array<struct<email:string,name:string>>"

TABLES: dict[str, str] = {
    "documents": f"{_COMMON}, title string, content string, checksum string, mime_type string, size_bytes bigint, bucket string, path string, language string, page_count int, author string, created_time timestamp, updated_time timestamp, metadata string, raw_json string, {_TIMES}",
    "communications": f"{_COMMON}, thread_id string, subject string, body string, sender_name string, sender_email string, recipients {_PEOPLE}, cc {_PEOPLE}, bcc {_PEOPLE}, received_at timestamp, sent_at timestamp, has_attachments boolean, attachment_count int, in_reply_to string, message_id string, checksum string, {_TIMES}",
    "events": f"{_COMMON}, title string, description string, location string, organizer_name string, organizer_email string, attendees array<struct<name:string,email:string,response:string>>, start_time timestamp, end_time timestamp, is_all_day boolean, recurrence array<string>, status string, checksum string, {_TIMES}",
    "files": "id string, filename string, extension string, mime_type string, size_bytes bigint, checksum string, bucket string, path string, parent_type string, parent_id string",
    "contacts": "id string, source string, name string, email string, phone string, organization string, role string",
    "processing_logs": "pipeline_name string, status string, started_at timestamp, completed_at timestamp, source_count bigint, processed_count bigint, failed_count bigint, skipped_count bigint, errors string",
    "gold_nodes": "id string, type string, subtype string, name string, summary string, content string, properties map<string,string>, traits array<string>, keywords array<string>, source_ref struct<table:string,id:string,source:string,source_type:string,checksum:string>, status string, confidence double, importance int, effective_start timestamp, effective_end timestamp, embedding_text string, embedding_vector array<double>",
    "gold_edges": "source_node_id string, target_node_id string, predicate string, weight double, shared string",
    "gold_timeline": "node_id string, field string, new_value string",
    "chunks": "id string, parent_node_id string, parent_type string, content string, chunk_index int, chunk_count int, embedding array<double>, metadata map<string,string>",
    "agent_events": "trace_id string, session_id string, kind string, at timestamp, call_id string, step_id string, tool string, tokens bigint, cost double, error string, description string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
