"""The document API: listing, details, derived states; and retrieval for a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.operators import relational, search

SORTABLE = ("created_at", "title", "size_bytes", "content_length")


def list_documents(docs: DataFrame, number: int = 1, size: int = 20, q: str | None = None, sort_by: str = "created_at", descending: bool = True, **equal) -> tuple[DataFrame, DataFrame]:
    """A page of documents (without their contents) and the totals."""
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("size is 1 to 100, number 1 or more")
    rows = relational.where_equal(docs, **equal)
    if q:
        rows = rows.filter(relational.contains_any_case([c for c in ("title", "content", "checksum", "source") if c in docs.columns], q))
    rows = rows.withColumn("content_length", F.length("content")).drop("content")
    return relational.page(rows, sort_by, descending, number, size, allowed=SORTABLE), relational.page_totals(rows, size)


def document(docs: DataFrame, key, column: str = "id") -> DataFrame:
    return docs.filter(F.col(column) == key)


def files_of(files: DataFrame, parent) -> DataFrame:
    """The files of a parent, by path."""
    return files.filter(F.col("parent_id") == parent).orderBy("path", "id")


def file_at(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def events_from(events: DataFrame, at, most: int = 10) -> DataFrame:
    """The next events from a time on."""
    return events.filter(F.col("start_time") >= F.lit(at).cast(events.schema["start_time"].dataType)).orderBy("start_time", "id").limit(most)


def content(docs: DataFrame, key) -> DataFrame:
    return document(docs, key).select("id", "title", "content", F.coalesce(F.length("content"), F.lit(0)).alias("content_length"))


def pipeline_steps(docs: DataFrame) -> DataFrame:
    """The steps of each document's processing with their states."""
    status = F.coalesce("processing_status", F.lit("pending"))
    early = F.when(status.isin("completed", "processing"), "success").otherwise(status)
    names = ("Reader", "Cleaner", "Validator", "Normalizer")
    steps = F.array(*[F.struct(F.lit(n).alias("name"), early.alias("status"), F.lit(None).cast("string").alias("error")) for n in names], F.struct(F.lit("Store").alias("name"), status.alias("status"), F.when(status == "failed", F.col("error_message")).alias("error")))
    return docs.select("id", steps.alias("steps"), "processed_at", status.alias("status"))


def quality_report(docs: DataFrame) -> DataFrame:
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    text = F.coalesce("content", F.lit(""))
    return docs.select("id", "checksum", F.coalesce(F.length("checksum") == 64, F.lit(False)).alias("checksum_valid"), F.col("processing_status").alias("validation_status"), "error_message", some("language").alias("language_detected"), (strip(text) != "").alias("has_content"), F.length(text).alias("content_length"), some("mime_type").alias("mime_type_valid"), some("source_object_id").alias("has_source_id"))


def history(docs: DataFrame) -> DataFrame:
    version = F.struct(F.lit(1).alias("version"), F.col("created_at").cast("string").alias("created_at"), F.col("updated_at").cast("string").alias("modified_at"), F.col("processing_status").alias("status"))
    return docs.select("id", F.array(version).alias("versions"))


def retrieve(nodes: DataFrame, question: str, now) -> dict[str, DataFrame]:
    """What answers draw on: upcoming items, recent mail, important documents, and search results."""
    order = [F.desc_nulls_last("importance"), F.desc_nulls_last("effective_start"), F.asc("id")]
    return {
        "upcoming": search.upcoming(nodes, now),
        "communications": search.recent(nodes, now),
        "documents": search.important(nodes),
        "search_results": search.keyword_search(nodes, question, ["name", "summary", "content"], order),
    }


_SECTIONS = {
    "upcoming": ("SCHEDULED ITEMS (EVENTS, MEETINGS, DEADLINES)", ["name", "type", "subtype", "summary", "effective_start", "effective_end", "importance"]),
    "communications": ("RECENT COMMUNICATIONS", ["name", "summary", "effective_start", "type", "subtype"]),
    "documents": ("IMPORTANT DOCUMENTS", ["name", "summary", "importance"]),
    "search_results": ("SEARCH RESULTS", ["name", "type", "summary", "effective_start", "importance"]),
}


def prompt_sections(found: dict[str, DataFrame]) -> DataFrame:
    """A section of text for each non-empty part of what was retrieved (a hundred rows at most each)."""
    out = None
    for name, (title, fields) in _SECTIONS.items():
        rows = found[name]
        said = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), F.date_format(f, "yyyy-MM-dd HH:mm") if f.startswith("effective") else F.col(f).cast("string"))) for f in fields if f in rows.columns]
        line = rows.select(F.monotonically_increasing_id().alias("i"), F.concat(F.lit("  "), F.concat_ws(" | ", *said)).alias("l")).filter(F.trim("l") != "")
        text = line.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda x: x["l"]), "\n").alias("t")).filter("t != ''")
        part = text.select(F.lit(name).alias("part"), F.concat(F.lit(f"=== {title} ===\n"), "t").alias("section"))
        out = part if out is None else out.unionByName(part)
    return out


def answer_sources(found: dict[str, DataFrame]) -> DataFrame:
    """Sources of an answer, from all parts in their order."""
    parts = None
    for k, name in enumerate(_SECTIONS):
        rows = found[name].select("id", "type", "name", "summary", "content").withColumn("seq", F.lit(k * 1_000_000) + F.monotonically_increasing_id())
        parts = rows if parts is None else parts.unionByName(rows)
    return search.sources(parts)
