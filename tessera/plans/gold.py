"""The knowledge graph: nodes, concepts, agents, edges, timeline and embeddings from entity tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import enrich, text, vectors
from tessera.operators import chunk, dedup, graph, quality, schedule
from tessera.sources import sinks


def _ref(table: str, rows: DataFrame):
    kind = F.col("source_type") if "source_type" in rows.columns else F.lit(table)
    return F.struct(F.lit(table).alias("table"), F.col("id").alias("id"), F.col("source").alias("source"), kind.alias("source_type"), F.col("checksum").alias("checksum"))


def _nodes(rows: DataFrame, table: str, kind, content, start, end) -> DataFrame:
    out = rows.select(graph.node_id(F.lit(table), F.col("id")).alias("node_id"), kind.alias("k"), content.alias("content"), start.cast("timestamp").alias("effective_start"), end.cast("timestamp").alias("effective_end"), _ref(table, rows).alias("source_ref"))
    return out.select(F.col("node_id").alias("id"), "k.*", "content", "effective_start", "effective_end", "source_ref")


def nodes(docs: DataFrame, comms: DataFrame, events: DataFrame) -> DataFrame:
    """Nodes of all entities with concepts and embedding text; each natural key once."""
    null = F.lit(None)
    d = _nodes(docs, "documents", graph.classify_document(F.col("title"), F.col("source_object_id")), F.col("content"), F.col("created_time"), null)
    c = _nodes(comms, "communications", graph.classify_communication(F.col("subject"), F.col("source_object_id")), F.col("body"), F.col("received_at"), null)
    e = _nodes(events, "events", graph.classify_event(F.col("title"), F.col("source_object_id"), F.col("organizer_name"), F.col("start_time"), F.col("end_time"), F.col("status")), F.col("description"), F.col("start_time"), F.col("end_time"))
    rows = dedup.first_by(d.unionByName(c).unionByName(e), ["id"], "id")
    return enriched(rows)


def enriched(rows: DataFrame) -> DataFrame:
    found = rows.withColumn("__c", enrich.concepts(F.col("content"), F.col("name")))
    found = found.withColumns({"traits": F.col("__c.traits"), "keywords": F.col("__c.keywords"), "entities": F.col("__c.entities"), "summary": F.lit(None).cast("string")}).drop("__c")
    return found.withColumn("embedding_text", enrich.embedding_text(F.col("name"), F.col("summary"), F.col("content"), F.col("traits"), F.col("keywords")))


def embedded(rows: DataFrame, dimensions: int = 384, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """With the vectors of ``model``, a function of the text (such as a pandas UDF that loads its weights
    once in a worker); a vector of another size, or with broken elements, is null. Without a model
    hashed word vectors stand in."""
    text = F.col("embedding_text")
    return rows.withColumn("embedding_vector", vectors.sound(model(text), dimensions) if model else vectors.hashed(text, dimensions))


def scheduled(document_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event nodes found in documents, and the edges that lead to them."""
    found = schedule.extract(document_nodes, "content", "id")
    key = graph.node_id(F.col("document_id"), F.date_format("effective_start", "yyyy-MM-dd'T'HH:mm:ss"), F.col("name"))
    rows = found.select(key.alias("id"), F.lit("event").alias("type"), F.lit("calendar_entry").alias("subtype"), "name", F.lit(0.9).alias("confidence"), "importance", "status", F.col("raw_text").alias("content"), F.col("effective_start").cast("timestamp").alias("effective_start"), F.col("effective_end").cast("timestamp").alias("effective_end"), "document_id")
    edges = rows.select(F.col("document_id").alias("source_node_id"), F.col("id").alias("target_node_id"), F.lit("contains").alias("predicate"), F.lit(1.0).alias("weight"))
    return rows.drop("document_id"), edges


def mentions(comms: DataFrame, events: DataFrame) -> DataFrame:
    """Who is named where and as what: seq, node_id, email, name, role, source. Everybody in a list of
    recipients is named on their own."""
    node_c, node_e = graph.node_id(F.lit("communications"), F.col("id")), graph.node_id(F.lit("events"), F.col("id"))
    each = lambda c, role: F.transform(c, lambda p: F.struct(p["email"].alias("email"), p["name"].alias("name"), F.lit(role).alias("role")))
    one = lambda email, name, role: F.array(F.struct(F.col(email).alias("email"), F.col(name).alias("name"), F.lit(role).alias("role")))
    none = F.array().cast("array<struct<email:string,name:string>>")
    parts = F.concat(one("sender_email", "sender_name", "sender"), each(F.coalesce("recipients", none), "to"), each(F.coalesce("cc", none), "cc"))
    c = comms.select(F.concat_ws(":", F.lit("1"), "id").alias("seq"), node_c.alias("node_id"), "source", F.explode(parts).alias("p"))
    people = F.concat(one("organizer_email", "organizer_name", "organizer"), each(F.col("attendees"), "attendee"))
    e = events.select(F.concat_ws(":", F.lit("2"), "id").alias("seq"), node_e.alias("node_id"), "source", F.explode(people).alias("p"))
    return c.unionByName(e).select("seq", "node_id", "p.*", "source").filter("email is not null and email != ''")


def discovered(node_rows: DataFrame, said: DataFrame, threads: DataFrame, cap: int = 100) -> DataFrame:
    """Edges between nodes that share a concept, a person or a thread."""
    concepts = node_rows.select("id", F.explode(F.array_union("traits", "keywords")).alias("concept"))
    by_concept = graph.shared_edges(concepts, "concept", "id", "related_to", 0.7, cap)
    by_person = graph.shared_edges(said.select("email", "node_id"), "email", "node_id", "involves", 0.8, cap)
    by_thread = graph.shared_edges(threads, "thread_id", "node_id", "same_thread", 0.9, cap)
    return by_concept.unionByName(by_person).unionByName(by_thread)


def build(docs: DataFrame, comms: DataFrame, events: DataFrame, cap: int = 100, dimensions: int = 384, folder: str | None = None, model: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """All graph tables by name, and the nodes that break their contract. No edge leads to a blocked node.

    Parsing and concepts feed five results: with a ``folder`` they are written there once, and read.
    """
    rows = _kept(nodes(docs, comms, events), folder, "nodes")
    passed, blocked = quality.split_blocked(rows, "silver_to_gold")
    inside, contains = scheduled(passed.filter("type = 'document'"))
    inside, contains = _kept(inside, folder, "scheduled"), _kept(contains, folder, "contains")
    good = passed.select("id")
    said = mentions(comms, events).join(good, F.col("node_id") == F.col("id"), "left_semi")
    people = graph.agents(said.select("seq", "email", "name", "source"))
    threads = comms.filter("thread_id != ''").select("thread_id", graph.node_id(F.lit("communications"), F.col("id")).alias("node_id"))
    threads = threads.join(good, F.col("node_id") == F.col("id"), "left_semi")
    null = F.lit(None).cast("string")
    edges = contains.withColumn("shared", null).unionByName(graph.role_edges(said, people).withColumn("shared", null)).unionByName(discovered(passed, said, threads, cap))
    edges = dedup.first_by(edges, ["source_node_id", "predicate", "target_node_id"], "weight")
    every = embedded(passed, dimensions, model).unionByName(inside, allowMissingColumns=True).unionByName(people.drop("email", "source"), allowMissingColumns=True)
    return {"gold_nodes": every, "gold_edges": edges, "gold_timeline": graph.timeline(every), "blocked": blocked}


def _kept(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    if not folder:
        return df
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def save(built: dict[str, DataFrame], folder: str) -> None:
    """Adds to the tables of a store what they lack: nodes by id, edges by both ends and predicate, the
    timeline by node, field and value. What is there stays as it is."""
    sinks.insert_if_absent(built["gold_nodes"], f"{folder}/gold_nodes", ["id"], "id")
    sinks.insert_if_absent(built["gold_edges"], f"{folder}/gold_edges", ["source_node_id", "predicate", "target_node_id"], "weight")
    sinks.insert_if_absent(built["gold_timeline"], f"{folder}/gold_timeline", ["node_id", "field", "new_value"], "new_value")


def chunks(node_rows: DataFrame, dimensions: int = 384) -> DataFrame:
    """Chunks of ten or more characters of nodes with content, with vectors."""
    rows = chunk.rows(node_rows.filter("content is not null and content != ''"), chunk.separated(F.col("content")), "id", least=10)
    kinds = node_rows.select(F.col("id").alias("parent_id"), F.col("type").alias("parent_type"))
    rows = rows.join(kinds, "parent_id")
    return rows.select(graph.node_id(F.col("parent_id"), F.col("chunk_index").cast("string")).alias("id"), F.col("parent_id").alias("parent_node_id"), "parent_type", "content", "chunk_index", "chunk_count", vectors.hashed(F.col("content"), dimensions).alias("embedding"))


def statistics(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    n = node_rows.groupBy(F.lit("node").alias("what"), F.col("type").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(edge_rows.groupBy(F.lit("edge").alias("what"), F.col("predicate").alias("kind")).agg(F.count("*").alias("n")))
