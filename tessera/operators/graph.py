"""Nodes, agents, edges and timelines of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed, text


def node_id(*parts: Column) -> Column:
    """A key made from natural keys, the same in every run."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def classify_document(title: Column, source_id: Column) -> Column:
    """Struct of type, subtype, name, importance, confidence and status of a document's node."""
    name = F.coalesce(F.nullif(title, F.lit("")), source_id, F.lit(""))
    ext = text.extension(name)
    kind = text.lookup(ext, {k: v[0] for k, v in fixed.NODE_TYPES.items()}, "document")
    sub = text.lookup(ext, {k: v[1] for k, v in fixed.NODE_TYPES.items()}, "generic")
    shown = F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Document "), source_id))
    return F.struct(kind.alias("type"), sub.alias("subtype"), shown.alias("name"), F.when(kind == "resource", 1).otherwise(2).alias("importance"), F.lit(0.95).alias("confidence"), F.lit("active").alias("status"))


def classify_communication(subject: Column, source_id: Column) -> Column:
    shown = F.coalesce(F.nullif(subject, F.lit("")), F.concat(F.lit("Email "), source_id))
    return F.struct(F.lit("communication").alias("type"), F.lit("email").alias("subtype"), shown.alias("name"), F.lit(2).alias("importance"), F.lit(0.95).alias("confidence"), F.lit("active").alias("status"))


def classify_event(title: Column, source_id: Column, organizer: Column, start: Column, end: Column, status: Column) -> Column:
    """A meeting's importance grows with an organizer, and with both times."""
    led = F.coalesce(organizer, F.lit("")) != ""
    importance = F.when(led & start.isNotNull() & end.isNotNull(), 3).when(led, 2).otherwise(1)
    shown = F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Event "), source_id))
    return F.struct(F.lit("activity").alias("type"), F.lit("meeting").alias("subtype"), shown.alias("name"), importance.alias("importance"), F.lit(0.95).alias("confidence"), F.coalesce(F.nullif(status, F.lit("")), F.lit("active")).alias("status"))


def agents(mentions: DataFrame) -> DataFrame:
    """One agent for each e-mail of mentions (seq, email, name, source): the first name seen wins, the
    e-mail stands in for none."""
    known = mentions.filter("email is not null and email != ''")
    first = known.groupBy("email").agg(F.min(F.struct("seq", "name", "source")).alias("m"))
    name = F.coalesce(F.nullif(F.col("m.name"), F.lit("")), F.col("email"))
    return first.select(node_id(F.lit("agents"), F.col("email")).alias("id"), F.lit("agent").alias("type"), F.lit("person").alias("subtype"), name.alias("name"), "email", F.coalesce("m.source", F.lit("unknown")).alias("source"), F.lit(0.9).alias("confidence"), F.lit(2).alias("importance"))


def role_edges(mentions: DataFrame, found: DataFrame) -> DataFrame:
    """Edges between agents and what mentions (seq, node_id, email, role) name: the sender and the
    organizer lead to the node, the others are led to."""
    predicates = {"sender": "sends", "to": "to", "cc": "cc", "organizer": "organizes", "attendee": "participates_in"}
    both = mentions.join(found.select(F.col("id").alias("agent_id"), F.col("email").alias("__e")), F.col("email") == F.col("__e"))
    leads = F.col("role").isin("sender", "organizer", "attendee")
    return both.select(F.when(leads, F.col("agent_id")).otherwise(F.col("node_id")).alias("source_node_id"), F.when(leads, F.col("node_id")).otherwise(F.col("agent_id")).alias("target_node_id"), text.lookup(F.col("role"), predicates, "to").alias("predicate"), F.lit(1.0).alias("weight")).distinct()


def shared_edges(members: DataFrame, group: str, node: str, predicate: str, weight: float, cap: int = 100) -> DataFrame:
    """Edges between nodes of one group (a concept, an address, a thread), at most ``cap`` a group.

    The cap is the operator's: the first pairs in order of nodes. They lie among the first nodes, so
    a group is cut to those that the capped pairs need before it is joined with itself: the pairs
    made are a small multiple of those kept. Of a pair that several groups link the least group is
    named.
    """
    rows = members.select(F.lower(F.col(group).cast("string")).alias("g"), F.col(node).alias("n")).filter("g is not null and n is not null").distinct()
    # Row i of a group of m starts m - i pairs; pairs (first, any) come first, so few firsts and the
    # first cap + 1 nodes are enough.
    placed = _first(rows, cap + 1)
    # A column of row numbers within the first nodes of each group.
    w = Window.partitionBy("g").orderBy("n")
    placed = placed.withColumn("r", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy("g")))
    # Pairs that begin at earlier rows come before: with m nodes row r begins after (r-1)(2m-r)/2 pairs.
    a = placed.select("g", "m", F.col("n").alias("a"), F.col("r").alias("ra")).filter(F.expr("(ra - 1) * (2 * m - ra) / 2") < cap)
    b = placed.select(F.col("g").alias("gb"), F.col("n").alias("b"), F.col("r").alias("rb"))
    pairs = a.join(b, (F.col("g") == F.col("gb")) & (F.col("ra") < F.col("rb")))
    rank = F.expr("(ra - 1) * (2 * m - ra) / 2 + (rb - ra)")
    kept = pairs.filter(rank <= cap)
    return kept.groupBy("a", "b").agg(F.min("g").alias("shared")).select(F.col("a").alias("source_node_id"), F.col("b").alias("target_node_id"), F.lit(predicate).alias("predicate"), F.lit(weight).alias("weight"), "shared")


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The first n nodes of each group. Groups are cut in salted parts before their rows meet, so a
    hot group costs n rows a part."""
    salted = rows.withColumn("s", F.pmod(F.xxhash64("n"), F.lit(64)))
    part = salted.withColumn("r", F.row_number().over(Window.partitionBy("g", "s").orderBy("n"))).filter(F.col("r") <= n).select("g", "n")
    return part.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("n"))).filter(F.col("r") <= n).select("g", "n")


def edge_details(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of both ends."""
    s = nodes.select(F.col("id").alias("source_node_id"), F.col("name").alias("source_name"))
    t = nodes.select(F.col("id").alias("target_node_id"), F.col("name").alias("target_name"))
    return edges.join(s, "source_node_id").join(t, "target_node_id")


def neighbours(edges: DataFrame, node, direction: str = "both", predicate: str | None = None) -> DataFrame:
    out, into = F.col("source_node_id") == node, F.col("target_node_id") == node
    rows = edges.filter({"outgoing": out, "incoming": into, "both": out | into}[direction])
    return rows.filter(F.col("predicate") == predicate) if predicate else rows


def timeline(nodes: DataFrame, fields: tuple[str, ...] = ("effective_start", "effective_end")) -> DataFrame:
    """One entry for each set time field of each node."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("timestamp").alias("at")) for f in fields])
    rows = nodes.select(F.col("id").alias("node_id"), F.explode(entries).alias("e")).filter("e.at is not null")
    return rows.select("node_id", "e.field", F.date_format("e.at", "yyyy-MM-dd'T'HH:mm:ss").alias("new_value"))


def merge_concepts(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes (id, traits, keywords) with the traits and keywords found for them added."""
    n = nodes.join(found.select(F.col("id").alias("__i"), F.col("traits").alias("__t"), F.col("keywords").alias("__k")), F.col("id") == F.col("__i"), "left")
    empty = F.array().cast("array<string>")
    return n.withColumn("traits", F.array_union(F.coalesce("traits", empty), F.coalesce("__t", empty))).withColumn("keywords", F.array_union(F.coalesce("keywords", empty), F.coalesce("__k", empty))).drop("__i", "__t", "__k")
