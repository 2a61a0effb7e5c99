"""Keyword, full-text, vector and hybrid search, retrieval context and sources."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.functions.enrich import words
from tessera.functions.stems import stem  # noqa: F401  (part of this module's interface)
from tessera.operators import fulltext
from tessera.operators.relational import keyword_match, query_terms

def keyword_search(df: DataFrame, question: str, columns: list[str], order: list, most: int = 10) -> DataFrame:
    """Rows that have one of the question's words in a column, the first by ``order``. If there are
    none, rows that have all its words as tokens."""
    if not query_terms(question):
        return df.limit(0)
    hits = df.filter(keyword_match(columns, question))
    if hits.isEmpty():
        hits = df.filter(has_all(F.concat_ws(" ", *columns), question))
    return hits.orderBy(*order).limit(most)


def has_all(c: Column, query: str) -> Column:
    """Full-text match without stemming: every token of the query is a token of the text."""
    wanted = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), words(c))) == 0 if wanted else F.lit(False)


def english_search(df: DataFrame, query: str, text: str, key: str, most: int = 5) -> DataFrame:
    """English full text without an index, see :func:`tessera.operators.fulltext.search`."""
    return fulltext.search(df, query, text, key, most)


def vector_search(df: DataFrame, query: list[float], vector: str, key: str, most: int = 5, threshold: float | None = None) -> DataFrame:
    """The most similar rows by cosine, exactly; null vectors never match. ``threshold`` is strict."""
    scored = df.filter(F.col(vector).isNotNull()).withColumn("score", vectors.cosine_to(F.col(vector), query))
    if threshold is not None:
        scored = scored.filter(F.col("score") > threshold)
    return scored.orderBy(F.desc("score"), key).limit(most)


def hybrid(by_vector: DataFrame, by_keyword: DataFrame, key: str, most: int = 5, weight: float = 0.7) -> DataFrame:
    """Weighted sum of two scored lists (a missing score is 0), the first ``most``."""
    v, k = by_vector.select(key, F.col("score").alias("v")), by_keyword.select(key, F.col("score").alias("k"))
    fused = v.join(k, key, "full_outer")
    score = F.coalesce("v", F.lit(0.0)) * weight + F.coalesce("k", F.lit(0.0)) * (1 - weight)
    return fused.select(key, score.alias("score"), (F.col("v").isNotNull() & F.col("k").isNotNull()).alias("hybrid")).orderBy(F.desc("score"), key).limit(most)


def diversity(hits: DataFrame, parent: str) -> DataFrame:
    return hits.agg((F.count_distinct(parent) / F.greatest(F.count("*"), F.lit(1))).alias("diversity"))


def upcoming(nodes: DataFrame, now, most: int = 100) -> DataFrame:
    """Nodes that start between a week ago and thirty days ahead, by start."""
    at = F.lit(now).cast("timestamp_ntz")
    start = F.col("effective_start").cast("timestamp_ntz")
    return nodes.filter(start.between(at - F.expr("INTERVAL 7 DAYS"), at + F.expr("INTERVAL 30 DAYS"))).orderBy("effective_start", "id").limit(most)


def recent(nodes: DataFrame, now, kind: str = "communication", most: int = 20) -> DataFrame:
    at = F.lit(now).cast("timestamp_ntz")
    return nodes.filter((F.col("type") == kind) & (F.col("effective_start").cast("timestamp_ntz") >= at - F.expr("INTERVAL 7 DAYS"))).orderBy(F.desc("effective_start"), "id").limit(most)


def important(nodes: DataFrame, kind: str = "document", least: int = 2, most: int = 10) -> DataFrame:
    return nodes.filter((F.col("type") == kind) & (F.col("importance") >= least)).orderBy(F.desc("importance"), F.desc_nulls_last("updated_at"), "id").limit(most)


def sources(hits: DataFrame, most: int = 10) -> DataFrame:
    """Sources of an answer from hits (seq, id, type, name, summary, content): the first of each id, a
    name from the summary where there is none, by type, the first ``most``. At most a few hundred
    rows: what retrieval returned."""
    first = hits.groupBy("id").agg(F.min(F.struct("seq", "type", "name", "summary", "content")).alias("m")).select("id", "m.*")
    said = F.coalesce(F.nullif("summary", F.lit("")), F.nullif("content", F.lit("")), F.lit(""))
    vague = (F.coalesce("name", F.lit("")) == "") | ((F.col("type") == "communication") & F.col("name").startswith("Email"))
    name = F.when(vague & (said != ""), F.substring(said, 1, 100)).otherwise(F.coalesce("name", F.lit("")))
    # The order of types.
    rank = F.when(F.col("type").isin("event", "agent"), 0).when(F.col("type") == "document", 1).when(F.col("type") == "communication", 2).otherwise(9)
    shown = first.select("id", "seq", F.coalesce("type", F.lit("unknown")).alias("type"), name.alias("name"), F.coalesce(F.nullif("summary", F.lit("")), F.nullif(F.substring("content", 1, 200), F.lit(""))).alias("summary"), rank.alias("rank"))
    return shown.filter("name != ''").orderBy("rank", "seq").limit(most).select("id", "type", "name", "summary")


def retrieval_quality(hits: DataFrame, truth: DataFrame, most: int = 10) -> DataFrame:
    """Precision, recall, reciprocal rank and NDCG of ranked hits (query, id, rank) against truth
    (query, id), for each query with hits or truth."""
    top = hits.filter(F.col("rank") <= most)
    marked = top.join(truth.select("query", "id", F.lit(1).alias("good")), ["query", "id"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    by = marked.groupBy("query").agg(F.count("*").alias("n"), F.sum("good").alias("tp"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"), F.sum(F.col("good") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    of = truth.groupBy("query").agg(F.count_distinct("id").alias("of"))
    both = by.join(of, "query", "full_outer").fillna(0, ["n", "tp", "of"])
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.col("of"), F.lit(most)), F.lit(1)).cast("int")), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda a, x: a + x)
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return both.select("query", ratio(F.col("tp"), F.col("n")).alias("precision"), ratio(F.col("tp"), F.col("of")).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"))
