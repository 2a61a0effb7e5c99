"""Cutting texts into chunks, and checks on chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import similarity
from tessera.functions.text import filled, let, strip
from tessera.operators import dedup


def windows(c: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of ``size`` characters that overlap; a text that fits is one."""

    def cut(c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(size - overlap))
        return F.when(F.length(c) <= size, F.array(c)).otherwise(F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(size))))

    return let(filled(c), cut)


def paragraphs(c: Column, size: int = 500, overlap: int = 50) -> Column:
    """Lines packed up to ``size`` characters; a chunk begins with the last ``overlap`` characters of
    the one before if that is longer. A long line stays whole. Empty texts have no chunks."""
    lines = F.filter(F.transform(F.split(filled(c), "\n"), strip), lambda x: x != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, p: Column) -> Column:
        full = (F.length(a["now"]) + F.length(p) + 1 > size) & (a["now"] != "")
        tail = F.when(F.length(a["now"]) > overlap, F.concat(F.substring(a["now"], -overlap, overlap), F.lit("\n"), p)).otherwise(p)
        done = F.when(full, F.concat(a["done"], F.array(strip(a["now"])))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(full, tail).otherwise(strip(F.concat(a["now"], F.lit("\n"), p))).alias("now"))

    return F.aggregate(lines, empty, step, lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(strip(a["now"])))).otherwise(a["done"]))


#: Separators in the order in which they are tried.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", ", ", " ")


def separated(c: Column, size: int = 500, overlap: int = 50) -> Column:
    """Packs the parts between the first separator that the text has; parts that are too long stay.
    Without any separator: windows of characters."""

    def by_text(c: Column) -> Column:
        sep = F.lit(None).cast("string")
        for s in reversed(SEPARATORS):
            sep = F.when(c.contains(s), F.lit(s)).otherwise(sep)
        return F.when(F.length(c) <= size, F.array(c)).otherwise(let(sep, lambda found: _packed(c, found, size, overlap)))

    return let(filled(c), by_text)


def _packed(c: Column, sep: Column, size: int, overlap: int) -> Column:
    # A literal split: Java's \Q..\E keeps the dots and marks.
    parts = F.split(c, F.concat(F.lit("\\Q"), sep, F.lit("\\E")))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["now"]) + F.length(p) + F.length(sep) <= size
        some = a["now"] != ""
        grown = F.concat(a["now"], F.when(some, sep).otherwise(""), p)
        rest = F.when(some, F.concat(F.substring(a["now"], -overlap, overlap), sep, p)).otherwise(p)
        return F.struct(F.when(fits | ~some, a["done"]).otherwise(F.concat(a["done"], F.array(strip(a["now"])))).alias("done"), F.when(fits, grown).otherwise(rest).alias("now"))

    packed = F.aggregate(parts, empty, step, lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(strip(a["now"])))).otherwise(a["done"]))
    return F.when(sep.isNull(), windows(c, size, overlap)).otherwise(packed)


def rows(df: DataFrame, chunks: Column, key: str, least: int = 0) -> DataFrame:
    """A row for each chunk of each row: parent, index, count and content of ``least`` or more characters."""
    out = df.select(F.col(key).alias("parent_id"), chunks.alias("__c")).select("parent_id", F.size("__c").alias("chunk_count"), F.posexplode("__c").alias("chunk_index", "content"))
    return out.filter(F.length("content") >= least) if least else out


def contiguous(chunks: DataFrame) -> DataFrame:
    """Whether the indexes of each parent run from 0 to the count without gaps."""
    return chunks.groupBy("parent_id").agg(((F.max("chunk_index") + 1 == F.count("*")) & (F.count_distinct("chunk_index") == F.count("*")) & (F.min("chunk_index") == 0)).alias("contiguous"))


def summary(chunks: DataFrame, text: str = "content") -> DataFrame:
    """Number and total length of chunks."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("total_length"))


def duplicates(chunks: DataFrame, key: str = "id", text: str = "content", threshold: float = 0.9) -> DataFrame:
    """Pairs of chunks whose token sets are similar above the threshold (between distinct sets)."""
    return dedup.similar_pairs(chunks, key, similarity.token_hashes, text, threshold)
