"""Ranked English full text: a table of postings with positions, and ranks by the distances of terms."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.enrich import words
from tessera.functions.stems import stem

# English stop-words of full-text search.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now
""".split()
# The weight of a position, the farthest distance that counts, the share of what is farther, and the
# limit of the sum of inverse squares, of the published rank.
WEIGHT, FARTHEST, FAR, SQUARES = 0.1, 100, 1e-30, 1.64493406685

#: Folders into which terms are dealt, and words of texts that are inverted together.
BUCKETS, TOKENS = 64, 1 << 21
_STOPS = frozenset(ENGLISH_STOP_WORDS)


def query_stems(query: str) -> list[str]:
    """The distinct stems of a query, without stop-words, in the order of their text."""
    return sorted({stem(w) for w in re.findall(r"\w+", query.lower()) if w not in ENGLISH_STOP_WORDS})


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, keys, starts, positions: where each stem stands in the texts of a block, from 1. Posting i is that of
    ``keys[i]``, with ``positions[starts[i]]`` up to ``starts[i + 1]``; stop-words have a place and no posting.

    A text is read once and whole, so that nothing is shuffled to find its postings; each distinct word of a block is
    stemmed once. Null and empty texts have no postings.
    """
    rows = df.select(F.col(key).alias("key"), words(F.col(text)).alias("ws"))
    fields = [T.StructField("term", T.StringType()), T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), *T.StructType.fromDDL("starts array<int>, positions array<int>").fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(ends):  # as many texts as have TOKENS words together, one at least
                before = ends[begin - 1] if begin else 0
                until = max(begin + 1, int(np.searchsorted(ends, before + TOKENS, "right")))
                if (found := _inverted(batch.slice(begin, until - begin))).num_rows:
                    yield found
                begin = until

    return rows.mapInArrow(run, T.StructType(fields))


def _inverted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each stem of a batch of keys and words."""
    flat = batch.column(1).flatten().dictionary_encode()
    stems = [None if w in _STOPS else stem(w) for w in flat.dictionary.to_pylist()]
    terms = pa.array(dict.fromkeys(s for s in stems if s is not None), pa.string())
    number = pc.fill_null(pc.index_in(pa.array(stems, pa.string()), terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
    owner, place = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    term = number[flat.indices.to_numpy(zero_copy_only=False)]
    at = np.flatnonzero(term >= 0)
    order = np.sort(term[at] * len(flat) + at) % max(len(flat), 1)  # by term, text and place
    term, owner = term[order], owner[order]
    new_term = np.diff(term, prepend=-1) != 0
    first = np.flatnonzero(new_term | (np.diff(owner, prepend=-1) != 0))  # of each posting
    top = np.flatnonzero(new_term[first])  # the first posting of each term
    last = np.append(top[1:], len(first))
    # A row's starts are those of its postings and its end, counted from its own first position.
    own = np.insert(first, last, np.append(first, len(order))[last]) - np.repeat(first[top], last - top + 1)
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [
            terms.take(pa.array(term[first[top]])),
            lists(np.append(top, len(first)), batch.column(0).take(pa.array(owner[first]))),
            lists(np.append(top, len(first)) + np.arange(len(top) + 1), pa.array(own, pa.int32())),
            lists(np.append(first[top], len(order)), pa.array(place[order] + 1, pa.int32())),
        ],
        names=["term", "keys", "starts", "positions"],
    )


def opened(rows: DataFrame, *keep: str) -> DataFrame:
    """key, term, positions and the columns ``keep`` of blocks; rows of one key, and of equal ``keep``, are one text."""
    own = lambda k, i: F.struct(k.alias("key"), F.slice("positions", F.get("starts", i) + 1, F.get("starts", i + 1) - F.get("starts", i)).alias("at"))
    each = rows.select("term", *keep, F.explode(F.transform("keys", own)).alias("p")).select("p.key", "term", *keep, "p.at")
    return each.groupBy("key", "term", *keep).agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("positions"))


def postings(df: DataFrame, key: str, text: str, terms: list[str] | None = None) -> DataFrame:
    """key, term, positions of all stems of ``df``, or of ``terms``; rows of one key are one text."""
    rows = blocks(df, key, text)
    return opened(rows if terms is None else rows.filter(F.col("term").isin(terms)))


def pair_rank(a: np.ndarray, b: np.ndarray) -> float:
    """The logarithm of what is left of 1 by the pairs of positions of two terms: a pair at distance d takes the share
    0.1 * sqrt(1 / (1.005 + 0.05 * exp(d / 1.5 - 2))), one that is farther than 100 next to nothing."""
    near = np.zeros(FARTHEST + 1, np.int64)
    for step in (a, b), (b, a):
        low = np.searchsorted(step[1], step[0], "right")
        high = np.searchsorted(step[1], step[0] + FARTHEST, "right")
        n = high - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        near += np.bincount(step[1][at] - np.repeat(step[0], n), minlength=FARTHEST + 1)
    d = np.arange(1, FARTHEST + 1)
    share = WEIGHT / np.sqrt(1.005 + 0.05 * np.exp(d / 1.5 - 2))
    far = len(a) * len(b) - int(near.sum()) - len(np.intersect1d(a, b))
    return float((near[1:] * np.log1p(-share)).sum() + far * np.log1p(-WEIGHT * np.sqrt(FAR)))


def rank(positions: list[np.ndarray]) -> float:
    """The rank of a text by the positions of all terms of the query: of one term, by how often it stands there; of
    several, by the distances of all pairs."""
    if len(positions) == 1:
        return float(WEIGHT * (1 / np.arange(1, len(positions[0]) + 1) ** 2.0).sum() / SQUARES)
    return float(-np.expm1(sum(pair_rank(positions[i], positions[k]) for i in range(len(positions)) for k in range(i))))


def ranked(rows: DataFrame, terms: list[str], most: int) -> DataFrame:
    """key and score of the ``most`` best texts that have all ``terms``, from postings; ties, by nine decimals, are in the
    order of keys."""
    key = rows.schema["key"]
    found = rows.filter(F.col("term").isin(terms)).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "positions"))).alias("of")).filter(F.size("of") == len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [rank([np.array(t["positions"], np.int64) for t in of]) for of in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["key", "score"])

    scored = found.mapInArrow(run, T.StructType([key, T.StructField("score", T.DoubleType())])).withColumn("score", F.round("score", 9))
    return scored.orderBy(F.desc("score"), "key").limit(most)


def search(df: DataFrame, query: str, text: str, key: str, most: int = 5) -> DataFrame:
    """Rows of ``df`` with their score, the best first, without an index: every text is read."""
    terms = query_stems(query)
    if not terms:
        return df.withColumn("score", F.lit(None).cast("double")).limit(0)
    best = ranked(postings(df, key, text, terms), terms, most)
    return df.join(F.broadcast(best.withColumnRenamed("key", key)), key).orderBy(F.desc("score"), key)  # ``most`` rows


class PostingsIndex:
    """Blocks of postings in folders by hash of the term, within their files in the order of terms.

    A search opens the folders of its terms, and of their files the row groups that may hold them. New texts
    are added without touching what is there; a text that is added twice counts as its first.
    """

    def __init__(self, spark: SparkSession, folder: str, key_type: str = "long", buckets: int = BUCKETS):
        self.spark, self.folder, self.key_type, self.buckets = spark, folder, key_type, buckets

    def insert(self, df: DataFrame, key: str, text: str) -> None:
        rows = blocks(df, key, text).select("*", F.lit(uuid.uuid4().hex).alias("added"), self._bucket("term").alias("bucket"))
        # A folder that is large is split over tasks, small ones share one.
        rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        rows.write.mode("append").partitionBy("bucket").parquet(self.folder)

    def _bucket(self, term: str):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def postings(self, terms: list[str]) -> DataFrame:
        """key, term, added (a value for each insertion) and positions of ``terms``."""
        names = self.spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = sorted({r[0] for r in names.select(self._bucket("term")).collect()})  # of the terms of one query
        rows = self.spark.read.schema(f"term string, keys array<{self.key_type}>, starts array<int>, positions array<int>, added string, bucket int").parquet(self.folder)
        return opened(rows.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)), "added")

    def search(self, query: str, most: int = 5) -> DataFrame:
        """key and score of the best texts that have all words of the query."""
        terms = query_stems(query)
        rows = self.postings(terms).groupBy("key", "term").agg(F.min("positions").alias("positions"))
        return ranked(rows, terms, most) if terms else rows.select("key", F.lit(0.0).alias("score")).limit(0)
