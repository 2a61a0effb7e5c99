"""Substring search without reading every text: trigrams of blocks, then the blocks that may hold a hit.

Rows lie in blocks of a few hundred, and a second table says which trigrams a block has. A search reads the
trigrams of its words, then the candidate blocks, and compares there as the plain search does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scratch
from tessera.operators import relational
from tessera.sources import sinks

#: Rows of a block, blocks of a folder, folders of trigrams, and candidate blocks that are named to the scan.
ROWS, BLOCKS, BUCKETS, NAMED = 256, 1024, 64, 2000
#: Block numbers that the tasks of an insert have each: more than a task has rows for.
TASK = 1 << 25


def trigrams(query: str) -> list[str]:
    """The trigrams that a text in lower case has if it matches ``query``, in which ``%`` and ``_`` are wild."""
    parts = re.split(r"[%_\\]", query.lower())
    return sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})


class SubstringIndex:
    """``rows`` of a table by folder and block, and ``grams`` (gram, block) by folder of the hashed trigram."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, columns: list[str], rows: int = ROWS):
        """``schema`` of the rows, and the text ``columns`` that are searched."""
        self.spark, self.folder, self.schema, self.columns, self.size = spark, folder, schema, columns, rows

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if sinks.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._read("rows", T.StructType([*self.schema.fields, *T.StructType.fromDDL("block long, part long").fields]))

    def grams(self) -> DataFrame:
        return self._read("grams", T.StructType.fromDDL("gram string, block long, bucket int"))

    def insert(self, df: DataFrame, near: str) -> None:
        """Adds rows in new blocks. Rows that are next to each other in the order of the column ``near`` share blocks:
        the more alike they are, the fewer blocks a search reads."""
        last = self.rows().agg(F.max("block")).first()[0]
        first = 0 if last is None else last // TASK + 1
        space = scratch.Scratch(self.spark, "blocks")
        at = F.monotonically_increasing_id()
        # Each task numbers its rows in order, in a span of block numbers of its own.
        block = (F.lit(first) + F.shiftright(at, 33)) * TASK + F.floor(at.bitwiseAND((1 << 33) - 1) / self.size)
        rows = df.repartitionByRange(near).sortWithinPartitions(near).withColumn("block", block.cast("long"))
        rows = space.table(rows.withColumn("part", F.floor(F.col("block") / BLOCKS).cast("long")), "rows")
        # Small row groups, in the order of blocks: statistics let a scan skip the others.
        rows.repartitionByRange("block").sortWithinPartitions("block").write.mode("append").option("parquet.block.size", 1 << 20).partitionBy("part").parquet(f"{self.folder}/rows")
        found = self._block_grams(rows).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
        found.repartitionByRange("bucket", "gram", "block").sortWithinPartitions("bucket", "gram", "block").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/grams")
        space.drop()

    def _block_grams(self, rows: DataFrame) -> DataFrame:
        """Distinct gram and block; Spark lowers the texts, so that case is as in the comparison."""
        lowered = rows.select("block", *[F.lower(F.col(c)).alias(f"t{i}") for i, c in enumerate(self.columns)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of: dict[int, set[str]] = {}
                for block, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = of.setdefault(block, set())
                    for t in texts:
                        if t:
                            own.update([t[i : i + 3] for i in range(len(t) - 2)])
                for block, own in of.items():
                    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([block] * len(own), pa.int64())], names=["gram", "block"])

        return lowered.mapInArrow(run, "gram string, block long").distinct()

    def candidates(self, query: str) -> DataFrame | None:
        """The blocks that have all trigrams of ``query``; None: it has none, and every block may match."""
        grams = trigrams(query)
        if not grams:
            return None
        buckets = sorted({r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(BUCKETS))).collect()})  # of one query
        rows = self.grams().filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        return rows.groupBy("block").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("block")

    def search(self, queries: list[str]) -> DataFrame:
        """The rows in which a column has one of ``queries``, in any case. A query that is too short for trigrams, such
        as ``ab``, reads every row (:meth:`scans`)."""
        hits = self._within(queries)
        match = reduce(Column.__or__, [relational.contains_any_case(self.columns, q) for q in queries], F.lit(False))
        return hits.filter(match).select(*self.schema.names)

    def scans(self, queries: list[str]) -> bool:
        """Whether a search for ``queries`` has to read all rows."""
        return any(not trigrams(q) for q in queries)

    def _within(self, queries: list[str]) -> DataFrame:
        """The rows of all candidate blocks."""
        rows = self.rows()
        if not queries or self.scans(queries):
            return rows
        blocks = reduce(DataFrame.unionByName, [self.candidates(q) for q in queries]).distinct()
        named = [r[0] for r in blocks.limit(NAMED + 1).collect()]
        if len(named) <= NAMED:  # few: the scan itself skips the rest
            return rows.filter(F.col("part").isin(sorted({b // BLOCKS for b in named})) & F.col("block").isin(sorted(named)))
        return rows.join(blocks, "block", "left_semi")

