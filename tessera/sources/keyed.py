"""Stored tables by key: insert if absent, upsert and status updates that touch only the buckets of a batch.

Rows lie in folders by hash of their key. A batch reads the folders of its own keys; Parquet's Bloom filters and
statistics on the hashed key skip row groups that can't hold them. Changed folders are written whole, with dynamic
partition overwrite, from a copy in the shared folder; all others keep their files. One writer at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scratch
from tessera.operators import dedup
from tessera.sources import sinks

#: Folders of a table; keys of a batch up to which they are sent into the scan instead of joined.
BUCKETS, PUSHED = 64, 200
_HASH, _BUCKET = "__h", "__b"


class KeyedTable:
    """A table of ``schema`` in ``folder`` with the key columns ``keys``. The number of buckets is that of the first write."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, keys, buckets

    # ---- reading -------------------------------------------------------------------------------

    def _stored(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(_HASH, T.LongType()), T.StructField(_BUCKET, T.IntegerType())])
        if not sinks.exists(self.spark, self.folder):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.folder)

    def rows(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def _hash(self) -> Column:
        return F.xxhash64(*[F.col(k).cast("string") for k in self.keys])

    def _blank(self) -> Column:
        return reduce(lambda a, k: a | F.col(k).isNull() | (F.col(k).cast("string") == ""), self.keys, F.lit(False))

    def _marked(self, df: DataFrame) -> DataFrame:
        """With hash and bucket. Rows of blank keys, which may be very many, are spread by all their columns."""
        h = F.when(self._blank(), F.xxhash64(*[F.col(c).cast("string") for c in self.schema.names])).otherwise(self._hash())
        return df.select(*self.schema.names).withColumn(_HASH, h).withColumn(_BUCKET, F.pmod(F.col(_HASH), F.lit(self.buckets)).cast("int"))

    def near(self, batch: DataFrame) -> DataFrame:
        """The stored rows in the buckets of ``batch`` (marked), of a small batch only those of its hashed keys."""
        buckets = sorted(r[0] for r in batch.select(_BUCKET).distinct().collect())  # at most the number of buckets
        rows = self._stored().filter(F.col(_BUCKET).isin(buckets))
        some = [r[0] for r in batch.select(_HASH).distinct().limit(PUSHED + 1).collect()]
        return rows.filter(F.col(_HASH).isin(some)) if len(some) <= PUSHED else rows

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (the key columns)."""
        full = keys.select(*[F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        marked = self._marked(full).select(*self.keys, _HASH, _BUCKET).distinct()
        return self.near(marked).select(*self.schema.names).join(marked.select(*self.keys), self.keys, "left_semi")

    # ---- writing -------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, mode: str) -> None:
        out = rows.repartitionByRange(_BUCKET, _HASH).sortWithinPartitions(_BUCKET, _HASH).write.mode(mode)
        out = out.option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{_HASH}", "true")
        out.partitionBy(_BUCKET).parquet(self.folder)

    def insert_if_absent(self, new: DataFrame, order: str) -> int:
        """Adds the rows whose key the table lacks, one a key, the first by ``order``; how many. Rows of blank keys are
        always added. Files that are there stay as they are."""
        space = scratch.Scratch(self.spark, "insert")
        marked = space.table(self._marked(new), "batch")
        keyed = marked.filter(~self._blank())
        fresh = dedup.first_by(keyed, self.keys, order).join(self.near(keyed).select(*self.keys), self.keys, "left_anti")
        fresh = space.table(fresh.select(*marked.columns).unionByName(marked.filter(self._blank())), "fresh")
        count = fresh.count()
        if count:
            self._write(fresh, "append")
        space.drop()
        return count

    def _replaced(self, space: scratch.Scratch, rows: DataFrame) -> None:
        """Writes whole buckets anew from a copy, as no table can be read and overwritten at once. Should that be broken
        off, the same batch does it again."""
        self._write(space.table(rows, "changed"), "overwrite")
        space.drop()

    def upsert(self, new: DataFrame, order: str, updated: list[str] | None = None) -> None:
        """Rows of a stored key take the values of ``updated`` columns (default: all) that aren't null; others are
        added. Of several new rows of a key the first by ``order`` counts; rows of blank keys are always added."""
        space = scratch.Scratch(self.spark, "upsert")
        marked = space.table(self._marked(new), "batch")
        first = dedup.first_by(marked.filter(~self._blank()), self.keys, order).select(*self.schema.names)
        buckets = sorted(r[0] for r in marked.select(_BUCKET).distinct().collect())  # at most the number of buckets
        if not buckets:
            return
        old = self._stored().filter(F.col(_BUCKET).isin(buckets))
        merged = dedup.upsert(first, old.filter(~self._blank()).select(*self.schema.names), self.keys, updated)
        blank = old.filter(self._blank()).unionByName(marked.filter(self._blank()))
        self._replaced(space, self._marked(merged).unionByName(blank))

    def set_status(self, value, status: str, error: str | None, now) -> int:
        """Status of the row of one key, see :func:`sinks.set_status`: only its bucket is read and written. How many
        rows have that key."""
        (key,) = self.keys
        of = self.spark.range(1).select(*[F.lit(value if f.name == key else None).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        bucket = self._marked(of).first()[_BUCKET]
        rows = self._stored().filter(F.col(_BUCKET) == bucket)
        found = rows.filter(F.col(key) == value).count()
        if found:
            self._replaced(scratch.Scratch(self.spark, "status"), self._marked(sinks.set_status(rows.select(*self.schema.names), key, value, status, error, now)))
        return found

    def compact(self, most: int = 8) -> list[int]:
        """Writes the buckets of more than ``most`` files anew, and names them."""
        counts = self._stored().select(_BUCKET, F.input_file_name().alias("f")).groupBy(_BUCKET).agg(F.count_distinct("f").alias("n"))
        many = sorted(r[0] for r in counts.filter(F.col("n") > most).collect())
        if many:
            self._replaced(scratch.Scratch(self.spark, "compact"), self._stored().filter(F.col(_BUCKET).isin(many)))
        return many
