"""Helpers that the operators share: tables, the shared folder, and bounded Arrow slices."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python worker handles at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch, unless the session says otherwise: batches exist in the JVM and in Python, on
#: both ways, for each task.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset (tests, one machine) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jsc.isDefined():
        return jsc.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
    own = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


#: Folders that this driver has made below the shared one.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    _MADE.append(f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove_written(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Deletes intermediate tables of this driver (by default all): call it when no result that reads
    them is read any more."""
    count = 0
    for p in [p for p in list(_MADE) if paths is None or p in paths]:
        _MADE.remove(p)
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        count += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def written(df: DataFrame, name: str, compression: str = "zstd", last: bool = False) -> DataFrame:
    """``df`` written to a new table of the shared folder and read again: lineage ends here, and
    a lost executor costs nothing that was done before. ``last``: all intermediate tables that were
    made before go, as nothing but ``df`` needs them."""
    spark = df.sparkSession
    before = list(_MADE)
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    if last:
        remove_written(spark, before)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
    """``df`` written as a table, and the aggregates ``sums`` of its rows, taken on the way: they need no job."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(k) for k, c in sums.items()]), name)
    return out, seen.get


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by sorting, never by broadcast: Spark takes a written table for as large as its compressed files, and
    keys that repeat or count up take a hundredth of what they are as rows in the driver."""
    return left.join(right.hint("merge"), on, how)


def replaced(df: DataFrame, name: str, old: str | None) -> tuple[DataFrame, str]:
    """``df`` written as a table, and its path; the table ``old``, from which it was made, goes."""
    out = written(df, name)
    path = _MADE[-1]
    if old:
        remove_written(df.sparkSession, [old])
    return out, path


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of about ``limit`` bytes of text, with their texts (null: empty)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
        begin, total = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > limit:
                piece = batch.slice(begin, i - begin)
                yield piece, [t or "" for t in piece.column(at).to_pylist()]
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            piece = batch.slice(begin)
            yield piece, [t or "" for t in piece.column(at).to_pylist()]


#: What workers remember between batches; emptied when a task ends.
FORGETTABLE: list = []


def _release() -> None:
    """Gives memory back to the system: idle Python workers live as long as their executor."""
    for forget in FORGETTABLE:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim keeps it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` whose workers keep no memory when a task ends.

    Spark reads the size of Arrow batches from the session when a plan runs, so that it can't be set
    for one plan: where the session has Spark's default, it is lowered to BATCH_BYTES and stays so.
    """

    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) in (None, "67108864b", "67108864", "64MB", "64m"):  # Spark's own
        conf.set(_BATCH, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(task, schema)


def carried(docs: DataFrame, keep: list[str] | tuple[str, ...], text: str) -> DataFrame:
    """k, a struct of the columns ``keep`` as they are, and t, the text: whatever a user's columns are
    called, no name of ours meets them."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("k"), F.col(quoted(text)).alias("t"))


def with_results(rows: DataFrame, results: str) -> T.StructType:
    """Schema of the columns of ``rows`` but for the last, and of ``results`` (as DDL) after them."""
    return T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(results).fields])


#: Bytes of rows that are broadcast. The driver holds a hash table of about five times as many, and its
#: serialised copy, for every broadcast until it is cleaned.
SENT_BYTES = 4 << 20


def fits(df: DataFrame, row_bytes: int, limit: int = SENT_BYTES) -> bool:
    """Whether ``df``, counted, stays below ``limit`` bytes; only then may it be broadcast."""
    return df.limit(limit // row_bytes + 1).count() <= limit // row_bytes


#: Rows of one key above which a join doesn't leave them to one task, and tasks that share them.
HOT, SALTS = 10_000, 64


def salts(n: int) -> Column:
    """A row for each of ``n`` salts."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def joined_evenly(left: DataFrame, right: DataFrame, key: str, hot: int = HOT, limit: int = SENT_BYTES) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each ``key`` once and in ``n`` how many rows of
    ``left`` have it. No task gets all rows of a hot key.

    ``right`` is broadcast if it is small (counted first). Else its keys of more than ``hot`` rows are: at
    most one in ``hot`` rows of ``left``. Should even they be too many, ``left`` is spread over SALTS
    keys for them.
    """
    if fits(right, 32, limit):
        return left.join(F.broadcast(right), key).drop("n")
    often, rest = right.filter(F.col("n") > hot), right.filter(F.col("n") <= hot)
    if fits(often, 32, limit):
        many = left.join(F.broadcast(often), key)
        left = left.join(F.broadcast(often.select(key)), key, "left_anti")
    else:
        salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).alias("__salt")
        spread = often.withColumn("__salt", salts(SALTS))
        salted = left.select("*", salt)
        many = salted.join(spread, [key, "__salt"]).drop("__salt")
        left = salted.join(spread.select(key, "__salt"), [key, "__salt"], "left_anti").drop("__salt")
    return many.unionByName(left.join(rest, key)).drop("n")


def same(left: DataFrame, right: DataFrame, names: list[str]):
    """Null-safe equality on all ``names``, as a join condition."""
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[n])
    return on
