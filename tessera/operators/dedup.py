"""Exact and set-similarity deduplication as equi-joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scratch
from tessera.functions import similarity


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order`` (ties: any one whole row, the least).

    An aggregate with partial results, so a hot key is one row a task before the shuffle. Rows of a
    null key are one group.
    """
    row = F.struct(F.col(order).alias("__o"), *[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(row).alias("r")).select(*[F.col("r")[c].alias(c) for c in df.columns])


def insert_if_absent(new: DataFrame, old: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, one a key. Empty or null keys never match:
    such rows are always inserted."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.col(k).cast("string") == "")
    fresh = first_by(new.filter(~blank), keys, order).join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns)).unionByName(new.filter(blank).select(*old.columns))


def upsert(new: DataFrame, old: DataFrame, keys: list[str], updated: list[str] | None = None) -> DataFrame:
    """Rows of both by key: of ``updated`` columns (default: all) the new value wins unless null, of
    the others the old one."""
    updated = updated if updated is not None else [c for c in old.columns if c not in keys]
    n, o = new.alias("n"), old.alias("o")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
    pick = [F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys]
    for c in old.columns:
        if c in keys:
            continue
        a, b = (f"n.{c}", f"o.{c}") if c in updated else (f"o.{c}", f"n.{c}")
        pick.append(F.coalesce(F.col(a), F.col(b)).alias(c))
    return n.join(o, on, "full_outer").select(*pick)


def duplicate_groups(df: DataFrame, checksum: Column, key: str) -> DataFrame:
    """Checksums that occur twice or more: rows and the least key."""
    return df.groupBy(checksum.alias("checksum")).agg(F.count("*").alias("copies"), F.min(key).alias("first_id")).filter("copies > 1")


#: Sets above which an element is common: joined by itself it would be one task's alone.
COMMON = 1000
#: Frequent elements that are sent to the executors, at most, and sets whose elements a worker orders at once.
KNOWN, AT_ONCE = 500_000, 256


#: Words of 64 bits in a set's parities.
PARITIES = 4


def with_parities(sets: DataFrame) -> DataFrame:
    """``sets`` with b0, b1, ...: bits that each element of the column set flips one of. Two sets differ in as many
    elements as bits at least."""
    flip = lambda w: F.expr(f"aggregate(set, 0L, (bits, x) -> if(pmod(x, {PARITIES}) = {w}, bits ^ shiftleft(1L, cast(pmod(shiftright(x, 8), 64) AS int)), bits))")
    return sets.withColumns({f"b{w}": flip(w) for w in range(PARITIES)})


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent elements of all sets, sorted by themselves, and in how many sets they are: all that are in more than one,
    or if these are more than KNOWN, all that are in more than the least power of two that leaves so few."""
    space = scratch.Scratch(sets.sparkSession, "frequency")
    f = F.col("f")
    counted = space.table(sets.select(F.explode("set").alias("e")).groupBy("e").agg(F.count("*").alias("f")).filter(f > 1), "counted")
    above = counted.agg(*[F.count_if(f > (1 << k)).alias(f"a{k}") for k in range(40)]).first()
    found = counted.filter(f > (1 << next(k for k in range(40) if above[k] <= KNOWN))).toArrow()
    space.drop()
    e, n = found.column("e").to_numpy(), found.column("f").to_numpy()
    order = np.argsort(e)
    return e[order], n[order]


def _ordered(rows: DataFrame, known: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``rows`` (set, length and others) with ``first``, the first ``length`` elements, instead of both: elements by hash as they
    are in the set, those that are ``known`` to be frequent after all others, from rare to common."""
    held = rows.sparkSession.sparkContext.broadcast((known, counts))
    own = [c for c in rows.columns if c not in ("set", "length")]
    schema = T.StructType([*[rows.schema[c] for c in own], T.StructField("first", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = held.value
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, len(b), AT_ONCE)):
            lists = batch.column("set")
            e, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, e), max(len(known) - 1, 0))
            rank = np.where(known[at] == e, counts[at], 0) if len(known) else np.zeros(len(e))
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((e, rank, row))
            start = np.cumsum(size) - size
            e = e[order][np.arange(len(e)) - start[row] < batch.column("length").to_numpy(zero_copy_only=False)[row]]
            ends = np.r_[0, np.cumsum(np.minimum(batch.column("length").to_numpy(zero_copy_only=False), size))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.ListArray.from_arrays(pa.array(ends), pa.array(e))], names=[*own, "first"])

    return rows.select(*own, "set", "length").mapInArrow(run, schema)


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """key, n, further columns and e: the elements of each sorted set (key, set, n) of which similar sets share one. The order of
    elements is by hash, if no element is in the prefixes of more than COMMON sets, which are counted; else it is from rare to
    common, as far as :func:`frequent` tells them apart. Any order that is the same for all sets would do; it is made within
    the row, so that elements are shuffled as counts only."""
    own, length = [c for c in sets.columns if c != "set"], (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int")
    plain = sets.select(*own, F.explode(F.slice("set", F.lit(1), length)).alias("e"))
    if plain.groupBy("e").agg(F.count("*").alias("f")).filter(F.col("f") > COMMON).isEmpty():
        return plain
    return _ordered(sets.select(*own, "set", length.alias("length")), *frequent(sets)).select(*own, F.explode("first").alias("e"))


def may_be_similar(a: str, b: str, threshold: float) -> Column:
    """False only for two sets whose sizes (n) or parities rule the similarity out. Sets of sizes x and y and of a similarity
    of t or more differ in at most (1 - t) / (1 + t) of x + y elements."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.b{w}").bitwiseXOR(F.col(f"{b}.b{w}"))) for w in range(PARITIES)), F.lit(0))
    return (x >= y * threshold) & (y >= x * threshold) & (bits * (1 + threshold) <= (x + y) * (1 - threshold) + 1e-6)


def of_pairs(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """Those of ``sets`` that ``pairs`` (a, b) name: no others are shuffled where the names are few."""
    named = pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct()
    return sets.join(F.broadcast(named), key, "left_semi") if scratch.fits(named, 16, 4 << 20) else sets


def similar_pairs(df: DataFrame, key: str, elements: Callable[[Column], Column], text: str, threshold: float, strict: bool = True) -> DataFrame:
    """Pairs (a < b) of rows whose element sets have a Jaccard similarity above the threshold, exactly.

    ``elements`` gives an array of distinct 64-bit hashes. Rows of equal sets are one before the join: pairs
    come between distinct sets, and :func:`set_members` tells the rows of each. Prefix filtering: in any
    fixed order of elements, similar sets share one of the first ``|A| - ceil(t |A|) + 1``. Only those
    are joined, with the bounds of :func:`may_be_similar`, so that few candidates leave the join, and these are
    verified on the whole sets. What all have in common is joined only where sets have nothing else, see
    :func:`prefixes`.
    """
    space = scratch.Scratch(df.sparkSession, "sets")
    every = with_parities(hashed_sets(df, key, elements(F.col(text)))).filter("n > 0")
    sets = first_of_class(space.table(every, "every"), space)
    prefix = prefixes(sets, threshold)
    a, b = prefix.alias("a"), prefix.alias("b")
    near = (F.col("a.key") < F.col("b.key")) & may_be_similar("a", "b", threshold)
    pairs = a.join(b, (F.col("a.e") == F.col("b.e")) & near).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    pairs = space.table(pairs, "pairs")
    sets = of_pairs(pairs, sets, "key")
    full = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("sb")), "b")
    full = full.select("a", "b", similarity.jaccard(F.col("sa"), F.col("sb")).alias("similarity"))
    return full.filter(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold)


def _set_hash(c: Column) -> Column:
    """What equal sorted arrays of hashes agree on: size and 128 bits."""
    return F.struct(F.size(c).alias("n"), F.xxhash64(c).alias("x"), F.xxhash64(F.lit(7), c).alias("y"))


def set_classes(df: DataFrame, key: str, elements: Callable[[Column], Column], text: str) -> DataFrame:
    """One row for each distinct non-empty set of elements (hashes): least key, sorted set, number of rows."""
    sets = df.select(F.col(key).alias("k"), F.sort_array(elements(F.col(text))).alias("set")).filter(F.size("set") > 0)
    return sets.groupBy(_set_hash(F.col("set")).alias("h")).agg(F.min("k").alias("key"), F.first("set").alias("set"), F.count("*").alias("copies")).drop("h")


def hashed_sets(df: DataFrame, key: str, elements: Column, *others: Column) -> DataFrame:
    """id (a number of the row), key, set (sorted), n, h (of equal sets the same) and ``others``."""
    sets = df.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.sort_array(elements).alias("set"), *others)
    return sets.withColumns({"n": F.size("set"), "h": _set_hash(F.col("set"))})


def first_of_class(every: DataFrame, space: scratch.Scratch) -> DataFrame:
    """key, set, n and parities of those rows of a table of :func:`hashed_sets` that have the least key of their h. Only keys
    and hashes are shuffled and no set is written again, unless the other rows are too many to be sent."""
    least = every.groupBy("h").agg(F.min(F.struct("key", "id"))["id"].alias("least"), F.count("*").alias("copies")).filter("copies > 1")
    others = space.table(every.select("h", "id").join(least, "h").filter("id != least").select("id"), "others")
    sets = every.select("id", "key", "set", "n", *[f"b{w}" for w in range(PARITIES)])
    if scratch.fits(others, 16):
        return sets.join(F.broadcast(others), "id", "left_anti").drop("id")
    return space.table(sets.join(others, "id", "left_anti").drop("id"), "sets")


def set_members(df: DataFrame, key: str, elements: Callable[[Column], Column], text: str) -> DataFrame:
    """Every row's key and the least key of the rows of an equal set, ``class_key``; a row of an empty
    set is its own class."""
    sets = df.select(F.col(key).alias("__k"), F.sort_array(elements(F.col(text))).alias("set"))
    rows = sets.select("__k", F.when(F.size("set") > 0, _set_hash(F.col("set"))).alias("h"))
    rows = scratch.Scratch(df.sparkSession, "members").table(rows, "rows")  # both sides of the join need it
    first = rows.filter("h is not null").groupBy("h").agg(F.min("__k").alias("first"))
    return rows.join(first, "h", "left").select(F.col("__k").alias(key), F.coalesce("first", "__k").alias("class_key"))


def attachment_duplicates(attachments: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Why attachments (seq, email_id, filename, content_hash, cleaned_text) are duplicates.

    ``reason``: an earlier row has the same non-empty hash; or, for texts over 50 characters, an
    earlier distinct text is similar above the threshold. Earlier means a lesser seq, whether or not
    that row is itself a duplicate, so the result doesn't depend on an order of removal.
    """
    hashed = attachments.filter("content_hash is not null and content_hash != ''").groupBy("content_hash").agg(F.min("seq").alias("__first"))
    exact = attachments.join(hashed, "content_hash").filter("seq > __first").select("seq", F.lit("duplicate_content_exact_hash").alias("reason"), F.col("__first").alias("similar_to"), F.lit(1.0).alias("similarity"))
    texts = attachments.filter(F.length("cleaned_text") > 50)
    pairs = similar_pairs(texts, "seq", similarity.shingle_hashes, "cleaned_text", threshold)
    same = set_members(texts, "seq", similarity.shingle_hashes, "cleaned_text").withColumnRenamed("class_key", "key")
    own = same.filter("seq > key").select("seq", F.col("key").alias("similar_to"), F.lit(1.0).alias("similarity"))
    other = same.join(pairs.select(F.col("b").alias("key"), F.col("a").alias("similar_to"), "similarity"), "key").select("seq", "similar_to", "similarity").filter("seq > similar_to")
    best = own.union(other).groupBy("seq").agg(F.min(F.struct("similar_to", "similarity")).alias("m")).select("seq", F.lit("duplicate_text_similarity").alias("reason"), "m.similar_to", "m.similarity")
    best = best.join(exact.select("seq"), "seq", "left_anti")
    return exact.unionByName(best)


def record_duplicates(records: DataFrame, attachments: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Records (seq, email_id) that go, with the reason: a repeated id, or all attachments duplicates."""
    ids = records.filter("email_id is not null and email_id != ''").groupBy("email_id").agg(F.min("seq").alias("__first"))
    again = records.join(ids, "email_id").filter("seq > __first").select("seq", "email_id", F.lit("duplicate_email_id").alias("reason"))
    dup = attachment_duplicates(attachments, threshold).select("seq", F.lit(1).alias("d"))
    every = attachments.join(dup, "seq", "left").groupBy("record_seq").agg(F.min(F.coalesce("d", F.lit(0))).alias("all_dup")).filter("all_dup = 1")
    whole = records.join(every, records["seq"] == every["record_seq"], "left_semi").join(again.select("seq"), "seq", "left_anti")
    return again.unionByName(whole.select("seq", "email_id", F.lit("all_attachments_are_duplicates").alias("reason")))
