"""Prefix trie of conversations (operator 11).

Every distinct sequence of first turns is a node. Nodes are met by digests of their prefixes; those that several
conversations share are packed by prefix shard into level-order tries of LOUDS bits and label arrays, which numpy
builds and rolls up from the deepest level. Nodes of very many conversations, above all shards, merge in
rounds of joins that reach twice as far each time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import shared

#: Conversations above which a node belongs to the upper levels; nodes that are packed into one trie, unless one
#: shard has more; turns of a conversation that are chained in one go; characters of ids that make a chunk.
HEAVY, PACKED, CHAINED, CHUNK = 200, 100_000, 1024, 1 << 16
#: Turns that a conversation has from the first of its hundred at most, plus one.
HEADS, HUNDRED = 6, 100
ROOT = b"\0" * 16
NOTHING = hashlib.sha256(b"").hexdigest()


def digest(*parts: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


# ---- turns in order ----------------------------------------------------------------------------


def ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, turn, role, text) as c, id, label, size, and where each conversation stands: c, part, low, before, n.

    A turn's place is ``id - low + before``, with the line of its part (``id >> 33``). Rows are sorted over all
    tasks by conversation, turn (null first), role and text, so that the turns of one conversation may
    be in many tasks; only what each task has of it is counted.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"), text("role").alias("r"), text("text").alias("x"))
    rows = rows.repartitionByRange("c", "t", F.substring("r", 1, 16), F.substring("x", 1, 64)).sortWithinPartitions("c", "t", "r", "x")
    label = digest(F.encode(F.concat(F.length("r").cast("string"), F.lit(":"), "r", "x"), "UTF-8"))
    rows = shared.written(rows.select("c", F.monotonically_increasing_id().alias("id"), label.alias("label"), F.length("x").cast("long").alias("size")), "turns")
    parts = rows.groupBy("c", F.shiftright("id", 33).alias("part")).agg(F.min("id").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return rows, shared.written(parts.withColumn("before", F.coalesce(before, F.lit(0))), "turn_parts")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (c, d, label, size, last) and conversations (c, length) of conversations that begin like the first of their
    hundred: h of its turns, or as many as it has, stand for the first h of each; h is the CRC-32 of c modulo 6."""
    rows, parts = ordered(turns)
    own = parts.groupBy("c").agg(F.sum("n").alias("own"))
    first = own.select(F.col("c").alias("base"), F.col("own").alias("base_n"))
    convs = own.withColumns({"base": F.col("c") - F.col("c") % HUNDRED, "h": F.crc32(F.col("c").cast("string")) % HEADS}).join(first, "base", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = shared.written(convs.select("c", "base", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "convs")
    places = parts.select("c", "part", (F.col("before") - F.col("low")).alias("shift")).join(convs.drop("base"), "c")
    placed = rows.withColumn("part", F.shiftright("id", 33)).join(places, ["c", "part"]).withColumn("pos", F.col("id") + F.col("shift"))
    tails = placed.filter("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("d"), "label", "size", "length")
    heads = placed.filter((F.col("c") % HUNDRED == 0) & (F.col("pos") < HEADS - 1)).select(F.col("c").alias("base"), (F.col("pos") + 1).alias("d"), "label", "size")
    heads = convs.filter("m > 0").join(heads, "base").filter("d <= m").select("c", "d", "label", "size", "length")
    paths = tails.unionByName(heads)
    return paths.select("c", "d", "label", "size", (F.col("d") == F.col("length")).alias("last")), convs.select("c", "length")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths and conversations, as of :func:`rebuilt`, of conversations as they are."""
    rows, parts = ordered(turns)
    convs = parts.groupBy("c").agg(F.sum("n").alias("length"))
    places = parts.select("c", "part", (F.col("before") - F.col("low")).alias("shift")).join(convs, "c")
    placed = rows.withColumn("part", F.shiftright("id", 33)).join(places, ["c", "part"]).withColumn("d", F.col("id") + F.col("shift") + 1)
    return placed.select("c", "d", "label", "size", (F.col("d") == F.col("length")).alias("last")), convs


# ---- nodes -------------------------------------------------------------------------------------


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (c, block, d, label, size, last) in order: the digest of the labels of the block so far, and that before."""
    at, state = None, b""
    for batch in batches:
        mine, before = [], []
        for c, block, label in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (c, block) != at:
                at, state = (c, block), b""
            before.append(state or None)
            state = hashlib.sha256(state + label).digest()[:16]
            mine.append(state)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4, 5)), pa.array(mine, pa.binary()), pa.array(before, pa.binary())], names=["c", "block", "d", "size", "last", "mine", "before"])


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of full blocks (c, block, mine) in order: the key of the node before the next block."""
    at, state = None, b""
    for batch in batches:
        out = []
        for c, mine in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            state = hashlib.sha256(state + mine).digest()[:16] if c == at else mine
            at = c
            out.append(state)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b + 1 for b in batch.column(1).to_pylist()], pa.int64()), pa.array(out, pa.binary())], names=["c", "block", "above"])


def keyed(paths: DataFrame, chained: int = CHAINED) -> DataFrame:
    """c, d, size, last, key and parent: a key is the digest of all labels up to there, by blocks of ``chained`` turns, so
    that one long conversation is many tasks and only its block ends are chained by one."""
    rows = paths.select("c", F.floor((F.col("d") - 1) / chained).alias("block"), "d", "label", "size", "last")
    rows = rows.repartition("c", "block").sortWithinPartitions("c", "block", "d")
    rows = shared.written(shared.mapped(rows, _chained, "c long, block long, d long, size long, last boolean, mine binary, before binary"), "chained")
    full = rows.filter(F.col("d") % chained == 0).select("c", "block", "mine")
    if full.isEmpty():
        return rows.select("c", "d", "size", "last", F.col("mine").alias("key"), F.coalesce("before", F.lit(ROOT)).alias("parent"))
    ends = shared.mapped(full.repartition("c").sortWithinPartitions("c", "block"), _block_ends, "c long, block long, above binary")
    rows = rows.join(ends, ["c", "block"], "left")
    along = lambda c: F.when(F.col("block") == 0, F.col(c)).otherwise(digest(F.col("above"), F.col(c)))
    parent = F.when(F.col("before").isNotNull(), along("before")).otherwise(F.coalesce("above", F.lit(ROOT)))
    return shared.written(rows.select("c", "d", "size", "last", along("mine").alias("key"), parent.alias("parent")), "keyed")


def _linked(keys: DataFrame, convs: DataFrame) -> DataFrame:
    """key, parent, conv (least member), depth, n (members), size, ends (whether one ends there), and of the parent conv
    and n, of all nodes. What all conversations begin with is a row a task before it meets."""
    nodes = keys.groupBy("key", "parent").agg(F.min("c").alias("conv"), F.count("*").alias("n"), F.max("d").alias("depth"), F.max("size").alias("size"), F.max("last").alias("ends"))
    root = convs.agg(F.min("c").alias("conv"), F.count("*").alias("n"), F.max(F.col("length") == 0).alias("ends")).filter("n > 0")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), "conv", "n", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), "ends")
    nodes = shared.written(nodes.unionByName(root), "nodes")
    children = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n"))
    of = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"), F.col("n").alias("parent_n")).join(children, "parent")
    below = shared.joined_evenly(nodes.filter("parent is not null").withColumnRenamed("n", "members"), shared.written(of, "parents"), "parent").withColumnRenamed("members", "n")
    top = nodes.filter("parent is null").withColumns({"parent_conv": F.lit(None).cast("long"), "parent_n": F.lit(None).cast("long")})
    return shared.written(below.unionByName(top), "linked")


# ---- tries of shards ---------------------------------------------------------------------------


def louds(parent: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level order of a forest, and its LOUDS bits: a one for each child and a zero, of all roots first, then node by node.

    ``parent``: index of each node's parent (roots: -1). Siblings, and roots, follow ``order``.
    """
    count = len(parent)
    by_parent = np.lexsort((order, parent))
    degree = np.bincount(parent + 1, minlength=count + 1)
    begin = np.cumsum(degree) - degree
    level, levels = np.array([-1]), []
    while len(level):
        n = degree[level + 1]
        at = np.repeat(begin[level + 1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        level = by_parent[at]
        levels.append(level)
    found = np.concatenate(levels)
    degree = np.r_[degree[0], degree[found + 1]]
    bits = np.ones(count + len(degree), bool)
    bits[np.cumsum(degree + 1) - 1] = False
    return found, bits


def navigated(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Parents (roots: -1), degrees and the spans of levels of all nodes in level order, from LOUDS bits."""
    ones, zeros = np.flatnonzero(bits), np.flatnonzero(~bits)
    parent = ones - np.arange(len(ones)) - 1
    degree = np.diff(zeros) - 1
    spans, begin, end = [], 0, int(zeros[0])
    while begin < end:
        spans.append((begin, end))
        begin, end = end, end + int(degree[begin:end].sum())
    return parent, degree, spans


_TRIE = "count long, louds binary, labels binary, sizes array<long>, members array<long>, convs array<long>, parents array<long>, depths array<long>, ends array<boolean>, above binary"
_ROLLED = "key binary, parent binary, conv long, depth long, parent_conv long, n long, n_children long, n_leaves long, saved long, ends boolean"


def _packed(shards: list[pa.Table]) -> pa.RecordBatch:
    """One trie of whole shards."""
    rows = pa.concat_tables(shards).combine_chunks()
    numbers = {c: rows.column(c).to_numpy() for c in ("size", "n", "conv", "depth")}
    key, parent = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "S16") for c in ("key", "parent"))
    top = key == np.frombuffer(b"".join(rows.column("shard").to_pylist()), "S16")
    by_key = np.argsort(key)
    at = np.where(top, -1, by_key[np.minimum(np.searchsorted(key[by_key], parent), len(key) - 1)])
    found, bits = louds(at, numbers["conv"])
    lists = [rows.column(c).combine_chunks().take(pa.array(found)) for c in ("size", "n", "conv", "parent_conv", "depth", "ends")]
    labels = b"".join(rows.column("key").combine_chunks().take(pa.array(found)).to_pylist())
    above = b"".join(rows.column("parent").combine_chunks().take(pa.array(found[: int(top.sum())])).to_pylist())
    values = [len(found), np.packbits(bits).tobytes(), labels, *(x.to_pylist() for x in lists), above]
    names = ["count", "louds", "labels", "sizes", "members", "convs", "parents", "depths", "ends", "above"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.bool_()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def tries(nodes: DataFrame, packed: int = PACKED) -> DataFrame:
    """Tries of nodes (shard, key, parent, conv, depth, n, size, ends, parent_conv): a row for each pack of whole shards, with
    LOUDS bits, the labels of 16 bytes each (digests of prefixes), the other values in level order, and the
    keys of the nodes above its roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0
        for batch in batches:
            shard = batch.column(0).to_pylist()
            if held and count >= packed:  # a shard goes on as long as its rows follow each other
                last = held[-1].column("shard")[-1].as_py()
                cut = next((i for i, s in enumerate(shard) if s != last), len(shard))
                if cut < len(shard):
                    yield _packed([*held, pa.Table.from_batches([batch.slice(0, cut)])])
                    held, count, batch = [], 0, batch.slice(cut)
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
        if count:
            yield _packed(held)

    columns = ["shard", "key", "parent", "conv", "depth", "n", "size", "ends", "parent_conv"]
    return shared.mapped(nodes.select(*columns).repartition("shard").sortWithinPartitions("shard"), run, _TRIE)


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of tries with what their subtrees hold, added up level by level from the deepest."""
    for batch in batches:
        for row in batch.to_pylist():
            count = row["count"]
            bits = np.unpackbits(np.frombuffer(row["louds"], np.uint8), count=2 * count + 1).astype(bool)
            parent, degree, spans = navigated(bits)
            n = np.array(row["members"], np.int64)
            leaves = (degree == 0).astype(np.int64)
            saved = (n - 1) * np.array(row["sizes"], np.int64)
            for a, b in reversed(spans[1:]):
                np.add.at(leaves, parent[a:b], leaves[a:b])
                np.add.at(saved, parent[a:b], saved[a:b])
            ends = np.array(row["ends"], bool)
            children = np.where((n == 1) & ~ends, 1, degree)  # the path of one conversation goes on elsewhere
            key = [row["labels"][i : i + 16] for i in range(0, 16 * count, 16)]
            above = [row["above"][i : i + 16] for i in range(0, len(row["above"]), 16)]
            above += [None] * (count - len(above))
            columns = [pa.array(key, pa.binary()), pa.array(above, pa.binary()), row["convs"], row["depths"], row["parents"], n, children, leaves, saved]
            yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns), pa.array(ends)], names=["key", "parent", "conv", "depth", "parent_conv", "n", "n_children", "n_leaves", "saved", "ends"])


def _merged(upper: DataFrame, rolled: DataFrame) -> DataFrame:
    """The upper nodes with what their subtrees hold: what shards add to them, then sums over descendants that are so many
    levels below, twice as many in each round."""
    shards = rolled.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("from_shards"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("more"))
    own = upper.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("from_upper"))
    rows = upper.join(shards, "key", "left").join(own, "key", "left").na.fill(0, ["from_shards", "from_upper", "leaves", "more"])
    children = F.col("from_shards") + F.col("from_upper")
    rows = rows.withColumns({"n_children": children, "leaves": F.col("leaves") + (children == 0).cast("long"), "more": F.col("more") + (F.col("n") - 1) * F.col("size")})
    state = shared.written(rows.select("key", F.col("parent").alias("up"), "leaves", "more"), "upper")
    counts = shared.written(rows.select("key", "conv", "depth", "parent_conv", "n", "n_children", "ends"), "upper_nodes")
    while not state.filter("up is not null").isEmpty():
        add = state.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("add_leaves"), F.sum("more").alias("add_more"))
        far = state.select(F.col("key").alias("up"), F.col("up").alias("top"))
        state = state.join(add, "key", "left").join(far, "up", "left").na.fill(0, ["add_leaves", "add_more"])
        state = shared.written(state.select("key", F.col("top").alias("up"), (F.col("leaves") + F.col("add_leaves")).alias("leaves"), (F.col("more") + F.col("add_more")).alias("more")), "upper")
    return counts.join(state.drop("up"), "key").select("key", "conv", "depth", "parent_conv", "n", "n_children", F.col("leaves").alias("n_leaves"), F.col("more").alias("saved"), "ends")


# ---- conversations that end at a node ----------------------------------------------------------


def _end_digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256 of rows (key, c): the ids in order, joined by commas. Ids are joined in chunks by all tasks; the
    digest, which can be computed in order only, reads the chunks of a key one after the other."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0
        for batch in batches:
            out = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or size > CHUNK):
                    out.append((key, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    key, first = k, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _batch(out)
        yield _batch([(key, first, ",".join(ids))] if ids else [])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["key", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key and key is not None:
                    out.append((key, state.hexdigest()))
                if k != key:
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _done(out)
        yield _done([(key, state.hexdigest())] if key is not None else [])

    def _done(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["key", "ends_sha256"])

    joined = shared.mapped(ends.select("key", "c").repartitionByRange("key", "c").sortWithinPartitions("key", "c"), chunks, "key binary, first long, ids string")
    return shared.mapped(joined.repartition("key").sortWithinPartitions("key", "first"), digests, "key binary, ends_sha256 string")


# ---- the operator ------------------------------------------------------------------------------


def prefix_trie(paths: DataFrame, convs: DataFrame, heavy: int = HEAVY, packed: int = PACKED, chained: int = CHAINED) -> DataFrame:
    """A row for each node of the trie of ``paths`` (c, d from 1, label, size, last) of ``convs`` (c, length).

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    Nodes of one conversation below another such node are a path that nothing else shares; they need
    no trie. Where a conversation occurs once only, however long, that's most of it.
    """
    keys = keyed(paths, chained)
    nodes = _linked(keys, convs)
    alone = (F.col("n") == 1) & (F.coalesce("parent_n", F.lit(2)) == 1)
    tails = nodes.filter(alone).select("key", "conv", "depth", "parent_conv", "n", (~F.col("ends")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"), "ends")
    forest = nodes.filter(~alone)
    is_upper = (F.col("n") > heavy) | F.col("parent").isNull()
    upper = shared.written(forest.filter(is_upper), "upper_levels")
    # A conversation leaves the upper levels at the first node below them, which names its shard.
    below = upper.filter("parent is not null").select("key", "n")
    if below.isEmpty():
        shards = keys.filter("d = 1").select(F.col("c").alias("conv"), F.col("key").alias("shard"))
    else:
        through = shared.joined_evenly(keys.select("c", "key"), below, "key").groupBy("c").agg(F.count("*").alias("u"))
        shards = keys.select("c", "d", "key").join(through, "c", "left").filter(F.col("d") == F.coalesce("u", F.lit(0)) + 1).select(F.col("c").alias("conv"), F.col("key").alias("shard"))
    packs = shared.written(tries(forest.filter(~is_upper).join(shards, "conv"), packed), "tries")
    rolled = shared.written(shared.mapped(packs, _rolled, _ROLLED), "rolled")
    found = tails.unionByName(rolled.drop("parent")).unionByName(_merged(upper, rolled))
    ends = keys.filter("last").select("key", "c").unionByName(convs.filter("length = 0").select(F.lit(ROOT).alias("key"), "c"))
    ended = found.filter("ends").join(_end_digests(ends), "key")
    out = ended.unionByName(found.filter(~F.col("ends")).withColumn("ends_sha256", F.lit(NOTHING)))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, rebuilt as :func:`rebuilt` says.

    Rows are ordered by turn (null first), then role and text; rows that repeat are turns of their own. Null
    roles and texts are empty. Rows of a null conv_id are no conversation, as no number can be made of it. No
    rows give no nodes, not even the root. Negative ids belong to the hundred that ends at their multiple
    nearest zero. Extra columns are ignored.
    """
    return prefix_trie(*rebuilt(shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
