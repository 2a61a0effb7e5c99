"""SimHash near-duplicates by deletion-variant signatures (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import graph, shared

SHINGLE_WORDS, MAX_BITS = 3, 2
#: Fingerprints under one signature of which all pairs are compared at once; up to WALKED are walked for
#: a spanning forest of their links, and more take the exact way of ``_crowded_links``.
COMPARED, WALKED = 64, 8192


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the ASCII-lower-cased text; without words: zero."""
    words = text.lower().split()  # bytes split at \x20 and \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle_words + 1
    if n < 2:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        cuts = map(slice, starts[:n].tolist(), ends[shingle_words - 1 :].tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(42)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and fingerprint (as signed long, ``fp``) of every row; a null text counts as empty."""
    return _fingerprinted(docs, text, [key]).select(F.col("k")[key].alias(key), "fp")


def _fingerprinted(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """k, a struct of the columns ``keep``, and fp."""
    rows = shared.carried(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in shared.bounded(batches, "t"):
            found = np.fromiter((fingerprint(t.encode()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["k", "fp"])

    return shared.mapped(rows, run, shared.with_results(rows, "fp long"))


def signatures(fps: DataFrame) -> DataFrame:
    """64 signatures for each fingerprint: one of two 32-bit segments with one bit wild.

    Of two fingerprints that differ in up to three bits, one segment differs in at most one bit,
    and so they share the signature in which that bit is wild.
    """
    variant = F.expr("""transform(sequence(0, 63), i -> (cast(i as bigint) << 32) |
        ((IF(i < 32, fp, shiftrightunsigned(fp, 32)) & 4294967295L) & ~shiftleft(1L, i % 32)))""")
    return fps.select("fp", F.explode(variant).alias("k"))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _forest(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all distinct fingerprints that differ in ``max_bits`` or fewer bits, one for each
    that is reached: memory grows with the fingerprints, not with their pairs."""
    rest, left, right = np.unique(fp), [], []
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            own = reached.pop()
            near = _distance(rest.view(np.uint64), own.view(np.uint64)) <= max_bits
            if near.any():
                right.append(rest[near])
                left.append(np.full(len(right[-1]), own))
                reached.extend(right[-1])
                rest = rest[~near]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def _compared(max_bits: int):
    """Walks rows sorted by signature; yields links, and the rows of crowded signatures."""

    def links(k: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        unsigned = fp.view(np.uint64)
        for step in range(1, min(COMPARED, len(k))):
            at = np.flatnonzero(k[step:] == k[:-step])
            if not len(at):
                break
            x, y = unsigned[at], unsigned[at + step]
            near = (_distance(x, y) <= max_bits) & (x != y)
            # Equal segments share all 32 signatures; one of them will do.
            part = (k[at] >> 32).astype(np.uint64)
            segment = (((x ^ y) >> np.where(part < 32, 0, 32).astype(np.uint64)) & np.uint64(0xFFFFFFFF)) == 0
            near &= ~segment | (part % np.uint64(32) == 0)
            left.append(fp[at[near]])
            right.append(fp[at[near] + step])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2

    def out(a: np.ndarray, b: np.ndarray, crowded: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), crowded))], names=["a", "b", "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_k = kept_fp = np.empty(0, np.int64)
        crowd = None  # the signature that ran on beyond WALKED
        for batch in batches:
            k = np.concatenate([kept_k, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([kept_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(k):
                continue
            if crowd is not None and k[0] == crowd:
                n = np.searchsorted(k, crowd, "right")
                yield out(k[:n], fp[:n], True)
                k, fp = k[n:], fp[n:]
                if not len(k):
                    kept_k, kept_fp = k, fp
                    continue
            crowd = None
            tail = np.searchsorted(k, k[-1], "left")
            kept_k, kept_fp = k[tail:], fp[tail:]
            yield from settled(k[:tail], fp[:tail])
            if len(kept_k) > WALKED:
                crowd = kept_k[0]
                yield out(kept_k, kept_fp, True)
                kept_k = kept_fp = np.empty(0, np.int64)
        yield from settled(kept_k, kept_fp)

    def settled(k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        _, begin, size = np.unique(k, return_index=True, return_counts=True)
        crowded = np.repeat(size > WALKED, size)
        if crowded.any():
            yield out(k[crowded], fp[crowded], True)
        for i in np.flatnonzero((size > COMPARED) & (size <= WALKED)):
            a, b = _forest(fp[begin[i] : begin[i] + size[i]], max_bits)
            if len(a):
                yield out(a, b, False)
        few = np.repeat(size <= COMPARED, size)
        a, b = links(k[few], fp[few])
        if len(a):
            yield out(a, b, False)

    return run


def _crowded_links(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links among the fingerprints of crowded signatures, exactly and without pairs.

    Under a signature (k) two fingerprints may differ in its wild bit or not. With the other
    segment's bits wild as well, so many that ``max_bits`` are wild in all, all who agree on the
    rest are near each other, so that a link to the least of them suffices.
    """
    masks = [(sum(1 << i for i in bits), free) for free in (0, 1) for bits in combinations(range(32), max_bits - free)]
    wild, free = (np.array(x, np.int64) for x in zip(*masks, strict=True))

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                k, fp = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, 256).columns)
                place = k >> 32
                own = np.where(place < 32, fp, fp >> 32)
                other = np.where(place < 32, fp >> 32, fp) & 0xFFFFFFFF
                bit = np.where(free == 1, 2, (own >> (place % 32) & 1)[:, None])
                columns = [np.repeat(fp, len(wild)), np.repeat(k, len(wild)), np.tile(wild, len(k)), bit.ravel(), (other[:, None] & ~wild).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fp", "k", "m", "bit", "o"])

    rows = rows.select(F.col("a").alias("k"), F.col("b").alias("fp")).distinct()
    keyed = shared.mapped(rows, variants, "fp long, k long, m long, bit long, o long")
    keys = ["k", "m", "bit", "o"]
    least = keyed.groupBy(*keys).agg(F.min("fp").alias("root"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keyed.join(least, keys).filter("fp != root").select(F.col("fp").alias("a"), F.col("root").alias("b"))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all that differ in ``max_bits`` or fewer
    bits (each such pair is linked, or both are linked to one between)."""
    if not 1 <= max_bits <= 3:
        raise ValueError("two segments find links of one to three bits")
    spark = fps.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # A number of partitions is named, as few small rows would be one task's that become 64 times as many.
    rows = signatures(fps.select("fp").repartition(n, "fp").distinct()).select("k", "fp")
    found = shared.mapped(rows.repartition(n, "k").sortWithinPartitions("k", "fp"), _compared(max_bits), "a long, b long, crowded boolean")
    found = shared.written(found, "links")
    near = found.filter("not crowded").select("a", "b")
    crowded = found.filter("crowded")
    if not crowded.isEmpty():
        near = near.union(_crowded_links(crowded, max_bits))
    return near


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """Key, fingerprint and component of every row of ``docs``.

    ``component_id`` is the least key reachable over links of ``max_bits`` or fewer differing bits.
    Texts without words have the fingerprint zero and are linked like others. Repeated rows stay,
    null keys never name a component (one of null keys only is null). Keys are of any type that has an
    order. Copies meet in one fingerprint before anything is joined, and the rows of a fingerprint of
    very many copies are spread when they get their component.
    """
    own = shared.written(fingerprints(docs, text, key).toDF("id", "fp"), "fingerprints")
    least = shared.written(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "least")
    stars = shared.written(graph.components(links(least, max_bits)), "stars")
    member = stars.join(least.select(F.col("fp").alias("node"), "least"), "node")
    named = member.groupBy("root").agg(F.min("least").alias("named"), F.count("*").alias("n"))
    linked = shared.joined_evenly(member.select("root", "node"), shared.written(named, "named"), "root").select(F.col("node").alias("fp"), "named")
    component = least.join(linked, "fp", "left").select("fp", F.coalesce("named", "least").alias("component_id"), "n")
    found = shared.joined_evenly(own, shared.written(component, "of_prints"), "fp")
    return found.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: one for each component, that of the least key.

    Where several rows have that key, the least in order of text, then of the other columns, stays; of
    components of null keys only, one row for each fingerprint. The keys that go are found first: if
    they are few they are broadcast and no text is shuffled, else texts and keys are joined. All
    columns, whatever their names, stay as they are.
    """
    found = shared.written(near_duplicates(docs, text, key, max_bits).toDF("id", "f", "c"), "components")
    again = shared.written(found.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("__again")), "again")
    gone = found.filter(~F.col("id").eqNullSafe(F.col("c"))).select("id")
    gone = shared.written(gone.union(again).distinct().toDF("gone"), "gone")
    few = F.broadcast(gone) if shared.fits(gone, 64) else gone
    rows = shared.carried(docs, docs.columns, text)
    own = rows["k"][key]
    once = rows.join(few, own.eqNullSafe(few["gone"]), "left_anti").select("k.*")
    if again.isEmpty():
        return once
    # Keys of more than one row: which of the rows is meant, the fingerprint tells.
    rest = rows.join(again, own.eqNullSafe(again["__again"]), "left_semi")
    rest = _fingerprinted(rest.select(F.struct("t", "k").alias("row"), "t"), "t", ["row"])
    rest = rest.select(F.col("k.row").alias("row"), F.col("k.row.k")[key].alias("id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("print"))
    kept = found.filter(F.col("id").eqNullSafe(F.col("c"))).select(F.col("id").alias("of"), "f").distinct()
    rest = rest.join(kept, rest["id"].eqNullSafe(kept["of"]) & (rest["print"] == kept["f"]), "left_semi")
    # One row a key: of equal keys the least row; null keys by fingerprint.
    least = rest.groupBy("id", F.when(F.col("id").isNull(), F.col("print")).alias("g")).agg(F.min("row").alias("r"))
    return once.unionByName(least.select("r.k.*"))


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see :func:`near_duplicates`."""
    return near_duplicates(shared.table(spark, sf_dir, "documents"))
