"""Token ids in binary files: canonical, length-limited Huffman codes from global counts (operator 9).

A file set is a code book (id, length) and blocks. A block holds whole documents in ascending order
of their keys and decodes on its own: by table, from bit offsets kept every ``EVERY`` ids, all
of them at once.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, normalizers

from tessera.llm import pieces, shared
from tessera.llm.bpe import byte_letters

MAX_BITS = 18
#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Ids of a block (a longer document makes a longer block), and ids between two bit offsets.
BLOCK, EVERY = 1 << 16, 128
#: magic, version, documents, ids, ids of the shard before, bits, crc32 of the bit stream
_HEADER = struct.Struct("<4sIIQQQI")
_MAGIC = b"THUF"


class WordEncoder:
    """Encodes as a lower-casing word-level BPE file of the tokenizers library does: the library
    merges, a piece once for each worker and bounded table; normalising and cutting are vectorised."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.model = (tok := Tokenizer.from_file(path)).model
        self.special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = dict(enumerate(byte_letters()))
        self.newer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.pieces = pieces.Remembered(self._merged, remembered)

    def forget(self) -> None:
        self.pieces.forget()

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if pieces.unassigned()[pieces.code_points(text)].any():  # newer than Python's tables
            return self.newer.normalize_str(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # no final sigma: letters are lowered one by one

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letters = self.model.tokenize, self.letters
        found, counts = [], []
        for word in words:
            if not (word.isascii() and word.isprintable()):
                word = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters)
            tokens = tokenize(word)
            counts.append(len(tokens))
            found += [t.id for t in tokens]
        return np.array(found, np.uint32), np.array(counts, np.int64)

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array (``end`` behind each text) and the number of each."""
        ids, counts = pieces.by_runs(texts, self._encoded)
        if end is None:
            return ids, counts
        return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, owner, mark = [], [], []
        for i, t in enumerate(texts):
            for part in self.cut.split(t) if any(s in t for s in self.special) else [t]:
                parts.append("" if part in self.special else self.normal(part))
                owner.append(i)
                mark.append(self.special.get(part, -1))
        joined = "".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends_of = np.cumsum(sizes)
        points = pieces.code_points(joined)
        starts, ends = pieces.boundaries(points, (ends_of - sizes)[sizes > 0], word=True)
        ids, counts = self.pieces.of(joined, points, starts, ends)
        total = np.concatenate([[0], np.cumsum(counts)])
        per_part = np.diff(total[np.searchsorted(starts, np.concatenate([[0], ends_of]))])
        marked = np.array(mark, np.int64)
        at = marked >= 0
        if at.any():
            ids = np.insert(ids, np.cumsum(per_part)[at], marked[at].astype(np.uint32))
        return ids, np.bincount(np.array(owner, np.int64), per_part + at, len(texts)).astype(np.int64)


@cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary. It keeps its pieces from task to task, bounded by
    REMEMBERED: learning them anew in each task would cost a tenth of the time."""
    return WordEncoder(path)


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most`` bits (package-merge); 0: doesn't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << most:
        raise ValueError("more symbols than codes")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    # A level merges the symbols with the pairs of the level before; ``is_leaf`` tells them apart.
    levels, below = [], np.empty(0, np.int64)
    for _ in range(most):
        merged = np.concatenate([weight, below])
        sort = np.argsort(merged, kind="stable")
        levels.append(sort < n)
        merged = merged[sort]
        even = len(merged) // 2 * 2
        below = merged[0:even:2] + merged[1:even:2]
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


class Code:
    """The canonical code of a table of lengths: by length, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        size = self.lengths[order].astype(np.uint64)
        self.codes = np.zeros(len(lengths), np.uint64)
        first = np.zeros(len(order), np.uint64)
        if len(order):
            span = np.uint64(1) << (np.uint64(MAX_BITS) - size)
            first = np.cumsum(span) - span
            self.codes[order] = first >> (np.uint64(MAX_BITS) - size)
            self.symbol = np.repeat(order, span.astype(np.int64)).astype(np.uint32)
            self.step = np.repeat(size, span.astype(np.int64)).astype(np.int64)
        else:
            self.symbol, self.step = np.empty(0, np.uint32), np.empty(0, np.int64)
        spare = (1 << MAX_BITS) - len(self.symbol)
        self.symbol = np.concatenate([self.symbol, np.zeros(spare, np.uint32)])
        self.step = np.concatenate([self.step, np.ones(spare, np.int64)])

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """Bit stream, bit offset of every EVERY-th id, and bits."""
        size = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(size)
        at = ends - size
        bits = int(ends[-1]) if len(ids) else 0
        value = self.codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        words = at >> 5
        n = (bits >> 5) + 2
        # Bits of different ids never overlap, so sums are unions; 32 bits are exact in a double.
        high = np.bincount(words, (value >> np.uint64(32)).astype(np.float64), n)
        low = np.bincount(words + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        return (high + low[: len(high)]).astype(np.uint32).astype(">u4").tobytes()[: (bits + 7) // 8], at[::EVERY], bits

    def unpack(self, stream: bytes, offsets: np.ndarray, count: int) -> np.ndarray:
        """``count`` ids: from all offsets at once, an id a step."""
        raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = offsets.astype(np.int64)
        out = np.empty((EVERY, len(at)), np.uint32)
        most, limit = np.uint32((1 << MAX_BITS) - 1), len(window) - 1
        for i in range(EVERY):
            peek = window[np.minimum(at >> 3, limit)] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32) & most
            out[i] = self.symbol[peek]
            at += self.step[peek]
        return out.T.reshape(-1)[:count]


def packed(code: Code, keys: list[int | None], counts: list[int], ids: np.ndarray, before: int) -> bytes:
    """A block: header, keys (and which are null), ids of each document, bit offsets, bit stream."""
    stream, offsets, bits = code.pack(ids)
    null = np.array([k is None for k in keys], np.uint8)
    known = np.array([0 if k is None else k for k in keys], "<i8")
    head = _HEADER.pack(_MAGIC, 1, len(keys), len(ids), before, bits, zlib.crc32(stream))
    return b"".join([head, known.tobytes(), null.tobytes(), np.array(counts, "<u4").tobytes(), offsets.astype("<u8").tobytes(), stream])


def unpacked(code: Code, block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """Keys, ids of each document, all ids, and the ids of the shard before this block."""
    magic, version, docs, count, before, bits, crc = _HEADER.unpack_from(block)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a block of token ids")
    at = _HEADER.size
    known = np.frombuffer(block, "<i8", docs, at)
    null = np.frombuffer(block, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(block, "<u4", docs, at := at + docs)
    offsets = np.frombuffer(block, "<u8", -(-count // EVERY), at := at + 4 * docs)
    stream = block[at + 8 * len(offsets) :]
    if zlib.crc32(stream) != crc or len(stream) != (bits + 7) // 8:
        raise ValueError("a damaged block of token ids")
    keys = [None if z else k for k, z in zip(known.tolist(), null.tolist(), strict=True)]
    return keys, counts, code.unpack(stream, offsets, count), before


def encoded(docs: DataFrame, path: str, end: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ids (unsigned 16-bit little-endian where the vocabulary allows, else 32) of each text.

    Keys are integers of up to 64 bits, as the file format has them; others raise a ValueError.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"the files are ordered by an integer key; {key} is of type {docs.schema[key].dataType.simpleString()}")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(path)
        for batch, texts in shared.bounded(batches, "__text"):
            ids, counts = enc.encode(texts, end)
            flat = ids.astype("<u4").view(np.uint8)
            blob = flat.reshape(-1, 4)[:, :2].tobytes() if not len(ids) or ids.max() < 1 << 16 else None
            width = 2 if blob is not None else 4
            offsets = np.concatenate([[0], np.cumsum(counts) * width]).astype(np.int32)
            data = pa.py_buffer(blob if blob is not None else flat.tobytes())
            column = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), data])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(counts), width, np.int32)), column], names=["key", "width", "ids"])

    return shared.mapped(rows, run, "key long, width int, ids binary")


def _ids(width: int, blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if width == 2 else "<u4").astype(np.uint32)


def global_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all rows: summed in tasks; at most ``size`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        held_, waiting = [], 0
        for batch in batches:
            for width, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held_.append(_ids(width, blob))
                if (waiting := waiting + len(held_[-1])) > 1 << 20:
                    total += np.bincount(np.concatenate(held_), minlength=size)
                    held_, waiting = [], 0
        if held_:
            total += np.bincount(np.concatenate(held_), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    sums = shared.mapped(rows.select("width", "ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[sums.column("id").to_numpy()] = sums.column("n").to_numpy()
    return out


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> None:
    """Writes the ids of all texts, each followed by ``end``, in ascending order of the keys.

    Keys that are null come first; rows of one key are ordered by a hash of their ids; repeated rows stay. A
    null text counts as empty and has the end id alone. The shards are ranges of keys.
    """
    spark = docs.sparkSession
    rows = shared.written(encoded(docs, tokenizer, end, text, key), "ids")
    size = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    lengths = code_lengths(global_counts(rows, max(size, end + 1)))
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]  # at most the vocabulary
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{folder}/book")
    held = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(held.value)
        keys, parts, counts, shard, number, before, waiting = [], [], [], 0, 0, 0, 0

        def out() -> pa.RecordBatch:
            nonlocal number, before
            ids = np.concatenate(parts)
            payload = packed(code, keys, counts, ids, before)
            batch = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "block", "n_tokens", "payload"])
            number, before = number + 1, before + len(ids)
            for x in (keys, parts, counts):
                x.clear()
            return batch

        for batch in batches:
            for k, width, blob, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                keys.append(k)
                parts.append(_ids(width, blob))
                counts.append(len(parts[-1]))
                waiting += counts[-1]
                if waiting >= block:
                    yield out()
                    waiting = 0
        if keys:
            yield out()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Ranges are cut by key, and by a hash where many rows share a key: what is sampled stays small.
    order = [F.asc_nulls_first("key"), F.asc("h")]
    ordered = rows.withColumn("h", F.xxhash64("ids")).repartitionByRange(n, *order).sortWithinPartitions(*order, "ids")
    ordered = ordered.select("key", "width", "ids", F.spark_partition_id().alias("shard"))
    shared.mapped(ordered, run, "shard int, block long, n_tokens long, payload binary").write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def _blocks(spark: SparkSession, folder: str, made, schema: str) -> DataFrame:
    """Rows that ``made`` derives from each decoded block: keys, first id's place, ends, and ids."""
    book = spark.read.parquet(f"{folder}/book").toArrow()
    lengths = np.zeros(max(book.column("id").to_pylist(), default=0) + 1, np.uint8)
    lengths[book.column("id").to_numpy()] = book.column("length").to_numpy()
    blocks = spark.read.schema("shard int, block long, n_tokens long, payload binary").parquet(f"{folder}/blocks")
    totals = {r[0]: r[1] for r in blocks.groupBy("shard").agg(F.sum("n_tokens")).collect()}  # one a shard
    base, total = {}, 0
    for s in sorted(totals):
        base[s], total = total, total + totals[s]
    held = spark.sparkContext.broadcast((lengths, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths_, base_ = held.value
        code = Code(lengths_)
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts, ids, before = unpacked(code, batch.column(1)[i].as_py())
                yield made(keys, base_[batch.column(0)[i].as_py()] + before, np.cumsum(counts.astype(np.int64)), counts.astype(np.int64), ids)

    return shared.mapped(blocks.select("shard", "payload"), run, schema)


def read_tokens(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before), and ids of every document of a file set."""

    def made(keys, first, ends, counts, ids) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(first + ends - counts), lists], names=[key, "start", "ids"])

    return _blocks(spark, folder, made, f"`{key}` long, start long, ids array<int>")


def read_digests(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and crc32 of the ids (as little-endian unsigned 32-bit integers) of every
    document of a file set; the ids stay where they are decoded."""

    def made(keys, first, ends, counts, ids) -> pa.RecordBatch:
        flat = ids.astype("<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(first + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return _blocks(spark, folder, made, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents in files and reads place, number and checksum of each back."""
    folder = shared.new_path(spark, "tokens")
    write_tokens(shared.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, folder)
