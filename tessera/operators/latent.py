"""Vectors that carry meaning, learned from the corpus: a randomised singular value decomposition of its term-document matrix.

Texts are sparse rows, in blocks over all tasks. Each round multiplies the blocks with a narrow matrix that all tasks
have, adds the products up by chunks of terms, and makes the sum orthogonal again; its span turns towards the strongest
directions of the corpus. Words that occur with the same words come to lie in the same direction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scratch
from tessera.functions import vectors
from tessera.functions.enrich import words

#: Terms of a model at most, the most frequent ones, which bounds what is broadcast and what the driver makes
#: orthogonal (terms x (dimensions + SPARE) x 8 bytes); texts that have a term at least.
TERMS, MIN_TEXTS = 20_000, 2
#: Directions besides those that are kept, rounds, and terms whose sums travel together.
SPARE, ROUNDS, CHUNK = 16, 4, 512
#: Texts and their words that get vectors at once, and tasks of a product for each core.
ROWS, ITEMS, TASKS = 1024, 1 << 20, 3


class Latent:
    """A model: ``terms`` in order, ``idf`` of each, the right singular vectors (terms x dimensions) and singular values."""

    def __init__(self, spark: SparkSession, terms: list[str], idf: np.ndarray, right: np.ndarray, values: np.ndarray):
        self.spark, self.terms, self.idf, self.right, self.values = spark, terms, idf, right, values

    @classmethod
    def fitted(cls, df: DataFrame, text: str, dimensions: int = 384, terms: int = TERMS, min_texts: int = MIN_TEXTS, rounds: int = ROUNDS, seed: int = 1) -> Latent:
        """Learns from all texts of ``df``. A corpus of fewer directions than ``dimensions`` leaves the rest zero."""
        spark = df.sparkSession
        space = scratch.Scratch(spark, "latent")
        counts = space.table(df.select(words(F.col(text)).alias("ws")).mapInArrow(_counted, "terms array<string>, n array<int>"), "counts")
        total = counts.count()
        known = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_texts).orderBy(F.desc("df"), "term").limit(terms).toPandas()  # ``terms`` rows
        names, idf = known["term"].tolist(), np.log((1 + total) / (1 + known["df"].to_numpy(np.float64))) + 1 if len(known) else np.empty(0)
        held = spark.sparkContext.broadcast((pa.array(names, pa.string()), idf))

        def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                terms, n = batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False)
                t = pc.fill_null(pc.index_in(terms.flatten(), held.value[0]), -1).to_numpy(zero_copy_only=False)
                sizes = np.bincount(_owners(terms)[t >= 0], minlength=len(terms))
                w = np.log1p(n[t >= 0]) * held.value[1][t[t >= 0]]
                offsets = pa.array(np.append(0, np.cumsum(sizes[sizes > 0])), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(t[t >= 0], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(w))], names=["t", "w"])

        rows = space.table(counts.mapInArrow(weighted, "t array<int>, w array<double>"), "rows")
        # Each task gives sums of all terms: few tasks, that what is added up doesn't grow with the input.
        rows = rows.coalesce(TASKS * spark.sparkContext.defaultParallelism)
        width = min(dimensions + SPARE, max(len(names), 1))
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(names), width)))[0] if names else np.zeros((0, width))
        for _ in range(rounds if names else 0):
            basis = np.linalg.qr(cls._product(rows, basis))[0]
        # What is left is the exact decomposition within the span.
        power, turn = np.linalg.eigh(basis.T @ cls._product(rows, basis)) if names else (np.zeros(width), np.eye(width))
        order = np.argsort(-power)[:dimensions]
        values, right = np.sqrt(np.maximum(power[order], 0)), basis @ turn[:, order]
        right[:, values <= 1e-9 * max(values.max(initial=0), 1e-300)] = 0
        missing = dimensions - len(order)
        space.drop()
        return cls(spark, names, idf, np.pad(right, ((0, 0), (0, missing))), np.pad(values, (0, missing)))

    @staticmethod
    def _product(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
        """X^T (X basis) of the normalised rows X, summed over all blocks."""
        held = rows.sparkSession.sparkContext.broadcast(basis)
        width, size = basis.shape[1], len(basis)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = held.value
            total = np.zeros_like(m)
            for batch in batches:
                _added(total, m, *_flat(batch))
            for at in range(0, size, CHUNK):
                chunk = total[at : at + CHUNK]
                if chunk.any():
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([chunk.tobytes()], pa.binary())], names=["at", "sums"])

        def summed(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(b, np.float64) for b in part.column("sums").to_pylist())
            return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

        out = np.zeros_like(basis)
        found = rows.mapInArrow(partial, "at int, sums binary").groupBy("at").applyInArrow(summed, "at int, sums binary")
        for r in found.collect():  # as large as ``basis``, which is bounded by TERMS
            chunk = np.frombuffer(r["sums"], np.float64).reshape(-1, width)
            out[r["at"] : r["at"] + len(chunk)] = chunk
        return out

    def model(self):
        """A function of a text column to its vector, for :func:`tessera.plans.gold.build`: normalised, null where no word
        is known."""
        held = self.spark.sparkContext.broadcast((pa.array(self.terms, pa.string()), self.idf, self.right))

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def folded(tokens: pa.Array) -> pa.Array:
            names, idf, right = held.value
            out = []
            for own in _slices(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)):
                piece = tokens.slice(own.start, own.stop - own.start)
                t = pc.fill_null(pc.index_in(piece.flatten(), names), -1).to_numpy(zero_copy_only=False)
                cells, n = np.unique(_owners(piece)[t >= 0] * len(idf) + t[t >= 0], return_counts=True)
                owner, t = np.divmod(cells, max(len(idf), 1))
                sizes = np.bincount(owner, minlength=len(piece))
                v = _times(right, t, np.log1p(n) * idf[t], sizes)
                length = np.sqrt((v * v).sum(1))
                offsets = np.append(0, np.cumsum(length > 0)) * right.shape[1]
                v = v[length > 0] / length[length > 0, None]
                out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(length <= 0, False)), v.ravel()))
            return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

        return lambda text: folded(words(text))

    def embedded(self, df: DataFrame, text: str, name: str = "embedding_vector") -> DataFrame:
        return df.withColumn(name, vectors.sound(self.model()(F.col(text)), self.right.shape[1]))

    def save(self, folder: str) -> None:
        row = (self.terms, self.idf.tolist(), bytearray(self.right.tobytes()), self.values.tolist())
        self.spark.createDataFrame([row], "terms array<string>, idf array<double>, right binary, values array<double>").coalesce(1).write.parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Latent:
        r = spark.read.parquet(folder).first()
        return cls(spark, r["terms"], np.array(r["idf"]), np.frombuffer(r["right"], np.float64).reshape(len(r["terms"]), -1), np.array(r["values"]))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and normalised weights of all rows in one array each, and how many a row has."""
    t, w = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False)
    n = np.diff(batch.column(0).offsets.to_numpy())
    owner = np.repeat(np.arange(len(n)), n)
    length = np.sqrt(np.bincount(owner, w * w, len(n)))
    return t, w / np.maximum(length, 1e-300)[owner], n



def _owners(lists: pa.Array) -> np.ndarray:
    """The row of each element of an array of lists."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def _slices(n: np.ndarray) -> Iterator[slice]:
    """Slices of at most ROWS rows with ITEMS elements together, or of one row."""
    ends, begin = np.cumsum(n), 0
    while begin < len(n):
        until = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + ITEMS, "right"))
        until = max(begin + 1, min(until, begin + ROWS))
        yield slice(begin, until)
        begin = until


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text that has any, and how often it has them."""
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten().dictionary_encode()
        size = max(len(flat.dictionary), 1)
        cells, n = np.unique(_owners(lists) * size + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
        sizes = np.bincount(cells // size, minlength=len(lists))
        offsets = pa.array(np.append(0, np.cumsum(sizes[sizes > 0])), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, flat.dictionary.take(pa.array(cells % size))), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))], names=["terms", "n"])


def _times(m: np.ndarray, t: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The product of rows (terms, weights, and how many a row has) with ``m``. A row's part of ``m`` stays in the
    processor's cache, which that of many rows doesn't."""
    out = np.zeros((len(n), m.shape[1]))
    ends = np.cumsum(n).tolist()
    for i, (low, high) in enumerate(zip([0, *ends], ends, strict=False)):
        out[i] = w[low:high] @ m.take(t[low:high], 0)
    return out


def _added(total: np.ndarray, m: np.ndarray, t: np.ndarray, w: np.ndarray, n: np.ndarray) -> None:
    """Adds X^T (X m) of the rows X to ``total``; no row has a term twice."""
    ends = np.cumsum(n).tolist()
    for low, high in zip([0, *ends], ends, strict=False):
        own, weight = t[low:high], w[low:high]
        total[own] += np.outer(weight, weight @ m.take(own, 0))
