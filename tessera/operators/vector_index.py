"""A vector index of inverted lists: k-means cells, product-quantised residuals, exact rerank.

Cells and codes are fitted on a bounded sample; every row is in the index. A search reads the lists of the cells that
are nearest to its queries only, ranks rows by their codes, and scores the best exactly. The radius of each cell
tells which other cells might hold something nearer, so that a search can also be made exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scratch
from tessera.functions import vectors

#: Rows that cells and codes are fitted on at most, rounds of k-means, queries that are searched at once.
SAMPLE, ROUNDS, AT_ONCE = 20_000, 12, 4096
#: Rows that a task compares with the queries at once, and hits that it holds.
ROWS, HELD = 10_000, 1 << 17


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row, and the squared distance."""
    d = (centres * centres).sum(1)[None] - 2 * x @ centres.T
    at = d.argmin(1)
    return at, np.maximum(d[np.arange(len(x)), at] + (x * x).sum(1), 0)


def means(x: np.ndarray, count: int, seed: int = 1, rounds: int = ROUNDS) -> np.ndarray:
    """k-means with seeding by distance; of fewer distinct rows the rest repeats."""
    r = np.random.default_rng(seed)
    centres = x[[r.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < count:
        k = r.choice(len(x), p=d / d.sum()) if d.sum() > 0 else r.integers(len(x))
        centres = np.concatenate([centres, x[[k]]])
        d = np.minimum(d, ((x - x[k]) ** 2).sum(1))
    for _ in range(rounds):
        at, _ = nearest(x, centres)
        n = np.bincount(at, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """To ``digits`` decimals, halves away from zero, as SQL rounds."""
    return np.trunc(x * 10.0**digits + np.copysign(0.5, x)) / 10.0**digits


@dataclass
class Codes:
    """Cells and codebooks: ``cells`` (cells, dim), ``books`` (parts, codes, dim / parts)."""

    cells: np.ndarray
    books: np.ndarray

    @classmethod
    def fitted(cls, x: np.ndarray, cells: int, parts: int, codes: int = 256) -> Codes:
        cells = min(cells, len(x))
        centres = means(x, cells)
        at, _ = nearest(x, centres)
        rest = (x - centres[at]).reshape(len(x), parts, -1)
        return cls(centres, np.stack([means(rest[:, p], min(codes, len(x)), p + 2, 6) for p in range(parts)]))

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, distance to its centre, and codes of rows."""
        at, d = nearest(x, self.cells)
        rest = (x - self.cells[at]).reshape(len(x), len(self.books), -1)
        codes = np.stack([nearest(rest[:, p], b)[0] for p, b in enumerate(self.books)], 1).astype(np.uint8)
        return at, np.sqrt(d), codes

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of the residual of ``q`` in a cell to all codes of each part."""
        rest = (q - self.cells[cell]).reshape(len(self.books), 1, -1)
        return ((self.books - rest) ** 2).sum(2)


class VectorIndex:
    """An index in a folder: ``codes`` (one row) and ``lists`` by cell (key, direction, code, distance to the centre).

    Similarity is the cosine; rows of null, broken or zero vectors, or of another size, are in no list and never match.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        row = spark.read.parquet(f"{folder}/codes").first()
        self.size, self.key_type = row["size"], row["key_type"]
        self.codes = Codes(np.frombuffer(row["cells"], "<f8").reshape(-1, self.size), np.frombuffer(row["books"], "<f8").reshape(row["parts"], -1, self.size // row["parts"]))

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, folder: str, size: int, cells: int = 64, parts: int = 16, sample: int = SAMPLE) -> VectorIndex:
        """Fits cells and codes on ``sample`` rows (those of the least hashed keys) and adds all rows. ``size`` is a
        multiple of ``parts``. About the square root of the number of rows is a good number of cells."""
        spark = df.sparkSession
        rows = cls._directions(df, key, vector, size)
        picked = rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("direction").toPandas()["direction"]
        if not len(picked):
            raise ValueError("no row has a vector of this size")
        codes = Codes.fitted(np.stack(picked.to_numpy()).astype(np.float64), cells, parts)
        kind = df.schema[key].dataType.simpleString()
        spark.createDataFrame([(size, parts, kind, bytearray(codes.cells.astype("<f8").tobytes()), bytearray(codes.books.astype("<f8").tobytes()))], "size int, parts int, key_type string, cells binary, books binary").coalesce(1).write.parquet(f"{folder}/codes")
        made = cls(spark, folder)
        made.insert(df, key, vector)
        return made

    @staticmethod
    def _directions(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
        return df.select(F.col(key).alias("key"), vectors.sound(F.col(vector), size).alias("direction")).filter("direction is not null")

    def insert(self, df: DataFrame, key: str, vector: str) -> None:
        """Adds rows to the lists of their cells; what is there stays as it is."""
        codes, size = self.codes, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                at, d, code = codes.encoded(x) if len(x) else (np.empty(0, np.int64), np.empty(0), np.empty((0, 1), np.uint8))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(d), pa.array(at, pa.int32())], names=["key", "direction", "code", "off", "cell"])

        rows = self._directions(df, key, vector, size)
        schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("code binary, off double, cell int").fields])
        coded = rows.mapInArrow(run, schema)
        # By cell and key: a cell of very many rows is several files of several tasks, a small one a single file.
        coded.repartitionByRange("cell", F.xxhash64("key")).sortWithinPartitions("cell").write.mode("append").partitionBy("cell").parquet(f"{self.folder}/lists")

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The lists of some cells (default: all). Spark opens the folders of these cells only."""
        schema = f"key {self.key_type}, direction array<double>, code binary, off double, cell int"
        lists = self.spark.read.schema(schema).parquet(f"{self.folder}/lists")
        return lists if cells is None else lists.filter(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, key: str, vector: str, most: int = 10, probes: int = 8, rerank: int = 100, threshold: float | None = None, exact: bool = False, digits: int = 9) -> DataFrame:
        """query, key, score, rank: the ``most`` most similar rows of each query, of which ``rerank`` are scored exactly.

        Scores are rounded to ``digits`` before they are ranked; rows of equal score are in the order of their keys. ``exact``: all rows of the probed cells are scored, and
        in a second pass those of every cell that might hold one as good as the last of a query. Queries go in
        blocks of AT_ONCE, each read by the driver to know its cells.
        """
        asked = self._directions(queries, key, vector, self.size).select(F.col("key").alias("query"), "direction")
        asked = scratch.Scratch(self.spark, "queries").table(asked, "queries")
        count = asked.count()
        blocks = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(-(-count // AT_ONCE)))) if count > AT_ONCE else asked.withColumn("block", F.lit(0))
        found = None
        for k in range(max(1, -(-count // AT_ONCE))):
            block = blocks.filter(F.col("block") == k).select("query", "direction").toPandas()
            part = self._block(block, asked.schema["query"].dataType, most, probes, rerank, exact, digits)
            found = part if found is None else found.unionByName(part)
        return found if threshold is None else found.filter(F.col("score") > threshold)

    def _block(self, block, kind: T.DataType, most: int, probes: int, rerank: int, exact: bool, digits: int) -> DataFrame:
        ids = block["query"].tolist()
        x = np.stack(block["direction"].to_numpy()).astype(np.float64) if ids else np.empty((0, self.size))
        far = np.sqrt(np.maximum(((x[:, None] - self.codes.cells[None]) ** 2).sum(2), 0)) if len(x) else np.empty((0, len(self.codes.cells)))
        wanted = np.argsort(far, 1, kind="stable")[:, :probes]
        asked: dict[int, list[int]] = {}
        for i, cells in enumerate(wanted.tolist()):
            for c in cells:
                asked.setdefault(c, []).append(i)
        hits = self._hits(asked, x, ids, kind, most, None if exact else rerank, digits)
        if exact:
            hits = scratch.Scratch(self.spark, "probes").table(hits, "hits")
            last = {r["query"]: r["score"] for r in hits.filter(F.col("rank") == most).select("query", "score").collect()}  # a row a query of the block
            radius = dict(self.rows().groupBy("cell").agg(F.max("off")).collect())
            more: dict[int, list[int]] = {}
            for i, q in enumerate(ids):
                reach = np.sqrt(max(0.0, 2 - 2 * (last[q] - 10.0**-digits))) + 1e-9 if q in last else np.inf  # cosine as distance of directions
                for c, r in radius.items():
                    if far[i, c] - r <= reach and c not in wanted[i]:
                        more.setdefault(c, []).append(i)
            hits = self._ranked(hits.drop("rank").unionByName(self._hits(more, x, ids, kind, most, None, digits).drop("rank")), most, digits)
        return hits

    def _hits(self, asked: dict[int, list[int]], x: np.ndarray, ids: list, kind: T.DataType, most: int, rerank: int | None, digits: int) -> DataFrame:
        """Ranked rows of the cells of ``asked`` (queries by cell)."""
        codes, size = self.codes, self.size

        cells_of: dict[int, list[int]] = {}
        for c, queries in asked.items():
            for i in queries:
                cells_of.setdefault(i, []).append(c)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(k, ROWS) for b in batches for k in range(0, len(b), ROWS)):
                batch = batch.take(pc.sort_indices(batch.column(0)))  # so that rows of equal distance are in the order of keys
                cells = batch.column(3).to_numpy()
                dirs = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), -1)
                places = {c: np.flatnonzero(cells == c) for c in np.unique(cells).tolist()}
                parts, at, of, near, held = np.arange(code.shape[1]), [], [], [], 0

                def found() -> pa.RecordBatch:
                    where, which = np.concatenate(at), np.repeat(np.array(of, np.int32), [len(x) for x in at])
                    d = np.concatenate(near)
                    score = np.empty(len(where)) if rerank else -d
                    for k in range(0, len(where) if rerank else 0, ROWS):  # two copies of a row's vector for each hit
                        score[k : k + ROWS] = np.einsum("ij,ij->i", dirs[where[k : k + ROWS]], x[which[k : k + ROWS]])
                    return pa.RecordBatch.from_arrays([pa.array(which), batch.column(0).take(pa.array(where)), pa.array(score), pa.array(d)], names=["i", "key", "score", "d"])

                for i, wanted in cells_of.items():
                    own = [places[c] for c in wanted if c in places]
                    if not own:
                        continue
                    if rerank:
                        d = np.concatenate([codes.tables(x[i], c)[parts, code[places[c]]].sum(1) for c in wanted if c in places])
                        own = np.concatenate(own)
                    else:
                        own = np.concatenate(own)
                        d = -(dirs[own] @ x[i])
                    last = rerank or most
                    if len(d) > last:  # ties of the last place stay
                        kept = np.flatnonzero(d <= np.partition(d, last - 1)[last - 1] + (0 if rerank else 2 * 10.0**-digits))
                        own, d = own[kept], d[kept]
                    if not rerank:
                        d = rounded(d, digits)
                    if len(d) > last:
                        kept = np.lexsort((own, d))[:last]
                        own, d = own[kept], d[kept]
                    at.append(own)
                    of.append(i)
                    near.append(d)
                    held += len(own)
                    if held >= HELD:
                        yield found()
                        at, of, near, held = [], [], [], 0
                if at:
                    yield found()

        rows = self.rows(sorted(asked)).select("key", "direction", "code", "cell")
        schema = T.StructType([T.StructField("i", T.IntegerType()), rows.schema["key"], *T.StructType.fromDDL("score double, d double").fields])
        hits = rows.mapInArrow(run, schema)
        if rerank:  # of what all tasks found, the best by their codes
            order = Window.partitionBy("i").orderBy("d", "key")
            hits = hits.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rerank)
        names = self.spark.createDataFrame([(i, q) for i, q in enumerate(ids)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("query", kind)]))
        return self._ranked(hits.join(F.broadcast(names), "i").select("query", "key", "score"), most, digits)

    @staticmethod
    def _ranked(hits: DataFrame, most: int, digits: int) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        return hits.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def new_folder(spark: SparkSession, name: str = "vectors") -> str:
    """A folder for an index of one session, below the shared one."""
    return f"{scratch.shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the pairs (query, key) of ``truth`` that are found."""
    both = truth.select("query", "key").join(found.select("query", "key"), ["query", "key"], "left_semi").count()
    return both / max(truth.count(), 1)
