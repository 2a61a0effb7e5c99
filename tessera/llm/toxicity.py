"""Toxicity by class-conditional Kneser-Ney models over characters (operator 4).

The n-grams are six lower-cased characters, unfolded, of any script: their table holds every one that
the labelled rows have and grows with them. Each class has its own counts of the highest order and its
own continuation counts of the lower ones, down to a uniform distribution. The table is made by
groupings and joins, and sent to the executors whole or, if it is large, in parts that are used one after
the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import shared
from tessera.llm.pieces import SPACE, classes, code_points

#: Characters of an n-gram, and the sign that stands before a text.
LENGTH, PAD = 6, "\x02"
#: Bytes of the table up to which it is sent to the executors as a whole; of a larger one in parts of
#: PART_BYTES, of which a worker holds one.
SENT_BYTES, PART_BYTES = 96 << 20, 32 << 20
#: Bytes of text that meet each part together, and bits by which n-grams are dealt into parts.
PASS_BYTES, PAIR_BITS = 8 << 20, 10
DISCOUNT = 0.75
#: Symbols of segments: a text is judged by its most toxic segments of both sizes and on the whole.
SEGMENTS = (64, 24)
#: Steps a nat in which each feature is counted for the calibration, and where it is cut off: at most
#: 257 * 97 * 97 cells of each label, whatever the corpus.
STEPS, REACH = np.array([256, 16, 16]), np.array([0.5, 3.0, 3.0])


_BASE, _MIX, _CONTEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def keys_of(grams: list[str]) -> np.ndarray:
    """The 64-bit key of each n-gram."""
    out = np.zeros(len(grams), np.uint64)
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    for size in set(sizes.tolist()) - {0}:
        at = np.flatnonzero(sizes == size)
        c = code_points("".join(grams[i] for i in at.tolist())).reshape(-1, size)
        h = np.zeros(len(at), np.uint64)
        for i in range(size):
            h = h * _BASE + c[:, i].astype(np.uint64)
        out[at] = h
    return _mixed(out)


def keys_at(s: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the last ``k`` characters of the n-grams at places ``at``, and of their contexts."""
    h, place = np.zeros(len(at), np.uint64), at + LENGTH - k
    for i in range(k - 1):
        h = h * _BASE + s[place + i]
    return _mixed(h * _BASE + s[place + k - 1]), _mixed(h) ^ _CONTEXT


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_mixed(a.astype(np.uint64) * _BASE + b.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int16)


def pairs_of(grams: list[str], of: np.ndarray) -> np.ndarray:
    """The number of the two characters before the last of each n-gram, or of the last two of a context
    (``of``): all that is looked up for one place has the same, but for what is shorter, which gives -1."""
    out = np.full(len(grams), -1, np.int16)
    sizes = np.fromiter(map(len, grams), np.int64, len(grams)) + of
    for size in set(sizes.tolist()) - {0, 1, 2}:
        for context in (False, True):
            at = np.flatnonzero((sizes == size) & (of == context))
            c = code_points("".join(grams[i] for i in at.tolist())).reshape(-1, size - context)
            out[at] = _pair(c[:, size - 3], c[:, size - 2])
    return out


def pairs_at(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same number for the n-grams at places ``at``."""
    return _pair(s[at + LENGTH - 3], s[at + LENGTH - 2])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts (lower case, white space as one, a space around), places of the n-grams
    in them, and how many each text has."""
    texts = [t.lower() for t in texts]
    head = PAD * (LENGTH - 2)
    joined = "".join(f"{head} {t} " for t in texts)
    s = code_points(joined).astype(np.uint32)
    s = np.where(classes()[s] == SPACE, np.uint32(32), np.maximum(s, 1))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)) + len(head) + 2)
    keep = np.r_[True, (s[1:] != 32) | (s[:-1] != 32) | (owner[1:] != owner[:-1])] if len(s) else np.empty(0, bool)
    s, owner = s[keep], owner[keep]
    n = max(0, len(s) - LENGTH + 1)
    at = np.flatnonzero(owner[:n] == owner[LENGTH - 1 : LENGTH - 1 + n])
    return s, at, np.bincount(owner[at], minlength=len(texts))


def counts(labelled: DataFrame) -> DataFrame:
    """Toxic label, n-gram and count over all rows (__y, __text): summed in each slice, then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in shared.bounded(batches, "__text"):
            y = np.array(batch.column(0).to_pylist()) == 1
            s, at, n = grams(texts)
            key, toxic = keys_at(s, at, LENGTH)[0], np.repeat(y, n)
            for label in (0, 1):
                own = np.flatnonzero(toxic == label)
                _, first, many = np.unique(key[own], return_index=True, return_counts=True)
                for i in range(0, len(first), 1 << 16):
                    place = at[own[first[i : i + (1 << 16)]]]
                    found = np.ascontiguousarray(s[place[:, None] + np.arange(LENGTH)]).view(f"<U{LENGTH}").ravel().tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), label)), pa.array(found, pa.string()), pa.array(many[i : i + (1 << 16)].astype(np.int64))], names=["y", "gram", "n"])

    found = shared.mapped(labelled.select("__y", "__text"), run, "y long, gram string, n long")
    return found.groupBy("y", "gram").agg(F.sum("n").alias("n"))


def ratios(count: DataFrame, length: int = LENGTH, size: int | None = None, discount: float = DISCOUNT) -> DataFrame:
    """gram, of and ratio: the log of toxic over ordinary of what :func:`smoothed` gives."""
    return smoothed(count, length, size, discount).select("gram", "of", (F.log("p1") - F.log("p0")).alias("ratio"))


def smoothed(count: DataFrame, length: int = LENGTH, size: int | None = None, discount: float = DISCOUNT) -> DataFrame:
    """gram, of, p0 and p1, from y, gram and n: for every n-gram of each order that a class has, the
    probability of its last character after the others in both classes; and as a context (``of``), the
    weight of the lower order, which any other character after it takes times its lower probability.

    ``size``: number of characters that there can be (by default those seen and one more).
    """
    n = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    seen = lambda y: F.sum((F.col(f"c{y}") > 0).cast("long"))
    level = shared.written(count.groupBy("gram").agg(n(0).alias("c0"), n(1).alias("c1")), "grams")
    levels = {length: level}
    # Continuation counts: by how many different characters of a class an n-gram of a lower order is preceded.
    for k in range(length - 1, 0, -1):
        level = levels[k] = shared.written(level.groupBy(F.substring("gram", 2, k).alias("gram")).agg(seen(0).alias("c0"), seen(1).alias("c1")), "continuations")
    size = size or levels[1].count() + 1
    below, out = None, []
    for k in range(1, length + 1):
        rows = levels[k].withColumns({"__of": F.substring("gram", 1, k - 1), "__to": F.substring("gram", 2, k - 1)})
        sums = rows.groupBy("__of").agg(*(F.sum(f"c{y}").alias(f"t{y}") for y in (0, 1)), *(seen(y).alias(f"v{y}") for y in (0, 1)))
        spare = {f"s{y}": F.when(F.col(f"t{y}") > 0, discount * F.col(f"v{y}") / F.col(f"t{y}")).otherwise(1.0) for y in (0, 1)}
        sums = shared.written(sums.withColumns(spare).select("__of", "t0", "t1", "s0", "s1"), "contexts")
        rows = rows.join(sums, "__of")
        rows = rows.withColumns({"q0": F.lit(1 / size), "q1": F.lit(1 / size)}) if below is None else rows.join(below, "__to")
        p = [(F.greatest(F.col(f"c{y}") - discount, F.lit(0.0)) / F.greatest(F.col(f"t{y}"), F.lit(1)) + F.col(f"s{y}") * F.col(f"q{y}")).alias(f"q{y}") for y in (0, 1)]
        below = shared.written(rows.select(F.col("gram").alias("__to"), *p), "probabilities")
        out.append(below.select(F.col("__to").alias("gram"), F.lit(False).alias("of"), F.col("q0").alias("p0"), F.col("q1").alias("p1")))
        out.append(sums.select(F.col("__of").alias("gram"), F.lit(True).alias("of"), F.col("s0").alias("p0"), F.col("s1").alias("p1")))
    return reduce(DataFrame.unionByName, out)


def keyed(table: DataFrame) -> DataFrame:
    """``table`` with the 64-bit key of each n-gram or context, and its pair, instead of its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            key = keys_of(found)
            key[of] ^= _CONTEXT
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(pairs_of(found, of)), batch.column(2)], names=["key", "pair", "ratio"])

    return shared.mapped(table.select("gram", "of", "ratio"), run, "key long, pair short, ratio double")


class Lookup:
    """Ratios by key: sorted keys, and where those of each leading bits begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(4, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.starts[1:])

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each key, NaN where there is none."""
        out = np.full(len(h), np.nan, np.float32)
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            place = at[live]
            hit = self.keys[place] == h[live]
            out[live[hit]] = self.values[place[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def ratio(self, s: np.ndarray, at: np.ndarray, low: Lookup | None = None) -> np.ndarray:
        """Of every n-gram: its own, else that of its context and that of the n-gram of a lower order. ``low``
        has what is without a pair, if that isn't here."""
        out, rest = np.zeros(len(at), np.float32), np.arange(len(at))
        for k in range(LENGTH, 0, -1):
            key, context = keys_at(s, at[rest], k)
            held = low if low and k < 3 else self
            found = held.find(key)
            none = np.isnan(found)
            out[rest[~none]] += found[~none]
            rest = rest[none]
            out[rest] += np.nan_to_num(held.find(context[none]), nan=0.0)
        return out


def features(ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text, of which ``n`` gives the number of n-grams, the length-normalised log-likelihood
    ratio of the whole, and the largest of its segments of each size; without n-grams all are zero."""
    total = np.concatenate([[0.0], np.cumsum(ratio.astype(np.float64))])
    ends = np.cumsum(n)
    out = np.zeros((len(n), 1 + len(SEGMENTS)))
    some = n > 0
    out[some, 0] = (total[ends] - total[ends - n])[some] / n[some]
    # Segments overlap by half; a shorter text is one segment, of half the size at least.
    for i in np.flatnonzero(some).tolist():
        begin, end = int(ends[i] - n[i]), int(ends[i])
        for k, size in enumerate(SEGMENTS, 1):
            at = np.arange(begin, max(begin + 1, end - size // 2), size // 2)
            stop = np.minimum(at + size, end)
            out[i, k] = ((total[stop] - total[at]) / np.maximum(stop - at, size // 2)).max()
    return out


_X = ("__a", "__b", "__c")


def _sent(table: DataFrame) -> Broadcast:
    """The table as sorted keys and their ratios, sent to the executors."""
    found = table.select("key", "ratio").toArrow()
    key, ratio = found.column("key").to_numpy().view(np.uint64), found.column("ratio").to_numpy().astype(np.float32)
    order = np.argsort(key, kind="stable")
    pair = key[order], ratio[order]
    del found, key, ratio, order  # the driver pickles the pair: no other copies beside it
    pa.default_memory_pool().release_unused()
    return table.sparkSession.sparkContext.broadcast(pair)


def featured(rows: DataFrame, table: DataFrame, sent_bytes: int = SENT_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``rows`` (the last column is __text) with the features of each text instead of it.

    A keyed table of up to ``sent_bytes`` (counted first) is sent to the executors; of a larger one its parts
    of ``part_bytes``.
    """
    names = rows.columns[:-1]
    schema = shared.with_results(rows, "__a double, __b double, __c double")
    if not shared.fits(table, 16, sent_bytes):
        return _parted(rows, table, schema, part_bytes)
    held = _sent(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(*held.value)
        for batch, texts in shared.bounded(batches, "__text"):
            s, at, n = grams(texts)
            x = features(lookup.ratio(s, at), n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in x.T)], names=[*names, *_X])

    return shared.mapped(rows, run, schema)


def _packed(counts: dict[int, int], most: int) -> np.ndarray:
    """The part of each pair: runs of pairs of up to ``most`` rows together, or of one pair that has more."""
    out, part, total = np.zeros(1 << PAIR_BITS, np.int16), 0, 0
    for pair in range(1 << PAIR_BITS):
        n = counts.get(pair, 0)
        if total and total + n > most:
            part, total = part + 1, 0
        out[pair] = part
        total += n
    return out


def _taken(held: Broadcast) -> Lookup:
    """What was sent, without a copy that stays behind in the worker."""
    value = held.value
    if held._path is not None:  # else it can't be read twice
        vars(held).pop("_value", None)
    return Lookup(*value)


def _parted(rows: DataFrame, table: DataFrame, schema: T.StructType, part_bytes: int) -> DataFrame:
    """As :func:`featured`, with a table of any size: nothing is shuffled and no text is read twice. All that is looked up
    for a place is in the part of its pair, so that a worker needs one part at a time: places of PASS_BYTES of
    texts are ordered by part, and each part is read once for them. What has no pair is small and always held."""
    names = rows.columns[:-1]
    counts = {r["pair"]: r["count"] for r in table.groupBy("pair").count().collect()}
    part_of = _packed(counts, max(1, part_bytes // 16))
    low, parts = _sent(table.filter("pair < 0")), []
    for p in range(int(part_of[-1]) + 1):
        own = np.flatnonzero(part_of == p)
        parts.append(_sent(table.filter(F.col("pair").between(int(own[0]), int(own[-1])))))

    def ordered(batch: pa.RecordBatch, texts: list[str]) -> tuple:
        s, at, n = grams(texts)
        part = part_of[pairs_at(s, at)]
        order = np.argsort(part, kind="stable").astype(np.int32)
        ends = np.cumsum(np.bincount(part, minlength=len(parts)))
        return batch.select(names), s, at[order].astype(np.int32), order, ends, n, np.zeros(len(at), np.float32)

    def passed(waiting: list[tuple], shorter: Lookup) -> Iterator[pa.RecordBatch]:
        for p, held in enumerate(parts):
            lookup = _taken(held)
            for _, s, at, order, ends, _, ratio in waiting:
                own = slice(ends[p - 1] if p else 0, ends[p])
                ratio[order[own]] = lookup.ratio(s, at[own], shorter)
            del lookup
        for batch, _, _, _, _, n, ratio in waiting:
            x = features(ratio, n)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in x.T)], names=[*names, *_X])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter, waiting, total = Lookup(*low.value), [], 0
        for batch, texts in shared.bounded(batches, "__text"):
            waiting.append(ordered(batch, texts))
            total += sum(map(len, texts))
            if total >= PASS_BYTES:
                yield from passed(waiting, shorter)
                waiting, total = [], 0
        if waiting:
            yield from passed(waiting, shorter)

    return shared.mapped(rows, run, schema)


class Model:
    """The table of ratios by key and a logistic calibration of the features."""

    def __init__(self, table: DataFrame, weights: np.ndarray):
        self.table, self.weights = table, weights


def calibrated(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method on points x with label y and weight n."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, ridge = np.zeros(a.shape[1]), 1e-2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (n * (p - y)) + ridge * w
        h = (a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Constant:
    """The score where a class has no labelled text: the smoothed share of the other."""

    def __init__(self, toxic: int, ordinary: int):
        self.share = (toxic + 1) / (toxic + ordinary + 2)


def labelled(docs: DataFrame, labels: DataFrame, label: str, text: str, key: str) -> DataFrame:
    """__y and __text of the labelled rows. The labels are sent to the texts if they are few, and
    are joined otherwise. Null labels and keys are left out; of repeated labels the largest counts."""
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("long").alias("__y"))
    if shared.fits(marks, 64):
        marks = F.broadcast(marks)
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    return rows.join(marks, F.col("__id") == F.col("__key")).select("__y", "__text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id"):
    """Counts over three quarters of the labelled rows (by hash of the key), all of them; the last
    quarter calibrates the score."""
    quarter = F.pmod(F.xxhash64(key, F.lit(4)), F.lit(4))
    count = shared.written(counts(labelled(docs, labels.filter(quarter != 0), label, text, key)), "counts")
    if count.select("y").distinct().count() < 2:
        tally = {r[0]: r[1] for r in labels.filter(F.col(label).isNotNull()).groupBy((F.col(label) == 1).cast("int")).count().collect()}
        return Constant(tally.get(1, 0), tally.get(0, 0))
    table = shared.written(keyed(ratios(count)), "ratios")
    rest = labelled(docs, labels.filter(quarter == 0), label, text, key)
    x = featured(rest.select("__y", "__text"), table)
    bins = [F.round(F.greatest(F.least(F.col(c), F.lit(float(r))), F.lit(-float(r))) * int(s)).cast("long").alias(c) for c, r, s in zip(_X, REACH, STEPS, strict=True)]
    bins = x.select("__y", *bins).groupBy("__y", *_X).count().toArrow()
    y, *x, n = (bins.column(c).to_numpy().astype(np.float64) for c in ("__y", *_X, "count"))
    x = np.stack(x, 1) / STEPS
    if len(set(y.tolist())) < 2:  # too few labels to calibrate by: halfway between usual values
        y, x, n = np.array([0.0, 1]), np.array([[-0.1, 0.1, 0.3], [0.1, 0.6, 1.1]]), np.full(2, 20.0)
    return Model(table, calibrated(x, y, n))


def scored(docs: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), score: str = "score", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``keep`` and the score (0 to 1, higher: likelier toxic) of every row: whole texts, null as
    empty; texts without n-grams get the score of no evidence. Repeated rows stay."""
    if isinstance(model, Constant):
        return docs.select(*keep, F.lit(float(model.share)).alias(score))
    x = featured(shared.carried(docs, keep, text).withColumnRenamed("t", "__text"), model.table, sent_bytes)
    z = F.lit(float(model.weights[-1]))
    for c, w in zip(_X, model.weights[:-1], strict=True):
        z = z + F.col(c) * float(w)
    return x.select("k.*", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias(score))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by models of the labelled rows outside the held-out fifth."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = shared.table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored(docs, fit(docs, labels)).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
