"""Quality classifier: a byte-level convolutional network in numpy (operator 7).

Filters over eight bytes slide by two over the whole document. Their maxima over overlapping chunks
are pooled once more (mean and maximum over the chunks) and a small dense layer makes one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared

#: The bound of the training sample: rows, and bytes of all their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 64 << 20
#: Bytes over which the filters run at once.
RUN = 1 << 18
#: Every fit takes so many steps of so many documents.
STEPS, BATCH = 500, 32
DIM, FILTERS, HIDDEN = 4, 16, 16
STRIDE, GROUPS = 2, 4  # a filter spans GROUPS groups of STRIDE bytes
HALF = 64  # places of half a chunk; chunks of two halves overlap by one


class Layout:
    """Texts in one buffer, each padded with zeros to whole half-chunks and one filter more."""

    def __init__(self, texts: list[bytes]):
        unit = HALF * STRIDE
        sizes = np.array([(len(t) + STRIDE * GROUPS + unit - 1) // unit for t in texts])
        self.halves = sizes
        self.begin = np.cumsum(sizes) - sizes
        buffer = np.zeros((sizes.sum() + 1) * unit, np.uint8)
        for t, at in zip(texts, (self.begin * unit).tolist(), strict=True):
            buffer[at : at + len(t)] = np.frombuffer(t, np.uint8)
        self.buffer = buffer
        self.places = int(sizes.sum()) * HALF

    def last(self) -> np.ndarray:
        """Whether a half-chunk is the last of its text."""
        out = np.zeros(int(self.halves.sum()), bool)
        out[self.begin + self.halves - 1] = True
        return out


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "embed": r.normal(0, 0.5, (256, DIM)).astype(f),
            "filters": r.normal(0, 0.2, (GROUPS, STRIDE * DIM, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "w1": r.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(f),
            "b1": np.zeros(HIDDEN, f),
            "w2": r.normal(0, 0.3, HIDDEN).astype(f),
            "b2": np.zeros(1, f),
        }

    def _pooled(self, buffer: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Filters (before bias) at the places of the first halves of a buffer, as (halves, HALF, FILTERS).

        ``last`` tells the halves that end a text: there filters that would reach into the next text
        are left out. They would see nothing of their own but padding.
        """
        p, places = self.p, len(last) * HALF
        x = p["embed"][buffer].reshape(-1, STRIDE * DIM)
        out = x[:places] @ p["filters"][0]
        for g in range(1, GROUPS):
            out += x[g : g + places] @ p["filters"][g]
        out = out.reshape(-1, HALF, FILTERS)
        out[last, HALF - GROUPS + 1 :] = -np.inf
        return out

    def _head(self, halves: np.ndarray, lay: Layout) -> dict:
        """From half-chunk activations to probabilities, with what the gradient needs."""
        a = np.maximum(halves + self.p["bias"], 0)
        n = len(a)
        last = lay.last()
        nxt = np.minimum(np.arange(n) + 1, n - 1)
        pair = np.where(last, np.arange(n), nxt)  # a last half pairs with itself
        chunk = np.maximum(a, a[pair])
        weight = np.where(last & (np.repeat(lay.halves, lay.halves) > 1), 0, 1).astype(np.float32)
        count = np.maximum(lay.halves - 1, 1).astype(np.float32)[:, None]
        mean = np.add.reduceat(chunk * weight[:, None], lay.begin) / count
        top = np.maximum.reduceat(chunk, lay.begin)
        z = np.concatenate([mean, top], 1)
        h = np.maximum(z @ self.p["w1"] + self.p["b1"], 0)
        logit = np.clip(h @ self.p["w2"] + self.p["b2"], -30, 30)
        return {"a": a, "pair": pair, "chunk": chunk, "weight": weight, "count": count, "top": top, "z": z, "h": h, "prob": 1 / (1 + np.exp(-logit.astype(np.float64)))}

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of whole texts. Filters run over RUN bytes at once, whatever the length of a
        text: of each half-chunk only the maxima are kept, FILTERS numbers for 128 bytes."""
        lay = Layout(texts)
        return self._head(self._maxima(lay), lay)["prob"]

    def _maxima(self, lay: Layout) -> np.ndarray:
        unit, n = HALF * STRIDE, lay.places // HALF
        last = lay.last()
        out = np.empty((n, FILTERS), self.p["filters"].dtype)
        for at in range(0, n, RUN // unit):
            to = min(n, at + RUN // unit)
            part = lay.buffer[at * unit : (to + 1) * unit]  # a filter reaches into the next half
            out[at:to] = self._pooled(part, last[at:to]).max(axis=1)
        return out

    def gradient(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        p, lay = self.p, Layout(texts)
        out = self._pooled(lay.buffer, lay.last())
        where = out.argmax(axis=1)
        halves = np.take_along_axis(out, where[:, None], 1)[:, 0]
        s = self._head(halves, lay)
        d = ((s["prob"] - labels) / len(labels)).astype(np.float32)
        g = {"w2": s["h"].T @ d, "b2": d.sum(keepdims=True)}
        dh = np.outer(d, p["w2"]) * (s["h"] > 0)
        g["w1"], g["b1"] = s["z"].T @ dh, dh.sum(0)
        dz = dh @ p["w1"].T
        doc = np.repeat(np.arange(len(lay.halves)), lay.halves)
        dchunk = (dz[:, :FILTERS] / s["count"])[doc] * s["weight"][:, None]
        is_top = s["chunk"] == s["top"][doc]
        share = np.add.reduceat(is_top.astype(np.float32), lay.begin)[doc]
        dchunk += dz[:, FILTERS:][doc] * is_top / share
        mine = s["a"] >= s["a"][s["pair"]]
        da = np.where(mine, dchunk, 0)
        np.add.at(da, s["pair"], np.where(mine, 0, dchunk))
        da *= s["a"] > 0
        g["bias"] = da.sum(0)
        # Only the place of each maximum has a gradient.
        place = (np.arange(len(da))[:, None] * HALF + where) * STRIDE
        window = lay.buffer[place[:, :, None] + np.arange(STRIDE * GROUPS)]
        x = p["embed"][window].reshape(len(da), FILTERS, GROUPS, STRIDE * DIM)
        g["filters"] = np.einsum("nf,nfgd->gdf", da, x, optimize=True)
        dx = np.einsum("nf,gdf->nfgd", da, p["filters"], optimize=True).reshape(-1, DIM)
        flat = window.reshape(-1)
        g["embed"] = np.stack([np.bincount(flat, dx[:, i], 256) for i in range(DIM)], 1).astype(np.float32)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> Network:
        """Adam over random batches with half of each class, so rare labels are learned; the output
        is then shifted back to the share of labels in the sample."""
        r = np.random.default_rng(seed)
        sides = [np.flatnonzero(labels == k) for k in (0, 1)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for t in range(1, steps + 1):
            pick = np.concatenate([r.choice(s, batch // 2) for s in sides])
            rate = 0.01 * min(1, t / 20) * (1 - 0.95 * t / steps)
            for k, d in self.gradient([texts[i] for i in pick], labels[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        self.p["b2"] = self.p["b2"] + np.float32(np.log(len(sides[1]) / len(sides[0])))
        return self


class Constant:
    """The score where labels of both classes are missing: their share, smoothed."""

    def __init__(self, labels: np.ndarray):
        self.share = float((labels.sum() + 1) / (len(labels) + 2))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text", key: str = "doc_id", size: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """At most ``rows`` labelled texts of at most ``size`` bytes together: a bounded sample, in order of a
    hash of the key. A text that would go beyond ``size`` is passed over.

    Labels that are null, or whose key is, are left out; of repeated labels the least counts, and of
    repeated keys the least text.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(label).alias("__label"))
    drawn = marked.orderBy(F.xxhash64("__key"), "__key").limit(rows)
    found = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(drawn), F.col("__id") == F.col("__key"))
    sizes = found.groupBy("__id").agg(F.max(F.octet_length("__text")).alias("n")).orderBy(F.xxhash64("__id"), "__id").collect()  # at most ``rows``
    total, out = 0, []
    for r in sizes:
        if total + r.n > size:
            out.append(r["__id"])
        else:
            total += r.n
    if out:
        found = found.filter(~F.col("__id").isin(out))
    found = found.groupBy("__id").agg(F.min("__text").alias("t"), F.min("__label").alias("y"))
    return [(r.t.encode(), int(r.y)) for r in found.orderBy("__id").collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS):
    """The network fitted on a bounded sample of the labelled rows."""
    drawn = sample(docs, labels, label, rows, text, key)
    y = np.array([v for _, v in drawn], np.float64)
    if len(set(y.tolist())) < 2:
        return Constant(y)
    return Network().fit([t for t, _ in drawn], y)


def scored(docs: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), score: str = "score") -> DataFrame:
    """``keep`` and the probability of label 1 for every row: whole texts, null as empty."""
    return _scored(docs, model, text, keep).select("k.*", F.col("p").alias(score))


def _scored(docs: DataFrame, model, text: str, keep: tuple[str, ...] | list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = shared.carried(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in shared.bounded(batches, "t", RUN):
            found = held.value.score([t.encode() for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["k", "p"])

    return shared.mapped(rows, run, shared.with_results(rows, "p double"))


def learners(table: DataFrame, folds: int, held: int, key: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the key as text, modulo ``folds``, isn't ``held``."""
    return table.filter(F.crc32(F.col(key).cast("string")) % folds != held)


def kept(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more; all columns, whatever their names, stay as
    they are. Null texts are scored as empty; repeated rows have one fate."""
    model = fit(docs, learners(labels, 3, 1, key), text=text, key=key)
    return _scored(docs, model, text, docs.columns).filter(F.col("p") >= least).select("k.*")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a network fitted on labelled rows outside the held-out third."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, learners(shared.table(spark, sf_dir, "labels"), 3, 1))
    found = scored(docs, model)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
