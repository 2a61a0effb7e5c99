"""Benchmark decontamination by winnowing (operator 3).

Each sliding window of k-gram hashes keeps its minimum, so any shared span of ``window + k - 1``
words or more has a fingerprint in both texts. Where fingerprints meet, the hit is extended word by
word and compared exactly.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared

#: Words of a benchmark window, and of the k-grams that are hashed. The rest of a window is the
#: number of k-grams of which the minimum is kept.
SPAN_WORDS, GRAM_WORDS = 13, 8
#: Benchmarks of up to so many bytes of text are sent to all executors; larger ones are joined.
SENT_BYTES = 16 << 20
#: Keys over which a passage of very many texts is spread.
SALTS = 16
#: What separates words.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_NONE, _OTHER = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of every values[start:end], by prefix sums modulo 2**64, mixed."""
    size = 1 << max(16, int(len(values)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


class Words:
    """The words of many texts at once: places in one buffer, hashes, and the text of each."""

    def __init__(self, texts: list[bytes]):
        self.blob = b"\n".join(texts).translate(_LOWER) + b"\n"
        raw = np.frombuffer(self.blob, np.uint8)
        inside = _WORD[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.hashes = _sums(raw.astype(np.uint64) + np.uint64(1), self.starts, self.ends)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        #: Words of text i: from first[i] to before first[i + 1].
        self.first = np.searchsorted(self.starts, bounds)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first))

    def spans(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the k words from each place ``at``, on which equal spans agree."""
        other = (self.hashes ^ (self.hashes >> np.uint64(29))) * _OTHER
        return _sums(self.hashes, at, at + k), _sums(other, at, at + k)

    def least(self, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all whole windows, and the minimum of the k-grams of each."""
        g = self.grams(k)
        n = len(g) - window + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        least = g[:n].copy()
        for step in range(1, window):
            np.minimum(least, g[step : step + n], out=least)
        at = np.flatnonzero((g[window - 1 :] != _NONE) & (self.owner[:n] == self.owner[window - 1 :]))
        return at, least[at]

    def word(self, i: int) -> bytes:
        return self.blob[self.starts[i] : self.ends[i]]

    def said(self, k: int, at: np.ndarray) -> list[bytes]:
        """The k words from each place ``at``, with a space between."""
        blob, starts, ends = self.blob, self.starts, self.ends
        return [b" ".join([blob[a:b] for a, b in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist(), strict=True)]) for i in at.tolist()]

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each place; where the text ends before, the largest value."""
        n = len(self.hashes)
        out = np.full(n, _NONE)
        if n >= k:
            begin = np.arange(n - k + 1)
            inner = self.owner[: n - k + 1] == self.owner[k - 1 :]
            out[: n - k + 1] = np.where(inner, _sums(self.hashes, begin, begin + k), _NONE)
        return out

    def winnowed(self, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the k-grams that are the minimum of a whole window they stand in: all
        places of a minimum, also where it repeats."""
        g = self.grams(k)
        n = len(g) - window + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        least = g[:n].copy()
        for step in range(1, window):
            np.minimum(least, g[step : step + n], out=least)
        # The last gram of a window is whole: then all are.
        whole = (g[window - 1 :] != _NONE) & (self.owner[:n] == self.owner[window - 1 :])
        least[~whole] = 0
        # No minimum is above a gram of its window, so the largest of them equals the gram if one does.
        most = np.zeros(len(g), np.uint64)
        for step in range(window):
            np.maximum(most[step : step + n], least, out=most[step : step + n])
        at = np.flatnonzero((g == most) & (g != _NONE))
        return at, g[at]


def plans(sizes: set[int], span: int, gram: int) -> dict[int, tuple[int, int, int]]:
    """(k, window) and span for each size of item: whole spans, or the whole of a shorter item."""
    return {min(n, span): (min(gram, n), min(n, span) - min(gram, n) + 1, min(n, span)) for n in sizes if n}


class Index:
    """Fingerprints of benchmark items with their places."""

    def __init__(self, items: list[tuple[str, bytes]], span: int = SPAN_WORDS, gram: int = GRAM_WORDS):
        self.ids = [i for i, _ in items]
        self.words = Words([t for _, t in items])
        self.text = [[self.words.word(j) for j in range(a, b)] for a, b in zip(self.words.first[:-1], self.words.first[1:], strict=True)]
        self.plans = plans({len(t) for t in self.text}, span, gram)
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.keys: dict[int, np.ndarray] = {}
        self.maybe: dict[int, np.ndarray] = {}
        for length, (k, window, _) in self.plans.items():
            found = defaultdict(list)
            grams = self.words.grams(k)
            owner, whole = self.words.owner, self.words.grams(length)
            order = np.lexsort((whole, owner))
            again = (whole[order][1:] == whole[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & (whole[order][1:] != _NONE)
            repeated = set(owner[order][1:][again].tolist())
            places, least = self.words.winnowed(k, window)
            for p, h in zip(places.tolist(), least.tolist(), strict=True):
                item = int(owner[p])
                if min(len(self.text[item]), span) == length and item not in repeated:
                    found[h].append((item, p - int(self.words.first[item])))
            for item in sorted(repeated):
                text = self.text[item]
                if min(len(text), span) != length:
                    continue
                first, known, kept = int(self.words.first[item]), set(), set()
                for j in range(len(text) - length + 1):
                    own = tuple(text[j : j + length])
                    if own in known:  # equal windows of an item are found by the first of them
                        continue
                    known.add(own)
                    g = grams[first + j : first + j + window]
                    kept.update((np.flatnonzero(g == g.min()) + j).tolist())
                for place in sorted(kept):
                    found[int(grams[first + place])].append((item, place))
            self.places[length] = dict(found)
            self.keys[length] = np.array(sorted(found), np.uint64)
            self.maybe[length] = np.zeros(1 << 20, bool)
            self.maybe[length][self.keys[length] >> np.uint64(44)] = True

    def hits(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, end): all spans of a text that an item's windows occur in."""
        for length, (k, window, span) in self.plans.items():
            if not len(self.keys[length]):
                continue
            at, least = words.winnowed(k, window)
            hit = np.flatnonzero(self.maybe[length][least >> np.uint64(44)])
            hit = hit[np.isin(least[hit], self.keys[length])]
            if not len(hit):
                continue
            until: dict[tuple[int, int, int], int] = {}
            # The last span of neighbouring words that were found in the text, and its items so far: an
            # item that was seen adds nothing where all windows around a place are inside.
            last, low, high, seen = -1, 0, 0, set()
            for q, h in zip(at[hit].tolist(), least[hit].tolist(), strict=True):
                text = int(words.owner[q])
                if text != last:
                    last, low, high, seen = text, 0, 0, set()
                left, right = max(q - window + 1, int(words.first[text])), min(q + length, int(words.first[text + 1]))
                for item, place in self.places[length][h]:
                    if low <= left and right <= high and item in seen:
                        continue
                    line = (text, item, q - place)
                    if until.get(line, -1) > q:
                        continue
                    begin, end = self._extended(words, text, q, self.text[item], place)
                    until[line] = max(end, q + 1)
                    if end - begin >= span:
                        seen.add(item)
                        low, high = (min(low, begin), max(high, end)) if begin <= high and end >= low else (begin, end)
                        yield text, item, begin, end

    def _extended(self, words: Words, text: int, q: int, item: list[bytes], place: int) -> tuple[int, int]:
        """The longest run of equal words around word q, which stands at ``place`` in the item."""
        low, high = int(words.first[text]), int(words.first[text + 1])
        begin, end = q, q
        while end < high and place + end - q < len(item) and words.word(end) == item[place + end - q]:
            end += 1
        while begin > low and place + begin - 1 - q >= 0 and words.word(begin - 1) == item[place + begin - 1 - q]:
            begin -= 1
        return begin, end


def _digest(ids: set) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _row(n: int, spans: list[tuple[int, int]], items: set) -> tuple:
    hit, reach = 0, -1
    for a, b in sorted(spans):
        hit += max(0, b - max(a, reach))
        reach = max(reach, b)
    return n, hit, len(items), _digest(items), hit > 0 and 20 * hit >= n


#: The index that this worker has built last, under the name of its benchmark.
_LAST: dict[str, Index] = {}


def _index(name: str, items: list[tuple[str, bytes]], span: int, gram: int) -> Index:
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Index(items, span, gram)
    return _LAST[name]


def _sent(rows: DataFrame, items: list[tuple[str, bytes]], span: int, gram: int) -> DataFrame:
    """Overlap of every row (k, t) with a benchmark that all executors hold."""
    held, name = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, held.value, span, gram)
        for batch, texts in shared.bounded(batches, "t"):
            words = Words([t.encode() for t in texts])
            spans, seen = defaultdict(list), defaultdict(set)
            for text, item, a, b in index.hits(words):
                spans[text].append((a, b))
                seen[text].add(index.ids[item])
            counts = np.diff(words.first).tolist()
            none = _digest(set())
            found = [_row(n, spans[i], seen[i]) if i in spans else (n, 0, 0, none, False) for i, n in enumerate(counts)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["k", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return shared.mapped(rows, run, shared.with_results(rows, _FOUND))


def _windows(rows: DataFrame, span: int, gram: int, sizes: list[int], of_items: bool) -> DataFrame:
    """id, size, fp of each distinct fingerprint of the texts (id, t); of items also the hashes a and b and the
    words w of each distinct window, which stands under the minimum of its k-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in shared.bounded(batches, "t"):
            words = Words([t.encode() for t in texts])
            counts = np.minimum(np.diff(words.first), span)
            for length, (k, window, _) in plans(set(sizes), span, gram).items():
                at, fp = words.least(k, window)
                if of_items:  # an item has windows of one size
                    own = counts[words.owner[at]] == length
                    at, fp = at[own], fp[own]
                parts = [words.owner[at].astype(np.int64), fp.view(np.int64)]
                if of_items:  # windows of equal hashes and different words stay apart
                    said = {w: i for i, w in enumerate(dict.fromkeys(words.said(length, at)))}
                    number = np.array([said[w] for w in words.said(length, at)], np.int64)
                    parts += [h.view(np.int64) for h in words.spans(length, at)]
                    parts.append(number)
                order = np.lexsort(parts[::-1])
                parts = [c[order] for c in parts]
                fresh = np.r_[True, np.any([c[1:] != c[:-1] for c in parts], axis=0)] if len(at) else np.empty(0, bool)
                owner, *rest = (c[fresh] for c in (parts[:-1] if of_items else parts))
                columns = [batch.column(0).take(pa.array(owner)), pa.array(np.full(len(owner), length, np.int32)), *map(pa.array, rest)]
                if of_items:
                    columns.append(pa.array(words.said(length, at[order][fresh]), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "fp", "a", "b", "w"][: len(columns)])

    return shared.mapped(rows, run, shared.with_results(rows, "size int, fp long" + (", a long, b long, w binary" if of_items else "")))


def _candidates(rows: DataFrame, span: int, gram: int, sizes: list[int]) -> DataFrame:
    """id, size, start, the hashes a and b and the words w of the windows of the texts (id, fps, t) whose minimum is
    among ``fps``: what a fingerprint has hit is extended to the windows around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in shared.bounded(batches, "t"):
            words = Words([t.encode() for t in texts])
            lists = [np.array(x, np.int64).view(np.uint64) for x in batch.column(1).to_pylist()]
            known = np.unique(np.concatenate(lists))
            for length, (k, window, _) in plans(set(sizes), span, gram).items():
                at, fp = words.least(k, window)
                at = at[np.isin(fp, known)]
                owner = words.owner[at]
                a, b = words.spans(length, at)
                columns = [batch.column(0).take(pa.array(owner.astype(np.int64))), pa.array(np.full(len(at), length, np.int32)), pa.array(at - words.first[owner]), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(words.said(length, at), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "start", "a", "b", "w"])

    return shared.mapped(rows.select("id", "fps", "t"), run, "id long, size int, start long, a long, b long, w binary")


def _salted(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Inner join in which the rows of ``left`` (by id) of one key are spread over SALTS tasks."""
    left = left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    right = right.withColumn("salt", shared.salts(SALTS))
    return left.join(right, [*names, "salt"]).drop("salt")


def _joined(rows: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """Overlap of every row (k, t) with a benchmark of any size, of rows (item, t).

    The fingerprints of all texts meet the distinct ones of the benchmark; texts with a hit are fetched
    once, and those of their windows that a hit extends to meet the benchmark's windows by hashes, and are
    compared word by word. A passage that is in very many texts is spread over salted keys.
    """
    rows = shared.written(rows.withColumn("id", F.monotonically_increasing_id()), "texts")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in shared.bounded(batches, "t"):
            n = np.diff(Words([t.encode() for t in texts]).first)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(n, span)), pa.int64())], names=["n"])

    sizes = [r.n for r in shared.mapped(items.select("t"), counted, "n long").distinct().collect()]  # at most span + 1 rows
    own = shared.written(_windows(items.select(F.col("item").alias("id"), "t"), span, gram, sizes, True).distinct(), "windows")
    met = _salted(_windows(rows.select("id", "t"), span, gram, sizes, False), own.select("size", "fp").distinct(), ["size", "fp"])
    met = met.groupBy("id").agg(F.collect_set("fp").alias("fps"))
    found = _candidates(rows.select("id", "t").join(met, "id").select("id", "fps", "t"), span, gram, sizes)
    hits = _salted(found, own.select(F.col("id").alias("item"), "size", "a", "b", F.col("w").alias("said")).distinct(), ["size", "a", "b"]).filter("w = said")
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    hits = hits.groupBy("id").agg(spans.alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach"))
    step = lambda s, x: F.struct((s["hit"] + F.greatest(x["end"] - F.greatest(x["start"], s["reach"]), F.lit(0).cast("long"))).alias("hit"), F.greatest(s["reach"], x["end"]).alias("reach"))
    hit = F.coalesce(F.aggregate("spans", start, step)["hit"], F.lit(0).cast("long"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n = F.size(F.array_remove(F.split(F.coalesce("t", F.lit("")), _GAPS), "")).cast("long")
    out = rows.join(hits, "id", "left").select("k", n.alias("n_words"), hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def overlap(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item: str = "item_id", span: int = SPAN_WORDS, gram: int = GRAM_WORDS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Overlap of every row of ``docs`` with the benchmark items.

    A window is ``span`` consecutive words of an item; an item of fewer words is one window, an item
    without words none. ``n_hit`` counts the words inside any occurrence of a window, ``n_items`` the
    items with one, and a document is contaminated where ``20 * n_hit >= n_words``. Null texts have no
    words; repeated rows keep their rows; items of a null id are left out; items that share an id
    count once. Keys and ids are of any type; ids are sorted as strings. A benchmark of up to
    ``sent_bytes`` (counted first) is sent to the executors, a larger one is joined by fingerprints.
    """
    rows = shared.carried(docs, [key], text)
    items = benchmark.select(F.col(shared.quoted(item)).cast("string").alias("item"), F.col(shared.quoted(item_text)).alias("t")).filter("item is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    found = _joined(rows, items, span, gram) if size > sent_bytes else _sent(rows, [(r["item"], r["t"].encode()) for r in items.collect()], span, gram)
    return found.select("k.*", *found.columns[1:])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, unchanged, whatever their columns are called.

    Null and empty texts stay; repeated rows have one fate. The texts that go are found first and written by
    their SHA-256; only if they are few are they broadcast.
    """
    of = F.sha2(F.col(shared.quoted(text)), 256)
    bad = overlap(docs.select(of.alias("__of"), F.col(shared.quoted(text)).alias("__text")), benchmark, "__text", "__of").filter("contaminated")
    bad = shared.written(bad.select("__of").distinct(), "contaminated")
    if shared.fits(bad, 112):
        bad = F.broadcast(bad)
    return docs.join(bad, of == bad["__of"], "left_anti")


def op3_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark; see :func:`overlap`."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return overlap(docs, shared.table(spark, sf_dir, "benchmark"))
