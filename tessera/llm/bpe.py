"""Byte-level BPE encoding and decoding in batched numpy merge rounds (operator 2).

The symbols of many words lie in one flat array. A round looks up the rank of every adjacent pair
by binary search over the sorted pair keys, takes the lowest rank of each word, and merges all its
places at once. Words are encoded once per worker while a bounded table remembers them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import pieces, shared

#: Words that a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Bytes of a word up to which it is merged in rounds with others.
LONG = 256
NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 characters
    stand for themselves, the others follow from code point 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merges:
    """The merge table of a vocabulary file: sorted pair keys, their ranks and results."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.made, self.by_rank = keys[self.order], made, made.tolist()
        self.by_pair: dict[int, int] = {}  # made for the first long word
        back = {c: b for b, c in enumerate(letters)}
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            cut = token.removesuffix(suffix) if suffix else token
            self.bytes[i] = bytes(back[c] for c in cut)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words in one array, and how many each word has.

        A round costs what all symbols cost, and a word takes a round for each rank in it: words of
        more than LONG bytes are merged one by one instead.
        """
        if max(map(len, words)) <= LONG:
            return self._merged(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        parts: dict[int, np.ndarray] = {}
        if short:
            ids, counts = self._merged([words[i] for i in short])
            parts = dict(zip(short, np.split(ids, np.cumsum(counts)[:-1]), strict=True))
        own = [parts[i] if i in parts else self._long(w) for i, w in enumerate(words)]
        return np.concatenate(own), np.array(list(map(len, own)), np.int64)

    def _long(self, word: bytes) -> np.ndarray:
        """Ids of one word: the pair of the lowest rank, of equal ones the first, from a heap over a
        linked list of symbols."""
        raw = np.frombuffer(word, np.uint8)
        first = self.first[raw]
        first[-1] = self.last[raw[-1]]
        ranks = self.ranks(first[:-1], first[1:])
        at = np.flatnonzero(ranks != NO_RANK)
        heap = list(zip(ranks[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(heap)
        symbol, n = first.tolist(), len(word)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        by_rank, size = self.by_rank, self.size
        if not self.by_pair:
            self.by_pair = dict(zip(self.keys.tolist(), self.order.tolist(), strict=True))
        get = self.by_pair.get
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if symbol[i] < 0 or j >= n or get(symbol[i] * size + symbol[j]) != r:
                continue  # merged meanwhile
            symbol[i], symbol[j] = by_rank[r], -1
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (q := get(symbol[i] * size + symbol[after])) is not None:
                    heapq.heappush(heap, (q, i))
            if (before := left[i]) >= 0 and (q := get(symbol[before] * size + symbol[i])) is not None:
                heapq.heappush(heap, (q, before))
        return np.array([x for x in symbol if x >= 0], np.int64)

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.first[raw]
        last = np.cumsum(sizes) - 1
        symbol[last] = self.last[raw[last]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            pair = np.full(len(symbol), NO_RANK)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pair[inner] = self.ranks(symbol[inner], symbol[inner + 1])
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            spans = np.diff(np.append(begins, len(owner)))
            lowest = np.minimum.reduceat(pair, begins)
            ended = lowest == NO_RANK
            if ended.any():  # these words have no pair left
                out = np.repeat(ended, spans)
                done.append((owner[out], symbol[out]))
                symbol, owner, pair = symbol[~out], owner[~out], pair[~out]
                if not len(symbol):
                    break
                spans, lowest = spans[~ended], lowest[~ended]
            hit = np.flatnonzero(pair == np.repeat(lowest, spans))
            if len(hit) > 1:  # of overlapping places (a a a) every second one counts
                run = np.r_[True, np.diff(hit) > 1]
                since = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[since % 2 == 0]
            symbol[hit] = self.made[pair[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        owners = np.concatenate([o for o, _ in done]) if done else np.empty(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.empty(0, np.int64)
        order = np.argsort(owners, kind="stable")
        return ids[order], np.bincount(owners, minlength=len(words))


class Encoder:
    """Encodes many texts at once; its table of words is bounded by ``remembered``."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.merges = Merges(path)
        self.words = pieces.Remembered(lambda new: self.merges.merge([w.encode("utf-8", "surrogatepass") for w in new]), remembered)
        self.pool = np.frombuffer(b"".join(self.merges.bytes), np.uint8)
        self.place = np.cumsum(self.merges.lengths) - self.merges.lengths

    def forget(self) -> None:
        self.words.forget()

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without control strings, and how many each has."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends_of = np.cumsum(sizes)
        points = pieces.code_points(joined)
        starts, ends = pieces.boundaries(points, (ends_of - sizes)[sizes > 0], word=False)
        ids, counts = self.words.of(joined, points, starts, ends)
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[np.searchsorted(starts, np.concatenate([[0], ends_of]))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and the number of ids of each; control strings of the
        vocabulary in a text become their own ids."""
        return pieces.by_runs(texts, self._encoded)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.merges.special
        if not any(s in t for t in texts for s in special):
            return self._plain(texts)
        parts: list[str] = []
        owner: list[int] = []
        mark: list[int] = []
        for i, t in enumerate(texts):
            for text, code in _cut(t, special):
                parts.append(text)
                owner.append(i)
                mark.append(code)
        ids, counts = self._plain(parts)
        marked = np.array(mark)
        places = np.cumsum(counts)[marked >= 0]
        ids = np.insert(ids, places, marked[marked >= 0].astype(ids.dtype))
        return ids, np.bincount(owner, counts + (marked >= 0), len(texts)).astype(np.int64)

    def spelled(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where those of each end."""
        sizes = self.merges.lengths[ids]
        ends = np.cumsum(sizes)
        take = np.repeat(self.place[ids] - (ends - sizes), sizes)
        take += np.arange(len(take))
        return self.pool[take].tobytes(), ends

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[str]:
        """The texts of all ids, of which each text has so many; about RUN ids are spelled at once."""
        stops = np.cumsum(counts)
        at, i = 0, 0
        while i < len(counts):
            to = max(i + 1, int(np.searchsorted(stops, at + pieces.RUN, "right")))
            blob, ends = self.spelled(ids[at : int(stops[to - 1])])
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], stops[i:to] - at])].tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield blob[a:b].decode("utf-8", "replace")
            at, i = int(stops[to - 1]), to

    def decode(self, ids: np.ndarray) -> str:
        return self.spelled(ids)[0].decode("utf-8", "replace")


def _cut(text: str, special: dict[str, int]) -> list[tuple[str, int]]:
    """The text between control strings, each with the id of the string after it (-1: none)."""
    out, at = [], 0
    while True:
        found = [(p, -len(s), s) for s in special if (p := text.find(s, at)) >= 0]
        if not found:
            return [*out, (text[at:], -1)]
        place, _, s = min(found)
        out.append((text[at:place], special[s]))
        at = place + len(s)


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    found = Encoder(path)
    shared.FORGETTABLE.append(found.forget)
    return found


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` and the token ids (array of int) of every whole text.

    A null or empty text has no ids. Repeated rows stay. Other columns, whatever their names, go.
    """
    rows = shared.carried(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch, texts in shared.bounded(batches, "t"):
            flat, counts = enc.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["k", "ids"])

    return shared.mapped(rows, run, shared.with_results(rows, "ids array<int>")).select("k.*", F.col("ids").alias(ids))


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes every whole text and decodes it again; digests of both, a row for each row of ``docs``.

    ``ids_sha256``: of the ids as little-endian unsigned 32-bit integers; ``decoded_sha256``: of the
    decoded text in UTF-8. A null text counts as empty: no ids, and the digests of nothing. Keys are of
    any type, null too; other columns go.
    """
    rows = shared.carried(docs, [key], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch, texts in shared.bounded(batches, "t"):
            flat, counts = enc.encode(texts)
            flat = flat.astype("<u4")
            ends = np.cumsum(counts)
            of_ids = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            of_text = [hashlib.sha256(t.encode()).hexdigest() for t in enc.decoded(flat, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    found = shared.mapped(rows, run, shared.with_results(rows, "n_tokens long, ids_sha256 string, decoded_sha256 string"))
    return found.select("k.*", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document; see :func:`round_trip`."""
    return round_trip(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
