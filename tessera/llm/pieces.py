"""Cutting texts into pieces before BPE, as vectorised rules over arrays of code points.

Two published patterns are expressed here, in the order of their alternatives:

* ``prefix``: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
* ``word``: ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`` (white space goes)
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

#: Characters that are cut at once: a longer text is cut in runs of about so many.
RUN = 1 << 20
#: Code points of remembered pieces above which a table starts anew.
POINTS = 1 << 24
_PLACE = re.compile(r"[^\s](?=[ \n])")
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MIX = np.uint64(0xD6E8FEB86659FD93)
OTHER, LETTER, NUMBER, SPACE = range(4)


@cache
def unassigned() -> np.ndarray:
    """Whether Python's own tables lack a code point; the tables of the tokenizers library may be newer."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool)


@cache
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other. Of code points that Python doesn't know
    yet, the library's regular expressions say it, but for planes 4 to 13, which no version of Unicode uses."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    # The code points with the Unicode property White_Space.
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    new = np.flatnonzero(unassigned())
    new = new[(new < 0x40000) | (new >= 0xE0000)]
    text = "".join(map(chr, new.tolist()))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for _, (first, end) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[new[first:end]] = kind
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def boundaries(points: np.ndarray, begins: np.ndarray, word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of concatenated texts; ``begins``: where non-empty texts begin."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 4, bool)
    first[begins] = True
    first[n:] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first[:n]
    if word:
        start |= kind == NUMBER
    else:
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
        start[after - 1] = True
        start[after] = points[after - 1] != 0x20
    quotes = np.flatnonzero((points == 0x27) & start)
    if len(quotes):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~first[quotes + 1]
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        two &= ~first[quotes + 1] & ~first[quotes + 2]
        for hit, length in ((one, 2), (two, 3)):
            at = quotes[hit]
            start[at + 1] = False
            ends = at + length
            start[ends[ends < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    if word:
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def runs(text: str, size: int = RUN) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters. It is cut only before a space or line break that
    follows something else: no piece of either pattern goes on there, nor does any depend on what was
    before. Where a text has no such place the part is longer."""
    at = 0
    while len(text) - at > size:
        m = _PLACE.search(text, at + size - 1)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def by_runs(texts: list[str], encoded: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """What ``encoded`` gives for ``texts`` (ids of all, how many each has), a long text run by run."""
    if max(map(len, texts), default=0) <= RUN:
        return encoded(texts)
    found = [[encoded([p])[0] for p in runs(t)] for t in texts]
    return np.concatenate([x for own in found for x in own]), np.array([sum(map(len, own)) for own in found], np.int64)


@cache
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every points[start:end] (sorted, not overlapping), by prefix sums modulo 2**64. Texts of equal
    hashes can be made; who uses these compares the texts as well."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # so many pieces at once as lie within a run
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + RUN, "right")))
        high = int(ends[to - 1])
        up, down = _powers(1 << max(16, (high - low).bit_length()), _BASES[which])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((points[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        h = (total[b] - total[a]) * down[a]
        h ^= (b - a).astype(np.uint64) << np.uint64(40)
        h ^= h >> np.uint64(32)
        h *= _MIX
        out[at:to] = h ^ (h >> np.uint64(29))
        at = to
    return out


class Known:
    """Numbers of pieces, found by hashes in arrays that are probed for many pieces at once. Hashes only propose: the code
    points of every piece are compared with those of the number found, and pieces that another one's
    hashes hide are looked up by their text."""

    def __init__(self) -> None:
        self.count = 0
        self.points, self.used = np.empty(1 << 12, np.uint32), 0
        self.begin = np.zeros(1, np.int64)
        self.hidden: dict[bytes, int] = {}
        self._sized(16)

    def _sized(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.first, self.second = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, -1, np.int32)

    def _slots(self, first: np.ndarray) -> np.ndarray:
        return (first >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        slot = self._slots(first)
        out = self.number[slot]
        live = np.flatnonzero((out >= 0) & ((self.first[slot] != first) | (self.second[slot] != second)))
        while len(live):
            slot[live] = at = (slot[live] + 1) & self.mask
            found = self.number[at]
            out[live] = found
            live = live[(found >= 0) & ((self.first[at] != first[live]) | (self.second[at] != second[live]))]
        return out

    def _insert(self, first: np.ndarray, second: np.ndarray, numbers: np.ndarray) -> None:
        slot, rest = self._slots(first), np.arange(len(first))
        while len(rest):
            at = slot[rest]
            free = self.number[at] < 0
            self.number[at[free]] = numbers[rest[free]]  # of several the last one gets the slot
            won = free & (self.number[at] == numbers[rest])
            self.first[at[won]], self.second[at[won]] = first[rest[won]], second[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _stored(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Keeps the code points of new pieces, in the order of their numbers."""
        sizes = ends - starts
        total = np.cumsum(sizes)
        need = self.used + int(total[-1])
        if need > len(self.points):
            self.points = np.concatenate([self.points[: self.used], np.empty(2 * need - self.used, np.uint32)])
        self.points[self.used : need] = points[np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1])]
        self.begin = np.concatenate([self.begin, self.used + total])
        self.used = need
        self.count += len(starts)

    def _differing(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Places of the pieces whose code points aren't those of their numbers."""
        sizes, own = ends - starts, self.begin[numbers]
        bad = sizes != self.begin[numbers + 1] - own
        found, at = [np.flatnonzero(bad)], 0
        total = np.concatenate([[0], np.cumsum(np.where(bad, 0, sizes))])
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(total, total[at] + RUN, "right")) - 1)
            of = at + np.flatnonzero(~bad[at:to])
            if len(of):
                n = sizes[of]
                begins = np.cumsum(n) - n
                within = np.arange(begins[-1] + n[-1])
                same = points[np.repeat(starts[of] - begins, n) + within] == self.points[np.repeat(own[of] - begins, n) + within]
                if not same.all():
                    found.append(of[~np.logical_and.reduceat(same, begins)])
            at = to
        return np.concatenate(found)

    def numbers(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece, and for each new number, in order, a place where it stands."""
        first, second = hashes(points, starts, ends), hashes(points, starts, ends, 1)
        out = self._find(first, second)
        missing = np.flatnonzero(out < 0)
        new = missing
        if len(missing):
            order = missing[np.lexsort((second[missing], first[missing]))]
            a, b = first[order], second[order]
            fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            out[order] = self.count + np.cumsum(fresh) - 1
            new = order[fresh]
            if 2 * (self.count + len(new)) > len(self.number):
                old = np.flatnonzero(self.number >= 0)
                kept = self.first[old], self.second[old], self.number[old]
                self._sized((3 * (self.count + len(new))).bit_length())
                self._insert(*kept)
            self._insert(first[new], second[new], out[new])
            self._stored(points, starts[new], ends[new])
        more = []
        for i in self._differing(points, starts, ends, out).tolist():
            text = points[starts[i] : ends[i]].tobytes()
            if text not in self.hidden:
                self.hidden[text] = self.count
                self._stored(points, starts[i : i + 1], ends[i : i + 1])
                more.append(i)
            out[i] = self.hidden[text]
        return out, np.concatenate([new, np.array(more, np.int64)]) if more else new


class Remembered:
    """The ids of pieces, each of which is encoded once while a bounded table remembers it."""

    def __init__(self, encoded: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        #: Ids of all of some pieces in one array, and how many each has.
        self.encoded, self.limit = encoded, limit
        self.forget()

    def forget(self) -> None:
        self.known = Known()
        self.ids = np.empty(0, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def of(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces text[start:end] in one array, and how many each has."""
        if self.known.count > self.limit or self.known.used > POINTS:
            self.forget()
        words, new = self.known.numbers(points, starts, ends)
        if len(new):
            ids, counts = self.encoded([text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
        begin = self.begin[words]
        counts = self.begin[words + 1] - begin
        total = np.cumsum(counts)
        take = np.repeat(begin - (total - counts), counts)
        take += np.arange(len(take))
        return self.ids[take], counts
