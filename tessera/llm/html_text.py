"""Main text of pages by a tree-structured graphical model (operator 5).

Every block element and text block of a page is a binary variable: main text or not. Potentials
connect parent and child; sum-product messages pass upwards and downwards once, and give exact
marginals. The potentials are counted on labelled pages.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import dom, labelled_pages, shared

TRAINING_PAGES = 1500
SMOOTH = 0.5
#: Most that one text block may say, as a logarithm: blocks of a page resemble each other, and what
#: many of them say would else outweigh the elements around.
TEXT_REACH = 2.5
#: Text blocks of one shape that count in full on a page: more of them share what these say.
ALIKE = 4


def _bucket(n: int) -> int:
    return n.bit_length()


def features(page: dom.Page, i: int) -> list[str]:
    """What is seen of a node: of an element its tag and hints, of a text its shape."""
    tag = page.tag[i]
    if tag == "body":  # does it hold the blocks itself, or elements that do?
        direct, inner, _ = page.outline()
        return [f"body {i in direct} {inner}", *(f"hint {h}" for h in page.hints[i])]
    if tag != "#":
        named = " named" if tag in ("article", "main") and page.hints[i] else " p" if tag == "td" and i in page.outline()[2] else ""
        return [f"tag {tag}{named}", *(f"hint {h}" for h in page.hints[i])]
    text = page.text[i]
    words = text.count(" ") + 1
    density = min(4, 5 * page.linked[i] // max(1, len(text)))
    ends = text[-1] in ".!?…:;\"'”»"
    # What depends on each other is one feature, so that it doesn't count twice.
    around = page.tag[page.parent[i]] + " links" * (density >= 4)
    return [f"in {around}", f"shape {min(6, _bucket(words))} {ends} {density}", f"sign {'©' in text}"]


class Model:
    """Emission and transition potentials, as logarithms."""

    def __init__(self) -> None:
        self.seen: list[Counter] = [Counter(), Counter()]
        self.kinds: list[Counter] = [Counter(), Counter()]
        self.moves: Counter = Counter()

    @staticmethod
    def kind(tag: str) -> str:
        return "text" if tag == "#" else tag

    def learn(self, page: dom.Page) -> None:
        """Counts a page whose elements carry labels; a node without one has its parent's."""
        label = page.label
        for i in range(1, len(page.tag)):
            up = label[page.parent[i]]
            if label[i] is None:
                label[i] = up
            self.moves[self.kind(page.tag[i]), up, label[i]] += 1
            self.moves["", up, label[i]] += 1
            for f in features(page, i):
                self.seen[label[i]][f] += 1
                self.kinds[label[i]][f.split(" ")[0]] += 1

    def finish(self) -> Model:
        self.ratio: dict[str, float] = {}
        kinds = Counter(f.split(" ")[0] for f in {*self.seen[0], *self.seen[1]})
        for f in {*self.seen[0], *self.seen[1]}:
            k = f.split(" ")[0]
            p = [(self.seen[y][f] + SMOOTH) / (self.kinds[y][k] + SMOOTH * (kinds[k] + 1)) for y in (0, 1)]
            self.ratio[f] = math.log(p[1] / p[0])
        self.pass_on: dict[str, tuple[tuple[float, float], tuple[float, float]]] = {}
        for kind in {k for k, _, _ in self.moves}:
            rows = []
            for up in (0, 1):
                base = [(self.moves["", up, y] + SMOOTH) / (self.moves["", up, 0] + self.moves["", up, 1] + 2 * SMOOTH) for y in (0, 1)]
                n = self.moves[kind, up, 0] + self.moves[kind, up, 1]
                rows.append(tuple((self.moves[kind, up, y] + 4 * base[y]) / (n + 4) for y in (0, 1)))
            self.pass_on[kind] = tuple(rows)
        return self

    def marginals(self, page: dom.Page) -> list[float]:
        """Probability of main text of every node."""
        return self.passed(page)[0]

    def passed(self, page: dom.Page) -> tuple[list[float], float]:
        """Probability of main text of every node, and that the page has none at all: one pass upwards, one downwards."""
        n = len(page.tag)
        own0, own1 = [1.0] * n, [1.0] * n  # evidence of the subtree below, for label 0 and 1
        up0, up1 = [1.0] * n, [1.0] * n  # message of a node to its parent
        moves = [self.pass_on[""]] * n
        get, parent, tags = self.ratio.get, page.parent, page.tag
        seen = [features(page, i) if i else [] for i in range(n)]
        alike = Counter(f[1] for f, tag in zip(seen, tags, strict=True) if tag == "#")
        for i in range(1, n):
            said = sum(get(f, 0.0) for f in seen[i])
            if tags[i] == "#":
                own1[i] = math.exp(max(-TEXT_REACH, min(TEXT_REACH, said)) * min(1.0, ALIKE / alike[seen[i][1]]))
            else:
                own1[i] = math.exp(max(-12.0, min(12.0, said)))
            moves[i] = self.pass_on.get(self.kind(tags[i]), moves[i])
        own1[0] = 1e-9
        none = 0.0  # logarithm of the weight of no main text, as a share of all weights
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = moves[i]
            x, y = own0[i], own1[i]
            m0, m1 = a * x + b * y, c * x + d * y
            s = m0 + m1
            none += math.log(a) - math.log(s)
            up0[i], up1[i] = m0 / s, m1 / s
            p = parent[i]
            x, y = own0[p] * up0[i], own1[p] * up1[i]
            s = x + y
            none -= math.log(s)
            own0[p], own1[p] = x / s, y / s
        out = [0.0] * n
        belief0, belief1 = own0[:], own1[:]
        s = belief0[0] + belief1[0]
        belief0[0], belief1[0] = belief0[0] / s, belief1[0] / s
        for i in range(1, n):
            p = parent[i]
            # The parent's belief without what this node has told it.
            x, y = belief0[p] / max(up0[i], 1e-300), belief1[p] / max(up1[i], 1e-300)
            (a, b), (c, d) = moves[i]
            u, v = (x * a + y * c) * own0[i], (x * b + y * d) * own1[i]
            s = u + v
            belief0[i], belief1[i] = u / s, v / s
            out[i] = belief1[i]
        return out, math.exp(min(0.0, none))

    def extract(self, source: str, least: float = 0.5) -> str:
        """The blocks whose marginal is ``least`` or more, in page order, one a line. Marginals are those of a page that has
        main text somewhere, if only in an element without any."""
        page = dom.parse(source)
        found, none = self.passed(page)
        least *= 1 - none
        return "\n".join(t for tag, t, p in zip(page.tag, page.text, found, strict=True) if tag == "#" and p >= least)


@cache
def trained(count: int = TRAINING_PAGES) -> Model:
    """The model counted on ``count`` labelled pages; the same wherever it is made."""
    model = Model()
    for source, _ in labelled_pages.pages(count):
        model.learn(dom.parse(source, labelled=True))
    return model.finish()


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text: str = "text") -> DataFrame:
    """``keep``, the main text and its length in code points for every row of ``pages``.

    Null or empty pages, and pages without main text, have the empty text. Repeated rows stay; other
    columns go.
    """
    rows = shared.carried(pages, keep, html)
    held = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch, sources in shared.bounded(batches, "t"):
            found = [model.extract(s) for s in sources]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["k", "t", "n_chars"])

    found = shared.mapped(rows, run, shared.with_results(rows, "t string, n_chars long"))
    return found.select("k.*", F.col("t").alias(text), "n_chars")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; see :func:`main_text`."""
    return main_text(shared.table(spark, sf_dir, "pages"))
