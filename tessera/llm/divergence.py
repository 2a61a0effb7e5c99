"""Audit of how the sources of a language differ in their words (operator 13).

A term that many groups have is heavy: its shares stand in dense numpy tiles of groups and terms. The others are
light: all groups that lack one have the same smoothed share, so that a list of who has it is enough, and only
the deviations from that share are added. Both are partial sums of blocks of group pairs, added exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import shared

#: Documents of a language that have a kept term, unit of the shares, smoothing, and ranks of terms.
MIN_DOCUMENTS, UNIT, SMOOTHING, TOP = 30, 1_000_000_000, 5, 50
#: A term is heavy where more than one in HEAVY groups of its language has it.
HEAVY = 4
#: Groups of a block; cells of a dense tile, and the terms it has at least; postings of light terms in a part.
BLOCK, CELLS, LEAST_TERMS, POSTINGS = 256, 1 << 15, 512, 1 << 15
#: Terms that a task counts before it passes them on.
HELD = 200_000
#: Letters in lower case, every other ASCII character a blank; bytes of other characters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included."""
    return raw.translate(_LETTERS).split()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it) of all groups and terms.

    A null term counts the documents of the group, so that a group without terms has a row. Tasks add up
    what they have read before it is shuffled: a hot group's commonest term is a row a task.
    """
    rows = docs.select(*[F.coalesce(F.col(shared.quoted(c)), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "t"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (of, by), (n, df, count) in held.items():
                terms = pa.array([None, *n], pa.binary()).cast(pa.string())
                size = len(n) + 1
                columns = [pa.array([of] * size), pa.array([by] * size), terms, pa.array([0, *n.values()], pa.int64()), pa.array([count, *(df[t] for t in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch, texts in shared.bounded(batches, "t"):
            for of, by, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                own = held.setdefault((of, by), [Counter(), Counter(), 0])
                found = terms_of(t.encode())
                own[0].update(found)
                own[1].update(set(found))
                own[2] += 1
            if sum(len(n) + 1 for n, _, _ in held.values()) > HELD:
                yield from flushed()
        yield from flushed()

    counted = shared.mapped(rows, run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, v: str, unit: int = UNIT, smoothing: int = SMOOTHING) -> Column:
    """1 + floor(unit * (n + smoothing) / (total + smoothing * v)) in exact integers."""
    return F.expr(f"1 + ((cast({unit} as decimal(12,0)) * cast({n} + {smoothing} as decimal(20,0))) div cast({total} + {smoothing} * greatest({v}, 1) as decimal(20,0)))")


class Audit:
    """Written tables of one audit. ``groups``: lang, source, gid (from 0 in each language), total, v (kept terms),
    z (share of a term that the group lacks), size (groups of the language). ``postings``: lang, source, term, n, of
    groups that have a kept term, and of the whole language all_n and spread (groups that have it)."""

    def __init__(self, docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_documents: int = MIN_DOCUMENTS):
        counts = shared.written(term_counts(docs, lang, source, text), "counts")
        kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"), F.count("*").alias("spread"))
        kept = shared.written(kept.filter(F.col("docs") >= min_documents).drop("docs"), "kept")
        self.postings = shared.written(counts.filter("term is not null").drop("docs").join(kept, ["lang", "term"]), "postings")
        totals = self.postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
        groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "v"])
        order = Window.partitionBy("lang").orderBy("source")
        groups = groups.withColumns({"gid": F.row_number().over(order) - 1, "size": F.count("*").over(Window.partitionBy("lang")), "z": F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(0)})
        self.groups = shared.written(groups, "groups")

    def _small(self, df: DataFrame, row_bytes: int = 96) -> DataFrame:
        return F.broadcast(df) if shared.fits(df, row_bytes, 8 << 20) else df

    def _shares(self) -> DataFrame:
        """The postings with gid, p, size and v."""
        of = self._small(self.groups.select("lang", "source", "gid", "total", "v", "size"))
        return self.postings.join(of, ["lang", "source"]).withColumn("p", share("n", "total", "v"))

    def terms(self, top: int = TOP) -> DataFrame:
        """lang, source, item, value, rank: the terms that a group has oftener than its language."""
        langs = self.groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
        rows = self._shares().join(self._small(langs), "lang").withColumn("q", share("all_n", "lang_total", "v"))
        rows = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        # Spark cuts what can't be among the first ranks in each task, before it shuffles.
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    def _parts(self, heavy: int) -> DataFrame:
        """lang, bi, bj, part, gid, term, p: the shares by blocks of groups and parts of terms; parts from 0 are
        dense, others light. A row of a null term has the z of each group of the blocks."""
        rows = self._shares().withColumn("dense", F.col("spread") * heavy > F.col("size"))
        each = rows.groupBy("lang").agg(F.count(F.when(~F.col("dense"), 1)).alias("light"), F.count(F.when(F.col("dense"), 1)).alias("cells"))
        tile = F.greatest(F.lit(LEAST_TERMS), F.floor(F.lit(CELLS) / F.col("size")))
        sizes = self.groups.groupBy("lang").agg(F.first("size").alias("size"), F.first("v").alias("v")).join(each, "lang", "left").na.fill(0)
        # Every dense term is in more than size / heavy groups, which bounds the number of dense terms.
        dense = F.ceil(F.least(F.col("v"), F.col("cells") * heavy / F.col("size")) / tile)
        light = F.greatest(F.lit(1), F.ceil(F.col("light") / POSTINGS))
        sizes = shared.written(sizes.select("lang", dense.cast("long").alias("tiles"), light.cast("long").alias("chunks")), "parts")
        rows = rows.join(self._small(sizes, 48), "lang")
        h = F.xxhash64("term")
        part = F.when(F.col("dense"), F.pmod(h, F.col("tiles"))).otherwise(-1 - F.pmod(h, F.col("chunks")))
        rows = rows.select("lang", "gid", part.alias("part"), "term", "p", "size")
        every = self.groups.join(self._small(sizes, 48), "lang").withColumn("part", F.explode(F.sequence(-F.col("chunks"), F.col("tiles") - 1)))
        every = every.select("lang", "gid", "part", F.lit(None).cast("string").alias("term"), F.col("z").alias("p"), "size")
        block = F.floor(F.col("gid") / BLOCK).cast("int")
        both = rows.unionByName(every).withColumns({"b": block, "x": F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK).cast("int")))})
        return both.select("lang", F.least("b", "x").alias("bi"), F.greatest("b", "x").alias("bj"), "part", "gid", "term", "p")

    def pairs(self, heavy: int = HEAVY) -> DataFrame:
        """lang, a, b (gids, a < b) and value, the sum of differences over all kept terms."""
        block = BLOCK

        def summed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            return _block_sums(block, key, rows)

        sums = self._parts(heavy).groupBy("lang", "bi", "bj", "part").applyInArrow(summed, "lang string, a int, b int, d long")
        found = sums.groupBy("lang", "a", "b").agg(F.sum("d").alias("d"))
        a = self._small(self.groups.select("lang", F.col("gid").alias("a"), F.col("source").alias("a_source"), F.col("z").alias("a_z"), "v"))
        b = self._small(self.groups.select("lang", F.col("gid").alias("b"), F.col("source").alias("b_source"), F.col("z").alias("b_z")))
        return found.join(a, ["lang", "a"]).join(b, ["lang", "b"]).select("lang", "a_source", "b_source", (F.col("v") * F.abs(F.col("a_z") - F.col("b_z")) + F.col("d")).alias("value"))

    def ranked_pairs(self, heavy: int = HEAVY) -> DataFrame:
        """lang, source, item, value, rank: every other source of each group's language, the farthest first."""
        ends = F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))
        rows = self.pairs(heavy).select("lang", F.inline(ends), "value")
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))


def dense_sums(x: np.ndarray, y: np.ndarray, zx: np.ndarray, zy: np.ndarray) -> np.ndarray:
    """For rows i of ``x`` and j of ``y``: the sum over all columns of |x[i] - y[j]| - |zx[i] - zy[j]|."""
    out = np.empty((len(x), len(y)), np.int64)
    for i, row in enumerate(x):
        out[i] = np.abs(y - row).sum(1, dtype=np.int64)
    return out - x.shape[1] * np.abs(zx[:, None] - zy[None])


def one_sided(of: np.ndarray, p: np.ndarray, zx: np.ndarray, zy: np.ndarray) -> np.ndarray:
    """For every i and j: the sum of |p - zy[j]| - |zx[i] - zy[j]| over the postings p of group i."""
    out = np.zeros((len(zx), len(zy)), np.int64)
    order = np.lexsort((p, of))
    of, p = of[order], p[order]
    ends = np.searchsorted(of, np.arange(len(zx) + 1))
    for i in np.unique(of):
        own = p[ends[i] : ends[i + 1]]
        below = np.r_[0, np.cumsum(own)]
        k = np.searchsorted(own, zy)
        out[i] = below[-1] - 2 * below[k] + (2 * k - len(own)) * zy - len(own) * np.abs(zx[i] - zy)
    return out


def posting_pairs(tx: np.ndarray, gx: np.ndarray, px: np.ndarray, ty: np.ndarray, gy: np.ndarray, py: np.ndarray, zx: np.ndarray, zy: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """What both one-sided sums have wrong where two groups share a light term: of postings (term, group, p), sorted
    by term, |p - q| - |p - zy| - |zx - q| + |zx - zy| at [group of p, group of q]."""
    out = np.zeros(len(zx) * len(zy), np.int64)
    low, high = np.searchsorted(ty, tx, "left"), np.searchsorted(ty, tx, "right")
    total = np.r_[0, np.cumsum(high - low)]
    begin = 0
    while begin < len(tx):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + at_once, "right")) - 1)
        n = (high - low)[begin:end]
        left = np.repeat(np.arange(begin, end), n)
        right = np.arange(len(left)) - np.repeat(total[begin:end] - total[begin], n) + np.repeat(low[begin:end], n)
        p, q, a, b = px[left], py[right], gx[left], gy[right]
        np.add.at(out, a * len(zy) + b, np.abs(p - q) - np.abs(p - zy[b]) - np.abs(zx[a] - q) + np.abs(zx[a] - zy[b]))
        begin = end
    return out.reshape(len(zx), len(zy))


def _block_sums(block: int, key: tuple, rows: pa.Table) -> pa.Table:
    """Partial sums of one part of the terms, for the pairs of two blocks of groups."""
    lang, bi, bj, part = (k.as_py() for k in key)
    gid, p = rows.column("gid").to_numpy().astype(np.int64), rows.column("p").to_numpy().astype(np.int64)
    terms = rows.column("term").combine_chunks().dictionary_encode()
    own = terms.indices.is_valid().to_numpy(zero_copy_only=False)
    code = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    sides = []
    for b in (bi, bj):
        here = gid // block == b
        z = p[here & ~own][np.argsort(gid[here & ~own])]
        mine = np.flatnonzero(here & own)
        mine = mine[np.argsort(code[mine], kind="stable")]
        sides.append((code[mine], gid[mine] - b * block, p[mine], z))
    (tx, gx, px, zx), (ty, gy, py, zy) = sides
    if part >= 0:
        tiles = []
        for t, g, x, z in sides:
            tile = np.repeat(z[:, None], len(terms.dictionary), 1)
            tile[g, t] = x
            tiles.append(tile)
        sums = dense_sums(*tiles, zx, zy)
    else:
        sums = one_sided(gx, px, zx, zy) + one_sided(gy, py, zy, zx).T + posting_pairs(tx, gx, px, ty, gy, py, zx, zy)
    a, b = np.indices(sums.shape)
    a, b = a.ravel() + bi * block, b.ravel() + bj * block
    keep = a < b
    return pa.table({"lang": pa.array([lang] * int(keep.sum()), pa.string()), "a": pa.array(a[keep], pa.int32()), "b": pa.array(b[keep], pa.int32()), "d": pa.array(sums.ravel()[keep], pa.int64())})


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_documents: int = MIN_DOCUMENTS, top: int = TOP, heavy: int = HEAVY) -> DataFrame:
    """lang, source, part, item, value, rank: the differences of all sources of a language, and the terms in which a
    source differs most from its language.

    Null columns count as empty. Every row is a document, repeated rows too. A group without terms has
    its pairs; where a language keeps no term all values are 0 and sources are ranked by name; a
    language of one source has no pairs. No rows give none. Extra columns are ignored. Ties are in
    the order of the items' UTF-8 bytes.
    """
    audit = Audit(docs, lang, source, text, min_documents)
    parts = [(name, df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))) for name, df in (("pair", audit.ranked_pairs(heavy)), ("term", audit.terms(top)))]
    return parts[0][1].unionByName(parts[1][1])


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and marking terms of ``documents``; see :func:`divergence`."""
    return divergence(shared.table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS all_n FROM found GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCUMENTS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT DISTINCT lang, source FROM docs),
vocabulary AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
cells AS (SELECT grp.lang, grp.source, kept.term, coalesce(n, 0) AS n,
                 1 + {UNIT}::HUGEINT * (coalesce(n, 0) + {SMOOTHING}) // (coalesce(total, 0) + {SMOOTHING} * v) AS p,
                 1 + {UNIT}::HUGEINT * (all_n + {SMOOTHING}) // (lang_total + {SMOOTHING} * v) AS q
          FROM grp JOIN kept USING (lang) JOIN vocabulary USING (lang) LEFT JOIN totals USING (lang, source)
          LEFT JOIN counts ON counts.lang = grp.lang AND counts.source = grp.source AND counts.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
