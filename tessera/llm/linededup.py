"""Line deduplication across documents (operator 12).

Normalised lines are exploded and hashed, distinct documents are counted for each hash, lines at or over the
threshold leave every document but the first that has them, and texts are put together again by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import let
from tessera.llm import shared

#: Code points that a key has at least, and documents at which its lines are dropped.
MIN_CHARS, MIN_DOCUMENTS = 10, 2
#: Bytes of repeated keys up to which they are broadcast; beyond that they are joined.
SENT_BYTES = 8 << 20


def keys(raw: bytes, min_chars: int = MIN_CHARS) -> list[tuple[int, bytes]]:
    """Places and keys of the lines of a text in UTF-8: A-Z in lower case, blanks gone at both ends. Python's
    bytes know just these as upper case and white space. Shorter keys than ``min_chars`` have no place."""
    found = ((i, line.strip()) for i, line in enumerate(raw.lower().split(b"\n")))
    return [(i, k) for i, k in found if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode(errors="replace")) >= min_chars)]


def _parted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, row and t of every row; ``row`` tells apart the texts that rows of one key have."""
    t = F.coalesce(F.col(shared.quoted(text)), F.lit(""))
    return docs.select(F.col(shared.quoted(key)).alias("doc"), F.xxhash64(t).alias("row"), t.alias("t"))


def hashed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, row, pos and h, a 128-bit digest of the key, of every line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in shared.bounded(batches, "t"):
            of, at, digests = [], [], []
            for i, t in enumerate(texts):
                for pos, k in keys(t.encode(errors="surrogatepass"), min_chars):
                    of.append(i)
                    at.append(pos)
                    digests.append(hashlib.blake2b(k, digest_size=16).digest())
            rows = batch.select(["doc", "row"]).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at, pa.int32()), pa.array(digests, pa.binary())], names=["doc", "row", "pos", "h"])

    parted = _parted(docs, key, text)
    return shared.mapped(parted, run, shared.with_results(parted, "pos int, h binary"))


def repeated(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """h, first (the least document that has it), documents and n (lines) of the hashes that at least
    ``min_documents`` distinct documents have. A null key is one document, after all others.

    Spark counts the pairs of hash and document first, spread over both, so that a line which
    all documents have is a row a task where it meets.
    """
    documents = F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("int"))
    counts = lines.groupBy("h").agg(documents.alias("documents"), F.min("doc").alias("first"), F.count("*").alias("n"))
    return counts.filter(F.col("documents") >= min_documents)


def _reassembled(docs: DataFrame, key: str, text: str, min_chars: int, min_documents: int, sent_bytes: int) -> DataFrame:
    """k (the columns of ``docs`` but for the text), t (what stays), n_lines and n_dropped of every row."""
    lines = shared.written(hashed_lines(docs, key, text, min_chars), "lines")
    often = shared.written(repeated(lines, min_documents).select("h", "first", "n"), "repeated")
    gone = shared.joined_evenly(lines, often, "h", limit=sent_bytes).filter(~F.col("doc").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("doc").alias("of"), F.col("row").alias("of_row")).agg(F.collect_set("pos").alias("gone"))
    keep = F.struct(*[F.col(shared.quoted(c)) for c in docs.columns if c != text]).alias("k")
    t = F.coalesce(F.col(shared.quoted(text)), F.lit(""))
    rows = docs.select(keep, F.col(shared.quoted(key)).alias("doc"), F.xxhash64(t).alias("row"), t.alias("t"))
    rows = rows.join(gone, rows["doc"].eqNullSafe(gone["of"]) & (rows["row"] == gone["of_row"]), "left")
    # Places that stay are a difference of sets, so that a text of many lines takes no longer for each.
    stay = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    kept = let(F.split("t", "\n"), lambda parts: F.array_join(F.transform(stay(parts), lambda i: F.get(parts, i)), "\n"))
    n = (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return rows.select("k", F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept).alias("t"), n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, counts: tuple[str, str] | None = None, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``docs`` without the lines that at least ``min_documents`` documents have, but in the least of them.

    Lines are compared without blanks at both ends and with A-Z in lower case; keys of fewer than
    ``min_chars`` code points stay everywhere, and the first document keeps all its lines of a key. A
    document is a key, whatever rows it has: rows that repeat one count once and lose the same lines.
    Rows of a null key are one document, after all others. Null texts become empty; an empty text is
    one empty line, and so are what documents keep of nothing. Tables without rows give none. Other
    columns stay as they are, whatever their names; ``counts`` names two more, for the lines that
    a text had and those that it lost.
    """
    found = _reassembled(docs, key, text, min_chars, min_documents, sent_bytes)
    columns = [F.col("t").alias(c) if c == text else F.col("k").getField(c).alias(c) for c in docs.columns]
    return found.select(*columns, *(F.col(c).alias(name) for c, name in zip(("n_lines", "n_dropped"), counts or (), strict=False)))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and digest of the text that stays, of every document; see :func:`deduplicated`."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deduplicated(docs, counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast(T.BinaryType()), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {MIN_CHARS}
          GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= {MIN_DOCUMENTS}),
marked AS (SELECT keyed.*, often.key IS NOT NULL AND doc_id IS DISTINCT FROM first AS gone FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
