"""Token counts of fields and sections by offset-mapped attribution (operator 1).

A document is encoded once as a whole. Its tokens' character spans and the spans of its sections
are both sorted, so their interval join is a merge by binary search. A token that crosses a
boundary is allocated by an explicit rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bpe, shared

#: To whom a token goes that crosses a boundary: the section of its first character, the one that has
#: most of its characters (of equals the first), or each by its share of the characters.
RULES = ("first", "most", "share")


def token_spans(enc: bpe.Encoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens of all texts, first and end character of each (in its text), and tokens of
    each text. A token that holds a part of a character covers the whole character."""
    ids, counts = enc.encode(texts)  # a control string's id stands for its own characters
    return ids, *_characters(enc, texts, ids, counts), counts


def _characters(enc: bpe.Encoder, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blob = "".join(texts).encode("utf-8", "surrogatepass")
    lead = (np.frombuffer(blob, np.uint8) & 0xC0) != 0x80
    character = np.cumsum(lead) - 1  # of each byte
    ends = np.cumsum(enc.merges.lengths[ids])
    starts = ends - enc.merges.lengths[ids]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.repeat(np.cumsum(sizes) - sizes, counts)
    return character[starts] - base, character[ends - 1] + 1 - base


def allocated(first: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, as floats, of one text: tokens [first, end), sections between
    consecutive ``bounds`` (sorted, from 0 to the length of the text; a section may be empty)."""
    n = len(bounds) - 1
    # The section of a character is the last that begins at or before it.
    a = np.searchsorted(bounds[:-1], first, "right") - 1
    b = np.searchsorted(bounds[:-1], end - 1, "right") - 1
    inner = a == b
    total = np.bincount(a[inner], minlength=n).astype(np.float64)
    for f, e, s, t in zip(first[~inner].tolist(), end[~inner].tolist(), a[~inner].tolist(), b[~inner].tolist(), strict=True):
        if rule == "first":
            total[s] += 1
            continue
        share = np.minimum(bounds[s + 1 : t + 2], e) - np.maximum(bounds[s : t + 1], f)
        if rule == "most":
            total[s + int(share.argmax())] += 1
        else:
            total[s : t + 1] += share / (e - f)
    return total


def line_bounds(text: str) -> list[int]:
    """Sections by line: each ends behind its line break. An empty text is one empty section."""
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    if out[-1] != len(text) or len(out) == 1:
        out.append(len(text))
    return out


def section_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", rule: str = "most", sections=line_bounds) -> DataFrame:
    """Key, n_tokens, and the arrays section_starts and section_tokens of every row of ``docs``.

    The text is encoded whole; ``sections`` gives the bounds. The tokens of a text's sections add up
    to its tokens under every rule. A null text counts as empty: no tokens, one empty section.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    rows = shared.carried(docs, [key], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        for batch, texts in shared.bounded(batches, "t"):
            _, first, end, counts = token_spans(enc, texts)
            stop = np.cumsum(counts)
            starts, found = [], []
            for t, a, b in zip(texts, (stop - counts).tolist(), stop.tolist(), strict=True):
                bounds = np.array(sections(t))
                starts.append(bounds[:-1])
                found.append(allocated(first[a:b], end[a:b], bounds, rule))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.float64()))], names=["k", "n_tokens", "section_starts", "section_tokens"])

    found = shared.mapped(rows, run, shared.with_results(rows, "n_tokens long, section_starts array<long>, section_tokens array<double>"))
    return found.select("k.*", "n_tokens", "section_starts", "section_tokens")


def field_tokens(rows: DataFrame, fields: list[str], path: str, key: str = "doc_id", rule: str = "most", between: str = "\n") -> DataFrame:
    """Tokens of each of ``fields`` where they are encoded together, joined by ``between`` (which
    belongs to the field before): key, n_tokens and a column tokens_<field> for each."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    whole = F.concat(*[x for i, p in enumerate(parts) for x in ([p] if i == len(parts) - 1 else [p, F.lit(between)])])
    # The bounds travel before the text: field sizes, a space, then the fields.
    sizes = [F.length(p) + (len(between) if i < len(parts) - 1 else 0) for i, p in enumerate(parts)]
    table = rows.select(F.struct(F.col(key).alias(key)).alias("k"), F.array(*sizes).alias("sizes"), whole.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        for batch, texts in shared.bounded(batches, "t"):
            _, first, end, counts = token_spans(enc, texts)
            stop = np.cumsum(counts)
            found = []
            for own, a, b in zip(batch.column(1).to_pylist(), (stop - counts).tolist(), stop.tolist(), strict=True):
                found.append(allocated(first[a:b], end[a:b], np.concatenate([[0], np.cumsum(own)]), rule))
            columns = np.array(found).reshape(len(texts), len(fields)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *(pa.array(c) for c in columns)], names=["k", "n_tokens", *(f"tokens_{f}" for f in fields)])

    found = shared.mapped(table, run, T.StructType([table.schema["k"], T.StructField("n_tokens", T.LongType()), *(T.StructField(f"tokens_{f}", T.DoubleType()) for f in fields)]))
    return found.select("k.*", *(f"`{c}`" for c in found.columns[1:]))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, summed up for each: lines, the tokens of the first
    and the fullest line, and the array of all."""
    docs = shared.table(spark, sf_dir, "documents")
    found = section_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    counts = F.transform("section_tokens", lambda x: x.cast("int"))
    return found.select("doc_id", "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"), F.array_max(counts).cast("long").alias("most_tokens"), counts.alias("section_tokens"))
