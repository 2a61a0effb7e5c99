"""The stages of the corpus pipeline, each a thin call of one operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, quality, rules, shared, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that are above the limits of their host;
    ``n_chars`` follows the text. Null and empty texts go; repeated rows stay or go together; no rows
    give none; other columns stay as they are."""
    return rules.accepted(docs, length="n_chars" if "n_chars" in docs.columns else None)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of one half or more. Null texts are scored as empty; repeated rows stay or go
    together; without labels of both classes all have the smoothed share of the class there is; all
    columns stay as they are."""
    return quality.kept(docs, shared.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the least doc_id, and of repeated rows one. Null and empty texts are
    one group; of null keys one row for each fingerprint stays, unless a key is in its group; all
    columns stay as they are."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by ``benchmark``. Null and empty texts stay; repeated rows stay or
    go together; all columns stay as they are."""
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of every document, a row for each row; a null text
    counts as empty, a null key stays null; other columns go."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
