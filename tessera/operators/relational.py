"""Filters, paging, top-k, counts and key joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows that equal every given value; a value of None doesn't filter."""
    conditions = [F.col(c) == v for c, v in values.items() if v is not None]
    return df.filter(reduce(Column.__and__, conditions)) if conditions else df


def contains_any_case(columns: list[str], query: str) -> Column:
    """Whether one of the columns has the query; ``%`` and ``_`` in it are wild."""
    return reduce(Column.__or__, [F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)) for c in columns])


def query_terms(question: str) -> list[str]:
    return [w for w in question.replace("?", "").split() if len(w) > 1]


def keyword_match(columns: list[str], question: str) -> Column:
    """Whether one of the question's words of two or more characters is in one of the columns."""
    terms = query_terms(question)
    return reduce(Column.__or__, [contains_any_case(columns, t) for t in terms]) if terms else F.lit(False)


def page(df: DataFrame, sort_by: str, descending: bool = True, number: int = 1, size: int = 20, key: str = "id", allowed: tuple[str, ...] | None = None) -> DataFrame:
    """One page of the rows in a total order: the sort column, nulls last, then the key."""
    if allowed and sort_by not in allowed:
        raise ValueError(f"sort_by is one of {allowed}")
    order = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
    return df.orderBy(order, F.asc(key)).offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int = 20) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / size)).cast("long").alias("total_pages"))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows: Spark keeps n a task and merges them."""
    return df.orderBy(*order).limit(n)


def count_by(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and for each column how many are null or empty and their share in per cent."""
    n = F.count("*")
    out = [n.alias("n_rows")]
    for c in columns:
        empty = F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == ""))
        out += [empty.alias(f"{c}_missing"), F.round(empty * 100.0 / F.greatest(n, F.lit(1)), 4).alias(f"{c}_missing_pct")]
    return df.agg(*out)


def absent(df: DataFrame, other: DataFrame, on: str, other_on: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key ``other`` doesn't have (null keys stay): an anti join."""
    keys = other.select(F.col(other_on or on).alias("__on"))
    return df.join(keys, F.col(on) == F.col("__on"), "left_anti")


def present(df: DataFrame, other: DataFrame, on: str, other_on: str | None = None) -> DataFrame:
    keys = other.select(F.col(other_on or on).alias("__on"))
    return df.join(keys, F.col(on) == F.col("__on"), "left_semi")


def run_summary(df: DataFrame, status: str, error: str, key: str, done: str = "success", failed: str = "failed", most: int = 20) -> DataFrame:
    """Counts of outcomes, status of the run, and its first errors by key.

    The errors are cut to ``most`` in each task before they meet.
    """
    counts = df.agg(F.count("*").alias("source_count"), F.count_if(F.col(status) == done).alias("processed_count"), F.count_if(F.col(status) == failed).alias("failed_count"), F.count_if(~F.col(status).isin(done, failed)).alias("skipped_count"))
    first = df.filter(F.col(status) == failed).orderBy(key).limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(error).cast("string").alias("e")))), lambda x: x["e"]), "; ").alias("first_errors"))
    return counts.join(F.broadcast(first)).withColumn("status", F.when(F.col("failed_count") == 0, "success").otherwise("partial"))
