"""Stored tables, indexes and counters on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import scratch
from tessera.catalogue.registry import ORACLES, query
from tessera.operators import counters
from tessera.operators.pages import PageTable
from tessera.operators.substring_index import SubstringIndex
from tessera.operators.vector_index import new_folder
from tessera.sources.keyed import KeyedTable


def _table(df, keys, name):
    spark = df.sparkSession
    return KeyedTable(spark, new_folder(spark, name), df.schema, keys, buckets=16)


@query(ORACLES["insert_if_absent"])
def stored_insert_if_absent(t):
    """Two batches into a stored table, the second one twice."""
    rows = t("documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    table = _table(rows, ["checksum"], "checksums")
    # What is there first may have equal checksums: it was written without a check.
    table._write(table._marked(rows.filter("doc_id % 2 = 0")), "append")
    for _ in range(2):
        table.insert_if_absent(rows.filter("doc_id % 2 = 1"), "doc_id")
    return table.rows()


@query(ORACLES["record_upsert_some_columns"])
def stored_upsert_some_columns(t):
    d = t("documents").select("doc_id", "lang", "source")
    table = _table(d, ["doc_id"], "records")
    table.upsert(d.filter("doc_id % 2 = 0"), "doc_id")
    new = d.filter("doc_id % 3 = 0").select("doc_id", F.concat("lang", F.lit("!")).alias("lang"), F.concat("source", F.lit("!")).alias("source"))
    for _ in range(2):
        table.upsert(new, "doc_id", ["lang"])
    return table.rows()


@query(ORACLES["status_update"])
def stored_status_update(t):
    rows = t("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("pending").alias("processing_status"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("timestamp").alias("processed_at"))
    table = _table(rows, ["id"], "statuses")
    table.insert_if_absent(rows, "processing_status")
    table.set_status("5", "failed", "bad", "2024-01-01 00:00:00")
    return table.rows().drop("processed_at")


@query("""WITH s AS (SELECT event_type, epoch_us(ts) / 1e6 AS t, max(value) AS v FROM events GROUP BY 1, 2),
w AS (SELECT *, CAST(floor(t / 3600) AS BIGINT) AS w FROM s),
g AS (SELECT *, lag(v) OVER (PARTITION BY event_type, w ORDER BY t) AS u FROM w),
i AS (SELECT event_type, w, count(*) AS samples, sum(CASE WHEN u IS NULL THEN 0 WHEN v < u THEN v ELSE v - u END) AS grown, arg_min(v, t) AS first_v, min(t) AS first_t, max(t) AS last_t FROM g GROUP BY 1, 2 HAVING count(*) >= 2),
d AS (SELECT *, last_t - first_t AS sampled, (last_t - first_t) / (samples - 1) AS gap, first_t - w * 3600 AS early, (w + 1) * 3600 - last_t AS late FROM i),
e AS (SELECT *, least(CASE WHEN early < gap * 1.1 THEN early ELSE gap / 2 END, CASE WHEN grown > 0 AND first_v >= 0 THEN sampled * first_v / grown END) AS a, CASE WHEN late < gap * 1.1 THEN late ELSE gap / 2 END AS b FROM d)
SELECT make_timestamp(w * 3600 * 1000000) AS window_start, event_type, samples, round(grown * (sampled + a + b) / sampled, 5) AS increase FROM e""")
def counter_increase_1h(t):
    """The values of events as samples of a counter for each type, which begins again often."""
    found = counters.increase(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "event_type", size="1 hour", slice_s=900)
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "samples", F.round("increase", 5).alias("increase"))


@query("""SELECT time_bucket(INTERVAL '24 hours', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, true AS p50_within, true AS p95_within FROM events GROUP BY 1, 2""")
def quantiles_of_days_from_hours(t):
    """Daily quantiles from stored sketches of hours, and whether their ranks are within the stated error."""
    events = t("events").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "value")
    space = scratch.Scratch(events.sparkSession, "sketches")
    hours = space.table(counters.sketched(events, "ts", "value", "event_type"), "hours")
    days = space.table(counters.quantiles(counters.merged(hours, "event_type"), 0.5, 0.95), "days")
    same = events.withColumn("window_start", F.window("ts", "24 hours")["start"]).join(days, ["window_start", "event_type"])
    below = lambda p: F.count_if(F.col("value") < F.col(p)) / F.count("*")
    upto = lambda p: F.count_if(F.col("value") <= F.col(p)) / F.count("*")
    within = lambda p, q: ((below(p) <= q + counters.RANK_ERROR) & (upto(p) >= q - counters.RANK_ERROR)).alias(f"{p}_within")
    out = same.groupBy("window_start", "event_type").agg(F.count("*").alias("n"), within("p50", 0.5), within("p95", 0.95))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT doc_id FROM documents WHERE text ILIKE '%worthless%' OR source ILIKE '%worthless%' OR text ILIKE '%idi_t%' OR source ILIKE '%idi_t%' OR text ILIKE '%c17%' OR source ILIKE '%c17%'""")
def substring_index_search(t):
    """Words in any case, one with a wild character and one that only sources have, from a new index."""
    docs = t("documents").select("doc_id", "text", "source")
    index = SubstringIndex(docs.sparkSession, new_folder(docs.sparkSession, "substrings"), docs.schema, ["text", "source"])
    index.insert(docs, "source")
    return index.search(["Worthless", "idi_t", "c17"]).select("doc_id")


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 1000")
def deep_page(t):
    """Page 51 of all orders by price, from a table of ranges."""
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    table = PageTable.build(rows, new_folder(rows.sparkSession, "pages"), "price", allowed=("price", "id"))
    return table.page(51, 20).withColumn("price", F.round("price", 2))
