"""Keyed tables, counters with resets, quantile sketches, and alerts on streams."""

import glob
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import counters, telemetry
from tessera.sources.keyed import KeyedTable
from tessera.streaming import alerts

# ---- keyed tables ------------------------------------------------------------------------------

SCHEMA = T.StructType().add("id", "string").add("lang", "string").add("source", "string").add("x", T.IntegerType())


def files(folder):
    return {f for f in glob.glob(f"{folder}/__b=*/*.parquet")}


def state(table):
    return sorted(map(tuple, table.rows().collect()), key=str)


def test_inserts_touch_their_buckets(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["id"], buckets=16)
    assert table.rows().count() == 0
    first = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").cast("int").alias("x"))
    assert table.insert_if_absent(first, "x") == 500
    before, rows = files(table.folder), state(table)
    assert table.insert_if_absent(first, "x") == 0  # twice changes nothing
    assert (files(table.folder), state(table)) == (before, rows)
    batch = spark.createDataFrame([("1", "de", "t", 7), ("new", "de", "t", 9), ("new", "de", "t", 8)], SCHEMA)
    assert table.insert_if_absent(batch, "x") == 1
    assert before < files(table.folder)
    assert len(files(table.folder) - before) == 1
    assert table.rows().filter("id = 'new'").first().x == 8
    assert table.rows().filter("id = '1'").first().lang == "en"
    assert table.lookup(batch.select("id")).count() == 2
    plan = table.near(table._marked(batch))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    assert "__h" in plan.split("PushedFilters")[1]


def test_upserts_rewrite_their_buckets(spark, tmp_path):
    r = random.Random(4)
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["id"], buckets=8)
    want = {}
    for turn in range(3):
        rows = [(str(r.randint(0, 40)), r.choice(["en", "de", None]), r.choice(["a", "b"]), i) for i in range(4 + 20 * turn)]
        before = files(table.folder)
        table.upsert(spark.createDataFrame(rows, SCHEMA), "x", ["lang"])
        first = {}
        for row in rows:
            first.setdefault(row[0], row)  # x ascends
        for k, row in first.items():
            old = want.get(k)
            want[k] = row if old is None else (k, row[1] if row[1] is not None else old[1], old[2], old[3])
        assert state(table) == sorted(want.values(), key=str)
        touched = {f"__b={b[0]}/" for b in table._marked(spark.createDataFrame(rows, SCHEMA)).select("__b").distinct().collect()}
        assert all(f in files(table.folder) for f in before if not any(t in f for t in touched))
        again = state(table)
        table.upsert(spark.createDataFrame(rows, SCHEMA), "x", ["lang"])
        assert state(table) == again
    table.upsert(spark.createDataFrame([], SCHEMA), "x")
    table.upsert(spark.createDataFrame([(None, "en", "z", 1), ("", "en", "z", 1)], SCHEMA), "x")
    assert table.rows().filter("source = 'z'").count() == 2


def test_status_of_one_key(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, processing_status string, error_message string, processed_at timestamp")
    table = KeyedTable(spark, f"{tmp_path}/t", schema, ["id"], buckets=8)
    table.insert_if_absent(spark.range(100).select("id", F.lit("pending").alias("processing_status"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("timestamp").alias("processed_at")), "id")
    before = files(table.folder)
    assert table.set_status(5, "failed", "bad", "2024-01-01 00:00:00") == 1
    assert len(before - files(table.folder)) == 1
    assert table.set_status(500, "failed", "bad", "2024-01-01 00:00:00") == 0
    assert {(r.processing_status, r.error_message): r["count"] for r in table.rows().groupBy("processing_status", "error_message").count().collect()} == {("pending", None): 99, ("failed", "bad"): 1}
    for k in range(3):
        table.insert_if_absent(spark.range(1000 + 100 * k, 1100 + 100 * k).select("id", F.lit("x").alias("processing_status"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("timestamp").alias("processed_at")), "id")
    rows = state(table)
    assert table.compact(most=3) == list(range(8))
    assert state(table) == rows
    assert table.compact(most=3) == []


# ---- counters ----------------------------------------------------------------------------------


def grown(samples, start, end):
    """The increase of one series in one window, sample by sample."""
    own = [(t, v) for t, v in sorted(samples) if start <= t < end]
    if len(own) < 2:
        return None
    total = sum(v if v < u else v - u for (_, u), (_, v) in zip(own, own[1:], strict=False))
    sampled = own[-1][0] - own[0][0]
    gap = sampled / (len(own) - 1)
    early, late = (d if d < gap * 1.1 else gap / 2 for d in (own[0][0] - start, end - own[-1][0]))
    if total > 0 and own[0][1] >= 0:
        early = min(early, sampled * own[0][1] / total)
    return total * (sampled + early + late) / sampled


@pytest.mark.parametrize("size, span", [("5 minutes", 300), ("1 hour", 3600), ("6 hours", 21600)])
def test_increase_by_loop(spark, size, span):
    r = random.Random(span)
    base, rows = 1_700_000_000 // 21600 * 21600, []
    for s in range(6):
        t, v = base + r.randint(0, 50), float(r.randint(0, 5))
        while t < base + 43200:
            rows.append((f"s{s}", t, v))
            v = float(r.randint(0, 3)) if r.random() < 0.03 else v + r.choice([0, 0, 1, 7])  # resets
            t += r.choice([15, 15, 15, 30, 400, 5000]) if s else 4000  # gaps, and a series of single points
    df = spark.createDataFrame(rows, "s string, t long, v double").select("s", F.timestamp_seconds("t").alias("at"), "v")
    df = df.unionByName(df.limit(20)).unionByName(df.limit(1).withColumn("v", F.lit(float("nan"))))  # repeated and missing
    got = {(x.s, x.start): (round(x.increase, 4), x.rate) for x in counters.increase(df, "at", "v", "s", size=size, slice_s=600).withColumn("start", F.unix_timestamp("window_start")).collect()}
    want = {}
    for s in {x[0] for x in rows}:
        own = [(t, v) for k, t, v in rows if k == s]
        for start in range(base, base + 43200, span):
            if (x := grown(own, start, start + span)) is not None:
                want[s, start] = x
    assert set(got) == set(want)
    assert all(got[k][0] == pytest.approx(x, abs=1e-3) and got[k][1] == pytest.approx(x / span, abs=1e-6) for k, x in want.items())
    assert len(want) > 10


def test_quantiles_from_stored_hours(spark, tmp_path):
    df = spark.range(60_000).select(F.timestamp_seconds(F.lit(1_700_006_400) + F.col("id") * 5).alias("at"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 7.0).alias("v"), (F.col("id") % 3).alias("k"))
    counters.sketched(df, "at", "v", "k").write.parquet(f"{tmp_path}/hours")
    days = counters.quantiles(counters.merged(spark.read.parquet(f"{tmp_path}/hours"), "k"), 0.5, 0.95, 0.99)
    exact = df.groupBy(F.window("at", "24 hours")["start"].alias("window_start"), "k").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("v")).alias("all"))
    rows = days.join(exact.withColumnRenamed("n", "m"), ["window_start", "k"]).collect()
    assert len(rows) == days.count() == 12
    for x in rows:
        assert x.n == x.m == len(x["all"])
        for q, p in ((0.5, x.p50), (0.95, x.p95), (0.99, x.p99)):
            rank = sum(v <= p for v in x["all"]) / x.n
            assert abs(rank - q) <= counters.RANK_ERROR


# ---- alerts ------------------------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    """Events in shuffled files, with a restart in the middle, against the batch operator."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.ROCKSDB)
    r = random.Random(12)
    base, rows = 1_700_000_000 // 3600 * 3600, []
    for g in ("a", "b"):
        bad = False
        for w in range(60):
            bad = (not bad) if r.random() < 0.3 else bad
            if r.random() < 0.1:
                continue  # a window without events
            rows += [(g, base + w * 300 + r.randint(0, 299), (r.random() < 0.9) if bad else (r.random() < 0.1)) for _ in range(6)]
    rows.sort(key=lambda x: x[1])
    source, schema = tmp_path / "in", "g string, t long, bad boolean"

    def put(name, part):
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{source}/{name}")

    def run():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(source)).withColumn("at", F.timestamp_seconds("t"))
        windows = alerts.closed_windows(events, "at", F.col("bad"), "g", late="10 minutes")
        found = alerts.sustained(windows, F.col("bad") / F.col("n") > 0.5, "g", hold="15 minutes")
        q = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    cut = [0, 150, 300, 420, len(rows)]
    for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        put(f"{k}", rows[a:b])
        if k == 1:
            run()  # the state so far is in the checkpoint
    put("9", [(g, base + 400 * 300, False) for g in ("a", "b")])
    run()
    put("99", [(g, base + 800 * 300, False) for g in ("a", "b")])
    run()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("t"))
    windows = telemetry.ratio(df, "at", F.col("bad"), "g")
    want = {(x.g, x.since, x.n_windows) for x in telemetry.sustained(windows, "window_start", F.col("bad") / F.col("n") > 0.5, 300, 900, "g").collect()}
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(x.g, x.since, x.n_windows) for x in out if x.change == "resolved"} == want
    assert {(x.g, x.since) for x in out if x.change == "firing"} == {w[:2] for w in want}
    assert len(out) == 2 * len(want) > 4
