"""Windowed telemetry on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue.registry import query
from tessera.operators import telemetry
from tessera.operators.telemetry import BUCKETS


def _events(t):
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


def _naive(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


_W = "time_bucket(INTERVAL '{}', ts, TIMESTAMP '1970-01-01')"


@query(f"SELECT {_W.format('5 minutes')} AS window_start, event_type, count(*) AS n, round(count(*) / 300, 6) AS rate FROM events GROUP BY 1, 2")
def event_rate_5m(t):
    return _naive(telemetry.rate(_events(t), "ts", "event_type"), "window_start")


@query(f"""SELECT {_W.format('5 minutes')} AS window_start, count(*) AS n, CAST(count_if(event_type = 'error') AS BIGINT) AS bad, round(count_if(event_type = 'error') / (count(*) + 1), 6) AS ratio FROM events GROUP BY 1""")
def error_ratio(t):
    return _naive(telemetry.ratio(_events(t), "ts", F.col("event_type") == "error", smooth=1), "window_start")


@query(f"""SELECT {_W.format('1 hour')} AS window_start, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def latency_quantiles(t):
    return _naive(telemetry.quantiles(_events(t), "ts", "value"), "window_start")


def _histogram_sql() -> str:
    counts = ", ".join(f"count_if(value <= {b}) AS b{i}" for i, b in enumerate(BUCKETS))
    cases = []
    for i, b in enumerate(BUCKETS):
        low, below = (BUCKETS[i - 1], f"b{i - 1}") if i else (0.0, "0")
        cases.append(f"WHEN b{i} >= n * 0.95 THEN CASE WHEN b{i} - {below} > 0 THEN {low}::DOUBLE + ({b}::DOUBLE - {low}::DOUBLE) * (n * 0.95::DOUBLE - {below}) / (b{i} - {below}) ELSE {b} END")
    return f"SELECT event_type, n, round(CASE {' '.join(cases)} ELSE {BUCKETS[-1]}::DOUBLE END, 6) AS quantile FROM (SELECT event_type, count(value) AS n, {counts} FROM events GROUP BY event_type)"


@query(_histogram_sql())
def histogram_quantile_p95(t):
    return telemetry.histogram_quantile(_events(t), "value", 0.95, "event_type")


@query(f"SELECT {_W.format('24 hours')} AS window_start, event_type, count(*) AS increase FROM events GROUP BY 1, 2")
def increase_24h(t):
    return _naive(telemetry.increase(_events(t), "ts", "event_type"), "window_start")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def topk_users_errors(t):
    return telemetry.top_by(t("events").filter("event_type = 'error'"), "user_id")


@query(f"""SELECT {_W.format('6 hours')} AS window_start, round(regr_slope(value, epoch_us(ts) / 1e6 - epoch_us({_W.format('6 hours')}) / 1e6), 8) AS slope FROM events GROUP BY 1""")
def predict_linear_6h(t):
    out = telemetry.predict_linear(_events(t), "ts", "value", 86400)
    return _naive(out, "window_start").select("window_start", "slope")


@query(f"""WITH r AS (SELECT {_W.format('6 hours')} AS s, epoch_us(ts) / 1e6 - epoch_us({_W.format('6 hours')}) / 1e6 AS t, value FROM events)
SELECT s AS window_start, round(regr_intercept(value, t) + regr_slope(value, t) * (21600 + 86400), 4) AS predicted FROM r GROUP BY 1""")
def predict_linear_ahead(t):
    """Where the line of each six hours is a day after their end."""
    return _naive(telemetry.predict_linear(_events(t), "ts", "value", 86400), "window_start").select("window_start", "predicted")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY event_type")
def aggregate_by_type(t):
    return telemetry.aggregate_by(t("events"), "value", "event_type")


@query("""SELECT user_id, date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-01 00:00:00') AS age_s, date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-01 00:00:00') > 86400 AS stale FROM events GROUP BY user_id""")
def staleness_by_user(t):
    return telemetry.staleness(t("events"), "ts", "2024-02-01 00:00:00", 86400, "user_id")


@query(f"""WITH w AS (SELECT {_W.format('1 hour')} AS s, count_if(event_type = 'error') / (count(*) + 1) AS r FROM events GROUP BY 1),
h AS (SELECT s, epoch(s) - row_number() OVER (ORDER BY s) * 3600 AS i FROM w WHERE r > 0.1)
SELECT min(s) AS since, count(*) AS n_windows FROM h GROUP BY i HAVING count(*) * 3600 >= 7200""")
def sustained_alert(t):
    windows = telemetry.ratio(_events(t), "ts", F.col("event_type") == "error", size="1 hour", smooth=1)
    exact = F.col("bad") / (F.col("n") + 1) > 0.1
    return _naive(telemetry.sustained(windows, "window_start", exact, 3600, 7200), "since")


@query("""WITH l AS (SELECT max(date_trunc('hour', ts)) AS h FROM events) SELECT event_type, round(sum(value) * 730, 4) AS projected, round(sum(value) * 730 / 1000.0 * 100, 4) AS budget_pct FROM events, l WHERE date_trunc('hour', ts) = h GROUP BY event_type""")
def monthly_projection(t):
    return telemetry.monthly_projection(t("events"), "ts", "value", 1000.0, "event_type")
