"""Queries on events: votes, streaks, breakers, retries, windows, latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import crawl, facets, merge
from tidemark.sources.tables import table
from tidemark.streaming import crawl_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_K = "CAST(props->>'$.k' AS BIGINT)"


def _key():
    return F.get_json_object("props", "$.k").cast("long")


@query(f"""WITH l AS (SELECT {_K} AS target, user_id, event_type FROM events WHERE event_type IN ('click', 'error')
  QUALIFY row_number() OVER (PARTITION BY {_K}, user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT target, count(*) FILTER (event_type = 'click') AS n_useful, count(*) FILTER (event_type = 'error') AS n_dead FROM l GROUP BY ALL""")
def feedback_votes(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "error"))
    v = e.select(_key().alias("target"), "user_id", "ts", "event_id", F.when(F.col("event_type") == "click", "useful").otherwise("dead").alias("verdict"))
    return facets.votes(merge.latest(v, ["target", "user_id"], -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")))


_STREAKS = """WITH m AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
s AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS streak FROM m)
"""


@query(_STREAKS + "SELECT event_id, user_id, streak, streak >= 2 AS alert FROM s")
def failure_streak(spark, sf):
    found = crawl.failure_streaks(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", alert_at=2)
    return found.select("event_id", "user_id", "streak", "alert")


@query(_STREAKS + "SELECT event_id, coalesce(max(CASE WHEN streak >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skipped FROM s")
def breaker_fold(spark, sf):
    return crawl.breaker(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", trips_at=2).select("event_id", "skipped")


@query("""WITH c AS (SELECT event_id, CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 WHEN 'view' THEN 404 ELSE 200 END AS status FROM events)
SELECT event_id, CAST(a AS INTEGER) AS attempt, CASE WHEN a = 1 THEN 0 ELSE CAST(1000 * 2 ** (a - 2) AS BIGINT) END AS wait_ms FROM c, range(1, 5) t(a) WHERE a = 1 OR status = 429 OR status >= 500""")
def retry_plan(spark, sf):
    t = F.col("event_type")
    e = table(spark, sf, "events").select("event_id", F.when(t == "error", 503).when(t == "signup", 429).when(t == "view", 404).otherwise(200).alias("status"))
    return crawl.retry_plan(e, F.col("status")).select("event_id", "attempt", "wait_ms")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def daily_microbatch(spark, sf):
    return crawl_stream.windowed_counts(table(spark, sf, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("""SELECT strftime(h, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS h FROM events) GROUP BY ALL""")
def sliding_new_24h(spark, sf):
    return crawl_stream.windowed_counts(table(spark, sf, "events"), size="24 hours", slide="1 hour").select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def sessions(spark, sf):
    return crawl_stream.sessions(table(spark, sf, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, round(avg(value), 4) AS mean, max(CASE WHEN k = n // 2 THEN value END) AS median, min(value) AS least, max(value) AS greatest FROM r GROUP BY ALL""")
def latency_percentiles(spark, sf):
    return facets.latency(table(spark, sf, "events"), ["event_type"], "value")


@query(f"SELECT event_id, {_K} AS k, {_K} % 10 IN (3, 7) AS tagged FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", _key().alias("k"), (_key() % 10).isin(3, 7).alias("tagged"))


@query("""SELECT user_id, count(*) AS n_sources, count(*) FILTER (event_type <> 'error') AS n_ok,
CASE WHEN count(*) FILTER (event_type <> 'error') = count(*) THEN 'ok' WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'partial' ELSE 'failed' END AS status FROM events GROUP BY ALL""")
def run_summary(spark, sf):
    return facets.run_summary(table(spark, sf, "events").select("user_id", (F.col("event_type") != "error").alias("ok")), "user_id")
