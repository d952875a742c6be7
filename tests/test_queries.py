"""Every query with SQL gives the rows that DuckDB gives; streams agree with batches."""

from __future__ import annotations

import math
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.plans import cases, catalogue, details, events, texts, views
from tidemark.sources.tables import table
from tidemark.streaming import crawl_stream

SQL = catalogue.SQL | events.SQL | texts.SQL | views.SQL | cases.SQL | details.SQL
QUERIES = catalogue.QUERIES | events.QUERIES | texts.QUERIES | views.QUERIES | cases.QUERIES | details.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(plain(r[k]) for k in order) for r in records), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = rows(df.columns, df.collect())
    if name in SQL:
        want = duck.execute(SQL[name])
        assert got == rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", ["guide_benefits", "quota_texts"])
def test_queries_of_large_keys(spark, name):
    """Keys that only larger tables have, about where counts go over to their next unit."""
    folder = tempfile.mkdtemp(prefix="spark-")
    k = F.col("id")
    spark.range(840).select(k.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (k + 9_700).alias("l_partkey"), (k + 700).alias("l_suppkey")).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    df, want = QUERIES[name](spark, folder), con.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_streaks_in_a_stream_are_those_of_the_batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    e = table(spark, SMALL, "events").select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") == "error").alias("failed"))
    e.write.parquet(f"{folder}/in")
    stream = crawl_stream.streaming_streaks(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), alert_at=2)
    crawl_stream.run_available(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    got = {(r.event_id, r.streak, r.alert) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {(r.event_id, r.streak, r.alert) for r in QUERIES["failure_streak"](spark, SMALL).collect()}
