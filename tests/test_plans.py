"""What the plans of the catalogue's queries must not have, and what they must: no products, little Python, pruned and filtered scans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.test_queries import QUERIES
from tidemark.operators import details, link, listing, views
from tidemark.plans import catalogue

#: Joins without a key: one side is a row (where a round stopped) or an array of all aliases.
KEYLESS = {"verification_outcomes", "verified_offers", "verification_tally", "alias_longest_match"}
#: Queries that walk pages, or need a compatibility form, in Python.
PYTHON = {"html_blocks", "candidates_topk", "extracted_offers", "planted_blocks", "planted_offers", "daily_items"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_products_and_no_python_where_expressions_do(spark, name):
    p = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in p
    assert ("NestedLoopJoin" in p) <= (name in KEYLESS)
    assert bool(re.search("Python|Pandas|Arrow", p)) <= (name in PYTHON)


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").withColumnsRenamed({"o_orderkey": "id", "o_orderpriority": "category"}).withColumn("review_status", F.lit("approved"))
    p = plan(listing.ListQuery(category=["1-URGENT"]).where(orders).select("id"))
    assert "PushedFilters: [In(o_orderpriority" in p or "EqualTo(o_orderpriority" in p
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>", p)


def test_one_key_of_a_detail_reaches_the_scan(spark):
    """A detail page is a filter on the details of all things: each table is read for that key only."""
    p = plan(details.offers_of(catalogue.offers(spark, SMALL).withColumn("model_id", F.col("provider_id")), "model_id").where("model_id = 7"))
    assert "EqualTo(o_custkey,7)" in p and "EqualTo(c_custkey,7)" in p


def test_first_pages_are_bounded_takes(spark):
    p = plan(listing.ListQuery(sort="newest").rows(catalogue.offers(spark, SMALL)))
    assert "TakeOrderedAndProject" in p
    p = plan(views.EndpointQuery(sort="score").rows(spark.read.parquet(f"{SMALL}/supplier.parquet").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("provider_name"), F.lit(True).alias("enabled"), F.col("s_acctbal").alias("score"))).limit(40))
    assert "TakeOrderedAndProject" in p


def test_related_takes_few_rows_of_a_group_before_the_shuffle(spark):
    """A window that keeps the first rows of each group is cut before its shuffle, so that a hot group stays small."""
    history = spark.read.parquet(f"{SMALL}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").alias("offer_id"), F.lit("f").alias("field"), F.lit("a").alias("old_value"), F.lit("b").alias("new_value"), F.lit("crawl").alias("changed_by"), F.col("ts").alias("changed_at"))
    p = plan(details.offer_details(catalogue.offers(spark, SMALL), history))
    assert p.count("WindowGroupLimit") >= 4  # before and after the shuffle, of changes and of related offers


def test_texts_meet_a_version_once_however_many_have_it(spark):
    """Entities are one row a version before they meet texts: no (text, entity) rows are made."""
    texts = spark.range(3).withColumn("text", F.concat(F.lit("v1."), F.col("id")))
    entities = spark.range(40).select(F.col("id").alias("entity_id"), F.when(F.col("id") < 39, "Model 1.0").otherwise("Model 1.1").alias("name"))
    links = link.unique_version(texts, entities)
    assert re.search(r"HashAggregate\(keys=\[version", plan(links))
    assert [tuple(r) for r in links.collect()] == [(1, 39)]


def patterns(df) -> int:
    """How many patterns the optimized plan tries."""
    return len(re.findall("regexp_|RLIKE", df._jdf.queryExecution().optimizedPlan().toString()))


def test_search_results_work_out_a_link_once_and_on_all_cores(spark):
    """A link's host and normal form are bound, not written out wherever they are named; pages of a small file are dealt anew."""
    df = QUERIES["search_results"](spark, SMALL)
    assert patterns(df) < 100
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["planted_offers", "daily_items"])
def test_extraction_works_out_each_text_once(spark, name):
    """Dates, hosts and titles are bound; a filter on a title does not go below and work it out again."""
    df = QUERIES[name](spark, SMALL)
    assert name == "daily_items" or patterns(df) < 900  # the daily run's plan names its items four times, and reuses their exchange
    assert not re.search(r"Filter [^\n]*可转让", df._jdf.queryExecution().optimizedPlan().toString())


def test_offers_without_a_model_are_dealt_over_all_tasks(spark):
    """In a left join by a key that most rows lack, those rows must not all come to the task of null."""
    none = F.lit(None).cast("long")
    o = spark.range(4000).select("id", (F.col("id") % 7).alias("provider_id"), F.when(F.col("id") < 5, F.col("id")).alias("model_id"), none.alias("endpoint_id"))
    known = spark.range(9).select("id", F.lit("n").alias("name"))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        v = listing.catalogue_view(o, known, known, known).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in v.groupBy("task").count().collect()]
        named = {r.id for r in v.where("model_name = 'n'").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4000 and max(sizes) < 2000 and named == set(range(5))
