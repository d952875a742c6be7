"""Expressions and operators on small rows with known results."""

from __future__ import annotations

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import blocks, crawl, dedupe, extract, link, listing, merge, publish, validate
from tidemark.sources import feeds


def value(spark, make, *args):
    return spark.createDataFrame([tuple(args)], ", ".join(f"c{k} string" for k in range(len(args)))).select(make(*(F.col(f"c{k}") for k in range(len(args)))).alias("v")).first().v


@pytest.mark.parametrize(("make", "given", "want"), [
    (T.fold_name, "GLM-5.3-Flash", "glm53flash"), (T.fold_name, "ＧＬＭ 5.3 Flash", "glm53flash"),
    (T.version_of, "DeepSeek V4.1 Flash", "4.1"), (T.version_of, "混元 3.0", "3.0"), (T.version_of, "none", None),
    (T.normalize_date, "2026/10/7", "2026-10-07"), (T.normalize_date, "2026年10月7日", "2026-10-07"), (T.normalize_date, "2026-00-07", None),
    (T.normalize_url, "HTTPS://A.com:443/Path/?utm_source=x&q=1#top", "https://a.com/path?q=1"), (T.normalize_url, " No Url ", "no url"), (T.url_host, "http://u@H.com:8080/x", "h.com:8080"),
    (T.clean_text, " a&nbsp;&amp;  b\n\n\n\nc ", "a & b\n\nc"), (T.escape_xml, "<a href='x'>&", "&lt;a href=&#39;x&#39;&gt;&amp;"),
    (extract.clean_title, "100万 tokens。", "100万 tokens"), (extract.clean_title, "Usage creditsMore information", "Usage credits"),
    (validate.bad_title, "Offer", "generic"), (validate.bad_title, "新用户免费额度", "generic"), (validate.bad_title, "新用户免费额度领取攻略", None), (validate.bad_title, "③平台操作", "navigation"),
    (validate.bad_title, "Dedicated API credits and educational features for student lea", "cut sentence"), (validate.paid_tier, "付费层级（美元/100 万个 token）", True),
    (feeds.unwrap_redirect, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.com%2Fa&rut=1", "https://example.com/a"),
])
def test_expressions(spark, make, given, want):
    assert value(spark, make, given) == want


def test_benefits_dates_and_fingerprints(spark):
    got = value(spark, extract.benefit, "新用户送 1亿 GLM-5.3-Flash Token")
    assert (got.kind, got.amount) == ("token", 1e8)
    got = value(spark, lambda c: extract.dates(c, F.lit(2026)), "活动 12/20-1/5")
    assert (got.start, got.end) == ("2026-12-20", "2027-01-05")
    make = lambda p, t, u: T.fingerprint(p, t, u, F.lit(None).cast("string"))
    assert value(spark, make, "alibaba-qwen", "阿里云AI大模型免费7000万Tokens开通就送（附模型大全）", "https://developer.aliyun.com/article/1698340") == "21cf6be155f94f11c8a5de33965ecb06"
    shown = lambda u, a: T.format_benefit(F.lit("x"), a.cast("double"), u, F.lit(None).cast("string"))
    assert [value(spark, shown, *x) for x in (("token", "7e7"), ("CNY", "0.8"), ("USD", "200"))] == ["7000 万 tokens", "¥0.8", "$200"]


def test_lifecycle(spark):
    rows = [(1, None, None), (2, datetime.date(2026, 9, 21), None), (3, None, datetime.date(2026, 12, 1))]
    df = spark.createDataFrame(rows, "id int, end_date date, start_date date").withColumns({c: F.lit(None).cast("string") for c in ("status_override", "archived_at")}).withColumn("created_at", F.lit(None).cast("timestamp"))
    got = {r.id: (r.status, r.days_left) for r in listing.with_status(df, F.lit("2026-11-21").cast("date"), F.lit("2026-11-21").cast("timestamp")).collect()}
    assert got == {1: ("active", None), 2: ("ended", -61), 3: ("upcoming", None)}
    with pytest.raises(ValueError):
        listing.ListQuery(page=0)


def test_blocks_and_candidates(spark):
    page = "<h2>限时活动</h2><p>新用户注册即送 100 万 token，免费领取</p><p>more text that follows here</p><h2>Other</h2><p>nothing of interest at all</p>" + "<p>" + "filler " * 40 + "</p>"
    df = spark.createDataFrame([(1, "http://a.com/", page), (2, None, None)], "page_id long, url string, html string")
    got = blocks.candidates(blocks.html_blocks(df)).collect()
    assert len(got) == 1 and got[0].title == "限时活动" and got[0].context.endswith("more text that follows here")


def test_dedupe_keeps_the_better_and_the_first(spark):
    rows = [(k, "p", t, "https://site.example/offer", 5.0, c) for k, (t, c) in enumerate([("100万 tokens", 0.5), ("共100万 tokens，共享消耗。资源包", 0.5), ("100万 tokens", 0.5)])]
    none = F.lit(None).cast("string")
    df = spark.createDataFrame(rows, "ord long, provider_slug string, title string, claim_url string, benefit_amount double, confidence double")
    df = df.withColumns({c: none for c in ("summary", "source_excerpt", "source_url", "start_date", "end_date", "benefit_kind", "benefit_unit")}).withColumn("audience", F.array(F.lit("all")))
    got = dedupe.dedupe(dedupe.normalize_items(df)).collect()
    assert [r.ord for r in got] == [0]
    assert dedupe.dedupe(dedupe.normalize_items(df.limit(0))).collect() == []


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", 1, "n"), (2, "b", 2, None)], "id long, key string, v int, note string")
    new = spark.createDataFrame([("b", 3, "m"), ("c", 4, None), ("d", 5, None)], "key string, v int, note string")
    now = F.lit("2026-01-01").cast("timestamp")
    once = merge.upsert(old, new, "key", ["v"], now, sticky=["note"], id_column="id")
    got = {r.key: r for r in once.collect()}
    assert {k: (r.v, r.note, r.change) for k, r in got.items()} == {"a": (1, "n", "none"), "b": (3, "m", "update"), "c": (4, None, "insert"), "d": (5, None, "insert")}
    assert sorted(r.id for r in got.values()) == [1, 2, 3, 4]
    again = merge.upsert(once.drop("change"), new, "key", ["v"], now, sticky=["note"]).collect()
    assert {r.change for r in again} == {"none", "touch"}


def test_links(spark):
    texts = spark.createDataFrame([(1, "The GLM-5.3 Flash is here"), (2, "use v4.1 now"), (3, None)], "id long, text string")
    names = spark.createDataFrame([(10, "GLM-5.3", 0), (11, "GLM-5.3-Flash", 1), (12, "X 4.1", 2)], "entity_id long, alias string, ord int")
    assert [(r.id, r.entity_id) for r in link.longest_alias(texts, names).collect()] == [(1, 11)]
    assert {(r.id, r.entity_id) for r in link.unique_version(texts, names.withColumnRenamed("alias", "name")).collect()} == {(2, 12)}


def test_matches_and_pages(spark):
    subs = spark.sql("SELECT 1 AS sub_id, named_struct('providers', array('p'), 'categories', array(), 'audience', array('student')) AS filters UNION ALL SELECT 2, named_struct('providers', array(), 'categories', array(), 'audience', array())")
    subs = subs.select("sub_id", F.from_json(F.to_json("filters"), "providers array<string>, categories array<string>, audience array<string>").alias("filters"))
    items = spark.createDataFrame([(1, "p", "c", ["student"], "t"), (2, "p", "c", ["all"], "t"), (3, "q", "d", [], "t")], "id long, provider string, category string, audience array<string>, title string")
    found = publish.matches(subs, items)
    assert {(r.sub_id, r.id) for r in found.collect()} == {(1, 1), (2, 1), (2, 2), (2, 3)}
    assert {r.sub_id: r.title for r in publish.messages(found, items).collect()} == {1: "t", 2: "3 new offers"}
    assert spark.range(1).select(publish.page_list(F.lit(5), F.lit(9)).alias("v")).first().v == [1, 3, 4, 5, 6, 7, 9]


def test_robots(spark):
    robots = spark.createDataFrame([("h.com", "User-agent: *\nDisallow: /a\nAllow: /a/b\n\nUser-agent: bot\nDisallow: /")], "host string, text string")
    urls = spark.createDataFrame([("http://h.com/a/c",), ("http://h.com/a/b/d",), ("http://other.com/",)], "url string")
    got = {r.url: r.allowed for r in crawl.allowed(urls, crawl.robots_rules(robots, "reader")).collect()}
    assert list(got.values()).count(False) == 1 and not got["http://h.com/a/c"]
    assert not crawl.allowed(urls, crawl.robots_rules(robots, "Bot/1")).where("url LIKE '%h.com%' AND allowed").count()


def test_a_page_is_walked_in_time_to_its_length():
    """No tag asks the whole stack whether it is noise or in scope: 20000 elements in each other took two scans of it for each."""
    start = time.process_time()
    got = blocks.page_blocks("<div>" * 20000 + "<nav><p>menu</p></nav><p>text</p>", "https://a.example.com/")
    assert [b["text"] for b in got] == ["text"] and time.process_time() - start < 4


def test_an_upsert_keeps_a_sticky_column_that_new_rows_lack(spark):
    old = spark.createDataFrame([("a", 1, "hook")], "key string, n int, hook string")
    new = spark.createDataFrame([("a", 2), ("b", 3)], "key string, n int")
    got = merge.upsert(old, new, "key", ["n"], F.current_timestamp(), sticky=["hook"]).collect()
    assert {(r.key, r.n, r.hook, r.change) for r in got} == {("a", 2, "hook", "update"), ("b", 3, None, "insert")}
