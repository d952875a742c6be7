"""Daily runs over a small crawl: what is new, what changes, what stays; and rounds of verification that credentials end."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.jobs import daily
from tidemark.operators import probes, verification
from tidemark.sources import tables

PAGE = "<html><body><main><h2>{title}</h2><p>新用户注册即送 {n} 万 tokens，截至 2026年{m}月8日 <a href='/claim/{k}'>领取</a></p><p>{more}</p></main></body></html>"


def crawl(spark, pages):
    """pages: source_id -> (status, html)."""
    rows = [(k, f"https://www.vendor.example.com/p{k}", s, h) for k, (s, h) in pages.items()]
    df = spark.createDataFrame(rows, "source_id long, url string, status_code int, html string")
    sources = df.select(F.col("source_id").alias("id"), F.lit("vendor").alias("provider_slug"), "url", F.lit("page").alias("kind"))
    providers = spark.createDataFrame([("vendor", "CN", ["https://www.vendor.example.com"])], "slug string, country string, urls array<string>")
    aliases = spark.createDataFrame([("vendor", 7, "Alpha", 0), ("vendor", 8, "Alpha Pro", 1)], "provider_slug string, entity_id long, alias string, ord int")
    bases = spark.createDataFrame([(70, "https://api.vendor.example.com/v1", 9)], "base_id long, base string, model_id long")
    return daily.Inputs(df, sources, providers, aliases, bases)


def page(k, n=5, m=9, more="其他条款请看文档", title=None):
    return PAGE.format(k=k, n=n, m=m, more=more, title=title or f"第 {k} 号模型活动")


def offers(spark, folder):
    return {r.claim_url.rsplit("/", 1)[1]: r for r in tables.read_version(spark, f"{folder}/offers").collect()}


@pytest.fixture(scope="module")
def history(spark):
    """Three runs: pages 1 to 3 of which 3 does not answer; then 2 changes and 3 comes; then nothing changes."""
    folder = tempfile.mkdtemp(prefix="spark-") + "/catalogue"
    first = {1: (200, page(1, more="Alpha Pro 可用")), 2: (200, page(2)), 3: (503, page(3))}
    second = {1: first[1], 2: (200, page(2, n=6)), 3: (200, page(3, more="接口 https://api.vendor.example.com/v1/chat 可用"))}
    out = []
    for run_id, (pages, at) in enumerate(((first, "2026-08-01 02:00:00"), (second, "2026-08-02 02:00:00"), (second, "2026-11-02 02:00:00")), 1):
        row = daily.run(spark, folder, crawl(spark, pages), run_id, at).first()
        out.append((row, offers(spark, folder)))
    return folder, out


def test_runs_count_what_they_did(history):
    rows = [r for r, _ in history[1]]
    assert [(r.id, r.status, r.sources_total, r.sources_ok, r.sources_unchanged) for r in rows] == [(1, "partial", 3, 2, 0), (2, "ok", 3, 3, 1), (3, "ok", 3, 3, 3)]
    assert [(r.items_found, r.items_new, r.items_updated, r.items_rejected) for r in rows] == [(2, 2, 0, 0), (2, 1, 1, 0), (0, 0, 0, 0)]


def test_offers_keep_their_ids_and_times(history):
    (_, one), (_, two), (_, three) = history[1]
    assert set(one) == {"1", "2"} and set(two) == {"1", "2", "3"} == set(three)
    assert [one[k].id for k in "12"] == [two[k].id for k in "12"] and sorted(r.id for r in two.values()) == [1, 2, 3]
    assert two["2"].benefit_amount == 60000 and one["2"].benefit_amount == 50000
    assert two["2"].created_at == one["2"].created_at < two["2"].updated_at
    assert two["1"].updated_at == one["1"].updated_at and two["1"].last_verified_at == one["1"].last_verified_at  # its page did not change and was not read


def test_offers_are_linked_by_name_and_by_address(history):
    offers_now = history[1][1][1]
    assert (offers_now["1"].model_id, offers_now["1"].endpoint_id) == (8, None)
    assert (offers_now["2"].model_id, offers_now["2"].endpoint_id) == (None, None)
    assert (offers_now["3"].model_id, offers_now["3"].endpoint_id) == (9, 70)


def test_long_over_offers_are_archived(history):
    two, three = history[1][1][1], history[1][2][1]
    assert all(r.archived_at is None for r in two.values()) and all(r.archived_at is not None for r in three.values())


def test_logs(spark, history):
    folder = history[0]
    changes = {(r.run_id, r.field, r.old_value, r.new_value) for r in spark.read.parquet(f"{folder}/history").collect()}
    assert (2, "benefit_amount", "50000.0", "60000.0") in changes and all(c[0] == 2 for c in changes)
    assert spark.read.parquet(f"{folder}/snapshots").groupBy("run_id").count().orderBy("run_id").collect() == [(1, 3), (2, 3), (3, 3)]
    assert [r.id for r in spark.read.parquet(f"{folder}/runs").orderBy("id").collect()] == [1, 2, 3]


def test_a_run_without_pages(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/catalogue"
    inputs = crawl(spark, {1: (200, page(1))})
    empty = daily.Inputs(inputs.pages.limit(0), inputs.sources, inputs.providers, inputs.aliases, inputs.bases)
    row = daily.run(spark, folder, empty, 1, "2026-08-01 02:00:00").first()
    assert (row.status, row.sources_total, row.items_found, row.items_new) == ("failed", 0, 0, 0)
    assert tables.read_version(spark, f"{folder}/offers").count() == 0


def test_refused_credentials_end_a_round(spark):
    rows = [(k, None if k < 3 else f"2026-01-0{k} 00:00:00") for k in range(1, 8)]
    queue = spark.createDataFrame(rows, "id long, at string").select("id", F.col("at").cast("timestamp").alias("last_verified_at"))
    text = "<p>" + "An offer is told of here at some length. " + "</p>"
    pages = queue.select("id", F.when(F.col("id") == 6, 404).otherwise(200).alias("status_code"), F.lit(text).alias("html"))
    replies = queue.select("id", F.when(F.col("id") == 5, 401).otherwise(200).alias("reply_code"), F.when(F.col("id") != 5, '{"stillValid": true}').alias("reply"))
    got = {r.id: r.outcome for r in verification.outcomes(queue, pages, replies).collect()}
    assert got == {1: "confirmed", 2: "confirmed", 3: "confirmed", 4: "confirmed", 5: "skipped", 6: "skipped", 7: "skipped"}
    assert tuple(verification.tally(verification.outcomes(queue, pages, replies)).first()) == (4, 0, 4, 0)


def test_prompts_for_pages_with_text(spark):
    queue = spark.createDataFrame([(1, "P", "T", None, "ten"), (2, "P", "U", "s", None), (3, "P", "V", "s", "")], "id long, provider string, title string, summary string, benefit_text string")
    pages = spark.createDataFrame([(1, 200, "<p>" + "x" * 50 + "</p>"), (2, 200, "<p>x</p>"), (3, 404, "<p>" + "x" * 50)], "id long, status_code int, html string")
    got = verification.prompts(queue, pages, 20).collect()
    assert [r.id for r in got] == [1] and "Offer: P｜T｜ten\n" in got[0].prompt and "x" * 20 + "\n" in got[0].prompt and "x" * 21 not in got[0].prompt


def test_pages_of_a_site_one_after_the_other(spark):
    # 2 repeats 1's address; 3 has 2's text, but 2 is no page of its own; 4 repeats 3's text; 5 is not ok
    rows = [("s", 1, "u1", "https://a.example.com/x/", "h1", True), ("s", 2, "u2", "http://www.a.example.com/x", "h2", True), ("s", 3, "u3", None, "h2", True), ("s", 4, "u4", None, "h2", True), ("s", 5, "u5", None, "h1", False), ("t", 1, "u1", None, "h1", True)]
    df = spark.createDataFrame(rows, "site string, at long, url string, final_url string, body_hash string, ok boolean")
    got = {(r.site, r["at"]): r.duplicate_of for r in probes.distinct_pages(df, "site", "at").collect()}
    assert got == {("s", 1): None, ("s", 2): "u1", ("s", 3): None, ("s", 4): "u3", ("s", 5): None, ("t", 1): None}


def test_pages_of_known_blogs_are_owned(spark):
    rows = [("https://github.blog/x", "https://github.com"), ("https://docs.github.com/x", "https://github.com"), ("https://evil.example.com", "https://github.com"), (None, "https://github.com")]
    df = spark.createDataFrame(rows, "final_url string, origin string")
    assert [r.own for r in probes.owned(df, "origin", {"github.com": ["github.blog"]}).collect()] == [True, True, False, False]


def test_a_stream_of_pages_is_runs(spark, history):
    """Two folders of pages, one after the other, give what two runs give."""
    folder = tempfile.mkdtemp(prefix="spark-")
    first = {1: (200, page(1, more="Alpha Pro 可用")), 2: (200, page(2)), 3: (503, page(3))}
    second = {1: first[1], 2: (200, page(2, n=6))}
    schema = crawl(spark, first).pages.schema
    for pages in (first, second):
        crawl(spark, pages).pages.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        daily.follow(stream, f"{folder}/catalogue", crawl(spark, first), f"{folder}/state", "2026-08-01 02:00:00").awaitTermination()
    rows = spark.read.parquet(f"{folder}/catalogue/runs").orderBy("id").collect()
    assert [(r.id, r.status, r.sources_total, r.sources_unchanged, r.items_new, r.items_updated) for r in rows] == [(1, "partial", 3, 0, 2, 0), (2, "ok", 2, 1, 0, 1)]
    assert offers(spark, f"{folder}/catalogue")["2"].benefit_amount == 60000


def test_feeds_searches_scopes_and_replies(spark):
    """One run over a feed, a page of results, a page of which a part counts, and a page that a model read."""
    feed = "<rss><channel><item><title>新用户注册即送 9 万 tokens</title><link>https://www.vendor.example.com/feed/9</link><description>免费额度，新用户领取，截至 2026年9月9日</description></item></channel></rss>"
    result = "<table><tr><td><a class='result-link' href='https://news.example.net/a'>新用户注册即送 3 万 tokens 活动</a></td></tr><tr><td class='result-snippet'>免费领取额度，面向新用户</td></tr></table>"
    part = "<body><div class='side'>" + page(7, n=7).replace("第 7 号", "第 70 号") + "</div><div id='main'>" + page(8, n=8) + "</div></body>"
    rows = [(1, "page", None, feed), (2, "search", None, result), (3, "page", "#main", part), (4, "page", None, "<p>nothing to see on this page</p>")]
    inputs = crawl(spark, {k: (200, html) for k, _, _, html in rows})
    kinds = spark.createDataFrame([(k, kind, scope) for k, kind, scope, _ in rows], "id long, kind string, scope string")
    sources = inputs.sources.drop("kind").join(kinds, "id")
    reply = '{"title": "新用户注册送 4 万 tokens", "hook": "a gift", "benefitKind": "token", "benefitAmount": 40000, "benefitUnit": "token", "audience": ["new_user"], "claimUrl": "https://www.vendor.example.com/c4", "confidence": 0.9}'
    replies = spark.createDataFrame([(4, "t", "c", reply), (4, "t", "c", "no offer here")], "source_id long, title string, context string, reply string")
    full = daily.Inputs(inputs.pages, sources, inputs.providers, inputs.aliases, inputs.bases, replies)
    folder = tempfile.mkdtemp(prefix="spark-") + "/catalogue"
    row = daily.run(spark, folder, full, 1, "2026-08-01 02:00:00").first()
    got = {r.benefit_amount: r for r in tables.read_version(spark, f"{folder}/offers").collect()}
    assert sorted(got) == [30000, 40000, 80000, 90000] and row.items_new == 4
    assert (got[90000].end_date, got[90000].claim_url, got[90000].extracted_by) == ("2026-09-09", "https://www.vendor.example.com/feed/9", "rule")
    assert (got[30000].claim_url, got[30000].source_url, got[30000].extracted_by) == ("https://news.example.net/a",) * 2 + ("search",)
    assert (got[40000].hook, got[40000].extracted_by, got[40000].source_id) == ("a gift", "llm", 4)
    assert got[80000].source_id == 3
