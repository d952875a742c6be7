"""Operators on texts that the order tables write: every row plants what must be found, and the SQL says what that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import blocks, crawl, extract, link, validate
from tidemark.sources import feeds
from tidemark.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def say(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by a column."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out


def pick(by: Column, *choices: Column | None) -> Column:
    """The choice that stands at place `by`; None is null."""
    out = F
    for k, c in enumerate(choices):
        out = out.when(by == k, F.lit(None) if c is None else c)
    return out


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN k = 0 THEN 'token' WHEN k < 3 THEN 'credit_cny' WHEN k < 5 THEN 'credit_usd' WHEN k < 7 THEN 'duration' WHEN k = 7 THEN 'count' END AS kind,
n * CASE k WHEN 0 THEN 10000.0::DOUBLE WHEN 3 THEN 1000.0::DOUBLE WHEN 8 THEN NULL ELSE 1.0::DOUBLE END AS amount, CASE k WHEN 0 THEN 'token' WHEN 1 THEN 'CNY' WHEN 2 THEN 'CNY' WHEN 3 THEN 'USD' WHEN 4 THEN 'USD' WHEN 5 THEN 'day' WHEN 6 THEN 'month' WHEN 7 THEN 'count' END AS unit
FROM (SELECT *, l_orderkey % 9 AS k, l_partkey + 1 AS n FROM lineitem)""")
def benefits(spark, sf):
    n = F.col("l_partkey") + 1
    texts = ("新用户送 {n} 万 GLM-5.3-Flash Token", "充值 ¥{n} 起", "{n} 元代金券", "get ${n}k now", "{n} 美金 一次", "{n} 天免费", "{n} 个月试用", "赠送 {n} 张算力优惠卡", "nothing to have here")
    found = extract.benefit(pick(F.col("l_orderkey") % 9, *(say(t, n=n) for t in texts)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", found["kind"].alias("kind"), found["amount"].alias("amount"), found["unit"].alias("unit"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, strftime(o_orderdate, '-%m-%d') AS a, strftime(o_orderdate + INTERVAL 40 DAY, '-%m-%d') AS b, strftime(o_orderdate, '%Y') AS y FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 THEN '2026' || a WHEN k = 1 THEN y || a WHEN k = 3 THEN '2026' || a END AS start,
CASE k WHEN 0 THEN CASE WHEN b < a THEN '2027' || b ELSE '2026' || b END WHEN 1 THEN CASE WHEN b < a THEN (CAST(y AS INTEGER) + 1) || b ELSE y || b END WHEN 2 THEN y || a WHEN 3 THEN '2026' || a WHEN 4 THEN '2026' || greatest(a, b) END AS until FROM o""")
def date_ranges(spark, sf):
    """Ranges with and without a year, a deadline, a start, two days named, and none."""
    d = F.col("o_orderdate").cast("date")
    e = F.date_add(d, 40)
    texts = ("活动 {m}/{d}-{n}/{e}", "{y}年{m}月{d}日至{n}月{e}日", "截至 {y}年{m}月{d}日", "从 {m}月{d}日 开始", "{m}月{d}日和{n}月{e}日", "any day")
    values = {"y": F.year(d), "m": F.month(d), "d": F.day(d), "n": F.month(e), "e": F.day(e)}
    found = extract.dates(pick(F.col("o_orderkey") % 6, *(say(t, **values) for t in texts)), F.lit(2026))
    return table(spark, sf, "orders").select("o_orderkey", found["start"].alias("start"), found["end"].alias("until"))


@query("""SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2, 3) THEN event_id % 6 WHEN event_id % 6 = 4 AND event_id % 7 = 0 THEN 4 END AS kept FROM events""")
def claim_links(spark, sf):
    """Links on the source's host, below and on an allowed host, of a search, to a stranger, and none."""
    k = F.col("event_id")
    href = pick(k % 6, *map(F.lit, ("https://vendor.example.com/a", "https://go.allowed.example.org/b", "http://allowed.example.org/c", "https://any.example.net/d", "https://stranger.example.net/e")), None)
    got = extract.claim_link(href, F.lit("https://vendor.example.com/news"), F.array(F.lit("allowed.example.org")), (k % 6 == 3) | (k % 7 == 0))
    return table(spark, sf, "events").select("event_id", F.when(got.isNotNull(), k % 6).alias("kept"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, least(1, 0.30::DOUBLE + CASE WHEN k % 2 = 0 THEN 0.28 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 0.18 WHEN k % 3 = 1 THEN 0.10 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0.14 ELSE 0 END
  + CASE WHEN k % 7 < 3 THEN 0.12 ELSE 0 END + CASE WHEN k % 11 = 0 THEN -0.15 WHEN k % 11 = 1 THEN 0 ELSE 0.05 END + CASE WHEN k % 4 = 1 THEN 0 ELSE 0.06 END
  + CASE WHEN k % 2 = 1 AND k % 7 < 3 AND k % 11 > 1 THEN 0.22 ELSE 0 END + CASE WHEN k % 8 = 0 THEN 0.05 ELSE 0 END)), 2) AS confidence FROM (SELECT *, l_orderkey + l_partkey AS k FROM lineitem)""")
def confidence_parts(spark, sf):
    """Every weight of the score, on and off."""
    k = F.col("l_orderkey") + F.col("l_partkey")
    text = F.when(k % 11 == 0, F.rpad(F.lit("long"), 1600, ".")).when(k % 11 == 1, "short").otherwise("a text of some length that tells of a giveaway for all")
    offer = F.when(k % 2 == 0, F.struct(F.when(k % 8 == 0, "count").otherwise("token").alias("kind"), F.lit(1.0).alias("amount")))
    start, end = F.when(k % 3 < 2, "2026-01-01"), F.when(k % 3 == 0, "2026-02-01")
    who = F.array(F.when(k % 7 < 3, "student").otherwise("all"))
    title = F.when(k % 4 == 1, "title that ends，").otherwise("title that is good")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", extract.confidence(text, title, offer, start, end, F.when(k % 5 == 0, "https://x"), who).alias("confidence"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """One item an order, with one thing wrong with it or nothing: see the SQL of `verdicts`."""
    k = F.col("o_orderkey") % 16
    none = F.lit(None).cast("string")
    good = F.lit("新用户注册送额度")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(k == 0, "no").when(k == 1, "免费额度").when(k == 2, "付费层级（美元/100 万个 token）").otherwise(good).alias("title"),
        F.when(k == 3, "$1/ $2/ list").when(k == 4, "a plain page").otherwise("赠送给新用户").alias("summary"), none.alias("benefit_text"), none.alias("source_excerpt"),
        F.when(k == 4, F.array(F.lit("all"))).otherwise(F.array(F.lit("new_user"))).alias("audience"),
        F.when(k == 5, "ftp://x.example.com").when(k == 6, "https://stranger.example.net/x").when(k == 7, none).when(k == 8, "#top").when(k == 9, "https://stranger.example.net/y").otherwise("https://vendor.example.com/x").alias("claim_url"),
        F.lit("https://vendor.example.com/news").alias("source_url"), F.when(k == 10, "2026/1/1").otherwise("2026-01-01").alias("start_date"), F.when(k == 11, "2099-01-01").otherwise("2026-02-01").alias("end_date"),
        F.when(k == 12, -1.0).when(k == 13, 2e13).otherwise(100.0).alias("benefit_amount"), F.when(k == 13, "token").otherwise("CNY").alias("benefit_unit"),
        F.when(k == 14, 0.3).when(k == 15, 0.1).otherwise(0.9).alias("confidence"), (k == 9).alias("is_search"), validate.allowed_hosts(F.array(F.lit("https://vendor.example.com/"))).alias("hosts"),
    ).withColumn("title", F.when(k == 4, "a title that says it").otherwise(F.col("title")))


@query("""WITH v AS (SELECT o_orderkey, o_orderkey % 16 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k < 6 OR k = 15 THEN 'reject' WHEN k IN (6, 10, 11, 12, 13, 14) THEN 'pending' ELSE 'auto_ok' END AS action,
CASE k WHEN 0 THEN 'title missing' WHEN 1 THEN 'title: generic' WHEN 2 THEN 'title: paid tier' WHEN 3 THEN 'price list' WHEN 4 THEN 'nothing given' WHEN 5 THEN 'link is no web address' END AS reason,
CASE k WHEN 6 THEN 'link leads to an unknown host' WHEN 10 THEN 'start_date malformed' WHEN 11 THEN 'end_date out of range' WHEN 12 THEN 'amount invalid' WHEN 13 THEN 'amount too large' WHEN 15 THEN 'confidence too low' ELSE '' END AS reasons,
CASE k WHEN 7 THEN 'no link' WHEN 8 THEN 'link is a placeholder' WHEN 9 THEN 'link from search' ELSE '' END AS notes,
CASE k WHEN 6 THEN 0.55 WHEN 13 THEN 0.5 WHEN 14 THEN 0.3 WHEN 15 THEN 0.1 ELSE 0.9 END::DOUBLE AS confidence, k IN (10) AS no_start, k IN (11) AS no_end, k = 12 AS no_amount, k IN (7, 8) AS no_link FROM v""")
def verdicts(spark, sf):
    v = validate.verdict(_items(spark, sf), 2026)
    return v.select(
        "o_orderkey", "action", F.col("reject_reason").alias("reason"), F.array_join("reasons", ",").alias("reasons"), F.array_join("notes", ",").alias("notes"), "confidence",
        F.col("start_date").isNull().alias("no_start"), F.col("end_date").isNull().alias("no_end"), F.col("benefit_amount").isNull().alias("no_amount"), F.col("claim_url").isNull().alias("no_link"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN 'empty' WHEN 1 THEN 'short' WHEN 2 THEN 'generic' WHEN 3 THEN 'navigation' WHEN 4 THEN 'paid tier' WHEN 5 THEN 'cut sentence' WHEN 6 THEN 'price' WHEN 7 THEN 'long sentence'
WHEN 8 THEN 'unfinished sentence' WHEN 9 THEN 'clause' WHEN 10 THEN 'compound sentence' END AS fault FROM orders""")
def title_faults(spark, sf):
    """One title for each test, with the order's number in it where the test allows."""
    texts = (
        "  ", "abc", "Free tier :", "③平台操作", "付费层级（美元/100 万个 token）", "Order {k} gives credits and features to student leaders", "第 {k} 号套餐 20 美元",
        "第{k}号订单，" + "一二三四五六七八九十" * 9 + "。", "第{k}号订单今天为所有的新朋友们准备了一份特别的礼物给大家，", "第{k}号订单赠送的额度在有效期之内可以给所有的朋友使用",
        "第{k}号订单准备了礼物，今天来的新朋友可以拿走一份，明天来的也可以拿走一份好吃的东西", "第{k}号订单赠送礼物",
    )
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k, validate.bad_title(pick(k % 12, *(say(t, k=k) for t in texts))).alias("fault"))


@query("""SELECT c_custkey AS id, n AS pos, 'Offer & gift ' || c_custkey || '-' || n AS title, 'https://x.example.com/' || c_custkey || '/' || n AS link, CASE WHEN c_custkey % 2 = 0 THEN 'for bold ones' ELSE 'in short' END AS description FROM customer, (SELECT unnest([0, 1]) AS n)""")
def feed_items(spark, sf):
    """Each customer's feed of two items, RSS for one half and Atom for the other."""
    k = F.col("c_custkey")
    rss = "".join(f"<item><title><![CDATA[Offer &amp; gift {{k}}-{n}]]></title><link>https://x.example.com/{{k}}/{n}</link><description>for &lt;b&gt;bold&lt;/b&gt; ones</description></item>" for n in (0, 1))
    atom = "".join(f"<entry><title>Offer &amp; gift {{k}}-{n}</title><link rel='alternate' href='https://x.example.com/{{k}}/{n}'/><summary>in <i>short</i></summary></entry>" for n in (0, 1))
    xml = F.when(k % 2 == 0, say(f"<rss><channel><title>no item</title>{rss}</channel></rss>", k=k)).otherwise(say(f"<feed>{atom}</feed>", k=k))
    return feeds.feed_items(table(spark, sf, "customer").select(k.alias("id"), xml.alias("xml")))


@query("""SELECT c_custkey AS id, n AS pos, 'Hit ' || c_custkey AS title, CASE WHEN n = 0 THEN 'https://a.example.com/p?q=' || c_custkey ELSE 'http://b.example.com/x' END AS url, 'Snippet ' || n || ' of ' || c_custkey AS snippet FROM customer, (SELECT unnest([0, 1]) AS n)""")
def search_results(spark, sf):
    """Result pages of a direct and a redirected link, and one that leads nowhere."""
    k = F.col("c_custkey")
    part = "<tr><td><a rel='nofollow' class='result-link' href='{href}'>Hit <b>{k}</b></a></td></tr><tr><td class='result-snippet'>Snippet {n} of {k}</td></tr>"
    hrefs = ("https://a.example.com/p?q={k}&utm_source=s", "//duckduckgo.com/l/?uddg=http%3A%2F%2Fb.example.com%2Fx%2F&amp;rut=1", "//duckduckgo.com/settings")
    html = "<table>" + "".join(part.replace("{href}", h).replace("{n}", str(n)) for n, h in enumerate(hrefs)) + "</table>"
    return feeds.search_results(table(spark, sf, "customer").select(k.alias("id"), say(html, k=k).alias("html")))


@query("""SELECT s_suppkey, s_suppkey % 5 IN (0, 1, 2) AS named, s_suppkey % 4 < 3 AS own, s_suppkey % 3 < 2 AS challenge FROM supplier""")
def relevance(spark, sf):
    """Whether pages name a supplier, are of its site, or ask for proof of a human."""
    k = F.col("s_suppkey")
    heads = ("<title>{name} gives</title>", "<h1>The acmecloud offer</h1>", "<title>News</title><h1>ACX plan</h1>", "<title>the acme</title>", "<p>{name}</p>")
    html = pick(k % 5, *(say(h, name=F.col("s_name")) for h in heads))
    named = crawl.relevant(html, F.array("s_name"), F.lit("acmecloud-ai"), F.array(F.lit("acx")))
    url = pick(k % 4, *map(F.lit, ("https://www.acme.example.com/a", "https://docs.acme.example.com/", "https://other.example.com/", "https://acme.test/")))
    page = pick(k % 3, F.lit("<p>Unusual traffic</p>"), F.lit("<p>empty</p>"), F.lit("<table><tr><td>result"))
    return table(spark, sf, "supplier").select("s_suppkey", named.alias("named"), crawl.same_site(url, F.lit("https://acme.example.com")).alias("own"), crawl.is_challenge(page).alias("challenge"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'url' WHEN o_orderkey % 3 = 0 THEN 'alias' ELSE 'version' END AS by FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""")
def link_evidence(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    one = lambda by, n: o.where(k % n == 0).select(k.alias("id"), k.alias("entity_id"), F.lit(by).alias("by"))
    return link.by_evidence(one("url", 2), one("alias", 3), one("version", 5)).select("id", "by")


@query("""WITH e AS (SELECT p_partkey, (p_partkey % 500) || '.' || (p_partkey % 7) AS v FROM part), u AS (SELECT v, min(p_partkey) AS entity_id FROM e GROUP BY v HAVING count(*) = 1)
SELECT o_orderkey AS id, entity_id FROM orders JOIN u ON v = (o_orderkey % 600) || '.' || (o_orderkey % 7)""")
def version_links(spark, sf):
    k, p = F.col("o_orderkey"), F.col("p_partkey")
    texts = table(spark, sf, "orders").select(k.alias("id"), say("about v{a}.{b} today", a=k % 600, b=k % 7).alias("text"))
    return link.unique_version(texts, table(spark, sf, "part").select(p.alias("entity_id"), say("Model {a}.{b}", a=p % 500, b=p % 7).alias("name")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ',x' ELSE '' END AS list FROM events")
def json_lists(spark, sf):
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, say('["{t}", "x"]', t=F.col("event_type"))).when(k % 3 == 1, '{"a": 1}')
    return table(spark, sf, "events").select("event_id", F.array_join(T.json_strings(raw), ",").alias("list"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's page: a menu, a heading, an offer of so many tokens until a day, its terms, a table row and a footer."""
    html = (
        "<html><body><nav><p>免费额度 菜单</p></nav><main><h2>第 {k} 号模型活动</h2><p>新用户注册即送 {n} 万 tokens，截至 2026年{m}月{d}日 <a href='/claim/{k}'>领取</a></p>"
        "<p>其他条款请看文档</p><h3>More</h3><table><tr><td>one</td><td>two {k}</td></tr></table></main><footer><p>送 9 万 tokens</p></footer></body></html>"
    )
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("page_id"), say("https://www.vendor{v}.example.com/{k}", v=k % 9, k=k).alias("url"), say(html, k=k, n=k + 1, m=k % 12 + 1, d=k % 28 + 1).alias("html")
    )


@query("""SELECT p_partkey AS page_id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN 'h2' WHEN 1 THEN 'p' WHEN 2 THEN 'p' WHEN 3 THEN 'h3' WHEN 6 THEN 'tr' ELSE 'td' END AS tag,
CASE pos WHEN 0 THEN '第 ' || p_partkey || ' 号模型活动' WHEN 1 THEN '新用户注册即送 ' || (p_partkey + 1) || ' 万 tokens，截至 2026年' || (p_partkey % 12 + 1) || '月' || (p_partkey % 28 + 1) || '日 领取' WHEN 2 THEN '其他条款请看文档' WHEN 3 THEN 'More' WHEN 4 THEN 'one' WHEN 5 THEN 'two ' || p_partkey ELSE 'one | two ' || p_partkey END AS text,
CASE WHEN pos = 1 THEN 'https://www.vendor' || (p_partkey % 9) || '.example.com/claim/' || p_partkey END AS href, CASE WHEN pos IN (1, 2, 3) THEN '第 ' || p_partkey || ' 号模型活动' WHEN pos IN (4, 5) THEN 'More' END AS heading FROM part, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS pos)""")
def planted_blocks(spark, sf):
    b = blocks.html_blocks(_pages(spark, sf)).select("page_id", F.explode("blocks").alias("b"))
    return b.select("page_id", "b.pos", "b.tag", "b.text", "b.href", "b.heading")


@query("""SELECT p_partkey AS page_id, '第 ' || p_partkey || ' 号模型活动' AS heading, 'token' AS kind, (p_partkey + 1) * 10000.0::DOUBLE AS amount, '2026-' || lpad('' || (p_partkey % 12 + 1), 2, '0') || '-' || lpad('' || (p_partkey % 28 + 1), 2, '0') AS until,
'new_user' AS who, 'free_credit' AS category, 'auto_ok' AS action, 'https://www.vendor' || (p_partkey % 9) || '.example.com/claim/' || p_partkey AS link FROM part""")
def planted_offers(spark, sf):
    """Pages to blocks to candidates to items to verdicts, with what the pages planted."""
    pages = _pages(spark, sf)
    source = pages.select("page_id", F.col("url").alias("source_url"))
    named = blocks.candidates(blocks.html_blocks(pages)).join(source, "page_id")
    named = named.withColumns({"provider_slug": F.col("page_id").cast("string"), "country": F.lit("CN"), "hosts": validate.allowed_hosts(F.array("source_url")), "is_search": F.lit(False)})
    items = extract.extract(named, F.lit(2026)).withColumns({"hosts": validate.allowed_hosts(F.array("source_url")), "is_search": F.lit(False)})
    v = validate.verdict(items, 2026)
    return v.select(
        F.col("provider_slug").cast("long").alias("page_id"), F.col("title").alias("heading"), F.col("benefit_kind").alias("kind"), F.col("benefit_amount").alias("amount"), F.col("end_date").alias("until"),
        F.array_join("audience", ",").alias("who"), "category", "action", F.col("claim_url").alias("link"),
    )
