"""Feeds, search result pages, relay directories and settings as DataFrames, and the RSS sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import blank, decode_entities, escape_xml, let, normalize_url, strip_tags, url_host
from tidemark.sources.tables import spread


def feed_items(feeds: DataFrame) -> DataFrame:
    """(id, xml) of RSS or Atom -> id, pos, title, link, description."""
    items = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:item|entry)\b.*?</(?:item|entry)\s*>"), F.lit(0))
    rows = feeds.select("id", F.posexplode(items).alias("pos", "item"))

    def part(tags: str) -> Column:
        raw = F.regexp_extract("item", rf"(?is)<(?:{tags})\b[^>]*>(.*?)</(?:{tags})\s*>", 1)
        return strip_tags(decode_entities(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")))

    href = F.regexp_extract("item", r"""(?is)<link\b[^>]*href\s*=\s*["']([^"']+)""", 1)
    return rows.select("id", "pos", part("title").alias("title"), F.when(part("link") != "", part("link")).otherwise(href).alias("link"), part("description|summary|content").alias("description"))


def is_feed(html: Column) -> Column:
    """Whether a page is an RSS or Atom feed, by how it begins."""
    return F.substring(blank(html), 1, 300).rlike(r"(?i)<(?:rss|feed|rdf:RDF)\b")


def feed_pages(feeds: DataFrame) -> DataFrame:
    """(id, xml) -> id, html: each feed as a page of headings, texts and links, for whoever reads pages. A feed has as many items as its site shows."""
    i = feed_items(feeds)
    text = F.concat(F.lit("<h3>"), escape_xml(F.col("title")), F.lit("</h3><p>"), escape_xml(F.col("description")), F.lit(' <a href="'), escape_xml(F.col("link")), F.lit('">link</a></p>'))
    items = i.select("id", F.struct("pos", text.alias("t")).alias("x")).groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return items.select("id", F.concat(F.lit("<html><body>"), F.array_join(F.transform("xs", lambda x: x["t"]), ""), F.lit("</body></html>")).alias("html"))


def unwrap_redirect(href: Column, engine: str = "duckduckgo.com") -> Column:
    """The target of a search engine's redirect link; other http(s) links as they are, normal; else null."""

    def target(url: Column) -> Column:
        own = let(url_host(url), lambda host: (host == engine) | host.endswith("." + engine))
        return F.when(own, F.try_url_decode(F.nullif(F.regexp_extract(blank(url), r"[?&]uddg=([^&#]+)", 1), F.lit("")))).otherwise(url)

    full = let(href, lambda h: F.when(h.startswith("//"), F.concat(F.lit("https:"), h)).otherwise(h))
    return let(let(full, target), lambda out: F.when(out.rlike(r"(?i)^https?://"), normalize_url(out)))


def search_results(pages: DataFrame, most: int = 10) -> DataFrame:
    """(id, html) -> id, pos, title, url, snippet: result links and snippets paired by their places."""
    link = r"""(?is)<a\b[^>]*class\s*=\s*["'][^"']*result-link[^"']*["'][^>]*>.*?</a>"""
    links = F.regexp_extract_all("html", F.lit(link), F.lit(0))
    snippets = F.regexp_extract_all("html", F.lit(r"""(?is)<td\b[^>]*class\s*=\s*["'][^"']*result-snippet[^"']*["'][^>]*>(.*?)</td>"""), F.lit(1))
    href = lambda a: decode_entities(F.regexp_extract(a, r"""(?is)href\s*=\s*["']([^"']+)""", 1))
    # targets are part of the array, which is worked out once; as a column of their own the filter on them would work them out again
    led = F.transform(F.slice(links, 1, most), lambda a, k: F.struct(k.alias("pos"), a.alias("a"), unwrap_redirect(href(a)).alias("url")))
    rows = spread(pages.select("id", "html")).select("id", snippets.alias("snippets"), F.explode(F.filter(led, lambda x: x["url"].isNotNull())).alias("x")).select("id", "snippets", "x.*")
    return rows.select("id", "pos", strip_tags(decode_entities(F.col("a"))).alias("title"), "url", strip_tags(decode_entities(F.get("snippets", F.col("pos")))).alias("snippet"))


def rss_items(df: DataFrame, newest: int = 100) -> DataFrame:
    """The `newest` rows as escaped RSS items; parts of the description that are null are left out."""
    top = df.orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
    text = F.concat_ws(" ｜ ", "provider", "benefit", "deadline", "summary")
    item = F.concat(
        F.lit("<item><title>"), escape_xml(F.col("title")), F.lit("</title><link>"), escape_xml(F.col("link")), F.lit("</link><description>"), escape_xml(text),
        F.lit("</description><guid isPermaLink=\"false\">"), escape_xml(F.col("id").cast("string")), F.lit("</guid></item>"),
    )
    return top.select("id", item.alias("item"))


def rss(df: DataFrame, title: str, link: str, newest: int = 100) -> DataFrame:
    """One row with the whole feed: at most `newest` items."""
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><link>{link}</link>'
    ordered = rss_items(df.withColumn("_at", F.col("created_at")), newest)
    return ordered.agg(F.concat(F.lit(head), F.array_join(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda x: x["item"])), ""), F.lit("</channel></rss>")).alias("xml"))


RELAY = "id string, name string, homeUrl string, signupUrl string, tags array<string>, online boolean, latencyMs long, checkedAt string, models array<string>, bonus string"


def relays(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """JSON lists of relays, one path for each source, with the source's name and order."""
    out = None
    for k, (name, path) in enumerate(sources.items()):
        df = spark.read.schema(RELAY).json(path, multiLine=True, mode="PERMISSIVE").withColumns({"source": F.lit(name), "source_rank": F.lit(k)})
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], RELAY + ", source string, source_rank int")


def live_probes(raw: Column, probe: str) -> Column:
    """Probes in a JSON text: an array, an object's `probes`, or else its first array; none in anything else."""
    inner = F.from_json(raw, "map<string,string>")
    first = F.get(F.filter(F.map_values(inner), lambda v: v.rlike(r"^\s*\[")), F.lit(0))
    array = F.when(raw.rlike(r"^\s*\["), raw).otherwise(F.coalesce(F.get_json_object(raw, "$.probes"), first))
    return F.coalesce(F.from_json(array, f"array<{probe}>"), F.array().cast(f"array<{probe}>"))


def overlay_live(directory: DataFrame, live: DataFrame) -> DataFrame:
    """Live probes (id, online, latencyMs, checkedAt) laid over the directory where they say something."""
    l = live.select("id", *(F.col(c).alias(f"_{c}") for c in ("online", "latencyMs", "checkedAt")))  # noqa: E741
    joined = directory.join(l, "id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in ("online", "latencyMs", "checkedAt")}).select(*directory.columns)


def merge_by_host(df: DataFrame, rank: str, fill: list[str], tags: str | None = None, most_tags: int = 6, url: str = "url") -> DataFrame:
    """One row for each host: each column from the first row in `rank` that has it, the union of tags in order, the number of rows.

    min_by over ranks combines before the shuffle; only distinct tags are collected.
    """
    hosted = df.withColumn("host", F.regexp_replace(url_host(F.col(url)), r"^www\.", "")).where("host <> ''")
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(rank))).alias(c) for c in fill]
    out = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *aggs)
    if not tags:
        return out
    each = hosted.select("host", rank, F.posexplode(tags).alias("pos", "tag")).groupBy("host", "tag").agg(F.min(F.struct(rank, "pos")).alias("at"))
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("at")
    top = each.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most_tags)
    listed = top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "tag"))), lambda x: x["tag"]).alias("tags"))
    return out.join(listed, "host", "left")


def bonus_text(signup: Column, invite: Column, daily: Column) -> Column:
    def part(label: str, c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit(f"{label} $"), F.regexp_replace(c.cast("string"), r"\.0$", "")))

    return F.concat_ws(" · ", part("注册送", signup), part("邀请得", invite), part("每日签到", daily))


def settings(spark: SparkSession, *layers: dict) -> DataFrame:
    """Key and value of nested settings, later layers over earlier ones."""
    flat: dict[str, str] = {}

    def add(prefix: str, d: dict) -> None:
        for k, v in d.items():
            add(f"{prefix}{k}.", v) if isinstance(v, dict) else flat.update({prefix + k: None if v is None else str(v)})

    for layer in layers:
        add("", layer)
    return spark.createDataFrame(list(flat.items()), "key string, value string")
