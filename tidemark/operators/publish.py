"""What leaves the catalogue: guides, subscription matches and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blank, plain_number
from tidemark.operators.dedupe import best_first


def topic(provider: Column, amount: Column, unit: Column, kind: Column, client_only: Column) -> Column:
    """Guides about the same benefit of the same provider are one, however many sites report it."""
    what = F.when(amount.isNotNull(), F.concat_ws(" ", plain_number(amount), blank(unit))).otherwise(blank(kind))
    return F.concat_ws("::", provider, what, F.when(client_only, "client").otherwise("api"))


def client_only(*fields: Column) -> Column:
    """Whether an offer holds in a client application only, not for API keys."""
    text = F.concat_ws(" ", *fields)
    place = text.rlike(r"(?i)客户端|桌面端|桌面版|插件|IDE|CLI|app内|app 内")
    bound = text.rlike(r"(?i)仅限|只能|仅在|不可用于\s*API|不支持\s*API") | text.rlike(r"领取|领|赠送|免费")
    return place & bound


def key_limit(card: Column, only_client: Column, cn: Column, rpm: Column, rpd: Column) -> Column:
    limits = F.concat_ws(", ", F.when(rpm.isNotNull(), F.concat(rpm.cast("string"), F.lit(" requests a minute"))), F.when(rpd.isNotNull(), F.concat(rpd.cast("string"), F.lit(" requests a day"))))
    return (
        F.when(card, "needs a payment card").when(only_client, "within the client only").when(~cn, "not reachable from mainland China")
        .when(limits != "", limits).otherwise("see the provider's terms")
    )


def guide_topics(items: DataFrame, known_slugs: DataFrame | None = None, known_topics: DataFrame | None = None, least: float = 0.75, most: int = 50) -> DataFrame:
    """The `most` surest offers (id, provider, topic, confidence, archived_at), without those that have a guide; the first of each topic."""
    top = items.where((F.col("confidence") >= least) & F.col("archived_at").isNull()).orderBy(F.desc("confidence"), "id").limit(most)
    drafts = top.withColumn("slug", F.concat_ws("-", F.lit("auto"), "provider", F.col("id").cast("string")))
    for known, c in ((known_slugs, "slug"), (known_topics, "topic")):
        if known is not None:
            drafts = drafts.join(known.select(c), c, "left_anti")
    return best_first(drafts, ["topic"], -F.col("confidence"), F.col("id"))


def guide_body(parts: list[tuple[str, Column]]) -> Column:
    """Bullets with a label; parts that are null are left out."""
    return F.concat_ws("\n", *(F.when(c.isNotNull(), F.concat(F.lit(f"- {label}: "), c.cast("string"))) for label, c in parts))


def guide_sections(sections: Column) -> Column:
    """sections (heading, title, body, items, code) as (title, body), items as bullets and code fenced."""
    def one(s: Column) -> Column:
        items = F.array_join(F.transform(F.coalesce(s["items"], F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n")
        code = F.when(blank(s["code"]) != "", F.concat(F.lit("```\n"), s["code"], F.lit("\n```")))
        body = F.concat_ws("\n", F.nullif(blank(s["body"]), F.lit("")), F.nullif(items, F.lit("")), code)
        return F.struct(F.coalesce(s["title"], s["heading"]).alias("title"), body.alias("body"))

    return F.transform(sections, one)


def _spread(subscriptions: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides by (provider, category) where each filter's values or "any" stand, so that they meet by equality."""
    def values(c: str) -> Column:
        f = F.coalesce(F.col(f"filters.{c}"), F.array().cast("array<string>"))
        return F.when(F.size(f) > 0, F.array_distinct(f)).otherwise(F.array(F.lit("*")))

    def either(c: Column) -> Column:
        return F.array(c, F.lit("*"))

    subs = subscriptions.select("sub_id", values("providers").alias("p"), values("categories").alias("c"), values("audience").alias("a"))
    subs = subs.withColumn("provider", F.explode("p")).withColumn("category", F.explode("c")).select("sub_id", "provider", "category", "a")
    return subs, items.withColumn("provider", F.explode(either(F.col("provider")))).withColumn("category", F.explode(either(F.col("category"))))


_HEARD = "array_contains(a, '*') OR arrays_overlap(a, audience)"


def matches(subscriptions: DataFrame, items: DataFrame) -> DataFrame:
    """subscriptions (sub_id, filters) x items (id, provider, category, audience) -> sub_id, id.

    An empty filter passes everything. A subscription meets an item under one
    pair of values only, so that nothing comes twice. Those that filter neither
    provider nor category take every item: they are dealt to as many tasks as
    Spark scans items in, for they are what has to be sent, not a join's key.
    """
    subs, spread = _spread(subscriptions, items.select("id", "provider", "category", "audience"))
    open_to_all = (F.col("provider") == "*") & (F.col("category") == "*")
    met = subs.where(~open_to_all).join(spread.where(~open_to_all), ["provider", "category"]).where(_HEARD).select("sub_id", "id")
    listed = subs.where(open_to_all).select("sub_id", "a")
    every = items.select("id", "audience").join(listed, F.array_contains("a", "*") | F.arrays_overlap("a", "audience"))
    return met.unionByName(every.select("sub_id", "id"))


def match_counts(subscriptions: DataFrame, items: DataFrame) -> DataFrame:
    """sub_id, n: how many items each subscription gets, none left out. Items are counted before they meet subscriptions."""
    subs, spread = _spread(subscriptions, items.groupBy("provider", "category", "audience").agg(F.count(F.lit(1)).alias("n")))
    counted = spread.groupBy("provider", "category", "audience").agg(F.sum("n").alias("n"))
    return subs.join(counted, ["provider", "category"]).where(_HEARD).groupBy("sub_id").agg(F.sum("n").alias("n"))


def messages(matched: DataFrame, items: DataFrame, lines: int = 3) -> DataFrame:
    """One message a subscription: how many offers, their ids, and the titles of the first `lines`."""
    named = matched.join(items.select("id", "title"), "id")
    grouped = named.groupBy("sub_id").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("x"), F.count(F.lit(1)).alias("count"))
    body = F.array_join(F.transform(F.slice("x", 1, lines), lambda i: i["title"]), "\n")
    title = F.when(F.col("count") == 1, F.get("x", F.lit(0))["title"]).otherwise(F.concat(F.col("count").cast("string"), F.lit(" new offers")))
    return grouped.select("sub_id", "count", title.alias("title"), body.alias("body"), F.transform("x", lambda i: i["id"]).alias("ids"))


def page_list(page: Column, pages: Column) -> Column:
    """The pages that a pager shows: the first, the last, and two on either side."""
    near = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: page + d)
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(1), pages), near), lambda p: (p >= 1) & (p <= pages))))


def render_markdown(body: Column) -> Column:
    """Paragraphs, lists, quotes, bold and code of a Markdown text as HTML, escaped first."""
    from tidemark.functions.text import escape_xml

    def inline(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), "`([^`]+)`", "<code>$1</code>")

    def block(b: Column) -> Column:
        lines = F.split(b, "\n")

        def listed(tag: str, mark: str) -> Column:
            rows = F.transform(lines, lambda x: F.concat(F.lit("<li>"), F.regexp_replace(x, mark, ""), F.lit("</li>")))
            return F.concat(F.lit(f"<{tag}>"), F.array_join(rows, ""), F.lit(f"</{tag}>"))

        quote = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^&gt;\s?", "")), "<br>")
        return inline(
            F.when(F.forall(lines, lambda x: x.rlike(r"^\s*[-*]\s+")), listed("ul", r"^\s*[-*]\s+"))
            .when(F.forall(lines, lambda x: x.rlike(r"^\s*\d+\.\s+")), listed("ol", r"^\s*\d+\.\s+"))
            .when(F.forall(lines, lambda x: x.startswith("&gt;")), F.concat(F.lit("<blockquote>"), quote, F.lit("</blockquote>")))
            .otherwise(F.concat(F.lit("<p>"), F.replace(b, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
        )

    blocks = F.filter(F.split(F.trim(escape_xml(body)), r"\n\s*\n"), lambda b: F.trim(b) != "")
    return F.array_join(F.transform(blocks, block), "")
