"""Crawl bookkeeping: robots rules, body and redirect dedupe, failure streaks, breakers, retries, page relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import blank, strip_tags, url_host


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """robots (host, text) -> host, allow, path: the rules of the group that names the agent, else of *.

    Every User-agent line opens a group of its own.
    """
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    rows = robots.select("host", F.posexplode(lines).alias("pos", "line")).where("line <> ''")
    field, value = F.lower(F.trim(F.regexp_extract("line", r"^([^:]+):", 1))), F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1))
    rows = rows.select("host", "pos", field.alias("field"), value.alias("value"))
    w = Window.partitionBy("host").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("group", F.last(F.when(F.col("field") == "user-agent", F.lower("value")), ignorenulls=True).over(w))
    own = F.lit(agent.lower()).contains(F.col("group")) & (F.col("group") != "*") & (F.col("group") != "")
    rows = rows.withColumn("kind", F.when(own, 0).when(F.col("group") == "*", 1)).where("kind IS NOT NULL")
    least = F.min("kind").over(Window.partitionBy("host"))
    rows = rows.withColumn("best", least).where("kind = best AND field IN ('allow', 'disallow') AND value <> ''")
    return rows.select("host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) with `allowed`: the longest rule that begins the path decides, ties and no rule allow.

    The path's prefixes of the lengths that its host's rules have meet the rules by equality on host and path.
    """
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z][^:]*://[^/?#]*", ""), "#.*$", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    cut = urls.select("url").distinct().select("url", url_host(F.col("url")).alias("host"), path.alias("p"))
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    fitting = F.filter("lengths", lambda n: n <= F.length("p"))
    cut = cut.join(lengths, "host").select("url", "host", F.explode(F.transform(fitting, lambda n: F.substring(F.col("p"), F.lit(1), n))).alias("path"))
    best = cut.join(rules, ["host", "path"]).groupBy("url").agg(F.max(F.struct(F.length("path").alias("n"), "allow"))["allow"].alias("_a"))
    return urls.join(best, "url", "left").withColumn("allowed", F.coalesce("_a", F.lit(True))).drop("_a")


def catch_all(probes: DataFrame, least: int = 2) -> DataFrame:
    """probes (host, body_hash, ok) with `catch_all`: the host gives the same body to `least` or more addresses."""
    n = probes.where("ok").groupBy("host", "body_hash").agg(F.count(F.lit(1)).alias("_n"))
    return probes.join(n, ["host", "body_hash"], "left").withColumn("catch_all", F.col("ok") & (F.coalesce("_n", F.lit(0)) >= least)).drop("_n")


def first_of(probes: DataFrame, order: str, *keys: str) -> DataFrame:
    """probes with `duplicate`: an earlier row has the same value in any of the keys."""
    out, dup = probes, F.lit(False)
    for k in keys:
        first = probes.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_first_{k}"))
        out = out.join(first, k, "left")
        dup = dup | F.coalesce(F.col(order) > F.col(f"_first_{k}"), F.lit(False))
    return out.withColumn("duplicate", dup).select(*probes.columns, "duplicate")


def failure_streaks(attempts: DataFrame, source: str, order: list[str], failed: Column, alert_at: int = 5) -> DataFrame:
    """attempts with `streak`, the failures in a row up to each one, and `alert`: streak >= alert_at."""
    w = Window.partitionBy(source).orderBy(*order)
    marked = attempts.withColumn("_bad", F.coalesce(failed, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w))
    inner = Window.partitionBy(source, "_island").orderBy(*order)
    streak = F.sum(F.when(F.col("_bad"), 1).otherwise(0)).over(inner)
    return marked.withColumn("streak", streak.cast("long")).withColumn("alert", F.col("streak") >= alert_at).drop("_bad", "_island")


def breaker(attempts: DataFrame, run: str, order: list[str], failed: Column, trips_at: int = 3) -> DataFrame:
    """attempts with `skipped`: within the run, `trips_at` failures in a row came before."""
    streaks = failure_streaks(attempts, run, order, failed, trips_at)
    before = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return streaks.withColumn("skipped", F.coalesce(F.max("alert").over(before), F.lit(False))).drop("streak", "alert")


def retry_plan(calls: DataFrame, status: Column, attempts: int = 4, base_ms: int = 1000) -> DataFrame:
    """One row for each attempt that a call may need: network errors (null), 429 and 5xx are retried with doubled waits."""
    again = status.isNull() | (status == 429) | (status >= 500)
    n = F.when(again, attempts).otherwise(1)
    numbered = calls.withColumn("attempt", F.explode(F.sequence(F.lit(1), n)))
    return numbered.withColumn("wait_ms", F.when(F.col("attempt") == 1, 0).otherwise(base_ms * F.pow(F.lit(2), F.col("attempt") - 2)).cast("long"))


def page_names(html: Column) -> tuple[Column, Column]:
    """The title and the first main heading."""
    return tuple(strip_tags(F.regexp_extract(blank(html), rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1), scripts=False) for t in ("title", "h1"))


def relevant(html: Column, names: Column, slug: Column, aliases: Column, platform_words: tuple[str, ...] = ()) -> Column:
    """Whether title or heading names the provider: a name, a long part of its slug, or an alias."""
    head = F.lower(F.concat_ws(" ", *page_names(html)))
    parts = F.filter(F.split(F.lower(slug), "-"), lambda p: (F.length(p) >= 5) & ~p.isin(*platform_words) if platform_words else F.length(p) >= 5)
    terms = F.filter(F.concat(F.transform(F.concat(names, aliases), F.lower), parts), lambda t: F.length(t) >= 2)
    return F.coalesce(F.exists(terms, lambda t: head.contains(t)), F.lit(False))


def same_site(url: Column, origin: Column) -> Column:
    """Same host, one below the other, or the same last two labels."""
    a, b = (F.regexp_replace(url_host(x), r"^www\.", "") for x in (url, origin))
    root = lambda h: F.substring_index(h, ".", -2)
    return (a != "") & ((a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)) | (root(a) == root(b)))


def is_challenge(html: Column) -> Column:
    """A page that asks for proof of a human, or a search page without results."""
    h = F.lower(blank(html))
    asks = h.rlike(r"captcha|anomaly|are you a human|unusual traffic|cf-challenge|robot check")
    return asks | (~h.contains("result") & (F.length(h) < 20000) & ~h.contains("<table"))
