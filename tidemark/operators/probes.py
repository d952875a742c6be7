"""Candidate pages of a provider's site: what they are, which are the same page, and which are worth a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import blank, strip_tags, url_host
from tidemark.operators.crawl import same_site

#: Visible characters that make a page more than an empty shell.
LEAST_TEXT = 400


def probed(pages: DataFrame, least: int = LEAST_TEXT) -> DataFrame:
    """pages (..., status_code, html) with text_len, body_hash (null without text), ok and shell.

    A page is ok if it answered and shows enough text; one that answered with less is a shell.
    """
    answered = F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    shown = pages.withColumn("_shown", F.when(answered, strip_tags(F.col("html"))).otherwise(""))
    n = F.length("_shown")
    return shown.withColumns({
        "text_len": n, "body_hash": F.when(n > 0, F.substring(F.sha2("_shown", 256), 1, 16)), "ok": answered & (n >= least), "shell": answered & (n < least),
    }).drop("_shown")


def final_key(url: Column) -> Column:
    """Host without www and path without a trailing slash; the text itself where it is no address."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(blank(url), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path))).otherwise(blank(url))


def distinct_pages(probes: DataFrame, site: str, order: str) -> DataFrame:
    """probes (site, order, final_url, url, body_hash, ok) with duplicate_of: the first ok page of the site with this final address, else with this text.

    Only pages that are no duplicates themselves count as first, so that a site's
    pages are taken one after the other; a site has as many as there are paths to
    try, and they are folded as one array.
    """
    p = probes.withColumn("_key", final_key(F.coalesce("final_url", "url")))
    row = F.struct(F.col(order).alias("at"), F.col("_key").alias("key"), F.col("body_hash").alias("hash"), F.col("url"), F.col("ok"))
    kept = "array<struct<at:bigint,key:string,hash:string,url:string,of:string>>"

    def step(state: Column, x: Column) -> Column:
        firsts = F.filter(state, lambda y: y["of"].isNull())
        by_key = F.filter(firsts, lambda y: y["key"] == x["key"])
        by_hash = F.filter(firsts, lambda y: y["hash"] == x["hash"])
        of = F.coalesce(F.get(by_key, F.lit(0))["url"], F.get(by_hash, F.lit(0))["url"])
        return F.concat(state, F.array(F.struct(x["at"].cast("long").alias("at"), x["key"].alias("key"), x["hash"].alias("hash"), x["url"].alias("url"), of.alias("of"))))

    sites = p.where("ok").groupBy(site).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    folded = sites.select(site, F.explode(F.aggregate("rows", F.array().cast(kept), step)).alias("x"))
    found = folded.where("x.of IS NOT NULL").select(F.col(site).alias("_site"), F.col("x.at").alias("_at"), F.col("x.of").alias("duplicate_of"))
    return p.drop("_key").join(found, (F.col(site) == F.col("_site")) & (F.col(order) == F.col("_at")), "left").drop("_site", "_at")


def proposed(candidates: DataFrame, homepages: DataFrame, site: str, order: str) -> DataFrame:
    """Probed addresses that were proposed for a site, with catch_all and usable.

    An address that shows what the homepage (site, body_hash) shows, or what an
    earlier proposal shows, is answered by a catch-all page.
    """
    home = homepages.select(F.col(site).alias("_site"), F.col("body_hash").alias("_home")).where("_home IS NOT NULL").dropDuplicates(["_site"])
    met = candidates.join(home, F.col(site) == F.col("_site"), "left")
    again = F.row_number().over(Window.partitionBy(site, "body_hash").orderBy(order)) > 1
    catch_all = F.col("body_hash").isNotNull() & (again | F.coalesce(F.col("body_hash") == F.col("_home"), F.lit(False)))
    return met.withColumn("catch_all", catch_all).withColumn("usable", F.col("ok") & ~F.col("catch_all")).drop("_site", "_home")


def owned(probes: DataFrame, origin: str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """probes (final_url, origin) with `own`: they end on the provider's site, or on a host that is known to be its blog."""
    host = lambda c: F.regexp_replace(url_host(F.col(c)), r"^www\.", "")
    own = same_site(F.col("final_url"), F.col(origin))
    for end, hosts in (aliases or {}).items():
        own = own | (host(origin).endswith(end) & host("final_url").isin(*hosts))
    return probes.withColumn("own", F.coalesce(own, F.lit(False)))
