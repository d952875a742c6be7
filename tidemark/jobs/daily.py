"""The daily run: crawled pages become items, items are merged into the catalogue, and what changed is told.

    pages -> snapshots -> blocks -> candidates -> items -> deduped -> linked -> judged -> merged

Each step is a function from DataFrames to a DataFrame, so that all up to the merge
is one plan. `run` writes: the judged items once, since merge, history and counts
all read them, then a new version of the catalogue, and what is appended to logs.
A run that dies leaves the old version; run again with its run_id it starts from
that version, and readers of the logs take the last rows of a run_id and key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import rules
from tidemark.functions.display import result_text
from tidemark.functions.text import blank, content_hash, local_today, normalize_url, strip_tags
from tidemark.operators import blocks, dedupe, extract, link, merge, model_output, validate
from tidemark.sources import feeds, tables

#: What an update takes from the new item, and what it takes only where the new item has it.
FIELDS = (
    "title", "summary", "category", "benefit_kind", "benefit_amount", "benefit_unit", "benefit_text", "audience", "audience_note", "region", "requires_card", "requires_verification",
    "start_date", "end_date", "is_recurring", "claim_url", "source_url", "source_excerpt", "confidence",
)
STICKY = ("model_id", "endpoint_id", "source_id", "hook", "how_to_claim", "caveat", "extracted_by")
#: The catalogue's table of offers.
OFFERS = (
    "id long, fingerprint string, provider_slug string, title string, summary string, category string, benefit_kind string, benefit_amount double, benefit_unit string, benefit_text string, "
    "audience array<string>, audience_note string, region string, requires_card boolean, requires_verification string, start_date string, end_date string, is_recurring string, "
    "claim_url string, source_url string, source_excerpt string, confidence double, hook string, how_to_claim string, caveat string, extracted_by string, source_id long, model_id long, endpoint_id long, review_status string, status_override string, "
    "archived_at timestamp, created_at timestamp, updated_at timestamp, last_verified_at timestamp"
)


@dataclass(frozen=True)
class Inputs:
    """Tables of a run.

    pages: source_id, url, status_code, html. sources: id, provider_slug, url, kind
    (page or search), perhaps scope (a selector). providers: slug, country, urls (its
    own addresses). aliases: provider_slug, entity_id (of a model), alias, ord.
    bases: base_id (an endpoint), base (its address), model_id. replies, where a
    language model read passages: source_id, title, context, reply.
    """

    pages: DataFrame
    sources: DataFrame
    providers: DataFrame
    aliases: DataFrame
    bases: DataFrame
    replies: DataFrame | None = None


def snapshots(pages: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """pages with ok, digest and `again`: the source's last good snapshot (source_id, run_id, digest) has the same text."""
    ok = F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    read = pages.withColumn("ok", ok).withColumn("digest", F.when(ok, content_hash(strip_tags(F.col("html")))))
    if before is None:
        return read.withColumn("again", F.lit(False))
    last = before.where("digest IS NOT NULL").groupBy(F.col("source_id").alias("_source")).agg(F.max_by("digest", "run_id").alias("_last"))
    met = read.join(last, F.col("source_id") == F.col("_source"), "left")
    return met.withColumn("again", F.coalesce(F.col("digest") == F.col("_last"), F.lit(False))).drop("_source", "_last")


def passages(read: DataFrame, sources: DataFrame, profile: rules.Profile = rules.OFFERS) -> DataFrame:
    """source_id, source_url, is_search, title, context, href: what good and new pages say that may be offers.

    Pages and feeds give their best passages, with the source's address as theirs;
    result pages of searches give each result, whose own address is its source.
    """
    has_scope = "scope" in sources.columns
    s = sources.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"), (F.col("kind") == "search").alias("is_search"), F.col("scope") if has_scope else F.lit(None).cast("string").alias("scope"))
    good = read.where("ok AND NOT again").select(F.col("source_id").cast("long").alias("source_id"), "url", "html").join(s, "source_id")
    plain, fed = (good.where(~F.col("is_search") & x) for x in (~feeds.is_feed(F.col("html")), feeds.is_feed(F.col("html"))))
    fed = fed.select("source_id", "url", "scope").join(feeds.feed_pages(fed.select(F.col("source_id").alias("id"), F.col("html").alias("xml"))).withColumnRenamed("id", "source_id"), "source_id")
    pages = plain.select("source_id", "url", "html", "scope").unionByName(fed)
    near = blocks.candidates(blocks.html_blocks(pages.withColumnRenamed("source_id", "page_id")), profile=profile)
    told = near.select(F.col("page_id").alias("source_id"), "title", "context", "href").join(s.drop("scope"), "source_id")
    results = feeds.search_results(good.where("is_search").select(F.col("source_id").alias("id"), "html"))
    seen = results.select(F.col("id").alias("source_id"), "title", result_text(F.col("title"), F.col("snippet")).alias("context"), F.col("url").alias("href"), F.col("url").alias("source_url"), F.lit(True).alias("is_search"))
    return told.unionByName(seen)


def found_items(read: DataFrame, inputs: Inputs, year: Column, profile: rules.Profile = rules.OFFERS) -> DataFrame:
    """Items of pages that are good and new, in normal form and without repeats; what a model extracted stands beside what rules did, and the better one stays."""
    of = inputs.sources.select(F.col("id").alias("source_id"), "provider_slug")
    p = inputs.providers.select(F.col("slug").alias("provider_slug"), "country", F.col("urls").alias("_urls"))
    hosts = validate.allowed_hosts(F.concat("_urls", F.array("source_url")))
    hosted = passages(read, inputs.sources, profile).join(of, "source_id").join(p, "provider_slug").withColumn("hosts", hosts)
    items = extract.extract(hosted, year, profile, ("is_search",)).withColumn("extracted_by", F.when(F.col("is_search"), "search").otherwise("rule")).drop("is_search")
    if inputs.replies is not None:
        s = inputs.sources.select(F.col("id").alias("source_id"), "provider_slug", F.col("url").alias("source_url"))
        asked = inputs.replies.join(read.where("ok AND NOT again").select("source_id"), "source_id", "left_semi").join(s, "source_id").join(p, "provider_slug").withColumn("hosts", hosts)
        items = items.unionByName(model_output.items_from_replies(asked, year), allowMissingColumns=True)
    placed = dedupe.normalize_items(items).withColumn("ord", F.xxhash64("fingerprint", "source_url", "title", "confidence", "extracted_by"))
    return dedupe.dedupe(placed).drop("ord", "quality")


def entity_links(items: DataFrame, inputs: Inputs) -> DataFrame:
    """fingerprint, endpoint_id, model_id: by an API address in the item's text, else by a model's name, else by a version that only one model has."""
    text = F.concat_ws(" ", "title", "summary", "benefit_text")
    t = items.select(F.col("fingerprint").alias("id"), "provider_slug", text.alias("text"), F.concat_ws(" ", text, "source_excerpt").alias("more"))
    urls = t.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(https?://[^\s，。；、)）\]\"'<>]+)"), F.lit(1))).alias("pos", "url"))
    by_url = link.url_prefix(urls, inputs.bases.select("base_id", "base")).join(inputs.bases.select("base_id", "model_id"), "base_id").select("id", F.col("model_id").alias("entity_id"), F.col("base_id").alias("endpoint_id"))
    by_name = link.longest_alias(t.select("id", "provider_slug", "text"), inputs.aliases, "provider_slug").select("id", "entity_id")
    by_version = link.unique_version(t.select("id", F.col("more").alias("text")), inputs.aliases.select("entity_id", F.col("alias").alias("name")).distinct()).select("id", "entity_id")
    best = link.by_evidence(by_url, by_name, by_version)
    return best.select(F.col("id").alias("fingerprint"), "endpoint_id", F.col("entity_id").alias("model_id"))


def judged_items(items: DataFrame, inputs: Inputs, year: int, profile: rules.Profile = rules.OFFERS) -> DataFrame:
    """Linked items with their verdict; `review_status` is auto_ok or pending, null where they are rejected."""
    s = inputs.sources.groupBy(F.col("url").alias("_url")).agg(F.min("id").alias("source_id"), F.max(F.col("kind") == "search").alias("is_search"))
    p = inputs.providers.select(F.col("slug").alias("_slug"), F.col("urls").alias("_urls"))
    full = items.join(s, F.col("source_url") == F.col("_url"), "left").join(p, F.col("provider_slug") == F.col("_slug"), "left")
    full = full.withColumn("is_search", F.coalesce("is_search", F.col("extracted_by") == "search")).withColumn("hosts", validate.allowed_hosts(F.concat(F.coalesce("_urls", F.array().cast("array<string>")), F.array("source_url"))))
    full = full.join(entity_links(items, inputs), "fingerprint", "left")
    verdict = validate.verdict(full, year, profile)
    return verdict.withColumn("review_status", F.when(F.col("action") != "reject", F.col("action"))).drop("_url", "_slug", "_urls", "hosts", "is_search")


def merged(offers: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """The catalogue after the items (judged; rejected ones are no items), with `change`."""
    new = items.where("review_status IS NOT NULL")
    keep = [c for c in offers.columns if c in new.columns]
    return merge.upsert(offers, new.select(*keep), "fingerprint", FIELDS, as_of, STICKY, "id")


def field_changes(offers: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """What the merge changes in offers that are there: offer_id, field, old_value, new_value, changed_by, changed_at."""
    new = items.where("review_status IS NOT NULL")
    text = lambda df: df.withColumns({"audience": F.array_join(F.array_sort("audience"), ","), "claim_url": normalize_url(blank(F.col("claim_url")))})
    told = merge.changes(text(offers), text(new), "fingerprint", FIELDS).join(offers.select("fingerprint", F.col("id").alias("offer_id")), "fingerprint")
    return told.select("offer_id", "field", "old_value", "new_value", F.lit("crawl").alias("changed_by"), as_of.alias("changed_at"))


def run_row(read: DataFrame, judged: DataFrame, after: DataFrame, run_id: int, as_of: Column) -> DataFrame:
    """One row: id, started_at, status, sources, what was found, rejected, inserted and updated."""
    s = read.groupBy("source_id").agg(F.max("ok").alias("ok"), F.min("again").alias("again")).agg(F.count(F.lit(1)).alias("sources_total"), F.count_if("ok").alias("sources_ok"), F.count_if("again").alias("sources_unchanged"))
    j = judged.agg(F.count(F.lit(1)).alias("items_found"), F.count_if(F.col("review_status").isNull()).alias("items_rejected"), F.count_if(F.col("review_status") == "pending").alias("items_pending"))
    a = after.agg(F.count_if(F.col("change") == "insert").alias("items_new"), F.count_if(F.col("change") == "update").alias("items_updated"))
    status = F.when(F.col("sources_ok") == 0, "failed").when(F.col("sources_ok") < F.col("sources_total"), "partial").otherwise("ok")
    return s.join(F.broadcast(j)).join(F.broadcast(a)).select(F.lit(run_id).cast("long").alias("id"), as_of.alias("started_at"), status.alias("status"), *s.columns, *j.columns, *a.columns)  # rows of one each


def open_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of the offers; a new folder gets an empty one."""
    if not tables.has_version(spark, f"{folder}/offers"):
        tables.write_version(spark.createDataFrame([], OFFERS), f"{folder}/offers")
    return tables.read_version(spark, f"{folder}/offers")


def run(spark: SparkSession, folder: str, inputs: Inputs, run_id: int, at: str, profile: rules.Profile = rules.OFFERS, archive_after: int = 30) -> DataFrame:
    """One run over the catalogue in `folder`, as of the time `at` (UTC); returns its row.

    Writes offers (a version), snapshots, history and runs (appended by run_id).
    """
    as_of = F.lit(at).cast("timestamp")
    year = int(at[:4])
    before = open_catalogue(spark, folder)
    seen = tables.logged(spark, f"{folder}/snapshots")
    seen = seen.where(F.col("run_id") < run_id) if seen is not None else None
    read = tables.kept(snapshots(inputs.pages, seen), f"{folder}/runs-work/read-{run_id}")
    judged = tables.kept(judged_items(found_items(read, inputs, F.lit(year), profile), inputs, year, profile), f"{folder}/runs-work/judged-{run_id}")
    after = tables.kept(merged(before, judged, as_of), f"{folder}/runs-work/merged-{run_id}")
    tables.append(field_changes(before, judged, as_of).withColumn("run_id", F.lit(run_id).cast("long")), f"{folder}/history")
    tables.append(read.select("source_id", "url", "ok", "digest", F.lit(run_id).cast("long").alias("run_id")), f"{folder}/snapshots")
    tables.write_version(merge.archive(after.drop("change"), local_today(as_of), as_of, archive_after), f"{folder}/offers")
    done = tables.kept(run_row(read, judged, after, run_id, as_of), f"{folder}/runs-work/row-{run_id}")
    tables.append(done, f"{folder}/runs")
    return done


def follow(pages: DataFrame, folder: str, inputs: Inputs, checkpoint: str, at: str | None = None, **how) -> StreamingQuery:
    """Runs over a stream of pages (source_id, url, status_code, html): what has come since the last time, one run a batch, then stop.

    A batch's number is its run's, so that a batch that is tried again is the same
    run. `inputs.pages` is not read. `at` is for tests; otherwise each run is as
    of when it starts.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = at or spark.sql("SELECT date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'yyyy-MM-dd HH:mm:ss')").first()[0]
        run(spark, folder, Inputs(batch, inputs.sources, inputs.providers, inputs.aliases, inputs.bases), number + 1, now, **how)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
