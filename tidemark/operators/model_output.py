"""What a language model extracted: its JSON checked against the source and brought into the form of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blank, clean_text, normalize_date, normalize_url, url_host
from tidemark.operators.extract import loose_json

#: The fields that a reply may have.
SCHEMA = (
    "title string, hook string, howToClaim string, caveat string, summary string, category string, benefitKind string, benefitAmount string, benefitUnit string, benefitText string, "
    "audience array<string>, audienceNote string, startDate string, endDate string, isRecurring string, requiresCard boolean, requiresVerification string, claimUrl string, "
    "sourceExcerpt string, region string, confidence string, fieldConfidence struct<title:double,benefit:double,claimUrl:double>"
)
#: Confidence that is lost where the model was unsure of a field, and where no link is left.
UNSURE, CUTS, NO_LINK = 0.6, {"title": 0.25, "benefit": 0.15, "claimUrl": 0.15}, 0.1


def allowed_link(link: Column, source_url: Column, hosts: Column) -> Column:
    """The link in normal form if it stays on the source's host or leads to an allowed host or below it."""
    host = url_host(link)
    fits = (host == url_host(source_url)) | F.exists(hosts, lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))
    return F.when((host != "") & fits, normalize_url(link))


def lowered(confidence: Column, sure: Column, link: Column) -> Column:
    """0 to 1, two decimals: less for each field under UNSURE, and for a missing link; fields without a figure count as sure."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    out = unit(F.coalesce(confidence.try_cast("double"), F.lit(0.5)))
    for name, cut in CUTS.items():
        out = out - F.when(F.coalesce(sure[name], F.lit(1.0)) < UNSURE, cut).otherwise(0.0)
    return F.round(unit(out - F.when(link.isNull(), NO_LINK).otherwise(0.0)), 2)


def items_from_replies(replies: DataFrame, year: Column) -> DataFrame:
    """replies (reply, provider_slug, country, source_url, hosts, title, context) -> items; replies that hold no JSON object are left out.

    title and context are those of the candidate, and stand in for what the reply leaves open.
    """
    read = replies.withColumn("_r", loose_json(F.col("reply"), SCHEMA)).where("_r IS NOT NULL")
    r = lambda f: F.col(f"_r.{f}")
    short = lambda f, n: F.nullif(F.substring(clean_text(r(f)), 1, n), F.lit(""))
    said = lambda f: F.nullif(blank(r(f)), F.lit(""))
    linked = read.withColumn("_link", allowed_link(r("claimUrl"), F.col("source_url"), F.col("hosts")))
    named = F.coalesce(said("title"), F.nullif(blank(F.col("title")), F.lit("")), F.lit(""))
    kind = said("benefitKind")
    amount = r("benefitAmount").try_cast("double")
    return linked.select(
        "provider_slug", F.coalesce(F.nullif(F.substring(clean_text(named), 1, 150), F.lit("")), F.lit("untitled")).alias("title"), short("hook", 120).alias("hook"), short("howToClaim", 120).alias("how_to_claim"),
        short("caveat", 120).alias("caveat"), short("summary", 200).alias("summary"), F.coalesce(said("category"), F.lit("free_credit")).alias("category"), kind.alias("benefit_kind"),
        F.when(kind.isNotNull() & ~F.isnan(amount) & (F.abs(amount) < float("inf")), amount).alias("benefit_amount"), F.when(kind.isNotNull(), said("benefitUnit")).alias("benefit_unit"),
        F.when(kind.isNotNull(), short("benefitText", 80)).alias("benefit_text"), F.when(F.size(r("audience")) > 0, r("audience")).otherwise(F.array(F.lit("all"))).alias("audience"),
        said("audienceNote").alias("audience_note"), normalize_date(r("startDate"), year).alias("start_date"), normalize_date(r("endDate"), year).alias("end_date"), said("isRecurring").alias("is_recurring"),
        F.coalesce(r("requiresCard"), F.lit(False)).alias("requires_card"), said("requiresVerification").alias("requires_verification"), F.col("_link").alias("claim_url"), "source_url",
        F.substring(clean_text(F.coalesce(said("sourceExcerpt"), F.col("context"))), 1, 500).alias("source_excerpt"),
        F.coalesce(said("region"), F.when(F.col("country") == "CN", "CN").otherwise("GLOBAL")).alias("region"), lowered(r("confidence"), r("fieldConfidence"), F.col("_link")).alias("confidence"),
        F.lit("llm").alias("extracted_by"),
    )
