"""Normalising items and two rounds of dedupe: by fingerprint, then by provider, link and benefit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blank, fingerprint, normalize_date, normalize_url


def best_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first in `order`; combined before the shuffle, so that a hot key stays small."""
    row = F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), F.struct(*df.columns).alias("row"))
    return df.groupBy(*keys).agg(F.min(row)["row"].alias("row")).select("row.*")


def normalize_items(items: DataFrame, plain: bool = False) -> DataFrame:
    """Defaults, length limits, dates in order, fingerprint. `plain`: titles need no compatibility form."""
    start, end = normalize_date(F.col("start_date")), normalize_date(F.col("end_date"))
    swap = end < start
    df = items.withColumns({
        "title": F.substring(blank(F.col("title")), 1, 150), "summary": F.substring("summary", 1, 200), "source_excerpt": F.substring("source_excerpt", 1, 500),
        "claim_url": F.coalesce("claim_url", "source_url", F.lit("")), "start_date": F.when(swap, end).otherwise(start), "end_date": F.when(swap, start).otherwise(end),
        "audience": F.when(F.size(F.coalesce("audience", F.array().cast("array<string>"))) > 0, F.array_sort("audience")).otherwise(F.array(F.lit("all"))),
    })
    return df.withColumn("fingerprint", fingerprint(F.col("provider_slug"), F.col("title"), F.col("claim_url"), F.col("start_date"), plain))


def quality(confidence: Column, kind: Column, amount: Column, start: Column, end: Column, claim: Column, source: Column, audience: Column, summary: Column, title: Column) -> Column:
    """How much an item tells: the better of two equals stays."""
    t = blank(title)
    points = F.coalesce(confidence, F.lit(0.0)) * 10
    for hit, weight in (
        (blank(kind) != "", 5), (amount.isNotNull(), 3), (blank(start) != "", 2), (blank(end) != "", 2),
        ((blank(claim) != "") & (blank(source) != "") & (claim != normalize_url(source)), 3), (F.get(audience, F.lit(0)) != "all", 1), (blank(summary) != "", 1),
        (F.length(t).between(8, 60), 2), (~t.rlike("[，。；、]$"), 1), (t.rlike("有效期|过期作废|共享消耗|资源包|不结转"), -3),
    ):
        points = points + F.when(hit, weight).otherwise(0)
    return F.round(points, 6)


def dedupe(items: DataFrame, order: str = "ord") -> DataFrame:
    """items with fingerprint and a unique `order` -> the best of each; ties keep the first in order.

    A survivor carries the first place of its key, so that the second round
    breaks ties by where the first one put each item.
    """
    q = quality(*(F.col(c) for c in ("confidence", "benefit_kind", "benefit_amount", "start_date", "end_date", "claim_url", "source_url", "audience", "summary", "title")))
    scored = items.withColumn("quality", q)
    once = scored.groupBy("fingerprint").agg(
        F.min(F.struct((-F.col("quality")).alias("q"), F.col(order).alias("o"), F.struct(*scored.columns).alias("row"))).alias("best"), F.min(order).alias("place")
    ).select("best.row.*", "place")
    anchored = (F.length(blank(F.col("claim_url"))) > 12) | F.col("benefit_amount").isNotNull()
    near = F.concat_ws(
        "|", F.lower(blank(F.col("provider_slug"))), normalize_url(F.col("claim_url")), blank(F.col("benefit_kind")), F.coalesce(F.col("benefit_amount").cast("string"), F.lit("")), blank(F.col("benefit_unit"))
    )
    keyed = once.withColumn("near_key", F.when(anchored, near).otherwise(F.concat_ws("|", "fingerprint", near)))
    return best_first(keyed, ["near_key"], -F.col("quality"), F.col("place")).drop("place", "near_key")
