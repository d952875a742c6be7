"""Everything about one thing, for all things at once: offers, runs, models, endpoints and providers with what belongs to them.

A single detail page is a filter on these; Spark pushes it to where the key is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.listing import published, status_rank

FAR = "9999-12-31"


def _first(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The `most` first rows of each key, with their place."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_at") <= most)


def _listed(df: DataFrame, by: str, place: str, fields: list[str], name: str) -> DataFrame:
    """One array of structs for each key, in the order of `place`."""
    rows = F.array_sort(F.collect_list(F.struct(place, *fields)))
    return df.groupBy(by).agg(F.transform(rows, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))


def offer_details(offers: DataFrame, history: DataFrame, most_changes: int = 50, most_related: int = 6) -> DataFrame:
    """Offers with `history` (newest first) and `related`: ids of published offers of the same provider, the soonest to end first."""
    changes = _first(history, ["offer_id"], [F.desc("changed_at"), F.desc("id")], most_changes)
    told = _listed(changes.withColumnRenamed("offer_id", "_offer"), "_offer", "_at", ["field", "old_value", "new_value", "changed_by", "changed_at"], "history")
    order = [F.coalesce(F.col("end_date").cast("string"), F.lit(FAR)), F.col("id")]
    # a provider's first offers serve all its offers: one more than asked for, since an offer is not related to itself
    firsts = _listed(_first(published(offers).select("provider_id", "id", "end_date"), ["provider_id"], order, most_related + 1), "provider_id", "_at", ["id"], "_near")
    ids = F.coalesce(F.transform("_near", lambda x: x["id"]), F.array().cast("array<bigint>"))
    others = F.slice(F.filter(ids, lambda x: x != F.col("id")), 1, most_related)
    none = told.schema["history"].dataType.simpleString()
    full = offers.join(told, F.col("id") == F.col("_offer"), "left").join(firsts, "provider_id", "left")
    return full.withColumns({"history": F.coalesce("history", F.array().cast(none)), "related": others}).drop("_offer", "_near")


def review_queue(offers: DataFrame, most: int = 50) -> DataFrame:
    """Offers that wait for a person, the surest first; at most 200."""
    return offers.where(F.col("review_status") == "pending").orderBy(F.desc("confidence"), F.desc("id")).limit(min(most, 200))


def run_list(runs: DataFrame, most: int = 30) -> DataFrame:
    """The newest runs; at most 100."""
    return runs.orderBy(F.desc("id")).limit(min(most, 100))


def run_attempts(attempts: DataFrame, sources: DataFrame, providers: DataFrame) -> DataFrame:
    """Attempts with their source's address and provider, and their `place` in the run: by provider, address and number."""
    s = sources.select(F.col("id").alias("source_id"), "provider_id", F.col("url").alias("source_url"), "kind")
    p = providers.select(F.col("id").alias("provider_id"), F.col("slug").alias("provider_slug"), F.col("name").alias("provider_name"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("provider_name", "source_url", "attempt_no", "source_id"))
    return attempts.join(s, "source_id").join(p, "provider_id").withColumn("place", place)


def offers_of(offers: DataFrame, key: str) -> DataFrame:
    """key, place, id of each key's published offers: active, upcoming, ended, the soonest to end first."""
    shown = published(offers).where(F.col(key).isNotNull())
    order = [status_rank(), F.coalesce(F.col("end_date").cast("string"), F.lit(FAR)), F.col("id")]
    return shown.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("place"), "id")


def model_details(models: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Models (id) with `endpoints` (ids of enabled ones: those without a card first, then by the provider's tier and name) and how many providers they have.

    A model has an endpoint for each provider at most. Its offers are `offers_of(offers, "model_id")`.
    """
    rows = F.array_sort(F.collect_list(F.struct("requires_card", "tier", "provider_name", F.col("id"))))
    e = endpoints.where("enabled").groupBy(F.col("model_id").alias("_model")).agg(F.transform(rows, lambda x: x["id"]).alias("endpoints"), F.count_distinct("provider_id").alias("provider_count"))
    listed = F.coalesce("endpoints", F.array().cast("array<bigint>"))
    full = models.join(e, F.col("id") == F.col("_model"), "left").drop("_model")
    return full.withColumns({"endpoints": listed, "endpoint_count": F.size(listed), "provider_count": F.coalesce("provider_count", F.lit(0))})


def endpoint_details(endpoints: DataFrame) -> DataFrame:
    """Endpoints with `alternatives`: ids of other enabled endpoints of the model, those without a card first, then by provider.

    A model's endpoints travel as one array: it has one for each provider at most. Its offers are `offers_of(offers, "endpoint_id")`.
    """
    rows = F.array_sort(F.collect_list(F.struct("requires_card", "provider_name", F.col("id"))))
    by_model = endpoints.where("enabled").groupBy(F.col("model_id").alias("_model")).agg(F.transform(rows, lambda x: x["id"]).alias("_all"))
    full = endpoints.join(by_model, F.col("model_id") == F.col("_model"), "left")
    return full.withColumn("alternatives", F.array_remove(F.coalesce("_all", F.array().cast("array<bigint>")), F.col("id"))).drop("_model", "_all")


def provider_list(providers: DataFrame, offers: DataFrame, today: Column | None = None) -> DataFrame:
    """Providers with activity_count, active_count and last_activity_at.

    As the service counts them: all offers, active by their status. With `today`
    as a static copy counts them: published offers, active while their last day
    has not passed. Sort with `provider_order`.
    """
    counted = offers if today is None else published(offers)
    active = F.col("status") == "active" if today is None else F.col("end_date").isNull() | (F.col("end_date") >= today)
    n = counted.groupBy(F.col("provider_id").alias("_p")).agg(F.count(F.lit(1)).alias("activity_count"), F.count_if(active).alias("active_count"), F.max("updated_at").alias("last_activity_at"))
    return providers.join(n, F.col("id") == F.col("_p"), "left").drop("_p").fillna(0, ["activity_count", "active_count"])


def provider_order() -> list[Column]:
    return [F.col("tier"), F.desc("active_count"), F.col("name")]


def capability_counts(models: DataFrame, endpoints: DataFrame, offers: DataFrame, exported: bool = False) -> DataFrame:
    """capability, endpoint_count, provider_count, model_count, activity_count, each counted apart.

    As the service counts: a model's main capability counts beside those it lists,
    offers are those active or upcoming. Exported: only listed ones (the main one
    where none are), and published offers of any status.
    """
    caps = F.when(F.size("capabilities") > 0, F.col("capabilities")).otherwise(F.array("capability"))
    every = caps if exported else F.array_union(caps, F.array("capability"))
    m = models.where("capability IS NOT NULL").select("id", F.explode(F.array_distinct(every)).alias("capability")).groupBy("capability").agg(F.count(F.lit(1)).alias("model_count"))
    live = endpoints.where("enabled").join(models.select(F.col("id").alias("model_id"), "capability"), "model_id")
    e = live.groupBy("capability").agg(F.count(F.lit(1)).alias("endpoint_count"), F.count_distinct("provider_id").alias("provider_count"))
    shown = published(offers) if exported else offers.where(F.col("status").isin("active", "upcoming"))
    of_model = models.select(F.col("id").alias("model_id"), F.array_distinct(caps).alias("_caps"))
    a = shown.join(of_model, "model_id").select(F.explode("_caps").alias("capability")).groupBy("capability").agg(F.count(F.lit(1)).alias("activity_count"))
    both = e.join(m, "capability", "full_outer").join(a, "capability", "full_outer").where("capability IS NOT NULL")
    return both.fillna(0, ["endpoint_count", "provider_count", "model_count", "activity_count"])


def catalogue_stats(offers: DataFrame, runs: DataFrame) -> DataFrame:
    """name, value, n: published offers in all, by status, provider, category and audience, soon to end, new; pending ones; what the last run gave."""
    shown = published(offers)

    def by(name: str, c: Column) -> DataFrame:
        return shown.select(c.alias("value")).groupBy(F.col("value").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "value", "n")

    sums = shown.agg(F.count(F.lit(1)).alias("total"), F.count_if("ending_soon").alias("ending_soon"), F.count_if("is_new").alias("new"), F.count_distinct("provider_id").alias("providers"))
    waiting = offers.agg(F.count_if(F.col("review_status") == "pending").alias("pending"))
    last = runs.agg(F.max_by(F.struct("sources_total", "sources_ok", "items_new"), "id").alias("r")).select("r.*")

    def long(df: DataFrame) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.lit(None).cast("string").alias("value"), F.col(c).cast("long").alias("n")) for c in df.columns))
        return df.select(F.explode(pairs).alias("x")).select("x.*")

    parts = [by("status", F.col("status")), by("provider", F.col("provider")), by("category", F.col("category")), by("audience", F.explode("audience")), long(waiting), long(last)]
    out = long(sums)
    for p in parts:
        out = out.unionByName(p)
    return out
