"""List views of models, endpoints and guides: filters, orders, and the shapes that readers of the catalogue get."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.display import yaml_value
from tidemark.functions.text import blank, format_benefit, like_escape
from tidemark.operators.publish import guide_sections


def label(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code; the code itself where there is none."""
    if not labels:
        return c
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), c), c)


def holds(columns: list[str], words: str) -> Column:
    """Whether the columns, joined by spaces without nulls, hold the words in either case."""
    return F.lower(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in columns))).contains(words.strip().lower())


def _all(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests, F.lit(True))


def abilities() -> Column:
    """A model's capabilities; its main one where none are listed."""
    return F.when(F.size("capabilities") > 0, F.col("capabilities")).otherwise(F.array("capability"))


@dataclass
class ModelQuery:
    """Models (slug, name, vendor_slug, description, capability, capabilities, endpoint_count) by capability and name."""

    capability: list[str] = field(default_factory=list)
    vendor: list[str] = field(default_factory=list)
    words: str = ""
    has_endpoint: bool = False

    def where(self, df: DataFrame) -> DataFrame:
        tests = [F.arrays_overlap(abilities(), F.array(*map(F.lit, self.capability)))] if self.capability else []
        tests += [F.col("vendor_slug").isin(*self.vendor)] if self.vendor else []
        tests += [holds(["name", "slug", "description", "vendor_slug"], self.words)] if self.words.strip() else []
        tests += [F.col("endpoint_count") > 0] if self.has_endpoint else []
        return df.where(_all(tests))

    def rows(self, df: DataFrame) -> DataFrame:
        return self.where(df).orderBy("capability", "name", "slug")


def endpoint_order(name: str = "default") -> list[Column]:
    who = F.col("provider_name")
    return {
        "score": [F.desc_nulls_last("score"), who], "card": [F.asc("requires_card"), who], "provider": [who, F.col("model_name")],
        "default": [F.col("capability"), F.asc("requires_card"), who],
    }[name] + [F.col("id")]


@dataclass
class EndpointQuery:
    """Enabled endpoints with their provider and model. `main_only` tests a model's main capability, not all it has."""

    provider: list[str] = field(default_factory=list)
    model: list[str] = field(default_factory=list)
    capability: list[str] = field(default_factory=list)
    no_card: bool = False
    cn_accessible: bool = False
    openai_compatible: bool = False
    words: str = ""
    sort: str = "default"
    main_only: bool = False

    def where(self, df: DataFrame) -> DataFrame:
        tests = [F.col("enabled")]
        tests += [F.col("provider_slug").isin(*self.provider)] if self.provider else []
        tests += [F.col("model_slug").isin(*self.model)] if self.model else []
        if self.capability:
            has = F.col("capability").isin(*self.capability) if self.main_only else F.arrays_overlap("capabilities", F.array(*map(F.lit, self.capability)))
            tests.append(F.coalesce(has, F.lit(False)))
        tests += [~F.col("requires_card")] if self.no_card else []
        tests += [F.col("cn_accessible")] if self.cn_accessible else []
        tests += [F.col("openai_compatible")] if self.openai_compatible else []
        if self.words.strip():
            names = ("model_name", "model_slug", "provider_name", "quota_text")
            like = f"%{like_escape(self.words.strip())}%"
            any_of = (F.coalesce(F.ilike(F.col(c), F.lit(like), F.lit("\\")), F.lit(False)) for c in names)
            tests.append(holds(list(names), self.words) if self.main_only else reduce(Column.__or__, any_of))
        return df.where(_all(tests))

    def rows(self, df: DataFrame) -> DataFrame:
        return self.where(df).orderBy(*endpoint_order(self.sort))


def guide_list(guides: DataFrame, provider: str = "", model: str = "", words: str = "") -> DataFrame:
    """Guides without their sections: exact provider and model, words in title, summary or tags."""
    named = guides.withColumn("_tags", F.array_join("tags", " "))
    tests = [F.col("provider_slug") == provider] if provider else []
    tests += [F.col("model_slug") == model] if model else []
    tests += [holds(["title", "summary", "_tags"], words)] if words else []
    return named.where(_all(tests)).drop("_tags", "sections")


def offer_shape(df: DataFrame, labels: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Offers as nested rows: provider, benefit and model as structs, labels beside codes."""
    of = (labels or {}).get
    words = {k: of(k, {}) for k in ("category", "audience", "status", "capability")}
    fresh = (F.col("status") == "active") & F.col("is_new")
    some = F.struct(
        F.col("benefit_kind").alias("kind"), F.col("benefit_amount").alias("amount"), F.col("benefit_unit").alias("unit"), F.col("benefit_text").alias("text"),
        F.when(F.col("benefit_kind").isNull(), F.col("benefit_text"))
        .otherwise(format_benefit(F.col("benefit_kind"), F.col("benefit_amount"), F.col("benefit_unit"), F.col("benefit_text"))).alias("display"),
    )
    model = F.struct(F.col("model_slug").alias("slug"), F.col("model_name").alias("name"), F.col("capability"), label(F.col("capability"), words["capability"]).alias("capabilityLabel"))
    return df.select(
        "id", F.struct(F.col("provider_slug").alias("slug"), F.col("provider_name").alias("name"), F.col("region")).alias("provider"), "title", "category",
        label(F.col("category"), words["category"]).alias("categoryLabel"), F.when(F.col("benefit_kind").isNotNull() | F.col("benefit_text").isNotNull(), some).alias("benefit"),
        "audience", F.transform("audience", lambda a: label(a, words["audience"])).alias("audienceLabels"), F.col("requires_card").alias("requiresCard"),
        F.col("start_date").alias("startDate"), F.col("end_date").alias("endDate"), "confidence", F.col("review_status").alias("reviewStatus"), "status",
        F.when(fresh, "NEW").otherwise(label(F.col("status"), words["status"])).alias("statusLabel"), F.col("days_left").alias("daysLeft"), F.col("ending_soon").alias("endingSoon"),
        F.col("is_new").alias("isNew"), F.when(F.col("model_slug").isNotNull(), model).alias("model"),
    )


def model_shape(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    return df.select(
        "slug", "name", F.col("vendor_slug").alias("vendorSlug"), "capability", label(F.col("capability"), labels or {}).alias("capabilityLabel"), abilities().alias("capabilities"),
        F.transform(abilities(), lambda c: label(c, labels or {})).alias("capabilityLabels"), "description",
        F.coalesce("endpoint_count", F.lit(0)).alias("endpointCount"), F.coalesce("provider_count", F.lit(0)).alias("providerCount"),
    )


def endpoint_shape(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    return df.select(
        "id", F.struct(F.col("provider_slug").alias("slug"), F.col("provider_name").alias("name")).alias("provider"),
        F.struct(F.col("model_slug").alias("slug"), F.col("model_name").alias("name"), "capability", label(F.col("capability"), labels or {}).alias("capabilityLabel")).alias("model"),
        F.col("quota_text").alias("quotaText"), F.col("requires_card").alias("requiresCard"), F.col("cn_accessible").alias("cnAccessible"),
        F.col("openai_compatible").alias("openaiCompatible"), "score", F.coalesce("offer_count", F.lit(0)).alias("activityCount"),
    )


def guide_shape(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select(
        "slug", "title", "summary", F.col("provider_slug").alias("providerSlug"), F.col("model_slug").alias("modelSlug"), F.coalesce("tags", none).alias("tags"),
        guide_sections(F.col("sections")).alias("sections"), F.col("source_id").isNotNull().alias("autoGenerated"),
    )


def guides_with_override(written: DataFrame, drafts: DataFrame) -> DataFrame:
    """slug, pos, ... of both: a written guide replaces the draft of its slug, in the draft's place; other written ones follow the drafts.

    Of equal slugs on one side the last counts, in the first one's place.
    """
    both = drafts.withColumn("_side", F.lit(0)).unionByName(written.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    row = F.struct(*(F.col(c) for c in both.columns if c not in ("slug", "_side")))
    best = both.groupBy("slug").agg(F.min(F.struct("_side", "pos")).alias("_at"), F.max_by(row, F.struct("_side", "pos")).alias("_row"))
    keep = [F.col(f"_row.{c}") for c in both.columns if c not in ("slug", "_side", "pos")]
    return best.select("slug", F.col("_at._side").alias("side"), F.col("_at.pos").alias("pos"), *keep)


def merged_drafts(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """Drafts that are there already stay; new ones of other slugs are added after them."""
    new = drafts.join(existing.select("slug"), "slug", "left_anti")
    return existing.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)), allowMissingColumns=True)


def guide_yaml(df: DataFrame) -> DataFrame:
    """slug, yaml: each guide as an entry of a YAML list."""
    def line(name: str, c: str) -> Column:
        return F.concat(F.lit(f"\n    {name}: "), yaml_value(F.col(c)))

    parts = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("\n      - title: "), yaml_value(s["title"]), F.lit("\n        body: "), yaml_value(s["body"]))), "")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("\n    tags: ["), F.array_join(F.transform("tags", yaml_value), ", "), F.lit("]")))
    provider = F.when(blank(F.col("provider")) != "", line("provider", "provider"))
    entry = F.concat(F.lit("  - slug: "), yaml_value(F.col("slug")), line("title", "title"), line("summary", "summary"), blank(provider), blank(tags), F.lit("\n    sections:"), parts)
    return df.select("slug", entry.alias("yaml"))


def relay_counts(relays: DataFrame) -> DataFrame:
    """One row: how many relays there are, online, offline and recommended; those of unknown state are neither."""
    return relays.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("online")).alias("online"), F.count_if(~F.col("online")).alias("offline"), F.count_if("recommended").alias("recommended")
    )


def bundle(offers: DataFrame, models: DataFrame, endpoints: DataFrame, guides: DataFrame, stats: DataFrame) -> dict[str, DataFrame]:
    """The files of a static copy of the catalogue, by name; write each with `sources.tables.write_json`."""
    return {"activities": offer_shape(offers), "models": model_shape(models), "endpoints": endpoint_shape(endpoints), "guides": guide_shape(guides), "stats": stats}
