"""Guides drafted from offers: what is given, by which rules, how to claim it, and what to beware of.

The texts are those of `Phrases`; other languages are other phrases. Every part is
a column, so that a draft is made where its offer is read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.display import guide_benefit
from tidemark.functions.text import blank, plain_number
from tidemark.operators.dedupe import best_first
from tidemark.operators.publish import client_only, key_limit



@dataclass(frozen=True)
class Phrases:
    """Texts with {places} for what an offer says."""

    title: str = "{provider}, {benefit}: how to get it ({limit})"
    summary: str = "{provider} gives {benefit}{of_model}. Mind: {limit}. Rules, steps and pitfalls follow."
    of_model: str = " for {model}"
    headings: tuple[str, ...] = ("At a glance", "Rules", "How to claim", "Pitfalls", "Source")
    glance: dict[str, str] = field(default_factory=lambda: {
        "benefit": "**Benefit**: {benefit}{wording}", "wording": " (in the provider's words: {text})", "provider": "**Provider**: {provider}", "model": "**Model**: {model} ({capability}{context})",
        "context": ", {thousands}K context", "no_model": "**Model**: none in particular; the credit is the account's", "card": "**Payment card**: needed", "no_card": "**Payment card**: not needed",
        "reachable": "**Reachable from mainland China**: yes", "unreachable": "**Reachable from mainland China**: no", "compatible": "**API**: OpenAI compatible", "incompatible": "**API**: its own protocol",
        "until": "**Ends**: {end}", "since": "**Begins**: {start}",
    })
    rules: dict[str, str] = field(default_factory=lambda: {
        "about": "About: {about}", "who": "For: {who}", "amount": "By what is published the offer gives **{benefit}**.", "expiry": "Credits usually expire some time after they are claimed; use them soon.",
        "model": "It holds for **{model}**; see the list of models for others that give it.",
    })
    steps: dict[str, str] = field(default_factory=lambda: {
        "open": "Open the offer's page: {claim}", "docs": "Read the current rules: {docs}", "account": "Register and sign in with the provider", "card": "Add a payment method as asked (see the pitfalls)",
        "check": "See in the console that the credit has arrived", "base": "Point your client's base URL to {base}", "test": "Send one request to test it",
    })
    pitfalls: dict[str, str] = field(default_factory=lambda: {
        "card": "A card on file may be charged once the credit is used up: turn automatic renewal off.", "hold": "A small hold on the card is usual and is released after some days.",
        "unreachable": "The service does not answer from mainland China without a network of your own.", "client": "The credit holds in the provider's client only and gives no API key.",
        "limits": "Rates are limited: {limits}.", "per_minute": "{rpm} requests a minute", "per_day": "{rpd} requests a day", "incompatible": "The endpoint has its own protocol: change your client, not only its base URL.",
        "change": "Rules may change; the provider's page counts.",
    })
    source: str = "Drafted by rule from {source}\n\n> The provider's page counts."
    tags: tuple[str, str] = ("API credit", "client credit")


PHRASES = Phrases()


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced; null if one of the values is."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out


def _text(c: Column) -> Column:
    return F.nullif(blank(c), F.lit(""))


def _lines(parts: list[Column], mark: str = "- ", joint: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_compact(F.array(*parts)), lambda x: F.concat(F.lit(mark), x)), joint)


def _numbered(parts: list[Column]) -> Column:
    return F.array_join(F.transform(F.array_compact(F.array(*parts)), lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x)), "\n")


def _flags(df: DataFrame) -> DataFrame:
    """What the texts depend on, as columns: benefit, limits, who can reach it and how."""
    benefit = guide_benefit(F.col("benefit_kind"), F.col("benefit_amount"), F.col("benefit_unit"), F.col("benefit_text"))
    flagged = df.withColumns({
        "_benefit": benefit, "_client": client_only(*(blank(F.col(c)) for c in ("title", "summary", "benefit_text", "source_excerpt"))),
        "_card": F.coalesce("requires_card", "endpoint.requires_card", F.lit(False)), "_cn": F.coalesce("endpoint.cn_accessible", "cn_accessible", F.lit(True)),
        "_has_endpoint": F.col("endpoint").isNotNull(), "_has_model": F.col("model").isNotNull(), "_provider": F.coalesce(_text(F.col("provider_name")), F.col("provider_slug")),
        "_claim": F.coalesce(_text(F.col("endpoint.claim_url")), _text(F.col("claim_url"))), "_source": F.coalesce(_text(F.col("source_url")), _text(F.col("claim_url"))),
    })
    limit = key_limit(F.col("_card"), F.col("_client"), F.col("_cn"), F.col("endpoint.quota_rpm"), F.col("endpoint.quota_rpd"))
    topic = F.concat_ws("::", F.col("provider_slug"), F.col("_benefit"), F.when(F.col("_client"), "client").otherwise("api"))
    return flagged.withColumn("_limit", limit).withColumn("topic", topic).withColumn("slug", F.concat_ws("-", F.lit("auto"), "provider_slug", F.col("id").cast("string")))


def _glance(p: Phrases) -> Column:
    t, benefit = p.glance, F.col("_benefit")
    told = _text(F.substring("benefit_text", 1, 60))
    wording = F.when(~benefit.contains(F.col("benefit_text")), filled(t["wording"], text=told))
    context = F.when(F.col("model.context_window") > 0, filled(t["context"], thousands=plain_number(F.col("model.context_window") / 1000)))
    model = filled(t["model"], model=F.col("model.name"), capability=F.coalesce("model.capability", F.lit("general")), context=blank(context))
    return _lines([
        filled(t["benefit"], benefit=benefit, wording=blank(wording)), filled(t["provider"], provider=F.col("_provider")), F.when(F.col("_has_model"), model).otherwise(t["no_model"]),
        F.when(F.col("_card"), t["card"]).otherwise(t["no_card"]), F.when(F.col("_cn"), t["reachable"]).otherwise(t["unreachable"]),
        F.when(F.col("_has_endpoint"), F.when(F.col("endpoint.openai_compatible"), t["compatible"]).otherwise(t["incompatible"])),
        filled(t["until"], end=F.col("end_date")), filled(t["since"], start=F.col("start_date")),
    ])


def _rules(p: Phrases) -> Column:
    t = p.rules
    return _lines([
        filled(t["about"], about=F.coalesce(_text(F.trim("summary")), _text(F.trim("title")))), filled(t["who"], who=_text(F.col("audience_note"))),
        filled(t["amount"], benefit=F.col("_benefit")), F.lit(t["expiry"]), filled(t["model"], model=F.col("model.name")),
    ], "", "\n\n")


def _steps(p: Phrases) -> Column:
    t = p.steps
    return _numbered([
        filled(t["open"], claim=F.col("_claim")), filled(t["docs"], docs=_text(F.col("endpoint.docs_url"))), F.lit(t["account"]), F.when(F.col("_card"), t["card"]), F.lit(t["check"]),
        filled(t["base"], base=_text(F.col("endpoint.api_base"))), F.lit(t["test"]),
    ])


def _pitfalls(p: Phrases) -> Column:
    t, card = p.pitfalls, F.col("_card")
    rates = F.concat_ws(", ", *(F.when(F.col(f"endpoint.quota_{c}") > 0, filled(t[k], **{c: F.col(f"endpoint.quota_{c}")})) for c, k in (("rpm", "per_minute"), ("rpd", "per_day"))))
    return _lines([
        F.when(card, t["card"]), F.when(card, t["hold"]), F.when(~F.col("_cn"), t["unreachable"]), F.when(F.col("_client"), t["client"]), filled(t["limits"], limits=_text(rates)),
        F.when(F.col("endpoint.openai_compatible") == F.lit(False), t["incompatible"]), F.lit(t["change"]),
    ])


def written(offers: DataFrame, p: Phrases = PHRASES) -> DataFrame:
    """A draft for each offer.

    offers: id, provider_slug, provider_name, title, summary, the benefit's four
    columns, audience_note, source_excerpt, requires_card, cn_accessible, start_date,
    end_date, claim_url, source_url, confidence, created_at, and the structs model
    (slug, name, capability, context_window) and endpoint (requires_card,
    cn_accessible, openai_compatible, quota_rpm, quota_rpd, api_base, claim_url,
    docs_url), null where none is known.
    """
    df = _flags(offers)
    words = {"provider": F.col("_provider"), "benefit": F.col("_benefit"), "limit": F.col("_limit")}
    of_model = blank(filled(p.of_model, model=F.col("model.name")))
    bodies = (_glance(p), _rules(p), _steps(p), _pitfalls(p), filled(p.source, source=F.col("_source")))
    sections = F.filter(F.array(*(F.struct(F.lit(h).alias("title"), b.alias("body")) for h, b in zip(p.headings, bodies, strict=True))), lambda s: s["body"].isNotNull())
    tags = F.array_compact(F.array("_provider", F.col("model.name"), F.col("model.capability"), F.when(F.col("_client"), p.tags[1]).otherwise(p.tags[0])))
    return df.select(
        "slug", filled(p.title, **words).alias("title"), filled(p.summary, **words, of_model=of_model).alias("summary"), F.col("provider_slug").alias("provider"), F.col("model.slug").alias("model"),
        tags.alias("tags"), F.substring(F.col("created_at").cast("string"), 1, 10).alias("published_at"), F.col("id").alias("source_id"), "topic", "confidence", sections.alias("sections"),
    )


def drafts(offers: DataFrame, known: DataFrame | None = None, least: float = 0.75, most: int | None = 20, p: Phrases = PHRASES) -> DataFrame:
    """Drafts of published offers that are sure enough: the `most` surest, without those that `known` (slug, topic) has, one of each topic.

    Of offers with one topic, the same benefit of the same provider, the surest is
    told of; `most` None takes all.
    """
    shown = offers.where(F.col("review_status").isin("auto_ok", "approved") & F.col("archived_at").isNull() & (F.coalesce("confidence", F.lit(0.0)) >= least))
    top = shown.orderBy(F.desc("confidence"), "id").limit(most) if most is not None else shown
    new = written(top, p)
    if known is not None:
        new = new.join(known.select("slug").where("slug IS NOT NULL").distinct(), "slug", "left_anti").join(known.select("topic").where("topic IS NOT NULL").distinct(), "topic", "left_anti")
    return best_first(new, ["topic"], -F.col("confidence"), F.col("source_id"))
