"""Explainable verdicts on items: hard rejects in order, reasons that block approval, notes that do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import blank, has_any, let, trim_all, url_host

# What may stand before a title, and words of running English text.
ORDINAL = r"^(?:[0-9]+[.、)）]|[①②③④⑤⑥⑦⑧⑨⑩]|[一二三四五六七八九十][、.])\s*"
RUNNING = r"(?i)(?<![A-Za-z0-9_])(?:and|for|with|the|to|of|in|on|your|our|all)(?![A-Za-z0-9_])"

AUTO_APPROVE, PENDING_FLOOR = 0.62, 0.25


def money_mentions(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rules.MONEY))


def price_only(text: Column) -> Column:
    """Whether a text quotes prices rather than gives something."""
    return let(text, _quotes_prices)


def _quotes_prices(text: Column) -> Column:
    gift = text.rlike(rules.STRONG_GIFT)
    quotes = F.regexp_count(text, F.lit(rules.PRICE_CN))
    return (
        (F.regexp_count(text, F.lit(rules.PRICE_DENSE)) >= 2) | ((quotes >= 1) & (~gift | ((money_mentions(text) >= 3) & (quotes >= 2))))
        | ((money_mentions(text) >= 4) & ~gift) | (text.rlike(rules.PRICE_UNIT) & ~text.rlike(rules.UNIT_GIFT))
    )


def paid_tier(title: Column) -> Column:
    t = trim_all(blank(title))
    return t.rlike(rules.PAID_TIER) & t.rlike(rules.TIER_PRICE)


def bad_title(title: Column) -> Column:
    """Why a title says nothing; null for good ones. The first test that hits names the reason."""
    return let(trim_all(blank(title)), _title_fault)


def _title_fault(t: Column) -> Column:
    n = F.length(t)
    low = trim_all(F.regexp_replace(F.lower(t), r"(?U)[：:·—\-\s]+$", ""))
    bare = trim_all(F.regexp_replace(t, ORDINAL, ""))
    return (
        F.when(n == 0, "empty").when(n < 4, "short").when(low.isin(*rules.GENERIC_EN) | t.isin(*rules.GENERIC_ZH), "generic")
        .when(bare.isin(*rules.NAV_TITLES), "navigation").when(paid_tier(t), "paid tier")
        .when(~t.rlike(r"[一-龥]") & (n > 40) & t.rlike(RUNNING), "cut sentence")
        .when(t.rlike(r"(?U)(?:美元|元|美金)\s*$") & (money_mentions(t) >= 1), "price")
        .when((n > 90) & (F.regexp_count(t, F.lit("[，。；、！？]")) >= 2), "long sentence").when(t.rlike("[，。；、]$") & (n > 26), "unfinished sentence")
        .when(t.rlike(rules.CLAUSE) & (n > 24), "clause").when((n > 40) & (F.regexp_count(t, F.lit("[，。；]")) >= 2), "compound sentence")
    )


def gives(title: Column, summary: Column, benefit_text: Column, amount: Column, audience: Column, profile: rules.Profile = rules.OFFERS) -> Column:
    """Whether an item speaks of giving, or has an amount for somebody in particular."""
    core = F.concat_ws(" ", blank(title), blank(summary), blank(benefit_text))
    return has_any(core, profile.gift_signals) | F.coalesce(amount.isNotNull() & F.exists(audience, lambda a: a != "all"), F.lit(False))


def verdict(items: DataFrame, year: int, profile: rules.Profile = rules.OFFERS, auto_approve: float = AUTO_APPROVE, floor: float = PENDING_FLOOR) -> DataFrame:
    """items with hosts (array of allowed hosts) and is_search -> corrected items, action, reject_reason, reasons, notes."""
    text = F.concat_ws(" ", *(blank(F.col(c)) for c in ("title", "summary", "benefit_text", "source_excerpt")))
    link = trim_all(blank(F.col("claim_url")))
    web, anchor = link.rlike(r"(?i)^https?://"), link.rlike(r"(?i)^(?:#|javascript:)")
    hard = (
        F.when(F.length(blank(F.col("title"))) < 4, "title missing").when(F.col("_fault").isNotNull(), F.concat(F.lit("title: "), F.col("_fault")))
        .when(price_only(text), "price list").when(paid_tier(F.when(blank(F.col("title")) != "", F.col("title")).otherwise(F.col("summary"))), "paid tier")
        .when(~gives(F.col("title"), F.col("summary"), F.col("benefit_text"), F.col("benefit_amount"), F.col("audience"), profile), "nothing given")
        .when((link != "") & ~web & ~anchor, "link is no web address")
    )
    known = let(url_host(link), lambda host: (host != "") & ((host == url_host(F.col("source_url"))) | F.exists("hosts", lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))))
    stranger = web & ~F.col("is_search") & ~F.coalesce(known, F.lit(False))

    def date_fault(c: str) -> Column:
        y = F.substring(c, 1, 4).try_cast("int")
        return F.when(~F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), f"{c} malformed").when((y < 2015) | (y > year + 2), f"{c} out of range")

    amount, unit = F.col("benefit_amount"), F.col("benefit_unit")
    bad_amount = amount.isNotNull() & ((amount <= 0) | F.isnan(amount) | (F.abs(amount) == float("inf")))
    huge = F.coalesce(((unit == "token") & (amount > 1e13)) | (unit.isin("CNY", "USD") & (amount > 1e6)), F.lit(False)) & ~bad_amount
    blocking = F.array_compact(F.array(
        F.when(stranger, "link leads to an unknown host"), date_fault("start_date"), date_fault("end_date"), F.when(bad_amount, "amount invalid"), F.when(huge, "amount too large"),
    ))
    notes = F.array_compact(F.array(F.when(link == "", "no link"), F.when(anchor, "link is a placeholder"), F.when(web & F.col("is_search"), "link from search")))
    conf = F.least(F.col("confidence"), F.when(stranger, 0.55).otherwise(1.0), F.when(huge, 0.5).otherwise(1.0))
    checked = items.withColumn("_fault", bad_title(F.col("title"))).withColumns({"reject_reason": hard, "_blocking": blocking, "notes": notes, "_conf": conf})
    action = (
        F.when(F.col("reject_reason").isNotNull(), "reject").when((F.col("_conf") >= auto_approve) & (F.size("_blocking") == 0), "auto_ok")
        .when(F.col("_conf") >= floor, "pending").otherwise("reject")
    )
    low = F.when(F.col("reject_reason").isNull() & (F.col("_conf") < floor), F.array_append("_blocking", F.lit("confidence too low"))).otherwise(F.col("_blocking"))
    fixed = {
        "action": action, "reasons": low, "claim_url": F.when(~anchor, F.col("claim_url")), "confidence": F.col("_conf"),
        "start_date": F.when(date_fault("start_date").isNull(), F.col("start_date")), "end_date": F.when(date_fault("end_date").isNull(), F.col("end_date")),
        "benefit_amount": F.when(~bad_amount, amount),
    }
    return checked.withColumns(fixed).drop("_blocking", "_conf", "_fault")


def allowed_hosts(urls: Column) -> Column:
    """Hosts of a provider's own addresses, their registrable ends, and the usual console and account hosts of each."""
    return let(F.filter(F.transform(urls, url_host), lambda h: h != ""), _with_usual_hosts)


def _with_usual_hosts(hosts: Column) -> Column:
    roots = F.transform(hosts, lambda h: F.array_join(F.slice(F.split(h, r"\."), -F.least(F.lit(2), F.size(F.split(h, r"\."))), 2), "."))
    www = F.transform(hosts, lambda h: F.concat(F.lit("www."), h))

    def below(every: Column, prefix: str) -> Column:
        return F.transform(every, lambda h: F.concat(F.lit(prefix), h))

    return let(F.array_distinct(F.concat(hosts, roots, www)), lambda every: F.array_distinct(F.concat(every, below(every, "console."), below(every, "account."))))
