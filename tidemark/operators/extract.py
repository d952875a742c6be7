"""Fields of an offer from a passage: category, benefit, dates, audience, title, summary, confidence. Expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import blank, clean_text, has_any, let, normalize_date, parse_amount, url_host
from tidemark.operators.validate import bad_title


def category(text: Column, profile: rules.Profile = rules.OFFERS) -> Column:
    """The first category of which the text holds a keyword; the first category's keywords win always."""
    out = F
    for name, words in profile.categories:
        out = out.when(has_any(text, words), name)
    return out.otherwise(profile.default_category)


def benefit(text: Column, profile: rules.Profile = rules.OFFERS) -> Column:
    """struct(kind, amount, unit, text) of the first pattern that gives an amount over 0; null if none does."""
    return let(clean_text(text), lambda t: _first_benefit(t, profile))


def _first_benefit(t: Column, profile: rules.Profile) -> Column:
    found = []
    for pattern, kind, unit, scaled in profile.benefits:
        amount = parse_amount(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2) if scaled else F.lit(""))
        value = F.struct(F.lit(kind).alias("kind"), amount.alias("amount"), F.lit(unit).alias("unit"), F.substring(F.regexp_extract(t, pattern, 0), 1, 80).alias("text"))
        found.append(F.when(t.rlike(pattern), let(value, lambda v: F.when(v["amount"] > 0, v))))
    return F.coalesce(*found)


_DAY = r"(\d{4}[-/年])?\s*(\d{1,2})[-/月]\s*(\d{1,2})日?"


def dates(text: Column, year: Column) -> Column:
    """struct(start, end) as YYYY-MM-DD: a range, else a deadline, else the latest day named; years missing are `year`."""
    return let(clean_text(text), lambda t: _dates_of(t, year.cast("string")))


def _dates_of(t: Column, ref: Column) -> Column:

    def day(pattern: str, first: int, default: Column, plus: int = 0) -> Column:
        y = F.regexp_replace(F.regexp_extract(t, pattern, first), r"[-/年]", "")
        y = F.when(y == "", default).otherwise(y)
        y = (y.try_cast("int") + plus).cast("string") if plus else y
        return normalize_date(F.concat_ws("-", y, F.regexp_extract(t, pattern, first + 1), F.regexp_extract(t, pattern, first + 2)))

    span = rf"(?U){_DAY}\s*[-–—~至到]{{1,2}}\s*{_DAY}"
    first_year = F.regexp_replace(F.regexp_extract(t, span, 1), r"[-/年]", "")
    second_default = F.when(first_year == "", ref).otherwise(first_year)
    ranged = F.struct(F.when(t.rlike(span), day(span, 1, ref)).alias("start"), F.when(t.rlike(span), day(span, 4, second_default)).alias("end"))
    until = rf"(?U)(?:截至|截止到?|有效期至|用到|持续到|活动时间?至|至|到|by|until|ends?|valid\s+until)\s*{_DAY}"
    every = F.regexp_extract_all(t, F.lit(r"(?U)(?:^|[^\d])(\d{1,2}\s*[/月]\s*\d{1,2})\s*日?"), F.lit(1))
    latest = F.array_max(F.transform(every, lambda d: normalize_date(F.concat_ws("-", ref, F.regexp_replace(d, r"(?U)\s*[/月]\s*", "-")))))
    since = rf"(?U)(?:自|从|即日起|开始于|from|starts?)\s*{_DAY}"

    def told(x: Column) -> Column:
        end = F.when(x["end"] < x["start"], day(span, 4, second_default, plus=1)).otherwise(x["end"])
        return F.struct(
            F.coalesce(x["start"], F.when(t.rlike(since), day(since, 1, ref))).alias("start"),
            F.coalesce(end, F.when(t.rlike(until), day(until, 1, ref)), latest).alias("end"),
        )

    return let(ranged, told)


def audience(text: Column, profile: rules.Profile = rules.OFFERS) -> Column:
    """All audiences of which the text holds a keyword, in the profile's order; ['all'] if none."""
    tags = F.array_compact(F.array(*(F.when(has_any(text, words), name) for name, words in profile.audiences)))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("all")))


def audience_note(text: Column, profile: rules.Profile = rules.OFFERS) -> Column:
    """The first keyword found of each audience, once each, joined."""
    low = F.lower(text)
    first = (F.coalesce(*(F.when(low.contains(w.lower()), w) for w in words)) for _, words in profile.audiences)
    return F.array_join(F.array_distinct(F.array_compact(F.array(*first))), "、")


def requires_card(text: Column, profile: rules.Profile = rules.OFFERS) -> Column:
    return ~has_any(text, profile.no_card) & has_any(text, profile.card)


def recurring(text: Column, profile: rules.Profile = rules.OFFERS) -> Column:
    out = F
    for name, words in profile.recurring:
        out = out.when(has_any(text, words), name)
    return out.otherwise("once")


def claim_link(href: Column, source_url: Column, hosts: Column, is_search: Column) -> Column:
    """The link if it comes from a search source, stays on the source's host, or leads to an allowed host or below it."""
    def allowed(host: Column) -> Column:
        return (host != "") & ((host == url_host(source_url)) | F.exists(hosts, lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h))))

    return F.when(is_search | let(url_host(href), allowed), href)


def confidence(text: Column, title: Column, offer: Column, start: Column, end: Column, link: Column, who: Column) -> Column:
    """0 to 1, two decimals: what was found, and how the title and the passage look."""
    named = F.exists(who, lambda a: a != "all")
    n, m = F.length(text), F.length(blank(title))
    score = F.lit(0.30)
    for hit, weight in (
        (offer.isNotNull(), 0.28), (start.isNotNull() & end.isNotNull(), 0.18), (start.isNull() != end.isNull(), 0.10), (link.isNotNull(), 0.14),
        (F.get(who, F.lit(0)) != "all", 0.12), (n.between(40, 800), 0.05), (n > 1500, -0.15), (m.between(8, 60) & ~title.rlike("[，。；、]$"), 0.06),
        (offer.isNull() & named & text.rlike(rules.CONFIDENT_GIFT), 0.22), (offer["kind"] == "count", 0.05),
    ):
        score = score + F.when(hit, weight).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def clean_title(title: Column) -> Column:
    """Bullets, final stops, trailing 'learn more' and commas go; what stands technically before a gift goes too."""
    t = let(clean_text(title), _from_gift)
    for pattern in (
        r"(?U)^[\s\-–—•·]+|[\s\-–—•·]+$", r"[。．.]+$",
        r"(?iU)(?:More\s+information|Learn\s+more|Read\s+more|了解更多|查看详情|更多信息|详情)\s*$", r"(?U)^\s+|\s+$", r"^[，、,;；]+|[，、,;；]+$",
    ):
        t = F.regexp_replace(t, pattern, "")
    return t


def _from_gift(t: Column) -> Column:
    """What begins with the gift, where a technical description stands before it and the rest is a good title."""
    gift = F.regexp_instr(t, F.lit(r"赠送|送出|免费领取|注册即送|即送|领取|白送|赠")) - 1
    head = F.substring(t, F.lit(1), gift)
    cut = F.length(F.regexp_extract(head, r"^(.*)(?:支持|接口|[：:，、/])", 1))
    rest = clean_text(F.regexp_replace(F.substring(t, cut + 1, F.length(t)), r"(?U)^(?:支持|接口|[：:，、/\s])+", ""))
    technical = (gift > 8) & head.rlike(r"(?i)接口|RPM|QPS|API|v\d|异步|同步|频率|限制|参数|协议|HTTP|SDK") & head.rlike(r"支持|接口|[：:，、/]")
    better = let(rest, lambda r: F.when((F.length(r) >= 6) & (F.length(r) < F.length(t)) & bad_title(r).isNull(), r))
    return F.coalesce(F.when(technical, better), t)


def promote_title(title: Column, context: Column) -> Column:
    """The title if it is a good one, else the sentence of the passage that names gift and amount best."""
    sentences = F.filter(F.transform(F.split(blank(context), r"\n+|(?<=[。！？；])"), clean_text), lambda s: F.length(s).between(6, 80))
    term = "有效期|过期作废|资源包"

    def points(s: Column, k: Column) -> Column:
        score = F.lit(0.0) - k * 0.3
        for pattern, weight in (
            (rules.PROMOTE_GIFT, 5), (rules.PROMOTE_AMOUNT, 4), (rules.PROMOTE_WHO, 3), ("有效期|过期作废|共享消耗|不结转|不可转让|依次递减|资源包", -4),
            (r"^[①-⑩0-9]+[.、)）]?\s*(?:平台|模型|应用|组件|系统|控制台|文档|产品)", -5),
        ):
            score = score + F.when(s.rlike(pattern), float(weight)).otherwise(0.0)
        return score - F.when(F.length(s) < 12, 2.0).otherwise(0.0)

    def entry(s: Column, k: Column) -> Column:
        ideal = s.rlike(rules.PROMOTE_GIFT) & s.rlike(rules.PROMOTE_AMOUNT) & ~s.rlike(term)
        return F.struct(F.round(points(s, k), 6).alias("points"), (-k).alias("at"), s.alias("s"), ideal.alias("ideal"))

    def choose(sentences: Column) -> Column:
        return let(F.transform(sentences, entry), lambda scored: pick(sentences, scored))

    def pick(sentences: Column, scored: Column) -> Column:
        def joined(ideal: Column) -> Column:
            before = F.get(sentences, -ideal["at"] - 1)
            fits = (F.length(before) >= 8) & ~before.rlike(term + "|共享消耗") & before.rlike(rules.PROMOTE_GIFT + "|" + rules.PROMOTE_WHO) & (F.length(before) + F.length(ideal["s"]) <= 90)
            return F.substring(F.when(fits, F.concat(before, ideal["s"])).otherwise(ideal["s"]), 1, 150)

        best = let(F.array_max(scored), lambda x: F.when(x["points"] > 0, x["s"]))
        return F.coalesce(let(F.array_max(F.filter(scored, lambda x: x["ideal"])), joined), best)

    return F.when(bad_title(title).isNull(), title).otherwise(F.coalesce(let(sentences, choose), blank(title)))


def summary(context: Column, title: Column) -> Column:
    """The first two lines that say more than the title does; 200 characters at most."""
    return let(F.filter(F.transform(F.split(blank(context), "\n"), clean_text), lambda x: F.length(x) > 8), lambda lines: _told(lines, context, title))


def _told(lines: Column, context: Column, title: Column) -> Column:
    more = F.filter(lines, lambda x: ~title.contains(x) & ~x.contains(title))
    other = F.filter(lines, lambda x: x != title)
    texts = (F.array_join(F.slice(more, 1, 2), " "), F.array_join(F.slice(other, 1, 1), " "), blank(context))
    return F.coalesce(*(F.nullif(F.substring(clean_text(x), 1, 200), F.lit("")) for x in texts), F.lit(""))


def extract(found: DataFrame, year: Column, profile: rules.Profile = rules.OFFERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Candidates with source_url, provider_slug, country, hosts (array) and is_search -> items with all fields, and the columns to keep."""
    text = F.col("text")
    df = found.withColumn("text", clean_text(F.concat_ws("\n", "title", "context")))
    df = df.withColumn("claim_url", claim_link(F.col("href"), F.col("source_url"), F.col("hosts"), F.col("is_search")))
    df = df.withColumn("benefit", benefit(text, profile)).withColumn("dates", dates(text, year)).withColumn("audience", audience(text, profile))
    conf = confidence(text, F.col("title"), F.col("benefit"), F.col("dates.start"), F.col("dates.end"), F.col("claim_url"), F.col("audience"))
    df = df.withColumn("confidence", conf).withColumn("title", clean_title(promote_title(F.col("title"), F.col("context"))))
    card = requires_card(text, profile)
    verification = F.when(F.array_contains("audience", "verified"), "identity").when(F.array_contains("audience", "student"), "student_id").when(card, "payment")
    # a title is the one row of its array if it is long enough; a filter on it would go below and work it out twice
    titled = F.explode(F.filter(F.array("title"), lambda t: F.length(t) >= 4)).alias("title")
    return df.select(*(c for c in df.columns if c != "title"), titled).select(
        "provider_slug", "title", summary(F.col("context"), F.col("title")).alias("summary"), category(text, profile).alias("category"),
        F.col("benefit.kind").alias("benefit_kind"), F.col("benefit.amount").alias("benefit_amount"), F.col("benefit.unit").alias("benefit_unit"), F.col("benefit.text").alias("benefit_text"),
        "audience", audience_note(text, profile).alias("audience_note"), F.when(F.col("country") == "CN", "CN").otherwise("GLOBAL").alias("region"), card.alias("requires_card"),
        verification.alias("requires_verification"), F.col("dates.start").alias("start_date"), F.col("dates.end").alias("end_date"), recurring(text, profile).alias("is_recurring"),
        "claim_url", "source_url", F.substring("context", 1, 500).alias("source_excerpt"), "confidence", *keep,
    )


def loose_json(text: Column, schema: str) -> Column:
    """The JSON object from the first { to the last } of a text, code fences around it or not; null if it is broken."""
    return F.from_json(F.nullif(F.regexp_extract(blank(text), r"(?s)\{.*\}", 0), F.lit("")), schema)
