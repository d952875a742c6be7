"""Text, URL, date and hash expressions. All are Catalyst expressions but `nfkc`, which no built-in offers."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that say nothing about a title, taken out in this order.
NOISE_WORDS = ("限时", "最新", "官方", "公告", "通知", "重磅", "上线", "来袭", "开启", "正式", "全新", "独家", "首发", "火热", "进行中", "活动")

# Factors of amount suffixes.
UNIT_FACTORS = {"亿": 1e8, "万": 1e4, "千": 1e3, "k": 1e3, "K": 1e3, "m": 1e6, "M": 1e6, "b": 1e9, "B": 1e9}

# Query parameters that only track where a visitor came from.
TRACKING = r"(?i)^(utm_.*|ref|source|from|share|spm|scm|fbclid|gclid)(=|$)"

_TRIM = r"(?U)^[\s﻿]+|[\s﻿]+$"


def blank(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c evaluated once, however often `use` names it: expressions built on it do not multiply."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def trim_all(c: Column) -> Column:
    """Trim every Unicode space, not only ASCII ones."""
    return F.regexp_replace(c, _TRIM, "")


def clean_text(c: Column) -> Column:
    """Six entities decoded, runs of blanks to one space, at most one empty line, trimmed; null is empty."""
    return let(blank(c), _cleaned)


def _cleaned(c: Column) -> Column:
    plain = c
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.regexp_replace(c, f"(?i){entity}", char)
    c = F.when(plain.contains("&"), c).otherwise(plain)  # most texts have no entity
    c = F.regexp_replace(c, r"[ \t ]+", " ")
    return trim_all(F.regexp_replace(c, r"\n{3,}", "\n\n"))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility normal form, in Arrow batches."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def fold_title(c: Column) -> Column:
    """normalize_title without the compatibility form: for text that has none, all JVM-side."""
    c = F.regexp_replace(F.lower(blank(c)), r'[【】《》「」『』"\'“”‘’（）()\[\]]', " ")
    for word in NOISE_WORDS:
        c = F.replace(c, F.lit(word), F.lit(""))
    c = F.regexp_replace(c, r"[^\p{IsHan}a-z0-9]+", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def normalize_title(c: Column) -> Column:
    """Lower case, brackets and noise words out, Han, a-z and 0-9 kept."""
    return fold_title(nfkc(blank(c)))


_URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]*)([^?#\s]*)(?:\?([^#\s]*))?(?:#.*)?\s*$"


def url_host(c: Column) -> Column:
    """Lower-case host with its port unless that is the scheme's own; empty if there is none."""
    return let(blank(c), _host_of)


def _host_of(c: Column) -> Column:
    host = F.lower(F.regexp_replace(F.regexp_extract(c, _URL, 2), r"^.*@", ""))
    scheme = F.lower(F.regexp_extract(c, _URL, 1))
    return F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).when(scheme == "http", F.regexp_replace(host, r":80$", "")).otherwise(host)


def normalize_url(c: Column) -> Column:
    """Scheme, host and path without final slashes, tracking parameters and fragment out, all in lower case.

    What is no absolute URL comes back trimmed and in lower case; null is empty.
    """
    return let(blank(c), lambda c: let(_host_of(c), lambda host: _normal_url(c, host)))


def _normal_url(c: Column, host: Column) -> Column:
    query = F.array_join(F.filter(F.split(F.regexp_extract(c, _URL, 4), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    tail = let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    full = F.concat(F.regexp_extract(c, _URL, 1), F.lit("://"), host, F.regexp_replace(F.regexp_extract(c, _URL, 3), "/+$", ""), tail)
    return F.when(c.rlike(_URL) & (host != ""), F.lower(full)).otherwise(F.lower(trim_all(c)))


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD if the month is 1-12 and the day 1-31; the day need not exist in the month."""
    m, d = month.try_cast("int"), day.try_cast("int")
    return F.when(m.between(1, 12) & d.between(1, 31) & (year != ""), F.concat_ws("-", year, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))


def normalize_date(c: Column, year: Column | None = None) -> Column:
    """The first date of a text as YYYY-MM-DD: with a year in it, else month and day in `year`; null if none."""
    return let(trim_all(blank(c)), lambda c: _first_date(c, F.lit("") if year is None else year.cast("string")))


def _first_date(c: Column, year: Column) -> Column:
    def parts(pattern: str, own_year: bool) -> tuple[Column, Column]:
        g = [F.regexp_extract(c, pattern, k) for k in range(1, 4 if own_year else 3)]
        return c.rlike(pattern), _ymd(*g) if own_year else _ymd(year, *g)

    out = F
    for pattern, own in (
        (r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日?", True), (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", True),
        (r"(?U)(\d{1,2})\s*月\s*(\d{1,2})\s*日?", False), (r"^(\d{1,2})[-/.](\d{1,2})$", False),
    ):
        hit, value = parts(pattern, own)
        out = out.when(hit if own else hit & (year != ""), value)
    return out


def real_date(c: Column) -> Column:
    """YYYY-MM-DD as a date; a day beyond the month's end rolls over into the next month."""
    y, m, d = (F.regexp_extract(blank(c), r"^(\d{4})-(\d{2})-(\d{2})$", k).try_cast("int") for k in (1, 2, 3))
    return F.when(m.between(1, 12) & d.between(1, 31), F.date_add(F.make_date(y, m, F.lit(1)), d - 1))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(blank(c), 256), 1, 32)


def fingerprint(provider: Column, title: Column, url: Column, start: Column, plain: bool = False) -> Column:
    """Identity of an offer: provider, folded title, normal URL and start date. `plain`: titles need no compatibility form."""
    parts = (F.lower(trim_all(blank(provider))), (fold_title if plain else normalize_title)(title), normalize_url(url), blank(normalize_date(start)))
    return content_hash(F.concat_ws("|", *parts))


def unit_factor(unit: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in UNIT_FACTORS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, unit), F.lit(1.0))


def parse_amount(number: Column, unit: Column) -> Column:
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double") * unit_factor(blank(unit))


def fold_name(c: Column) -> Column:
    """Model names without case, width, spaces and punctuation: comparable by containment."""
    full = "".join(chr(k) for k in range(0xFF01, 0xFF5F))
    half = "".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F))
    c = F.lower(F.translate(F.lower(blank(c)), full, half))
    return F.regexp_replace(c, r"[^a-z0-9一-龥]", "")


def version_of(c: Column) -> Column:
    """The first d.d, else the first single digit that stands alone; null if none."""
    long, short = F.regexp_extract(blank(c), r"(\d+\.\d+)", 1), F.regexp_extract(blank(c), r"(?:^|[^0-9])(\d)(?![0-9.])", 1)
    return F.nullif(F.when(long != "", long).otherwise(short), F.lit(""))


def escape_xml(c: Column) -> Column:
    c = blank(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def decode_entities(c: Column) -> Column:
    c = blank(c)
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_tags(c: Column, scripts: bool = True) -> Column:
    """Tags to spaces, blanks to one; with `scripts` what script and style hold goes first."""
    c = blank(c)
    if scripts:
        c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))


def header_value(c: Column) -> Column:
    """Printable ASCII only, blanks to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(blank(c), r"[^\x20-\x7e]", " "), " +", " "))


def like_escape(text: str) -> str:
    """A literal for LIKE ... ESCAPE: % and _ lose their meaning."""
    return text.replace("%", "\\%").replace("_", "\\_")


def plain_number(c: Column, digits: int = 2) -> Column:
    """At most `digits` decimals, none that are 0, and never an exponent."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", c.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(c.isNotNull(), plain)


def format_benefit(kind: Column, amount: Column, unit: Column, text: Column) -> Column:
    """How a benefit reads: 7000 万 tokens, ¥20, $200, the text of counts, else amount and unit."""
    token = (
        F.when(amount >= 1e8, F.concat(plain_number(amount / 1e8), F.lit(" 亿 tokens")))
        .when(amount >= 1e4, F.concat(plain_number(amount / 1e4), F.lit(" 万 tokens")))
        .otherwise(F.concat(plain_number(amount), F.lit(" tokens")))
    )
    return (
        F.when(amount.isNull(), text).when(unit == "token", token).when(unit == "CNY", F.concat(F.lit("¥"), plain_number(amount)))
        .when(unit == "USD", F.concat(F.lit("$"), plain_number(amount))).when(kind == "count", F.coalesce(text, plain_number(amount)))
        .otherwise(F.concat_ws(" ", plain_number(amount), unit))
    )


def json_strings(c: Column) -> Column:
    """A JSON array of strings; null, broken or other JSON is the empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def local_today(as_of: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_date(F.from_utc_timestamp(as_of, zone))


def has_any(c: Column, keywords: tuple[str, ...] | list[str]) -> Column:
    """Whether the text holds any keyword, letters of either case."""
    def any_in(low: Column) -> Column:
        return reduce(Column.__or__, (low.contains(k.lower()) for k in keywords), F.lit(False))

    return F.coalesce(let(F.lower(c), any_in), F.lit(False))
