"""How values read in lists and guides, and casts that never fail. Expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import blank, plain_number, real_date, trim_all


def to_number(c: Column) -> Column:
    """A string as a finite number; null for anything else."""
    n = F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def to_flag(c: Column) -> Column:
    """1, "1" and true; 0, "0" and false; null for anything else."""
    return F.when(c.cast("string").isin("1", "true"), True).when(c.cast("string").isin("0", "false"), False)


def to_list(c: Column) -> Column:
    """A JSON array as strings; any other text as an array of itself; null and "" as the empty array."""
    return F.when(blank(c) == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.when(c.rlike(r"^\s*\["), F.from_json(c, "array<string>")), F.array(c)))


def guide_benefit(kind: Column, amount: Column, unit: Column, text: Column) -> Column:
    """The benefit in a guide's title: the amount with its unit, or with its kind's; else the text's first 40 characters; else that it is free."""
    kind, unit = blank(kind), blank(unit)
    tokens = (
        F.when(amount >= 1e8, F.concat(plain_number(amount / 1e8), F.lit(" 亿 tokens"))).when(amount >= 1e4, F.concat(plain_number(amount / 1e4), F.lit(" 万 tokens")))
        .otherwise(F.concat(plain_number(amount), F.lit(" tokens")))
    )
    shown = (
        F.when((unit == "token") | (kind == "token"), tokens).when((unit == "CNY") | (kind == "credit_cny"), F.concat(F.lit("¥"), plain_number(amount)))
        .when((unit == "USD") | (kind == "credit_usd"), F.concat(F.lit("$"), plain_number(amount))).when(unit == "day", F.concat(plain_number(amount), F.lit(" 天")))
        .when(unit == "month", F.concat(plain_number(amount), F.lit(" 个月"))).when(unit != "", F.concat(plain_number(amount), F.lit(" "), unit))
    )
    return F.coalesce(F.when(amount.isNotNull(), shown), F.nullif(F.substring(blank(text), 1, 40), F.lit("")), F.lit("免费额度"))


def relative_time(at: Column, as_of: Column, zone: str = "Asia/Shanghai") -> Column:
    """How long ago: now, minutes, hours or days; from 30 days on the local date."""
    minutes = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return F.coalesce(
        F.when(minutes < 1, "刚刚").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" 分钟前"))).when(hours < 24, F.concat(hours.cast("string"), F.lit(" 小时前")))
        .when(days < 30, F.concat(days.cast("string"), F.lit(" 天前"))).otherwise(F.to_date(F.from_utc_timestamp(at, zone)).cast("string")),
        F.lit(""),
    )


def short_date(c: Column) -> Column:
    """YYYY-MM-DD without its year."""
    return F.substring(blank(c), 6, 10)


def token_count(n: Column) -> Column:
    """Millions as M and thousands as K with at most one decimal; nothing for 0 and less."""
    return (
        F.when(n.isNull() | (n <= 0), "").when(n >= 1_000_000, F.concat(plain_number(n / 1_000_000, 1), F.lit("M")))
        .when(n >= 1000, F.concat(plain_number(n / 1000, 1), F.lit("K"))).otherwise(plain_number(n, 6))
    )


def quota_text(text: Column, amount: Column, unit: Column, rpm: Column, rpd: Column, tpm: Column) -> Column:
    """The quota's own text, else its parts, else that it is free."""
    def part(c: Column, name: str) -> Column:
        return F.when(c > 0, F.concat(plain_number(c), F.lit(name)))

    parts = F.concat_ws(" · ", F.concat(plain_number(amount), blank(unit)), part(rpm, " RPM"), part(rpd, " RPD"), part(tpm, " TPM"))
    return F.coalesce(F.nullif(blank(text), F.lit("")), F.nullif(parts, F.lit("")), F.lit("免费"))


def benefit_text(display: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(display, F.lit("")), F.nullif(text, F.lit("")), F.lit("免费"))


def result_text(title: Column, snippet: Column) -> Column:
    """A search result as the text that extraction reads."""
    return F.concat(blank(title), F.lit("\n"), blank(snippet))


def yaml_value(c: Column) -> Column:
    """A text as a double-quoted YAML scalar; null as null."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))


def shortened(c: Column, n: int = 140) -> Column:
    """The text, or its first n - 1 characters and an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def first_text(*cs: Column) -> Column:
    """The first text that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(trim_all(blank(c)), F.lit("")) for c in cs))


def chosen(c: Column) -> Column:
    """A comma list as its values, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(blank(c), ","), lambda x: F.trim(x)), lambda x: x != ""))


def toggled(c: Column, value: Column) -> Column:
    """A comma list with the value put in at its end, or taken out where it is there; null if nothing is left."""
    values = chosen(c)
    out = F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.array_append(values, value))
    return F.nullif(F.array_join(out, ","), F.lit(""))


def without(c: Column, value: Column) -> Column:
    """A comma list without the value; null if nothing is left."""
    return F.nullif(F.array_join(F.array_remove(chosen(c), value), ","), F.lit(""))


def days_later(c: Column, days: Column | int) -> Column:
    """YYYY-MM-DD so many days later; a day beyond its month's end counts on into the next."""
    return F.date_add(real_date(c), days).cast("string")
