"""The catalogue's queries: derived status, filters, order, pages, search, related items."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import let, like_escape

PUBLISHED = ("auto_ok", "approved")


def with_status(df: DataFrame, today: Column, as_of: Column, soon_days: int = 3) -> DataFrame:
    """status, days_left, ending_soon and is_new at a point in time; nothing of it is ever stored."""
    start, end = F.col("start_date"), F.col("end_date")
    left = F.datediff(end, today)
    status = (
        F.when(F.col("status_override").isNotNull(), F.col("status_override")).when(F.col("archived_at").isNotNull(), "ended")
        .when(start > today, "upcoming").when(end < today, "ended").otherwise("active")
    )
    return df.withColumns({
        "status": status, "days_left": left, "ending_soon": F.coalesce(left.between(0, soon_days), F.lit(False)),
        "is_new": F.coalesce(F.col("created_at") >= as_of - F.expr("INTERVAL 1 DAY"), F.lit(False)),
    })


def published(df: DataFrame) -> DataFrame:
    return df.where(F.col("review_status").isin(*PUBLISHED))


def catalogue_view(offers: DataFrame, providers: DataFrame, models: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Offers with their provider, and with model and endpoint where they have them, each as columns of its own prefix.

    Offers of unknown providers are left out. The three tables are read by key;
    which of them are broadcast Spark decides by their bytes. Offers without a
    model or an endpoint meet none, and are dealt by their id, not into one task.
    """
    def named(df: DataFrame, what: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{what}_{c}") for c in df.columns))

    out = offers.join(named(providers, "provider").withColumnRenamed("provider_id", "_p"), F.col("provider_id") == F.col("_p")).drop("_p")
    for df, what in ((models, "model"), (endpoints, "endpoint")):
        key = F.col(f"{what}_id")
        dealt = F.coalesce(key, F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast(out.schema[f"{what}_id"].dataType))
        out = out.join(named(df, what).withColumnRenamed(f"{what}_id", "_k"), (dealt == F.col("_k")) & key.isNotNull(), "left").drop("_k")
    return out


def status_rank() -> Column:
    return F.when(F.col("status") == "active", 0).when(F.col("status") == "upcoming", 1).otherwise(2)


def orders(name: str) -> list[Column]:
    """Sort keys by name; every order ends in the id, so that pages never overlap."""
    by_id = F.desc("id")
    last = F.coalesce(F.col("end_date"), F.lit("9999-12-31").cast("date"))
    return {
        "default": [status_rank(), last, by_id],
        "export": [status_rank(), last, F.desc("confidence"), by_id],
        "newest": [F.desc("created_at"), by_id],
        "confidence": [F.desc("confidence"), by_id],
        "ending": [F.asc_nulls_last("days_left"), by_id],
        "ending_active_first": [status_rank(), F.asc_nulls_last("days_left"), by_id],
        "provider": [F.col("provider"), by_id],
        "provider_zh": [F.collate(F.col("provider"), "zh"), by_id],
    }[name]


@dataclass
class ListQuery:
    """Filters that are given are all applied; lists mean any of their values."""

    provider: list[str] = field(default_factory=list)
    category: list[str] = field(default_factory=list)
    status: list[str] = field(default_factory=list)
    region: list[str] = field(default_factory=list)
    audience: list[str] = field(default_factory=list)
    capability: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    no_card: bool = False
    ending_soon: bool = False
    overlaps: tuple[str | None, str | None] = (None, None)
    include_pending: bool = False
    elsewhere: bool = False  # every region but those named
    words: str = ""  # in title or provider, either case
    sort: str = "default"
    page: int = 1
    page_size: int = 24

    def __post_init__(self) -> None:
        if self.page < 1 or not 1 <= self.page_size <= 200:
            raise ValueError("page starts at 1, page_size is 1 to 200")

    def where(self, df: DataFrame) -> DataFrame:
        out = df if self.include_pending else published(df)
        for c in ("provider", "category", "status", "region"):
            if wanted := getattr(self, c):
                some = F.col(c).isin(*wanted)
                out = out.where(~some if c == "region" and self.elsewhere else some)
        if self.words.strip():
            out = out.where(F.lower(F.concat_ws(" ", "title", "provider")).contains(self.words.strip().lower()))
        if self.audience:
            out = out.where(F.arrays_overlap("audience", F.array(*map(F.lit, self.audience))))
        if self.capability:
            out = out.where(F.arrays_overlap("capabilities", F.array(*map(F.lit, self.capability))))
        for c in self.flags:
            out = out.where(F.col(c))
        if self.no_card:
            out = out.where(~F.col("requires_card"))
        if self.ending_soon:
            out = out.where(F.col("ending_soon") & (F.col("status") == "active"))
        since, until = self.overlaps
        if since:
            out = out.where(F.col("end_date").isNull() | (F.col("end_date") >= F.lit(since).cast("date")))
        if until:
            out = out.where(F.col("start_date").isNull() | (F.col("start_date") <= F.lit(until).cast("date")))
        return out

    def rows(self, df: DataFrame) -> DataFrame:
        """The page: a sort with offset and limit, which Spark runs as a bounded take."""
        return self.where(df).orderBy(*orders(self.sort)).offset((self.page - 1) * self.page_size).limit(self.page_size)

    def total(self, df: DataFrame) -> DataFrame:
        return self.where(df).agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / self.page_size).cast("long").alias("pages"))


#: Latin letters with marks, and the letters without: the canonical decomposition's first letter.
_MARKED = [(chr(k), unicodedata.normalize("NFD", chr(k))[0]) for k in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(k))) > 1]


def without_marks(c: Column) -> Column:
    """Latin letters without accents."""
    return F.translate(c, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case and without accents, each once."""
    return F.array_distinct(F.filter(F.split(without_marks(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def all_prefixes(c: Column, query: str) -> Column:
    """Every word of the query begins some token."""
    plain = "".join(dict(_MARKED).get(x, x) for x in query.lower())
    words = [w for w in (w.replace('"', "").replace("*", "") for w in plain.split()) if w]

    def begins(found: Column, w: str) -> Column:
        return F.exists(found, lambda t: t.startswith(w))

    return let(tokens(c), lambda found: reduce(Column.__and__, (begins(found, w) for w in words), F.lit(True)))


def search(df: DataFrame, columns: list[str], query: str, fold_spaces: bool = False) -> DataFrame:
    """Rows whose columns match as token prefixes or as a substring of either case; a blank query is no filter."""
    q = query.strip()
    if not q:
        return df
    text = F.concat_ws(" ", *columns)
    like = F.lit(False)
    for c in columns:
        like = like | F.coalesce(F.ilike(F.col(c), F.lit(f"%{like_escape(q)}%"), F.lit("\\")), F.lit(False))
    if fold_spaces:
        like = like | F.contains(F.lower(F.regexp_replace(text, r"(?U)\s+", "")), F.lit("".join(q.lower().split())))
    return df.where(all_prefixes(text, q) | like)


def token_index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(token, key): the inverted form of the columns, for corpora searched often."""
    return df.select(F.explode(tokens(F.concat_ws(" ", *columns))).alias("token"), key)


def related(df: DataFrame, group: str, order: list[Column], most: int = 6) -> DataFrame:
    """For each row up to `most` others of its group, best first.

    A group's `most` + 1 best serve all its rows, so no pairs of a group are made.
    """
    w = Window.partitionBy(group).orderBy(*order)
    top = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1)
    best = top.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_n", F.col("id").alias("related_id")))).alias("_best"))
    others = F.slice(F.filter("_best", lambda x: x["related_id"] != F.col("id")), 1, most)
    return df.join(best, group).select("id", F.posexplode(others).alias("pos", "x")).select("id", (F.col("pos") + 1).alias("rank"), "x.related_id")
