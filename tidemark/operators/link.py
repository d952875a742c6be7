"""Linking texts to known entities: longest alias, unique version, URL prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import fold_name, version_of

#: Aliases that travel in one array; more of a group go in several.
MAX_ALIASES = 20_000


def longest_alias(texts: DataFrame, aliases: DataFrame, group: str | None = None, text: Column | None = None, least: int = 3) -> DataFrame:
    """texts (id, text) and aliases (entity_id, alias, ord) -> id, entity_id, alias: the longest folded alias that a text holds.

    With `group` both sides share that column and only meet within it. A group's
    aliases travel as arrays of about MAX_ALIASES, so that no (text, alias) rows
    are made: a text meets each array once, and the best of all counts. Whether
    the arrays are broadcast is left to Spark, which knows their bytes. Ties go
    to the smallest `ord`.
    """
    folded = aliases.withColumn("fold", fold_name(F.col("alias"))).where(F.length("fold") >= least).withColumn("_g", F.col(group) if group else F.lit(0))
    sizes = folded.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / MAX_ALIASES).alias("_parts"))
    entry = F.struct(F.length("fold").alias("n"), (-F.col("ord")).alias("o"), "entity_id", "alias", "fold")
    known = folded.join(sizes, "_g").groupBy("_g", F.pmod(F.xxhash64("fold"), "_parts").alias("_part")).agg(F.collect_list(entry).alias("known"))
    t = texts.select("id", (F.col(group) if group else F.lit(0)).alias("_g"), fold_name(F.col("text") if text is None else text).alias("f"))
    best = F.array_max(F.filter("known", lambda x: F.col("f").contains(x["fold"])))
    met = t.join(known, "_g").select("id", best.alias("b")).where("b IS NOT NULL")
    return met.groupBy("id").agg(F.max("b").alias("b")).select("id", "b.entity_id", "b.alias")


def unique_version(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """texts (id, text) and entities (entity_id, name) -> id, entity_id, where exactly one entity's version stands in the text.

    A version is one row, its least and its greatest entity, however many have it: a text meets a version once.
    """
    pattern = r"(?i)(?:^|[^0-9a-z.])v?(\d+(?:\.\d+)?)(?![0-9])"
    found = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("version"))
    named = entities.where("entity_id IS NOT NULL").select("entity_id", version_of(F.col("name")).alias("version")).where("version IS NOT NULL")
    known = named.groupBy("version").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    met = found.join(known, "version").groupBy("id").agg(F.min("lo").alias("entity_id"), F.max("hi").alias("hi"))
    return met.where("entity_id = hi").select("id", "entity_id")


def url_prefix(urls: DataFrame, bases: DataFrame, group: Column | None = None) -> DataFrame:
    """urls (id, pos, url) and bases (base_id, base) -> id, base_id: the first URL that begins with a base; of several bases the smallest id.

    Each URL is cut at every slash; the cuts meet bases by equality.
    """
    def trimmed(c: str) -> Column:
        return F.lower(F.regexp_replace(c, "/+$", ""))

    parts = F.split(trimmed("url"), "/")
    cuts = F.transform(F.sequence(F.lit(3), F.greatest(F.size(parts), F.lit(3))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    met = urls.select("id", "pos", F.explode(F.array_distinct(cuts)).alias("base")).join(bases.select("base_id", trimmed("base").alias("base")), "base")
    return met.groupBy("id").agg(F.min(F.struct("pos", "base_id"))["base_id"].alias("base_id"))


def by_evidence(*links: DataFrame) -> DataFrame:
    """The first of several link tables (id, entity_id) that knows an id."""
    every = links[0].withColumn("_rank", F.lit(0))
    for k, df in enumerate(links[1:], 1):
        every = every.unionByName(df.withColumn("_rank", F.lit(k)), allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy("_rank")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def coverage(items: DataFrame, links: DataFrame) -> DataFrame:
    """How many items have a link, and their share in percent."""
    return items.join(links.select("id", F.lit(True).alias("_l")), "id", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count("_l").alias("linked"), F.round(100.0 * F.count("_l") / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("percent")
    )
