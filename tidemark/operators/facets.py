"""Counts over the catalogue: statistics, facets, roll-ups of providers, models and capabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facets(df: DataFrame, columns: Sequence[str], labels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """facet, value, n in one pass by grouping sets; array columns count each element once a row.

    `labels` orders a facet's values; values without a label come after them.
    """
    scalar = [c for c in columns if df.schema[c].dataType.typeName() != "array"]
    parts = []
    if scalar:
        once = df.groupingSets([[F.col(c)] for c in scalar], *(F.col(c) for c in scalar)).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
        which, value = F, F
        for k, c in enumerate(scalar):
            mask = (2 ** len(scalar) - 1) ^ (1 << (len(scalar) - 1 - k))
            which, value = which.when(F.col("g") == mask, c), value.when(F.col("g") == mask, F.col(c).cast("string"))
        parts.append(once.select(which.alias("facet"), value.alias("value"), "n"))
    for c in columns:
        if c not in scalar:
            parts.append(df.select(F.explode(F.array_distinct(c)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("facet"), F.col("value").cast("string"), "n"))
    out = reduce(DataFrame.unionAll, parts).where(F.col("value").isNotNull())
    rank = F.lit(None).cast("int")
    for facet, values in (labels or {}).items():
        for k, v in enumerate(values):
            rank = F.when((F.col("facet") == facet) & (F.col("value") == v), k).otherwise(rank)
    return out.withColumn("rank", rank)


def counts_on(dim: DataFrame, fact: DataFrame, key: str, aggregates: Mapping[str, Column]) -> DataFrame:
    """Aggregates of the fact for every row of the dimension; those without facts get 0 for counts, null for others.

    The fact is aggregated before it is joined.
    """
    agg = fact.groupBy(key).agg(*(c.alias(n) for n, c in aggregates.items()))
    zero = [n for n in aggregates if n.startswith("n_")]
    return dim.join(agg, key, "left").fillna(0, zero)


def rollups(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Counts made apart, so that none multiplies another, side by side: the key and one n_<name> each."""
    long = reduce(DataFrame.unionAll, (df.select(key, F.lit(name).alias("which"), "n") for name, df in parts.items()))
    return long.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("which") == name, F.col("n"))), F.lit(0)).alias(f"n_{name}") for name in parts))


def votes(feedback: DataFrame) -> DataFrame:
    """useful and dead votes of each target; `feedback` has one row a target and voter."""
    return feedback.groupBy("target").agg(F.count_if(F.col("verdict") == "useful").alias("n_useful"), F.count_if(F.col("verdict") == "dead").alias("n_dead"))


def latency(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, upper median, least and greatest. The median is the element at floor(n / 2), exactly.

    Equal values are counted before they are sorted, so that hot keys cost their distinct values.
    """
    from pyspark.sql import Window

    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    run = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("until", run).withColumn("total", F.sum("c").over(w))
    half = F.floor(F.col("total") / 2)
    return placed.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 4).alias("mean"),
        F.min(F.when(F.col("until") > half, F.col(value))).alias("median"), F.min(value).alias("least"), F.max(value).alias("greatest"),
    )


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def distribution(df: DataFrame, key: str) -> DataFrame:
    """How often each value of the key occurs, most frequent first; missing ones count as `none`."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("none")).alias(key)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def run_summary(results: DataFrame, run: str) -> DataFrame:
    """Sources, successes and the status of each run: ok, partial or failed."""
    out = results.groupBy(run).agg(F.count(F.lit(1)).alias("n_sources"), F.count_if("ok").alias("n_ok"))
    return out.withColumn("status", F.when(F.col("n_ok") == F.col("n_sources"), "ok").when(F.col("n_ok") > 0, "partial").otherwise("failed"))
