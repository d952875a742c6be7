"""Keyed merge with field history, archive, review and latest-wins, all as new snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.dedupe import best_first



def changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row for each field that differs: key, field, old_value, new_value; null differs from any value."""
    a, b = old.select(key, *(F.col(f).alias(f"old_{f}") for f in fields)), new.select(key, *(F.col(f).alias(f"new_{f}") for f in fields))
    every = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").cast("string").alias("old_value"), F.col(f"new_{f}").cast("string").alias("new_value")) for f in fields))
    differing = F.filter(every, lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))
    return a.join(b, key).select(key, F.explode(differing).alias("c")).select(key, "c.*")


def upsert(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], as_of: Column, sticky: Sequence[str] = (), id_column: str | None = None) -> DataFrame:
    """The table after the merge, with `change` (insert, update, touch, none).

    `fields` take the new value, `sticky` only where the new value is not null;
    whatever else the table has stays on updates. Rows that match are touched
    (last_verified_at). New rows get ids after the greatest id, in key order:
    their number is by a window over the new rows' ranks within key ranges.
    """
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new, has_new = F.col(f"o.{key}").isNull(), F.col(f"n.{key}").isNotNull()
    moved = F.lit(False)
    for f in fields:
        moved = moved | ~F.col(f"o.{f}").cast("string").eqNullSafe(F.col(f"n.{f}").cast("string"))
    change = F.when(is_new, "insert").when(~has_new, "none").when(moved, "update").otherwise("touch")
    cols = []
    for c in old.columns:
        if c == key:
            cols.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c == "last_verified_at":
            cols.append(F.when(has_new, as_of).otherwise(F.col(f"o.{c}")).alias(c))
        elif c == "updated_at":
            cols.append(F.when(is_new | (has_new & moved), as_of).otherwise(F.col(f"o.{c}")).alias(c))
        elif c == "created_at":
            cols.append(F.coalesce(F.col(f"o.{c}"), as_of).alias(c))
        elif c in sticky:
            cols.append((F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")).alias(c))
        elif c in fields:
            cols.append(F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append((F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in new.columns else F.col(f"o.{c}")).alias(c))
    merged = joined.select(*cols, change.alias("change"))
    return with_new_ids(merged, id_column, key) if id_column else merged


def with_new_ids(merged: DataFrame, id_column: str, key: str, buckets: int = 4096) -> DataFrame:
    """Consecutive ids after the greatest for rows without one, in key order within hash buckets.

    Numbers are given per bucket and shifted by the buckets before, so that no
    task numbers all new rows.
    """
    b = F.pmod(F.xxhash64(key), F.lit(buckets))
    fresh = merged.where(F.col(id_column).isNull()).withColumn("_b", b)
    sizes = fresh.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # at most `buckets` rows
    base = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    top = merged.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    numbered = fresh.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    joined = numbered.join(F.broadcast(base), "_b").join(F.broadcast(top))
    given = joined.withColumn(id_column, (F.col("_top") + F.coalesce("_before", F.lit(0)) + F.col("_k")).cast("long"))
    return merged.where(F.col(id_column).isNotNull()).unionByName(given.select(*merged.columns))


def apply_patches(table: DataFrame, patches: DataFrame, key: str, fields: Sequence[str], as_of: Column) -> DataFrame:
    """Manual review: `fields` that a patch gives replace the table's; action approve / reject sets review_status, reject archives."""
    p = patches.select(F.col(key).alias("_k"), F.col("action").alias("_action"), *(F.col(f).alias(f"_p_{f}") for f in fields))
    joined = table.join(p, F.col(key) == F.col("_k"), "left")
    status = F.when(F.col("_action") == "approve", "approved").when(F.col("_action") == "reject", "rejected").otherwise(F.col("review_status"))
    sets = {f: F.coalesce(F.col(f"_p_{f}"), F.col(f)) for f in fields}
    sets |= {"review_status": status, "archived_at": F.when(F.col("_action") == "reject", as_of).otherwise(F.col("archived_at"))}
    return joined.withColumns(sets).select(*table.columns)


def archive(table: DataFrame, today: Column, as_of: Column, after_days: int = 30) -> DataFrame:
    """archived_at set for rows long over without an override, and for all rejected ones."""
    over = (F.datediff(today, F.col("end_date")) > after_days) & F.col("status_override").isNull()
    due = F.col("archived_at").isNull() & F.coalesce(over | (F.col("review_status") == "rejected"), F.lit(False))
    return table.withColumn("archived_at", F.when(due, as_of).otherwise(F.col("archived_at")))


def latest(df: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """The last write of each key."""
    return best_first(df, keys, *newest_first)


def disable_missing(table: DataFrame, configured: DataFrame, key: str) -> DataFrame:
    """Rows whose key is no longer configured are disabled, not deleted."""
    have = configured.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_here", F.lit(True))
    return table.join(have, F.col(key) == F.col("_k"), "left").withColumn("enabled", F.coalesce("_here", F.lit(False))).drop("_k", "_here")


def unchanged(snapshots: DataFrame, source: str, order: str, digest: Column) -> DataFrame:
    """snapshots with `unchanged`: the content equals that of the same source's previous snapshot."""
    w = Window.partitionBy(source).orderBy(order)
    return snapshots.withColumn("digest", digest).withColumn("unchanged", F.coalesce(F.lag("digest").over(w) == F.col("digest"), F.lit(False)))


def revalidated(table: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Items whose review status changes under new verdicts (key, action): key, was, now. What a person decided stays."""
    v = verdicts.select(F.col(key).alias("_k"), F.when(F.col("action") == "reject", "rejected").when(F.col("action") == "auto_ok", "auto_ok").otherwise("pending").alias("now"))
    manual = F.col("review_status").isin("approved", "rejected")
    met = table.where(~F.coalesce(manual, F.lit(False))).join(v, F.col(key) == F.col("_k"))
    return met.where(~F.col("review_status").eqNullSafe(F.col("now"))).select(key, F.col("review_status").alias("was"), "now")


def relinked(items: DataFrame, links: DataFrame) -> DataFrame:
    """items (id, model_id, endpoint_id) and new links -> those that change; items without a new link keep what they have."""
    new = links.select(F.col("id").alias("_id"), F.col("model_id").alias("new_model"), F.col("endpoint_id").alias("new_endpoint")).where("new_model IS NOT NULL")
    met = items.join(new, F.col("id") == F.col("_id"))
    same = F.col("model_id").eqNullSafe(F.col("new_model")) & F.col("endpoint_id").eqNullSafe(F.col("new_endpoint"))
    return met.where(~same).select("id", "model_id", "endpoint_id", "new_model", "new_endpoint")


def source_key(url: Column, query: Column, kind: Column) -> Column:
    """What a configured source is known by: its address, or its query and kind."""
    return F.coalesce(F.nullif(url, F.lit("")), F.concat_ws("|", query, kind))


def config_sync(table: DataFrame, configured: DataFrame, key: str, fields: Sequence[str], as_of: Column) -> DataFrame:
    """The table after the configuration: entries inserted or updated by key, those missing there disabled and kept."""
    return disable_missing(upsert(table, configured, key, fields, as_of), configured, key)


def delivered(subscriptions: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """subscriptions (sub_id, active, fail_count, last_push_at) after results (sub_id, status): a success clears the count, 404 and 410 end it."""
    r = results.select(F.col("sub_id").alias("_id"), "status")
    ok = F.col("status").between(200, 299)
    met = subscriptions.join(r, F.col("sub_id") == F.col("_id"), "left")
    tried = F.col("_id").isNotNull()
    return met.withColumns({
        "fail_count": F.when(~tried, F.col("fail_count")).when(F.coalesce(ok, F.lit(False)), 0).otherwise(F.col("fail_count") + 1),
        "active": F.col("active") & ~F.coalesce(F.col("status").isin(404, 410), F.lit(False)),
        "last_push_at": F.when(tried & F.coalesce(ok, F.lit(False)), as_of).otherwise(F.col("last_push_at")),
    }).select(*subscriptions.columns)
