"""Chat formatting: cumulative-snapshot collapse, in DataFrame functions only.

Chat logs often store a conversation again after each turn, so that every
snapshot but the last is a prefix of a longer one. Turns are ordered and hashed;
a rolling hash after each turn covers it and all turns before it, so a
conversation is a prefix of another exactly when its last hash is among the
other's earlier ones. Equal conversations collapse to the smallest conv_id; an
anti-join removes those that prefix a longer one. The turns of what is left are
fetched again and rendered: only then are a conversation's texts in one row, as
its rendered text must be.

A rolling hash is two sums of 64-bit hashes of (place, role, text), with the
number of turns: exact sums, so that a window over a conversation makes them in
one pass and spills where it is long.

Edge cases: turns go by (turn, role, text), nulls first, and rows that repeat
wholly count once, before anything is grouped by conversation; rows without
conv_id are ignored; null role or text differs from the empty one when hashed
and renders as empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEMPLATE = ("<|", "|>\n", "\n")


def _hash(seed: int) -> Column:
    """64 bits over the turn's place, role and text, as a decimal whose sums are exact; null differs from empty."""
    return F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(19,0)")


def distinct_turns(turns: DataFrame) -> DataFrame:
    """The turns of conversations with an id, each once: repeats go before the shuffle, wherever they stand."""
    return turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text").distinct()


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """Distinct turns -> conv_id, pos, hash after the turn, and whether it is the last."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("pos", F.row_number().over(order)).withColumn("last", F.lead("pos").over(order).isNull())
    hashed = placed.select("conv_id", "turn", "role", "text", "pos", "last", _hash(1).alias("a"), _hash(2).alias("b"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return hashed.select("conv_id", "pos", F.struct("pos", F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b")).alias("hash"), "last")


def maximal(turns: DataFrame) -> DataFrame:
    """Distinct turns -> conv_id, n_equal: conversations that are no prefix of another; of equal ones the smallest conv_id."""
    rolled = rolling_hashes(turns)
    inner = rolled.where(~F.col("last")).select("hash").distinct()
    whole = rolled.where("last").groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    return whole.join(inner, "hash", "left_anti").select("conv_id", "n_equal")


def render(turns: DataFrame, kept: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """The turns of kept conversations as one training text: before role, after role, after text."""
    head, mid, tail = (F.lit(x) for x in template)
    convs = turns.join(kept, "conv_id").groupBy("conv_id", "n_equal").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    one = F.transform("turns", lambda t: F.concat(head, F.coalesce(t["role"], F.lit("")), mid, F.coalesce(t["text"], F.lit("")), tail))
    return convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_equal", F.array_join(one, "").alias("text"))


def format_chats(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_equal, text."""
    once = distinct_turns(turns)
    return render(once, maximal(once), template)


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n,
        list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS a,
        string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), ''
                   ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS txt
      FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS n_equal, a, min(n) AS n, min(txt) AS txt FROM c GROUP BY a)
SELECT u.conv_id, u.n AS n_turns, u.n_equal, u.txt AS text
FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.a[1] = u.a[1] AND v.n > u.n AND v.a[1:u.n] = u.a)
"""
