"""Mixing sources to target weights: Efraimidis-Spirakis sampling, in DataFrame functions only.

Sources share the words of the corpus by weight. A source's target stops at MOST
times its size; what is above goes to the others by weight, until none is above.
A source gives as many complete epochs as fit into its target. For what is left,
each document draws a key u^(1/w), u from a hash of its id and w its quality
weight; documents go by descending key, their words are summed, and those before
the budget's end are taken once more. The document in which it ends gives its
first words, so that a source's words are its target, rounded.

Keys are cut into about sqrt(n) buckets of equal width for a source of n
documents. Weights are between 1 and MAX_WEIGHT, so that no bucket holds more than
MAX_WEIGHT times its share. Words are summed by bucket first, and only the bucket
in which the budget ends has its documents sorted. So no task sorts more than
about sqrt(n) rows of a source, and texts are read once and never shuffled.

One narrow row a source goes through one task, which ranks them and sums their
weights; a source table of up to SMALL rows is broadcast, a larger one is joined
by key.

Edge cases: null texts have 0 words and, like all documents of 0 words, 0 taken;
null sources are one source, the last; an empty table gives no rows; a null
doc_id counts as the empty string when hashed; rows that repeat are documents of
their own, equal ones interchangeable; other columns are ignored by `plan_mix` and
kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import set_aside, stored, with_row

WEIGHTS = (5, 2, 1)
#: A target stops at this many times its source's size.
MOST = 3
MAX_WEIGHT = 8.0
#: Rows up to which a table of sources is broadcast.
SMALL = 100_000

_GAP = r"\x20\x09-\x0D"


def n_words(text: str) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.length(F.regexp_replace(trimmed, f"[^{_GAP}]++[{_GAP}]*+", "x")).cast("long")


def prose_weight(text: str) -> Column:
    """1 to MAX_WEIGHT by the share of small letters, letters without case, and white space: signs and shouting weigh little."""
    whole = F.coalesce(F.col(text), F.lit(""))
    share = F.length(F.regexp_replace(whole, rf"[^\p{{Ll}}\p{{Lo}}\p{{M}}{_GAP}]++", "")) / F.greatest(F.length(whole), F.lit(1))
    squared = share * share
    return 1.0 + (MAX_WEIGHT - 1.0) * (squared * squared)


def draw(doc_id: str, weight: Column, seed: int) -> Column:
    """ln(u) / w, as high as the key u^(1/w) is; u in (0, 1] from the id, the same in every run and layout."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / float(1 << 52)
    return F.log(u) / F.greatest(F.lit(1.0), F.least(F.lit(MAX_WEIGHT), F.coalesce(weight, F.lit(1.0))))


def _joined(rows: DataFrame, table: DataFrame, on, how: str) -> DataFrame:
    """Broadcast behind a check of the table's rows; beyond it a join by key."""
    return rows.join(F.broadcast(table) if table.count() <= SMALL else table, on, how)


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """rows (source, size) -> source, rank, n, source_size, target: one row a source."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    capped = ranked.withColumn("w", weight).withColumn("cap", most * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("w"))
    # the level at which a source is if those that fill earlier are full and it is not
    before = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left.cast("double") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    at = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(every)
    target = F.when(F.col("level") <= F.col("fill"), F.col("at") * F.col("w")).otherwise(F.col("cap").cast("double"))
    levelled = capped.withColumn("level", level).withColumn("at", at).withColumn("target", target)
    return levelled.select("source", "rank", "n", "source_size", "target")


def _taken(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """rows (doc_id, source, size, x, ...) with source_size, target and taken."""
    plan = stored(source_targets(rows, weights, most), "mix-sources").withColumnRenamed("source", "_source")
    plan = plan.withColumn("goal", F.floor(F.col("target") + 0.5)).withColumn("epochs", F.expr("goal div greatest(source_size, 1)"))
    plan = plan.withColumn("left", F.col("goal") - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.sqrt("n")))
    placed = _joined(rows, plan, F.col("source").eqNullSafe(F.col("_source")), "inner")
    placed = placed.withColumn("bucket", F.least(F.col("buckets") - 1, F.floor(F.col("buckets") * (1.0 - F.exp("x")))))
    sums = placed.groupBy("rank", "bucket", "left").agg(F.sum("size").alias("in_bucket"))
    upto = F.sum("in_bucket").over(Window.partitionBy("rank").orderBy("bucket"))
    ends = sums.withColumn("rest", F.col("left") - upto + F.col("in_bucket")).where((F.col("rest") > 0) & (F.col("rest") <= F.col("in_bucket")))
    ends = stored(ends.select("rank", F.col("bucket").alias("edge"), "rest"), "mix-ends")
    whole = F.col("epochs") * F.col("size")
    met = _joined(placed, ends, "rank", "left")
    beside = met.where(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).withColumn("taken", whole + F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0))
    order = Window.partitionBy("rank").orderBy(F.desc("x"), F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("rest") - F.sum("size").over(order) + F.col("size")
    across = met.where(F.col("bucket") == F.col("edge")).withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), room)))
    return beside.unionByName(across)


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, quality: Column | None = None, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; `quality` are weights from columns of docs (default: prose_weight)."""
    weight = prose_weight("text") if quality is None else quality
    rows = stored(docs.select("doc_id", "source", n_words("text").alias("size"), draw("doc_id", weight, seed).alias("x")), "mix-rows")
    return _taken(rows, weights, most).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, quality: Column | None = None, seed: int = 1) -> DataFrame:
    """The mix itself: docs (all columns), a row for each time a document is taken; a last, partial one holds its first words."""
    hidden, back = set_aside(docs, "_row", "_r", "taken", "size", "_copy")
    keyed = with_row(hidden)
    weight = prose_weight("text") if quality is None else quality
    rows = stored(keyed.select("_row", "doc_id", "source", n_words("text").alias("size"), draw("doc_id", weight, seed).alias("x")), "mix-rows")
    taken = _taken(rows, weights, most).where("taken > 0").select(F.col("_row").alias("_r"), "size", "taken")
    copies = keyed.join(taken, F.col("_row") == F.col("_r")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    rest = F.col("taken") - (F.col("_copy") - 1) * F.col("size")
    words = F.slice(F.regexp_extract_all("text", F.lit(f"[^{_GAP}]+"), F.lit(0)), F.lit(1), rest.cast("int"))
    return back(copies.withColumn("text", F.when(rest >= F.col("size"), F.col("text")).otherwise(F.array_join(words, " "))).select(*hidden.columns))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    length(regexp_replace(coalesce(text, ''), '[^\p{Ll}\p{Lo}\p{M}\x20\x09-\x0D]+', '', 'g')) / greatest(length(coalesce(text, '')), 1) AS share,
    md5('1-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
r AS (SELECT doc_id, source, CAST(size AS BIGINT) AS size,
    ln((CAST('0x' || substr(digest, 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE) / (1.0::DOUBLE + 7.0::DOUBLE * ((share * share) * (share * share))) AS x FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM r GROUP BY source),
c AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
    FROM c WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level <= cap / w THEN max(CASE WHEN level <= cap / w THEN level END) OVER () * w ELSE CAST(cap AS DOUBLE) END AS target FROM l),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) // greatest(source_size, 1) AS epochs,
    CAST(floor(target + 0.5) AS BIGINT) % greatest(source_size, 1) AS rest FROM t)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - coalesce(sum(size) OVER (
    PARTITION BY r.source ORDER BY x DESC, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source
"""
