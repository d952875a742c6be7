"""Catalogue queries on the order tables: offers are orders, providers customers, models parts, endpoints suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import local_today, plain_number
from tidemark.operators import facets, listing, merge, publish
from tidemark.operators.dedupe import best_first
from tidemark.sources.tables import table

AS_OF = "1998-08-02 00:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def today():
    return local_today(as_of())


def offers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as offers, with their provider's name and region."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    start = F.col("o_orderdate").cast("date")
    a = o.select(
        k.alias("id"), F.col("o_custkey").alias("provider_id"), F.col("o_orderpriority").alias("category"), start.alias("start_date"),
        F.when(k % 7 != 0, F.date_add(start, (10 + k % 400).cast("int"))).alias("end_date"),
        F.when(F.col("o_orderstatus") == "F", "auto_ok").when(F.col("o_orderstatus") == "O", "approved").otherwise("pending").alias("review_status"),
        ((k % 100) / 100).alias("confidence"), (k % 3 == 0).alias("requires_card"), F.when(k % 13 == 0, "ended").alias("status_override"),
        F.when(k % 11 == 0, start).alias("archived_at"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_totalprice").alias("price"),
        F.when(k % 2 == 0, F.array(F.lit("all"))).otherwise(F.array(F.lit("student"), F.lit("new_user"))).alias("audience"),
    )
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("provider_id"), F.col("c_name").alias("provider"), F.when(F.col("c_nationkey") < 5, "CN").otherwise("GLOBAL").alias("region"))
    return listing.with_status(a.join(p, "provider_id"), today(), as_of())


OFFERS = """WITH a AS (SELECT o_orderkey AS id, o_custkey AS provider_id, o_orderpriority AS category, CAST(o_orderdate AS DATE) AS start_date,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(10 + o_orderkey % 400 AS INTEGER) END AS end_date,
  CASE o_orderstatus WHEN 'F' THEN 'auto_ok' WHEN 'O' THEN 'approved' ELSE 'pending' END AS review_status,
  (o_orderkey % 100) / 100.0::DOUBLE AS confidence, o_orderkey % 3 = 0 AS requires_card, CASE WHEN o_orderkey % 13 = 0 THEN 'ended' END AS status_override,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderdate AS DATE) END AS archived_at, o_orderdate AS created_at, o_totalprice AS price,
  CASE WHEN o_orderkey % 2 = 0 THEN ['all'] ELSE ['student', 'new_user'] END AS audience,
  c_name AS provider, CASE WHEN c_nationkey < 5 THEN 'CN' ELSE 'GLOBAL' END AS region
  FROM orders JOIN customer ON o_custkey = c_custkey),
v AS (SELECT *, CASE WHEN status_override IS NOT NULL THEN status_override WHEN archived_at IS NOT NULL THEN 'ended'
    WHEN start_date > DATE '1998-08-02' THEN 'upcoming' WHEN end_date < DATE '1998-08-02' THEN 'ended' ELSE 'active' END AS status,
  end_date - DATE '1998-08-02' AS days_left,
  coalesce(end_date >= DATE '1998-08-02' AND end_date - DATE '1998-08-02' <= 3, false) AS ending_soon,
  created_at >= TIMESTAMP '1998-08-01 00:00:00' AS is_new FROM a),
pub AS (SELECT * FROM v WHERE review_status IN ('auto_ok', 'approved'))
"""
_RANK = "CASE status WHEN 'active' THEN 0 WHEN 'upcoming' THEN 1 ELSE 2 END"
_SHOWN = "id, provider, category, status, CAST(end_date AS VARCHAR) AS end_date"


def shown(df: DataFrame) -> DataFrame:
    return df.select("id", "provider", "category", "status", F.col("end_date").cast("string").alias("end_date"))


@query(OFFERS + "SELECT id, status, CAST(days_left AS VARCHAR) AS days_left, ending_soon, is_new FROM v")
def lifecycle_status(spark, sf):
    return offers(spark, sf).select("id", "status", F.col("days_left").cast("string").alias("days_left"), "ending_soon", "is_new")


def _list(name: str, order: str, sort: str, page: int = 1):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return shown(listing.ListQuery(sort=sort, page=page).rows(offers(spark, sf)))

    run.__name__ = name
    query(OFFERS + f"SELECT {_SHOWN} FROM pub ORDER BY {order} LIMIT 24 OFFSET {24 * (page - 1)}")(run)


_list("active_list_default_sort", f"{_RANK}, coalesce(end_date, DATE '9999-12-31'), id DESC", "default")
_list("active_list_page_3", f"{_RANK}, coalesce(end_date, DATE '9999-12-31'), id DESC", "default", 3)
_list("active_list_export", f"{_RANK}, coalesce(end_date, DATE '9999-12-31'), confidence DESC, id DESC", "export")
_list("active_list_newest", "created_at DESC, id DESC", "newest")
_list("active_list_confidence", "confidence DESC, id DESC", "confidence")
_list("active_list_ending", "days_left ASC NULLS LAST, id DESC", "ending")
_list("active_list_ending_active_first", f"{_RANK}, days_left ASC NULLS LAST, id DESC", "ending_active_first")
_list("active_list_provider", "provider, id DESC", "provider")


@query(OFFERS + "SELECT id FROM v WHERE review_status IN ('auto_ok', 'approved') AND category IN ('1-URGENT', '2-HIGH') AND status IN ('active', 'ended') AND region = 'CN' AND NOT requires_card AND list_has_any(audience, ['student'])")
def filter_builder_combo(spark, sf):
    q = listing.ListQuery(category=["1-URGENT", "2-HIGH"], status=["active", "ended"], region=["CN"], no_card=True, audience=["student"])
    return q.where(offers(spark, sf)).select("id")


@query(OFFERS + "SELECT count(*) AS total, CAST(ceil(count(*) / 24.0) AS BIGINT) AS pages FROM v WHERE (end_date IS NULL OR end_date >= DATE '1998-01-01') AND start_date <= DATE '1998-12-31'")
def interval_overlap_total(spark, sf):
    return listing.ListQuery(include_pending=True, overlaps=("1998-01-01", "1998-12-31")).total(offers(spark, sf))


@query(OFFERS + "SELECT id FROM pub WHERE ending_soon AND status = 'active'")
def ending_soon(spark, sf):
    return listing.ListQuery(ending_soon=True).where(offers(spark, sf)).select("id")


_FACETS = """SELECT 'category' AS facet, category AS value, count(*) AS n FROM pub GROUP BY ALL
UNION ALL SELECT 'status', status, count(*) FROM pub GROUP BY ALL UNION ALL SELECT 'region', region, count(*) FROM pub GROUP BY ALL"""


@query(OFFERS + _FACETS + " UNION ALL SELECT 'audience', x, count(*) FROM (SELECT unnest(audience) AS x FROM pub) GROUP BY ALL")
def facets_multi(spark, sf):
    return facets.facets(listing.published(offers(spark, sf)), ["category", "status", "region", "audience"]).select("facet", "value", "n")


@query(OFFERS + _FACETS)
def facets_grouping_sets(spark, sf):
    return facets.facets(listing.published(offers(spark, sf)), ["category", "status", "region"]).select("facet", "value", "n")


@query(OFFERS + "SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (ending_soon) AS soon, count(*) FILTER (ending_soon AND status = 'active') AS soon_active, count(*) FILTER (is_new) AS fresh, count(DISTINCT provider_id) AS providers FROM pub")
def stats_summary(spark, sf):
    df = listing.published(offers(spark, sf))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if("ending_soon").alias("soon"),
        F.count_if(F.col("ending_soon") & (F.col("status") == "active")).alias("soon_active"), F.count_if("is_new").alias("fresh"), F.count_distinct("provider_id").alias("providers"),
    )


@query(OFFERS + "SELECT c_custkey AS provider_id, coalesce(n, 0) AS n_offers, coalesce(m, 0) AS n_active, CAST(last AS VARCHAR) AS last_start FROM customer LEFT JOIN (SELECT provider_id, count(*) AS n, count(*) FILTER (status = 'active') AS m, max(start_date) AS last FROM v GROUP BY ALL) ON provider_id = c_custkey")
def provider_rollup_view_filter(spark, sf):
    dim = table(spark, sf, "customer").select(F.col("c_custkey").alias("provider_id"))
    aggs = {"n_offers": F.count(F.lit(1)), "n_active": F.count_if(F.col("status") == "active"), "last_start": F.max("start_date").cast("string")}
    return facets.counts_on(dim, offers(spark, sf), "provider_id", aggs)


@query("SELECT s_suppkey, count(l_orderkey) AS n_items, sum(CASE WHEN l_shipdate >= DATE '1999-01-01' THEN 1 ELSE 0 END) AS n_late FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag IN ('A', 'R') GROUP BY ALL")
def provider_rollup_on_filter(spark, sf):
    fact = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select(F.col("l_suppkey").alias("s_suppkey"), "l_shipdate")
    aggs = {"n_items": F.count(F.lit(1)), "n_late": F.count_if(F.col("l_shipdate") >= F.lit("1999-01-01").cast("date"))}
    return facets.counts_on(table(spark, sf, "supplier").select("s_suppkey"), fact, "s_suppkey", aggs)


@query("SELECT l_partkey, count(*) AS n_endpoints, count(DISTINCT l_suppkey) AS n_providers FROM lineitem GROUP BY ALL")
def endpoint_counts_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_endpoints"), F.count_distinct("l_suppkey").alias("n_providers"))


@query("""WITH m AS (SELECT p_partkey, lower(p_type) AS cap FROM part UNION SELECT p_partkey, unnest(string_split(p_name, ' ')) FROM part),
x AS (SELECT cap, count(*) AS a, 0 AS b, 0 AS c FROM m GROUP BY cap UNION ALL
  SELECT lower(p_type), 0, count(*), 0 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL UNION ALL
  SELECT lower(p_type), 0, 0, count(DISTINCT l_suppkey) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT cap AS capability, CAST(sum(a) AS BIGINT) AS n_models, CAST(sum(b) AS BIGINT) AS n_endpoints, CAST(sum(c) AS BIGINT) AS n_providers FROM x GROUP BY ALL""")
def capability_three_way(spark, sf):
    p = table(spark, sf, "part")
    primary = p.select("p_partkey", F.lower("p_type").alias("capability"))
    models = primary.union(p.select("p_partkey", F.explode(F.split("p_name", " ")))).distinct().groupBy("capability").agg(F.count(F.lit(1)).alias("n"))
    met = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").join(primary, F.col("l_partkey") == F.col("p_partkey"))
    by = met.groupBy("capability")
    return facets.rollups({"models": models, "endpoints": by.agg(F.count(F.lit(1)).alias("n")), "providers": by.agg(F.count_distinct("l_suppkey").alias("n"))}, "capability")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name, l_extendedprice * (1 - l_discount) AS price
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45""")
def star_three_way(spark, sf):
    l = table(spark, sf, "lineitem").where("l_quantity >= 45")  # noqa: E741
    p, s = table(spark, sf, "part").select("p_partkey", "p_name"), table(spark, sf, "supplier").select("s_suppkey", "s_name")
    joined = l.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey)
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "s_name", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))


@query(OFFERS + f"""SELECT x.id, CAST(r AS INTEGER) AS rank, related_id FROM (
  SELECT x.id, y.id AS related_id, row_number() OVER (PARTITION BY x.id ORDER BY CASE y.status WHEN 'active' THEN 0 WHEN 'upcoming' THEN 1 ELSE 2 END,
    coalesce(y.end_date, DATE '9999-12-31'), y.id DESC) AS r FROM pub x JOIN pub y ON x.provider_id = y.provider_id AND x.id <> y.id) x WHERE r <= 6""")
def related_top6(spark, sf):
    return listing.related(listing.published(offers(spark, sf)), "provider_id", listing.orders("default"))


@query("""WITH e AS (SELECT l_partkey AS model, l_suppkey AS provider, max(l_quantity) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, provider) AS k FROM e) SELECT model, provider, score, CAST(k AS INTEGER) AS k FROM r WHERE k <= 3""")
def alternatives(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("model"), F.col("l_suppkey").alias("provider")).agg(F.max("l_quantity").alias("score"))
    w = Window.partitionBy("model").orderBy(F.desc("score"), "provider")
    return e.withColumn("k", F.row_number().over(w)).where("k <= 3")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_missing_refs(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return table(spark, sf, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def semi_id_set(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The customers as an older table of three quarters of them, and an incoming batch of another three quarters, some changed."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    old = c.where(k % 4 != 0).select(k.alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("note"))
    new = c.where(k % 4 != 1).select(k.alias("key"), F.col("c_name").alias("name"), F.when(k % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("amount"), F.when(k % 6 != 0, "n").alias("note"))
    return old, new


_VERSIONS = """WITH o AS (SELECT c_custkey AS key, c_name AS name, c_acctbal AS amount, c_mktsegment AS note FROM customer WHERE c_custkey % 4 <> 0),
n AS (SELECT c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS amount, CASE WHEN c_custkey % 6 <> 0 THEN 'n' END AS note FROM customer WHERE c_custkey % 4 <> 1)
"""


@query(_VERSIONS + """SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN o.name ELSE n.name END AS name, round(CASE WHEN n.key IS NULL THEN o.amount ELSE n.amount END, 2) AS amount,
coalesce(n.note, o.note) AS note, CASE WHEN o.key IS NULL THEN 'insert' WHEN n.key IS NULL THEN 'none' WHEN o.amount <> n.amount THEN 'update' ELSE 'touch' END AS change
FROM o FULL JOIN n ON o.key = n.key""")
def upsert_merge(spark, sf):
    old, new = _versions(spark, sf)
    return merge.upsert(old, new, "key", ["name", "amount"], as_of(), sticky=["note"]).withColumn("amount", F.round("amount", 2))


@query(_VERSIONS + "SELECT o.key, 'note' AS field, o.note AS old_value, n.note AS new_value FROM o JOIN n USING (key) WHERE o.note IS DISTINCT FROM n.note")
def change_history(spark, sf):
    old, new = _versions(spark, sf)
    return merge.changes(old, new, "key", ["name", "note"])


@query(OFFERS + """SELECT id, CAST(CASE WHEN archived_at IS NULL AND end_date IS NOT NULL AND DATE '1998-08-02' - end_date > 30 AND status_override IS NULL THEN DATE '1998-08-02'
ELSE archived_at END AS VARCHAR) AS archived_at FROM v""")
def archive_expired(spark, sf):
    return merge.archive(offers(spark, sf), today(), today()).select("id", F.col("archived_at").cast("string").alias("archived_at"))


_TOPIC = "concat_ws('::', provider, category, CASE WHEN requires_card THEN 'client' ELSE 'api' END)"


@query(OFFERS + f"""SELECT id, topic FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY confidence DESC, id) AS k FROM (
  SELECT *, {_TOPIC} AS topic FROM pub WHERE confidence >= 0.75 AND archived_at IS NULL ORDER BY confidence DESC, id LIMIT 50)) WHERE k = 1""")
def guide_topics(spark, sf):
    named = listing.published(offers(spark, sf)).withColumn("topic", publish.topic(F.col("provider"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.col("category"), F.col("requires_card")))
    return publish.guide_topics(named).select("id", "topic")


@query("""WITH s AS (SELECT c_custkey AS sub_id, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE [CAST(c_custkey % 150 AS VARCHAR)] END AS p, CASE WHEN c_custkey % 2 = 0 THEN [] ELSE ['purchase', 'signup'] END AS c FROM customer)
SELECT sub_id, count(*) AS n FROM s JOIN events ON (len(p) = 0 OR list_contains(p, CAST(user_id AS VARCHAR))) AND (len(c) = 0 OR list_contains(c, event_type)) GROUP BY ALL""")
def subscription_match(spark, sf):
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    filters = F.struct(
        F.when(k % 3 == 0, none).otherwise(F.array((k % 150).cast("string"))).alias("providers"),
        F.when(k % 2 == 0, none).otherwise(F.array(F.lit("purchase"), F.lit("signup"))).alias("categories"), none.alias("audience"),
    )
    subs = table(spark, sf, "customer").select(k.alias("sub_id"), filters.alias("filters"))
    items = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("provider"), F.col("event_type").alias("category"), none.alias("audience"))
    return publish.match_counts(subs, items)


@query("SELECT p_partkey, '$' || CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.2f', p_retailprice), '0') END AS shown FROM part")
def benefit_format(spark, sf):
    from tidemark.functions.text import format_benefit

    return table(spark, sf, "part").select("p_partkey", format_benefit(F.lit("credit_usd"), F.col("p_retailprice"), F.lit("USD"), F.lit(None).cast("string")).alias("shown"))


@query("""SELECT coalesce(CAST(CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(10 + o_orderkey % 400 AS INTEGER) END AS VARCHAR), 'long term') AS deadline, count(*) AS n FROM orders GROUP BY ALL""")
def timeline_by_deadline(spark, sf):
    return offers(spark, sf).groupBy(F.coalesce(F.col("end_date").cast("string"), F.lit("long term")).alias("deadline")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return facets.duplicates(table(spark, sf, "part"), "p_name")


@query("SELECT c_custkey, max(o_orderkey) AS o_orderkey, CAST(max(o_orderdate) AS VARCHAR)[1:10] AS at FROM (SELECT o_custkey AS c_custkey, * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) GROUP BY ALL")
def latest_per_key(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderdate").cast("date").alias("at"))
    return best_first(o, ["c_custkey"], -F.unix_date("at"), -F.col("o_orderkey")).withColumn("at", F.col("at").cast("string"))
