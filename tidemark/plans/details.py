"""Verification, details of single things, probes, model replies, guides and the daily run, on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import display
from tidemark.jobs import daily
from tidemark.operators import details, facets, guides, listing, model_output, probes, verification
from tidemark.plans import cases
from tidemark.plans.cases import pick, say
from tidemark.plans.catalogue import _RANK, OFFERS, as_of, offers, today
from tidemark.sources import relays
from tidemark.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def due(spark: SparkSession, sf: str) -> DataFrame:
    """Offers, two thirds of them verified before."""
    k = F.col("id")
    return offers(spark, sf).withColumn("last_verified_at", F.when(k % 3 != 0, F.timestamp_seconds(F.lit(900000000) + (k * 7919) % 1000000)))


_DUE = OFFERS + """, d AS (SELECT *, CASE WHEN id % 3 <> 0 THEN make_timestamp((900000000 + (id * 7919) % 1000000) * 1000000) END AS last_verified_at FROM pub WHERE status = 'active' AND archived_at IS NULL)
"""


@query(_DUE + "SELECT id, CAST(last_verified_at AS VARCHAR) AS last_verified_at FROM d ORDER BY d.last_verified_at NULLS FIRST, id LIMIT 25")
def verification_queue(spark, sf):
    return verification.verification_queue(due(spark, sf)).select("id", F.col("last_verified_at").cast("string").alias("last_verified_at"))


def _round(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The whole queue, and what a round found: pages that are gone, silent, empty or fine, and every kind of answer; nobody's credentials are refused."""
    queue = verification.verification_queue(due(spark, sf), None)
    k = F.col("id") % 9
    code = pick(k, F.lit(404), F.lit(410), F.lit(None).cast("int"), F.lit(503), F.lit(200)).cast("int")
    page = F.when(k == 4, "<p>short</p>").otherwise("<html><body><p>" + "An offer is told of here at some length. " + "</p></body></html>")
    reply = pick(k - 5, F.lit('```json\n{"stillValid": true, "reason": "seen"}\n```'), say('{"stillValid": false, "reason": "over {k}"}', k=F.col("id")), F.lit('{"stillValid": null}'))
    pages = queue.select("id", F.when(k < 5, code).otherwise(200).alias("status_code"), page.alias("html"))
    replies = queue.where(k > 4).select("id", F.when(k == 8, 500).otherwise(200).alias("reply_code"), reply.alias("reply"))
    return queue, verification.outcomes(queue, pages, replies)


_OUTCOME = "CASE WHEN id % 9 IN (0, 1, 6) THEN 'ended' WHEN id % 9 IN (2, 3, 4) THEN 'unreachable' WHEN id % 9 = 5 THEN 'confirmed' WHEN id % 9 = 7 THEN 'undecided' ELSE 'failed' END"


@query(_DUE + f"SELECT id, {_OUTCOME} AS outcome, CASE id % 9 WHEN 0 THEN 'page 404' WHEN 1 THEN 'page 410' WHEN 6 THEN 'over ' || id END AS reason FROM d")
def verification_outcomes(spark, sf):
    return _round(spark, sf)[1]


@query(_DUE + f"""SELECT v.id, CASE WHEN o = 'ended' THEN 'ended' ELSE v.status_override END AS status_override, CAST(CASE WHEN o = 'ended' AND v.end_date IS NULL THEN DATE '1998-08-02' ELSE v.end_date END AS VARCHAR) AS end_date,
CASE WHEN o <> 'failed' THEN 'now' WHEN v.id % 3 <> 0 THEN 'before' END AS verified FROM v LEFT JOIN (SELECT id, {_OUTCOME} AS o FROM d) x ON x.id = v.id""")
def verified_offers(spark, sf):
    done = verification.verified(due(spark, sf), _round(spark, sf)[1], today(), as_of())
    when = F.when(F.col("last_verified_at") == as_of(), "now").when(F.col("last_verified_at").isNotNull(), "before")
    return done.select("id", "status_override", F.col("end_date").cast("string").alias("end_date"), when.alias("verified"))


@query(_DUE + f"SELECT count(*) AS checked, count(*) FILTER ({_OUTCOME} = 'ended') AS ended, count(*) FILTER ({_OUTCOME} = 'confirmed') AS confirmed, count(*) FILTER ({_OUTCOME} = 'unreachable') AS unreachable FROM d")
def verification_tally(spark, sf):
    return verification.tally(_round(spark, sf)[1])


@query(OFFERS + """, h AS (SELECT l_orderkey AS id, string_agg(l_linenumber || ':' || l_shipdate::DATE, ',' ORDER BY l_shipdate DESC, lid DESC) AS history FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, lid DESC) AS r FROM (SELECT *, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS lid FROM lineitem)) WHERE r <= 3 GROUP BY 1),
near AS (SELECT provider_id, list(id ORDER BY coalesce(CAST(end_date AS VARCHAR), '9999-12-31'), id) AS ids FROM pub GROUP BY 1)
SELECT v.id, coalesce(history, '') AS history, coalesce(array_to_string(list_filter(ids, lambda x: x <> v.id)[1:6], ','), '') AS related FROM v LEFT JOIN h ON h.id = v.id LEFT JOIN near ON near.provider_id = v.provider_id""")
def offer_details(spark, sf):
    """Each order's lines as its history, the newest three of them."""
    h = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("id"), F.col("l_orderkey").alias("offer_id"), F.col("l_linenumber").cast("string").alias("field"),
        F.lit(None).cast("string").alias("old_value"), F.col("l_quantity").cast("string").alias("new_value"), F.lit("crawl").alias("changed_by"), F.col("l_shipdate").alias("changed_at"),
    )
    d = details.offer_details(offers(spark, sf), h, most_changes=3)
    told = F.transform("history", lambda x: F.concat(x["field"], F.lit(":"), F.substring(x["changed_at"].cast("string"), 1, 10)))
    return d.select("id", F.array_join(told, ",").alias("history"), F.array_join("related", ",").alias("related"))


@query(OFFERS + "SELECT id, confidence FROM v WHERE review_status = 'pending' ORDER BY confidence DESC, id DESC LIMIT 50")
def review_queue(spark, sf):
    return details.review_queue(offers(spark, sf)).select("id", "confidence")


@query("""SELECT e.event_id AS id, user_id % 50 AS run_id, s_name AS provider_name, n_name AS source_url, CAST(row_number() OVER (PARTITION BY user_id % 50 ORDER BY s_name, n_name, event_id) AS INTEGER) AS place
FROM events e JOIN supplier ON s_suppkey = event_id % 10 JOIN nation ON n_nationkey = s_nationkey""")
def run_attempts(spark, sf):
    """Events as attempts: suppliers are sources, of providers of their own name, their nation is the address."""
    a = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("run_id"), (F.col("event_id") % 10).alias("source_id"), F.col("event_id").alias("attempt_no"), F.lit("ok").alias("status"))
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sources = s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("provider_id"), F.col("n_name").alias("url"), F.lit("page").alias("kind"))
    providers = s.select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("slug"), F.col("s_name").alias("name"))
    return details.run_attempts(a, sources, providers).select("id", "run_id", "provider_name", "source_url", "place")


def of_models(spark: SparkSession, sf: str) -> DataFrame:
    """Offers of which every second is of a model, a part, and every fourth of an endpoint of it."""
    k = F.col("id")
    return offers(spark, sf).withColumns({"model_id": F.when(k % 2 == 0, k % 50), "endpoint_id": F.when(k % 4 == 0, k % 50 * 10 + 1), "updated_at": F.col("created_at")})


_OF = OFFERS + ", w AS (SELECT *, CASE WHEN id % 2 = 0 THEN id % 50 END AS model_id, CASE WHEN id % 4 = 0 THEN id % 50 * 10 + 1 END AS endpoint_id FROM v), wp AS (SELECT * FROM w WHERE review_status IN ('auto_ok', 'approved'))\n"


@query(_OF + f"SELECT model_id, CAST(row_number() OVER (PARTITION BY model_id ORDER BY {_RANK}, coalesce(CAST(end_date AS VARCHAR), '9999-12-31'), id) AS INTEGER) AS place, id FROM wp WHERE model_id IS NOT NULL")
def offers_of_models(spark, sf):
    return details.offers_of(of_models(spark, sf), "model_id")


@query(_OF + f"SELECT endpoint_id, CAST(row_number() OVER (PARTITION BY endpoint_id ORDER BY {_RANK}, coalesce(CAST(end_date AS VARCHAR), '9999-12-31'), id) AS INTEGER) AS place, id FROM wp WHERE endpoint_id IS NOT NULL")
def offers_of_endpoints(spark, sf):
    return details.offers_of(of_models(spark, sf), "endpoint_id")


def part_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """What each supplier has of a part as an endpoint."""
    e = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    k = F.col("l_partkey") * 100000 + F.col("l_suppkey")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("provider_name"))
    return e.join(s, "l_suppkey").select(
        k.alias("id"), F.col("l_partkey").alias("model_id"), F.col("l_suppkey").alias("provider_id"), "provider_name", (F.col("l_suppkey") % 3).alias("tier"), (k % 3 == 0).alias("requires_card"), (k % 11 != 0).alias("enabled")
    )


_ENDS = """WITH e AS (SELECT l_partkey * 100000 + l_suppkey AS id, l_partkey AS model_id, l_suppkey AS provider_id, s_name AS provider_name, l_suppkey % 3 AS tier, (l_partkey * 100000 + l_suppkey) % 3 = 0 AS requires_card,
  (l_partkey * 100000 + l_suppkey) % 11 <> 0 AS enabled FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey)
"""


@query(_ENDS + """SELECT p_partkey AS id, coalesce(ids, '') AS endpoints, coalesce(n, 0) AS endpoint_count, coalesce(p, 0) AS provider_count FROM part LEFT JOIN (
SELECT model_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY requires_card, tier, provider_name, id) AS ids, count(*) AS n, count(DISTINCT provider_id) AS p FROM e WHERE enabled GROUP BY 1) ON model_id = p_partkey""")
def model_details(spark, sf):
    d = details.model_details(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), part_endpoints(spark, sf))
    return d.select("id", F.array_join("endpoints", ",").alias("endpoints"), F.col("endpoint_count").cast("long").alias("endpoint_count"), "provider_count")


@query(_ENDS + """, a AS (SELECT model_id, list(id ORDER BY requires_card, provider_name, id) AS ids FROM e WHERE enabled GROUP BY 1)
SELECT id, coalesce(array_to_string(list_filter(ids, lambda x: x <> id), ','), '') AS alternatives FROM e LEFT JOIN a USING (model_id)""")
def endpoint_details(spark, sf):
    return details.endpoint_details(part_endpoints(spark, sf)).select("id", F.array_join("alternatives", ",").alias("alternatives"))


def _providers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_nationkey") % 3).alias("tier"))


@query(OFFERS + """SELECT c_custkey AS id, coalesce(n, 0) AS activity_count, coalesce(m, 0) AS active_count, CAST(last AS VARCHAR)[1:10] AS last FROM customer
LEFT JOIN (SELECT provider_id, count(*) AS n, count(*) FILTER (status = 'active') AS m, max(created_at) AS last FROM v GROUP BY 1) ON provider_id = c_custkey""")
def provider_list(spark, sf):
    d = details.provider_list(_providers(spark, sf), of_models(spark, sf))
    return d.select("id", "activity_count", "active_count", F.substring(F.col("last_activity_at").cast("string"), 1, 10).alias("last"))


@query(OFFERS + """SELECT c_custkey AS id, coalesce(n, 0) AS activity_count, coalesce(m, 0) AS active_count FROM customer
LEFT JOIN (SELECT provider_id, count(*) AS n, count(*) FILTER (end_date IS NULL OR end_date >= DATE '1998-08-02') AS m FROM pub GROUP BY 1) ON provider_id = c_custkey""")
def provider_list_exported(spark, sf):
    return details.provider_list(_providers(spark, sf), of_models(spark, sf), today()).select("id", "activity_count", "active_count")


@query(OFFERS + "SELECT c_custkey AS id FROM customer LEFT JOIN (SELECT provider_id, count(*) FILTER (status = 'active') AS m FROM v GROUP BY 1) ON provider_id = c_custkey ORDER BY c_nationkey % 3, coalesce(m, 0) DESC, c_name LIMIT 20")
def provider_list_first(spark, sf):
    return details.provider_list(_providers(spark, sf), of_models(spark, sf)).orderBy(*details.provider_order()).limit(20).select("id")


def _capable(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), F.lower("p_type").alias("capability"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.split("p_name", " ")).alias("capabilities"))


def _counted(listed: str, shown: str) -> str:
    return _ENDS + f""", m AS (SELECT p_partkey AS id, lower(p_type) AS capability, CASE WHEN p_partkey % 3 = 0 THEN [lower(p_type)] ELSE string_split(p_name, ' ') END AS caps FROM part),
w AS (SELECT * FROM ({OFFERS} SELECT id, CASE WHEN id % 2 = 0 THEN id % 50 END AS model_id, status, review_status FROM v)),
n AS (SELECT capability, 'm' AS k, count(*) AS c FROM (SELECT DISTINCT id, unnest({listed}) AS capability FROM m) GROUP BY 1
  UNION ALL SELECT capability, 'e', count(*) FROM e JOIN m ON m.id = model_id WHERE enabled GROUP BY 1 UNION ALL SELECT capability, 'p', count(DISTINCT provider_id) FROM e JOIN m ON m.id = model_id WHERE enabled GROUP BY 1
  UNION ALL SELECT capability, 'a', count(*) FROM (SELECT DISTINCT w.id, unnest(caps) AS capability FROM w JOIN m ON m.id = model_id WHERE {shown}) GROUP BY 1)
SELECT capability, CAST(coalesce(sum(c) FILTER (k = 'e'), 0) AS BIGINT) AS endpoint_count, CAST(coalesce(sum(c) FILTER (k = 'p'), 0) AS BIGINT) AS provider_count, CAST(coalesce(sum(c) FILTER (k = 'm'), 0) AS BIGINT) AS model_count,
CAST(coalesce(sum(c) FILTER (k = 'a'), 0) AS BIGINT) AS activity_count FROM n GROUP BY capability"""


@query(_counted("list_append(caps, capability)", "status IN ('active', 'upcoming')"))
def capability_counts(spark, sf):
    return details.capability_counts(_capable(spark, sf), part_endpoints(spark, sf), of_models(spark, sf))


@query(_counted("caps", "review_status IN ('auto_ok', 'approved')"))
def capability_counts_exported(spark, sf):
    return details.capability_counts(_capable(spark, sf), part_endpoints(spark, sf), of_models(spark, sf), True)


@query(OFFERS + """SELECT 'total' AS name, NULL AS value, count(*) AS n FROM pub UNION ALL SELECT 'ending_soon', NULL, count(*) FILTER (ending_soon) FROM pub UNION ALL SELECT 'new', NULL, count(*) FILTER (is_new) FROM pub
UNION ALL SELECT 'providers', NULL, count(DISTINCT provider_id) FROM pub UNION ALL SELECT 'pending', NULL, count(*) FROM v WHERE review_status = 'pending'
UNION ALL SELECT 'status', status, count(*) FROM pub GROUP BY 2 UNION ALL SELECT 'provider', provider, count(*) FROM pub GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM pub GROUP BY 2
UNION ALL SELECT 'audience', a, count(*) FROM (SELECT unnest(audience) AS a FROM pub) GROUP BY 2
UNION ALL SELECT unnest(['sources_total', 'sources_ok', 'items_new']), NULL, unnest([s_suppkey, s_suppkey // 2, s_nationkey]) FROM (SELECT * FROM supplier ORDER BY s_suppkey DESC LIMIT 1)""")
def catalogue_stats(spark, sf):
    runs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("sources_total"), F.expr("s_suppkey div 2").alias("sources_ok"), F.col("s_nationkey").cast("long").alias("items_new"))
    return details.catalogue_stats(offers(spark, sf), runs)


@query("SELECT id, name FROM (SELECT s_suppkey AS id, s_name AS name FROM supplier) ORDER BY id DESC LIMIT 30")
def run_list(spark, sf):
    return details.run_list(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as paths tried on their customer's site: long and short pages, errors, pages that lead to one address, and ones with one text."""
    k = F.col("o_orderkey")
    page = F.when(k % 7 == 0, F.lit("<p>" + "the same long page " * 30 + "</p>")).when(k % 7 == 1, "<p>thin</p>").otherwise(say("<script>x</script><p>" + "page {k} says much " * 30 + "</p>", k=k))
    url = say("https://site{c}.example.com/p{k}", c=F.col("o_custkey"), k=k)
    return table(spark, sf, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("site"), url.alias("url"), F.when(k % 5 == 0, say("http://WWW.site{c}.example.com/blog/", c=F.col("o_custkey"))).otherwise(url).alias("final_url"),
        F.when(k % 11 == 0, 404).when(k % 13 != 0, 200).cast("int").alias("status_code"), page.alias("html"),
    )


_PROBED = """WITH p AS (SELECT o_orderkey AS id, o_custkey AS site, 'https://site' || o_custkey || '.example.com/p' || o_orderkey AS url, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS answered, o_orderkey % 7 AS k7,
  CASE WHEN o_orderkey % 5 = 0 THEN 'blog' ELSE 'p' || o_orderkey END AS key, CASE o_orderkey % 7 WHEN 0 THEN repeat('the same long page ', 30) WHEN 1 THEN 'thin' ELSE repeat('page ' || o_orderkey || ' says much ', 30) END AS raw FROM orders),
q AS (SELECT *, CASE WHEN answered THEN trim(raw) ELSE '' END AS shown FROM p),
r AS (SELECT *, length(shown) AS text_len, CASE WHEN shown <> '' THEN sha256(shown)[1:16] END AS body_hash, answered AND length(shown) >= 400 AS ok, answered AND length(shown) < 400 AS shell FROM q)
"""


@query(_PROBED + "SELECT id, CAST(text_len AS INTEGER) AS text_len, body_hash, ok, shell FROM r")
def probed_pages(spark, sf):
    return probes.probed(_probes(spark, sf)).select("id", "text_len", "body_hash", "ok", "shell")


# a page with the blog's address and one with the common text are each first of their kind; which of both kinds comes first decides about the others
@query(_PROBED + """, o AS (SELECT * FROM r WHERE ok), w AS (SELECT *, key = 'blog' AS b, k7 = 0 AS c FROM o),
firsts AS (SELECT site, min(id) FILTER (b) AS fb, min(id) FILTER (c) AS fc, min(id) FILTER (b AND NOT c) AS fbn, min(id) FILTER (c AND NOT b) AS fcn, min(id) FILTER (b AND c) AS fbc FROM w GROUP BY site),
kept AS (SELECT site, CASE WHEN fb IS NULL THEN NULL WHEN fb = fbc AND fc < fb THEN fbn ELSE fb END AS kb, CASE WHEN fc IS NULL THEN NULL WHEN fc = fbc AND fb < fc THEN fcn ELSE fc END AS kc FROM firsts)
SELECT r.id, CASE WHEN NOT r.ok THEN NULL WHEN key = 'blog' AND kb < r.id THEN (SELECT url FROM r x WHERE x.id = kb) WHEN k7 = 0 AND kc < r.id THEN (SELECT url FROM r x WHERE x.id = kc) END AS duplicate_of FROM r LEFT JOIN kept ON kept.site = r.site""")
def distinct_pages(spark, sf):
    return probes.distinct_pages(probes.probed(_probes(spark, sf)), "site", "id").select("id", "duplicate_of")


@query(_PROBED + """, c AS (SELECT *, row_number() OVER (PARTITION BY site, body_hash ORDER BY id) AS n, body_hash = sha256(trim(repeat('the same long page ', 30)))[1:16] AND site % 2 = 0 AS home FROM r)
SELECT id, body_hash IS NOT NULL AND (n > 1 OR home) AS catch_all, ok AND NOT (body_hash IS NOT NULL AND (n > 1 OR home)) AS usable FROM c""")
def proposed_pages(spark, sf):
    """Every second site answers what it does not know with its homepage."""
    p = probes.probed(_probes(spark, sf))
    home = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("site"), F.lit(200).alias("status_code"), F.lit("<p>" + "the same long page " * 30 + "</p>").alias("html"))
    return probes.proposed(p, probes.probed(home).select("site", "body_hash"), "site", "id").select("id", "catch_all", "usable")


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k FROM orders WHERE o_orderkey % 8 <> 7)
SELECT id, CASE WHEN k = 1 THEN 'candidate ' || id WHEN k = 2 THEN 'untitled' ELSE 'Title ' || id END AS title, CASE WHEN k = 3 THEN 'trial' ELSE 'free_credit' END AS category, CASE WHEN k <> 4 THEN 'token' END AS kind,
CASE WHEN k NOT IN (4, 5) THEN CAST(id AS DOUBLE) END AS amount, CASE WHEN k = 6 THEN 'student,new_user' ELSE 'all' END AS audience, CASE WHEN k = 0 THEN '2026-03-05' WHEN k = 3 THEN '2025-12-31' END AS until,
CASE WHEN k = 5 THEN NULL ELSE 'https://go.vendor.example.com/c/' || id END AS link, CASE WHEN k = 6 THEN 'CN' ELSE 'GLOBAL' END AS region,
CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.65 WHEN 2 THEN 0.75 WHEN 3 THEN 0.35 WHEN 4 THEN 0.5 WHEN 5 THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence FROM r""")
def replies_to_items(spark, sf):
    """One reply an order: whole, with fields missing, unsure, with a stranger's link, odd numbers, and none at all."""
    k, o = F.col("o_orderkey") % 8, F.col("o_orderkey")
    body = lambda more: '```json\n{"title": "Title {k}", "benefitKind": "token", "benefitAmount": {k}, "claimUrl": "https://go.vendor.example.com/C/{k}/?utm_source=x", "confidence": 0.9' + more + "}\n```"
    texts = (
        body(', "endDate": "3月5日"'), body(', "title": "", "fieldConfidence": {"title": 0.5}').replace('"title": "Title {k}", ', ""), body(', "fieldConfidence": {"benefit": 0.1}').replace("Title {k}", ""),
        body(', "category": "trial", "endDate": "2025/12/31", "fieldConfidence": {"title": 0.1, "benefit": 0.2, "claimUrl": 0.3}'), body("").replace('"benefitKind": "token", ', "").replace("0.9", '"high"'),
        body("").replace('"benefitAmount": {k}', '"benefitAmount": "much"').replace("go.vendor.example.com", "stranger.example.net").replace("0.9", "7"), body(', "audience": ["student", "new_user"], "region": "CN"').replace("0.9", "1.5"),
        "I could not find an offer.",
    )
    source = table(spark, sf, "orders").select(
        o, pick(k, *(say(t, k=o) for t in texts)).alias("reply"), o.cast("string").alias("provider_slug"), F.lit("US").alias("country"), F.lit("https://vendor.example.com/news").alias("source_url"),
        F.array(F.lit("vendor.example.com")).alias("hosts"), F.when(k == 2, "").otherwise(say("candidate {k}", k=o)).alias("title"), F.lit("context").alias("context"),
    )
    got = model_output.items_from_replies(source, F.lit(2026))
    return got.select(
        F.col("provider_slug").cast("long").alias("id"), "title", "category", F.col("benefit_kind").alias("kind"), F.col("benefit_amount").alias("amount"), F.array_join("audience", ",").alias("audience"),
        F.col("end_date").alias("until"), F.col("claim_url").alias("link"), "region", "confidence",
    )


def _guided(spark: SparkSession, sf: str) -> DataFrame:
    """Offers with what a guide tells of: tokens, dollars or nothing; half with an endpoint, a third with a model."""
    k = F.col("id")
    model = F.struct(say("m{k}", k=k % 50).alias("slug"), say("Model {k}", k=k % 50).alias("name"), F.lit("chat").alias("capability"), F.lit(128000.0).alias("context_window"))
    end = F.struct((k % 3 == 0).alias("requires_card"), (k % 5 != 0).alias("cn_accessible"), (k % 4 == 0).alias("openai_compatible"), F.when(k % 6 == 0, 60).alias("quota_rpm"), F.lit(None).cast("int").alias("quota_rpd"),
                   F.lit("https://api.example.com/v1").alias("api_base"), F.lit(None).cast("string").alias("claim_url"), F.lit(None).cast("string").alias("docs_url"))
    none = F.lit(None).cast("string")
    return offers(spark, sf).withColumns({
        "provider_slug": say("p{k}", k=F.col("provider_id") % 97), "provider_name": F.col("provider"), "title": say("Offer {k}", k=k), "summary": none, "benefit_kind": F.when(k % 3 == 0, "token").when(k % 3 == 1, "credit_usd"),
        "benefit_amount": F.when(k % 3 < 2, (k % 40 + 1).cast("double")), "benefit_unit": F.when(k % 3 == 0, "token").when(k % 3 == 1, "USD"), "benefit_text": F.when(k % 7 == 0, "仅限客户端领取"), "audience_note": none,
        "source_excerpt": none, "cn_accessible": F.lit(True), "claim_url": say("https://x.example.com/{k}", k=k), "source_url": none, "model": F.when(k % 3 == 0, model), "endpoint": F.when(k % 2 == 0, end),
    })


_TOPIC = """'p' || (provider_id % 97) || '::' || CASE WHEN id % 3 = 0 THEN (id % 40 + 1) || ' tokens' WHEN id % 3 = 1 THEN '$' || (id % 40 + 1) WHEN id % 7 = 0 THEN '仅限客户端领取' ELSE '免费额度' END || CASE WHEN id % 7 = 0 THEN '::client' ELSE '::api' END"""


@query(OFFERS + f"""SELECT id AS source_id, topic, 'auto-p' || (provider_id % 97) || '-' || id AS slug, CASE WHEN id % 3 = 0 THEN 'm' || (id % 50) END AS model,
5 AS n_sections, CAST(7 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END - CASE WHEN end_date IS NULL THEN 1 ELSE 0 END AS INTEGER) AS glance,
CAST(4 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS steps,
CAST(1 + CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN id % 2 = 0 AND id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS pitfalls
FROM (SELECT *, {_TOPIC} AS topic FROM pub WHERE archived_at IS NULL AND confidence >= 0.75) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY confidence DESC, id) = 1""")
def guide_drafts(spark, sf):
    """Drafts of all sure offers, each topic once: how many lines each part has."""
    d = guides.drafts(_guided(spark, sf), most=None)
    lines = lambda k: F.size(F.split(F.get("sections", F.lit(k))["body"], "\n"))
    return d.select("source_id", "topic", "slug", "model", F.size("sections").alias("n_sections"), lines(0).alias("glance"), lines(2).alias("steps"), lines(3).alias("pitfalls"))


def crawl(spark: SparkSession, sf: str) -> daily.Inputs:
    """Each part's planted page as a source of its own, of nine vendors; every tenth page did not answer; models by name and by API address."""
    k = F.col("page_id")
    pages = cases._pages(spark, sf)
    named = F.replace("html", F.lit("其他条款请看文档"), F.concat(F.lit("适用于 Alpha"), (k % 4).cast("string"), F.lit(" 模型，其他条款请看文档")))
    vendor = F.concat(F.lit("vendor"), (k % 9).cast("string"))
    nine = spark.range(9)
    slug = F.concat(F.lit("vendor"), F.col("id").cast("string"))
    return daily.Inputs(
        pages.select(k.cast("long").alias("source_id"), "url", F.when(k % 10 == 0, 503).otherwise(200).alias("status_code"), named.alias("html")),
        pages.select(k.cast("long").alias("id"), vendor.alias("provider_slug"), "url", F.lit("page").alias("kind")),
        nine.select(slug.alias("slug"), F.lit("CN").alias("country"), F.array(F.concat(F.lit("https://www.vendor"), F.col("id").cast("string"), F.lit(".example.com/"))).alias("urls")),
        nine.select(slug.alias("provider_slug"), F.explode(F.array(*(F.lit(n).cast("long") for n in range(3)))).alias("entity_id")).withColumn("alias", say("Alpha {n}", n=F.col("entity_id"))).withColumn("ord", F.col("entity_id")),
        nine.select(F.col("id").alias("base_id"), F.concat(F.lit("https://api.vendor"), F.col("id").cast("string"), F.lit(".example.com")).alias("base"), F.lit(0).cast("long").alias("model_id")),
    )


@query("""SELECT p_partkey AS source_id, 'vendor' || (p_partkey % 9) AS provider_slug, '第 ' || p_partkey || ' 号模型活动' AS title, (p_partkey + 1) * 10000.0::DOUBLE AS amount,
'2026-' || lpad('' || (p_partkey % 12 + 1), 2, '0') || '-' || lpad('' || (p_partkey % 28 + 1), 2, '0') AS until, 'https://www.vendor' || (p_partkey % 9) || '.example.com/claim/' || p_partkey AS link,
CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 END AS model_id, 'auto_ok' AS review_status FROM part WHERE p_partkey % 10 <> 0""")
def daily_items(spark, sf):
    """Pages to judged, linked items: the daily run up to its merge."""
    inputs = crawl(spark, sf)
    items = daily.judged_items(daily.found_items(daily.snapshots(inputs.pages), inputs, F.lit(2026)), inputs, 2026)
    return items.select("source_id", "provider_slug", "title", F.col("benefit_amount").alias("amount"), F.col("end_date").alias("until"), F.col("claim_url").alias("link"), "model_id", "review_status")


@query(_ENDS + f""", w AS ({OFFERS.replace("WITH a AS", "SELECT * FROM (WITH a AS")} SELECT id, provider, status, CASE WHEN id % 2 = 0 THEN id % 50 END AS model_id, CASE WHEN id % 4 = 0 THEN id % 50 * 100000 + id % 10 END AS endpoint_id FROM v))
SELECT w.id, provider AS provider_name, status, p_name AS model_name, e.provider_name AS endpoint_provider FROM w LEFT JOIN part ON p_partkey = w.model_id LEFT JOIN e ON e.id = endpoint_id""")
def catalogue_view(spark, sf):
    """Offers with their customer, and the part and the supplier's offer of it where they name one that is there."""
    k = F.col("id")
    o = offers(spark, sf).drop("provider", "region").withColumns({"model_id": F.when(k % 2 == 0, k % 50), "endpoint_id": F.when(k % 4 == 0, k % 50 * 100000 + k % 10)})
    models = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    v = listing.catalogue_view(o, _providers(spark, sf), models, part_endpoints(spark, sf).select("id", F.col("provider_name").alias("provider")))
    return v.select("id", "provider_name", "status", "model_name", "endpoint_provider")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN NULL WHEN 2 THEN 'a,b,' || event_type ELSE 'a,b' END AS put, CASE event_id % 4 WHEN 2 THEN 'a,b' WHEN 3 THEN 'a,b' END AS taken,
CASE WHEN length(event_type) > 5 THEN event_type[1:4] || '…' ELSE event_type END AS short, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN 'a, b' ELSE 'b,' || event_type || ' ,a' END AS said FROM events""")
def selections(spark, sf):
    """Lists of chosen values: empty, of this one, without it, and with it among blanks and repeats."""
    k, t = F.col("event_id") % 4, F.col("event_type")
    now = pick(k, F.lit(" "), t, F.lit("a, b,a"), F.concat(F.lit("a,b,,"), t))
    said = display.first_text(F.when(k == 2, " a, b "), F.when(k == 3, F.concat(F.lit("b,"), t, F.lit(" ,a"))), F.lit(" "), t)
    return table(spark, sf, "events").select("event_id", display.toggled(now, t).alias("put"), display.without(now, t).alias("taken"), display.shortened(t, 5).alias("short"), said.alias("said"))


@query("SELECT o_orderkey, CAST(o_orderdate::DATE + CAST(o_orderkey % 90 AS INTEGER) AS VARCHAR) AS day FROM orders")
def days_later(spark, sf):
    day = display.days_later(F.substring(F.col("o_orderdate").cast("string"), 1, 10), (F.col("o_orderkey") % 90).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", day.alias("day"))


@query("SELECT coalesce(CASE WHEN p_size > 10 THEN p_brand END, 'none') AS p_brand, count(*) AS n FROM part GROUP BY 1")
def brand_distribution(spark, sf):
    return facets.distribution(table(spark, sf, "part").withColumn("p_brand", F.when(F.col("p_size") > 10, F.col("p_brand"))), "p_brand")


def relay_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as records of three directories; about three of them share a host, one in a hundred has none."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    return table(spark, sf, "customer").select(
        say("r{k}", k=k).alias("id"), F.col("c_name").alias("name"), F.when(k % 4 == 0, say("about {k}", k=k)).alias("subtitle"), F.when(k % 100 != 7, say("https://www.H{h}.example.com/x", h=k * 7 % 500)).alias("homeUrl"),
        F.when(k % 3 == 0, say("https://s{k}.example.com", k=k)).alias("signupUrl"), none.alias("docsUrl"), F.when(k % 5 != 0, F.array(say("t{n}", n=k % 3), say("u{n}", n=k % 11), F.lit("all"))).alias("tags"),
        F.when(k % 2 == 0, F.when(k % 6 == 0, "").otherwise(say("$" + "{k}", k=k))).alias("bonus"), (k % 9 == 0).alias("recommended"), F.lit(None).cast("boolean").alias("registerOpen"),
        F.lit(None).cast("array<string>").alias("loginMethods"), F.lit(None).cast("boolean").alias("checkinEnabled"), F.when(k % 4 != 1, k % 4 == 2).alias("online"), F.when(k % 5 != 1, k).alias("latencyMs"),
        F.when(k % 7 != 2, say("at {k}", k=k)).alias("checkedAt"), F.when(k % 8 == 3, F.array(say("m{k}", k=k))).alias("models"), F.when(k % 8 == 3, 1).alias("modelsCount"), none.alias("modelsNote"),
        none.alias("announcement"), none.alias("mirror"), say("d{n}", n=k % 3).alias("source"), (k % 3).cast("int").alias("rank"), k.cast("int").alias("pos"),
    )


@query("""WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 100 <> 7 THEN 'h' || (c_custkey * 7 % 500) || '.example.com' ELSE 'r' || c_custkey END AS host, c_custkey % 3 AS rank, c_custkey % 4 = 2 AS up,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 6 <> 0 THEN '$' || c_custkey END AS bonus, CASE WHEN c_custkey % 4 = 0 THEN 'about ' || c_custkey END AS subtitle, CASE WHEN c_custkey % 5 <> 1 THEN c_custkey END AS latency,
  CASE WHEN c_custkey % 7 <> 2 THEN 'at ' || c_custkey END AS checked, CASE WHEN c_custkey % 8 = 3 THEN 'm' || c_custkey END AS model, CASE WHEN c_custkey % 5 <> 0 THEN ['t' || (c_custkey % 3), 'u' || (c_custkey % 11), 'all'] END AS tags FROM customer),
g AS (SELECT host, count(*) AS n, list(k ORDER BY rank, k) AS ks, list('d' || (k % 3) ORDER BY rank, k) AS sources, first(bonus ORDER BY rank, k) FILTER (bonus IS NOT NULL) AS bonus, first(subtitle ORDER BY rank, k) FILTER (subtitle IS NOT NULL) AS subtitle,
  first(model ORDER BY rank, k) FILTER (model IS NOT NULL) AS model, first({'c': checked, 'l': latency} ORDER BY rank, k) FILTER (up) AS u, first({'o': k % 4, 'c': checked, 'l': latency} ORDER BY rank, k) AS b FROM r GROUP BY host),
e AS (SELECT host, tag, min({'a': rank, 'b': k, 'c': pos}) AS place FROM (SELECT host, rank, k, unnest(tags) AS tag, unnest([0, 1, 2]) AS pos FROM r WHERE tags IS NOT NULL) GROUP BY 1, 2),
t AS (SELECT host, list(tag ORDER BY place) AS tags FROM e GROUP BY 1)
SELECT g.host, 'r' || ks[1] AS id, CASE WHEN u IS NOT NULL THEN true WHEN b.o <> 1 THEN false END AS online, CASE WHEN u IS NOT NULL AND b.o <> 2 THEN coalesce(b.l, u.l) ELSE b.l END AS latency,
CASE WHEN u IS NOT NULL AND b.o <> 2 THEN coalesce(u.c, b.c) ELSE b.c END AS checked, bonus, subtitle, model, array_to_string(CASE WHEN n > 1 THEN coalesce(tags, [])[1:6] ELSE coalesce(tags, []) END, ',') AS tags,
array_to_string(sources, ',') AS sources FROM g LEFT JOIN t ON t.host = g.host""")
def relays_merged(spark, sf):
    m = relays.merged_relays(relay_records(spark, sf))
    return m.select(
        "host", "id", "online", F.col("latencyMs").alias("latency"), F.col("checkedAt").alias("checked"), "bonus", "subtitle", F.get("models", F.lit(0)).alias("model"), F.array_join("tags", ",").alias("tags"),
        F.array_join("sources", ",").alias("sources"),
    )
