"""Queries on documents and pages: normal forms, hashes, blocks, extraction, validation, search, linking, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions import text as T
from tidemark.operators import blocks, crawl, dedupe, extract, link, listing, merge, validate
from tidemark.sources import feeds
from tidemark.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A keyword profile whose words occur in the test tables' invented prose.
PLAIN = rules.Profile(
    strong=("token", "that", "sch"), weak=("with", "und", "les"), negative=("license", "password"), gift_words=("for", "pour"), gift_signals=("from", "avec"),
    categories=(("student", ("token", "license")), ("trial", ("with the", "und die")), ("discount", ("from", "pour"))),
    audiences=(("new_user", ("that", "sch")), ("student", ("license",)), ("teacher", ("é", "ü"))), card=("token",), no_card=("license",), recurring=(("daily", ("daily", "that")), ("weekly", ("les ",))),
)

_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', '')"
_URL = f"""lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) || '://' || {_HOST} || rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') ||
  CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END)"""
_PARTS = """(SELECT *, list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_.*|ref|source|from|share|spm|scm|fbclid|gclid)(=|$)')) AS q FROM pages)"""


@query(f"SELECT page_id, {_URL} AS normal FROM {_PARTS}")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("normal"))


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY ALL")
def url_host(spark, sf):
    return table(spark, sf, "pages").groupBy(T.url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


_FOLD = "trim(regexp_replace(regexp_replace(lower({0}), '[【】《》「」『』\"''“”‘’（）()\\[\\]]', ' ', 'g'), '[^\\p{{Han}}a-z0-9]+', ' ', 'g'))"


@query("SELECT doc_id, " + _FOLD.format("coalesce(text, '')") + " AS title FROM documents")
def title_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fold_title(F.col("text")).alias("title"))


@query("SELECT doc_id, substr(sha256(coalesce(source, '') || '|' || " + _FOLD.format("coalesce(text, '')") + " || '|https://' || coalesce(source, '') || '.example.com/' || coalesce(lang, '') || '|2026-10-07'), 1, 32) AS fingerprint FROM documents")
def fingerprint(spark, sf):
    url = F.concat(F.lit("https://"), T.blank(F.col("source")), F.lit(".example.com/"), T.blank(F.col("lang")), F.lit("/?utm_source=x#top"))
    return table(spark, sf, "documents").select("doc_id", T.fingerprint(F.col("source"), F.col("text"), url, F.lit("2026/10/7"), plain=True).alias("fingerprint"))


@query("SELECT substr(sha256(coalesce(text, '')), 1, 32) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY ALL")
def content_hash_dedupe(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, coalesce(sha256(coalesce(text, '')) = lag(sha256(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id), false) AS unchanged FROM documents")
def snapshot_changed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", T.content_hash(F.col("text")).alias("h"))
    return merge.unchanged(d, "source", "doc_id", F.col("h")).select("doc_id", "unchanged")


@query("""WITH i AS (SELECT doc_id, source, substr(coalesce(text, ''), 1, 150) AS title, n_chars % 50 AS page, n_chars % 5 AS amount, doc_id % 100 AS c FROM documents),
f AS (SELECT *, """ + _FOLD.format("title") + """ AS folded, c / 10.0 + 5 + 3 + 1 + CASE WHEN length(title) BETWEEN 8 AND 60 THEN 2 ELSE 0 END + 1 AS q,
  coalesce(source, '') || '|' || page || '|' || amount AS near FROM i),
r1 AS (SELECT *, row_number() OVER (PARTITION BY source, folded, page ORDER BY q DESC, doc_id) AS k, min(doc_id) OVER (PARTITION BY source, folded, page) AS place FROM f),
r2 AS (SELECT *, row_number() OVER (PARTITION BY near ORDER BY q DESC, place) AS k2 FROM r1 WHERE k = 1)
SELECT doc_id, near FROM r2 WHERE k2 = 1""")
def dedupe_two_round(spark, sf):
    d = table(spark, sf, "documents")
    page = (F.col("n_chars") % 50).cast("string")
    none = F.lit(None).cast("string")
    items = d.select(
        F.col("source").alias("provider_slug"), F.col("text").alias("title"), F.lit("s").alias("summary"), F.lit("count").alias("benefit_kind"),
        (F.col("n_chars") % 5).cast("double").alias("benefit_amount"), none.alias("benefit_unit"), F.array(F.lit("all")).alias("audience"), none.alias("start_date"), none.alias("end_date"),
        F.concat(F.lit("https://x.example.com/p/"), page).alias("claim_url"), none.alias("source_url"), none.alias("source_excerpt"), ((F.col("doc_id") % 100) / 100).alias("confidence"),
        F.col("doc_id").alias("ord"), F.concat_ws("|", T.blank(F.col("source")), page, (F.col("n_chars") % 5).cast("string")).alias("near"),
    )
    return dedupe.dedupe(dedupe.normalize_items(items, plain=True)).select(F.col("ord").alias("doc_id"), "near")


_STRIP = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script)\\b.*?</script\\s*>|<(style)\\b.*?</style\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_STRIP} AS text FROM pages")
def html_strip_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


def _name(tag: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_name('title')} AS title, {_name('h1')} AS h1 FROM pages")
def html_title_h1(spark, sf):
    title, h1 = crawl.page_names(F.col("html"))
    return table(spark, sf, "pages").select("page_id", title.alias("title"), h1.alias("h1"))


@query()
def html_blocks(spark, sf):
    return blocks.html_blocks(table(spark, sf, "pages")).select("page_id", F.explode("blocks").alias("b")).select("page_id", "b.*")


@query()
def candidates_topk(spark, sf):
    return blocks.candidates(blocks.html_blocks(table(spark, sf, "pages")), profile=PLAIN)


@query()
def extracted_offers(spark, sf):
    """Pages to blocks to candidates to items to verdicts, as one plan."""
    pages = table(spark, sf, "pages")
    found = blocks.candidates(blocks.html_blocks(pages), profile=PLAIN)
    source = pages.select("page_id", F.col("url").alias("source_url"))
    host = T.url_host(F.col("source_url"))
    named = found.join(source, "page_id").withColumns({"provider_slug": host, "country": F.lit("GLOBAL"), "hosts": validate.allowed_hosts(F.array("source_url")), "is_search": F.lit(False)})
    items = extract.extract(named, F.lit(2026), PLAIN).withColumns({"hosts": validate.allowed_hosts(F.array("source_url")), "is_search": F.lit(False)})
    return validate.verdict(items, 2026, PLAIN).drop("hosts", "is_search")


def _sum(words: tuple[str, ...], weight: int) -> str:
    return " + ".join(f"CASE WHEN contains(t, '{w}') THEN {weight} ELSE 0 END" for w in words)


def _any(words: tuple[str, ...], text: str = "t") -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


_UNIT = "regexp_matches(t, '(?i)per\\s+\\d|/\\s*\\d*\\s*(1M|1K|M|K|千|万|百万)\\s*(tokens?|字符|图片|次|calls?)')"


@query(f"""SELECT doc_id, CAST(CASE WHEN length(t) < 12 THEN 0 ELSE {_sum(PLAIN.strong, 3)} + {_sum(PLAIN.weak, 1)} + {_sum(PLAIN.negative, -4)}
+ CASE WHEN {_UNIT} AND NOT {_any(PLAIN.gift_words)} THEN -8 ELSE 0 END
+ CASE WHEN regexp_matches(t, '之前为\\s*[\\d.]+\\s*(美元|元)|\\d+\\s*美元[/／]|起(为|调整)') THEN -6 ELSE 0 END
+ CASE WHEN regexp_matches(t, '\\d+\\s*(亿|万|k|K|M)\\s*(个)?\\s*(token|Token|TOKEN)') THEN 6 ELSE 0 END
+ CASE WHEN regexp_matches(t, '[¥￥$]\\s*\\d+') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, '\\d{{1,2}}\\s*月\\s*\\d{{1,2}}\\s*日|\\d{{1,2}}[/-]\\d{{1,2}}') THEN 2 ELSE 0 END
+ CASE WHEN length(t) > 600 THEN -2 ELSE 0 END END AS INTEGER) AS score FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def block_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", blocks.block_score(F.col("text"), PLAIN).alias("score"))


#: One pattern, so that SQL can say what the operator finds in free text; cases.benefits has the others.
DOLLARS = rules.Profile(benefits=((r"\$\s*(\d+(?:\.\d+)?)\s*(k|K|m|M|b|B)?", "credit_usd", "USD", True),))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, regexp_extract(t, '\\$\\s*(\\d+(?:\\.\\d+)?)\\s*([kKmMbB])?', 1) AS n, lower(regexp_extract(t, '\\$\\s*(\\d+(?:\\.\\d+)?)\\s*([kKmMbB])?', 2)) AS u FROM t)
SELECT doc_id, CASE WHEN n <> '' AND CAST(n AS DOUBLE) > 0 THEN CAST(n AS DOUBLE) * CASE u WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END END AS dollars FROM m""")
def amount_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", extract.benefit(F.col("text"), DOLLARS)["amount"].alias("dollars"))


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}') AND CAST(regexp_extract(t, '(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})', 2) AS INTEGER) BETWEEN 1 AND 12 AND CAST(regexp_extract(t, '(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})', 3) AS INTEGER) BETWEEN 1 AND 31 THEN regexp_extract(t, '(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})', 1) || '-' || lpad(regexp_extract(t, '(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})', 2), 2, '0') || '-' || lpad(regexp_extract(t, '(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})', 3), 2, '0') END AS day FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def date_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_date(F.col("text")).alias("day"))


def _tag(name: str, words: tuple[str, ...]) -> str:
    return f"CASE WHEN {_any(words)} THEN '{name}' END"


_AUDIENCE = "list_filter([" + ", ".join(_tag(n, w) for n, w in PLAIN.audiences) + "], lambda x: x IS NOT NULL)"
_DOCS = "(SELECT doc_id, coalesce(text, '') AS t FROM documents)"


@query(f"SELECT doc_id, CASE WHEN len({_AUDIENCE}) = 0 THEN 'all' ELSE array_to_string({_AUDIENCE}, ',') END AS audience FROM {_DOCS}")
def audience_tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(extract.audience(T.blank(F.col("text")), PLAIN), ",").alias("audience"))


_CASES = "CASE " + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in PLAIN.categories) + " ELSE 'free_credit' END"
_EVERY = "CASE " + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in PLAIN.recurring) + " ELSE 'once' END"


@query(f"SELECT doc_id, {_CASES} AS category, {_EVERY} AS recurring, NOT {_any(PLAIN.no_card)} AND {_any(PLAIN.card)} AS card FROM {_DOCS}")
def category_fields(spark, sf):
    t = T.blank(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", extract.category(t, PLAIN).alias("category"), extract.recurring(t, PLAIN).alias("recurring"), extract.requires_card(t, PLAIN).alias("card"))


@query(f"""SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN who <> 'all' THEN 0.12 ELSE 0 END + CASE WHEN length(t) BETWEEN 40 AND 800 THEN 0.05 ELSE 0 END
- CASE WHEN length(t) > 1500 THEN 0.15 ELSE 0 END + CASE WHEN length(h) BETWEEN 8 AND 60 AND NOT regexp_matches(h, '[，。；、]$') THEN 0.06 ELSE 0 END
+ CASE WHEN who <> 'all' AND regexp_matches(t, '(?i)credits|free credit|free tier|trial|giveaway') THEN 0.22 ELSE 0 END)), 2) AS confidence
FROM (SELECT doc_id, t, t AS h, CASE WHEN len({_AUDIENCE}) = 0 THEN 'all' ELSE 'some' END AS who FROM {_DOCS})""")
def confidence(spark, sf):
    t, none = T.blank(F.col("text")), F.lit(None).cast("string")
    offer = F.lit(None).cast("struct<kind:string,amount:double>")
    return table(spark, sf, "documents").select("doc_id", extract.confidence(t, t, offer, none, none, none, extract.audience(t, PLAIN)).alias("confidence"))


@query(f"""SELECT doc_id, CASE WHEN length(h) = 0 THEN 'empty' WHEN length(h) < 4 THEN 'short'
WHEN length(h) > 40 AND regexp_matches(h, '(?i)\\b(and|for|with|the|to|of|in|on|your|our|all)\\b') THEN 'cut sentence' END AS reason
FROM (SELECT doc_id, trim(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS h FROM {_DOCS})""")
def bad_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", validate.bad_title(F.col("text")).alias("reason"))


@query("""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS l, strip_accents(lower(coalesce(text, ''))) AS a FROM documents)
SELECT doc_id FROM d WHERE contains(l, 'the with') OR (regexp_matches(a, '(^|[^\\p{L}\\p{N}])the') AND regexp_matches(a, '(^|[^\\p{L}\\p{N}])with'))""")
def search_union(spark, sf):
    return listing.search(table(spark, sf, "documents"), ["text"], "the with").select("doc_id")


@query("SELECT DISTINCT unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+')) AS token, doc_id FROM documents")
def search_index(spark, sf):
    return listing.token_index(table(spark, sf, "documents"), "doc_id", ["text"])


@query("""WITH a AS (SELECT min(p_partkey) AS entity_id, regexp_extract(p_name, '^\\S+', 0) AS alias FROM part GROUP BY alias),
f AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9一-龥]', '', 'g') AS f FROM documents)
SELECT doc_id AS id, entity_id, alias FROM f JOIN a ON contains(f.f, a.alias) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, entity_id) = 1""")
def alias_longest_match(spark, sf):
    names = table(spark, sf, "part").groupBy(F.regexp_extract("p_name", r"^\S+", 0).alias("alias")).agg(F.min("p_partkey").alias("entity_id")).withColumn("ord", F.col("entity_id"))
    return link.longest_alias(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), names)


@query("""WITH b AS (SELECT p_brand, min(p_partkey) AS entity_id, regexp_extract(p_brand, '(\\d+)', 1) AS v FROM part GROUP BY ALL),
u AS (SELECT page_id, regexp_extract(regexp_replace(lower(url), '^[a-z]+://[^/]*', ''), '/(\\d)(?:[^0-9]|$)', 1) AS v FROM pages)
SELECT page_id AS id, entity_id FROM u JOIN b USING (v) WHERE u.v <> '' AND length(b.v) = 1""")
def unique_version_link(spark, sf):
    """One-digit page numbers in the path against brands of one digit."""
    path = F.regexp_replace(F.lower("url"), r"^[a-z]+://[^/]*", "")
    u = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.regexp_extract(path, r"/\d(?:[^0-9]|$)", 0).alias("text"))
    b = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("entity_id")).where(F.length(F.regexp_extract("p_brand", r"(\d+)", 1)) == 1)
    return link.unique_version(u, b.select("entity_id", F.col("p_brand").alias("name")))


@query(f"""WITH b AS (SELECT min(page_id) AS base_id, lower(regexp_extract(url, '^[a-z]+://[^/]*/[a-z]+', 0)) AS base FROM pages GROUP BY ALL)
SELECT page_id AS id, min(base_id) AS base_id FROM pages JOIN b ON base <> '' AND (lower(rtrim(url, '/')) = base OR starts_with(lower(url), base || '/')) GROUP BY ALL""")
def prefix_url_link(spark, sf):
    p = table(spark, sf, "pages")
    b = p.groupBy(F.lower(F.regexp_extract("url", r"^[a-z]+://[^/]*/[a-z]+", 0)).alias("base")).agg(F.min("page_id").alias("base_id")).where("base <> ''")
    return link.url_prefix(p.select(F.col("page_id").alias("id"), F.lit(0).alias("pos"), "url"), b)


@query(f"""WITH p AS (SELECT *, regexp_replace({_HOST}, '^www\\.', '') AS host FROM pages)
SELECT host, count(*) AS n, min_by(url, page_id) AS url, min(page_id) AS page_id FROM p WHERE host <> '' GROUP BY host""")
def relay_merge_by_host(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.col("url").alias("first_url"))
    return feeds.merge_by_host(p, "page_id", ["first_url", "page_id"]).select("host", "n", F.col("first_url").alias("url"), "page_id")


@query(f"SELECT page_id, count(*) OVER (PARTITION BY {_HOST}, substr(sha256(coalesce(html, '')), 1, 32)) >= 2 AS catch_all FROM pages")
def catch_all_hash(spark, sf):
    p = table(spark, sf, "pages").select("page_id", T.url_host(F.col("url")).alias("host"), T.content_hash(F.col("html")).alias("body_hash"), F.lit(True).alias("ok"))
    return crawl.catch_all(p).select("page_id", "catch_all")


@query(f"SELECT page_id, page_id > min(page_id) OVER (PARTITION BY {_URL}) OR page_id > min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS duplicate FROM {_PARTS}")
def redirect_dedupe(spark, sf):
    p = table(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("final_url"), T.content_hash(F.col("html")).alias("body_hash"))
    return crawl.first_of(p, "page_id", "final_url", "body_hash").select("page_id", "duplicate")


@query(f"SELECT page_id, regexp_matches(regexp_replace(url, '^[a-zA-Z][^:]*://[^/?#]*', ''), '^/(en|de/5)') = false AS allowed FROM pages")
def robots_allowed(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    hosts = pages.select(T.url_host(F.col("url")).alias("host")).distinct()
    robots = hosts.withColumn("text", F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /\nDisallow: /en # all\nDisallow: /de/5\n"))
    return crawl.allowed(pages, crawl.robots_rules(robots, "reader/1.0")).select("page_id", "allowed")


def _esc(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        c = f"replace({c}, '{a if a != chr(39) * 2 else chr(39) * 2}', '{b}')"
    return c


@query(f"""SELECT doc_id AS id, '<item><title>' || {_esc("coalesce(text, '')")} || '</title><link></link><description>' || {_esc("concat_ws(' ｜ ', source, lang)")} || '</description><guid isPermaLink="false">' || doc_id || '</guid></item>' AS item
FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 100""")
def rss_items(spark, sf):
    d, none = table(spark, sf, "documents"), F.lit(None).cast("string")
    df = d.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("created_at"), F.col("text").alias("title"), F.lit("").alias("link"), F.col("source").alias("provider"), F.col("lang").alias("benefit"), none.alias("deadline"), none.alias("summary"))
    return feeds.rss_items(df)


@query("SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role IN ('user', 'system')) AS n_asked, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY ALL")
def array_contains_roles(spark, sf):
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return g.select("conv_id", F.size("r").cast("long").alias("n_turns"), F.size(F.filter("r", lambda x: x.isin("user", "system"))).cast("long").alias("n_asked"), F.array_join("r", ",").alias("roles"))
