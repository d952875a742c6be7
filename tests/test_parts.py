"""Sources, sinks and expressions that the queries do not show on their own."""

from __future__ import annotations

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.test_operators import value
from tidemark.functions import display
from tidemark.functions import text as T
from tidemark.operators import blocks, extract, publish, views
from tidemark.sources import feeds, relays, tables


@pytest.mark.parametrize(("make", "given", "want"), [
    (T.decode_entities, "&lt;b&gt; &amp; &quot;x&quot; &#39;y&#39;&nbsp;z", "<b> & \"x\" 'y' z"), (T.strip_tags, "<script>a</script><p>b</p><style>c</style> d", "b d"),
    (T.header_value, "a一b\tc  d", "a b c d"), (T.escape_xml, "\"a\" & <b>", "&quot;a&quot; &amp; &lt;b&gt;"),
    (publish.render_markdown, "- a\n- **b**\n\n1. x\n2. `y`\n\n> q\n> r\n\nplain <i>\nline", "<ul><li>a</li><li><strong>b</strong></li></ul><ol><li>x</li><li><code>y</code></li></ol><blockquote>q<br>r</blockquote><p>plain &lt;i&gt;<br>line</p>"),
    (display.chosen, " a,,b ,a", ["a", "b"]), (display.shortened, "x" * 141, "x" * 139 + "…"), (display.shortened, "x" * 140, "x" * 140),
    (lambda c: display.days_later(c, 1), "2026-02-31", "2026-03-04"),
])
def test_expressions(spark, make, given, want):
    assert value(spark, make, given) == want


def test_titles_are_promoted_from_the_passage(spark):
    context = "平台操作说明见下\n新用户注册即送 100 万 tokens 免费额度，先到先得。\n有效期为一个月。"
    assert value(spark, extract.promote_title, "免费额度", context).startswith("新用户注册即送 100 万 tokens")
    assert value(spark, extract.promote_title, "新用户注册送额度", context) == "新用户注册送额度"
    assert value(spark, lambda c, t: extract.summary(c, t), "短\nthe first line of it\nthe title says this\nthe third line of it", "the title says this") == "the first line of it the third line of it"


def test_scope_fallback_and_segments():
    page = "<body><div id='x' class='a b'><p>inside one</p></div><p>outside</p></body>"
    for scope in ("#x", ".b", "div"):
        assert [b["text"] for b in blocks.page_blocks(page, None, scope)] == ["inside one"]
    assert [b["text"] for b in blocks.page_blocks(page, None, "#none")] == ["inside one", "outside"]
    long = "".join(f"第{k}句话说的是同一件事情。" for k in range(60))
    bare = blocks.page_blocks(f"<body><div>{long}</div></body>", None)
    assert "".join(b["text"] for b in bare) == long and all(len(b["text"]) <= 500 for b in bare) and len(bare) > 1
    nested = blocks.page_blocks("<ul><li>a <p>b</p></li><li>c</li></ul><a href='/up'><h2>t</h2></a>", "https://x.example.com/d/")
    assert [(b["text"], b["href"]) for b in nested] == [("b", None), ("c", None), ("t", "https://x.example.com/up")]


def test_settings_in_layers(spark):
    got = {r.key: r.value for r in feeds.settings(spark, {"a": {"b": 1, "c": None}, "d": "x"}, {"a": {"b": 2}}).collect()}
    assert got == {"a.b": "2", "a.c": None, "d": "x"}


def test_bundle_as_json_lines(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, t string")
    tables.write_json(df, f"{folder}/out")
    assert sorted((r.id, r.t) for r in spark.read.json(f"{folder}/out").collect()) == [(1, None), (2, "x")]
    tables.write_json(df.limit(1), f"{folder}/out")
    assert spark.read.json(f"{folder}/out").count() == 1


def test_versions_replace_the_table_at_once(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/t"
    assert not tables.has_version(spark, folder) and tables.logged(spark, folder) is None
    tables.write_version(spark.range(3), folder)
    tables.write_version(tables.read_version(spark, folder).where("id < 2"), folder)
    assert tables.read_version(spark, folder).count() == 2


def test_spread_deals_only_what_is_too_narrow(spark):
    assert tables.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert tables.spread(spark.range(0, 10, 1, 3)).rdd.getNumPartitions() == 3


def test_feed_of_the_newest(spark):
    rows = [(k, f"T{k} & <x>", f"https://x.example.com/{k}", "P", None, "soon", None, f"2026-01-0{k} 00:00:00") for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "id long, title string, link string, provider string, benefit string, deadline string, summary string, at string").withColumn("created_at", F.col("at").cast("timestamp"))
    assert sorted(r.id for r in feeds.rss_items(df, 2).collect()) == [2, 3]
    xml = feeds.rss(df, "All", "https://x.example.com", 2).first().xml
    assert xml.index("T3 &amp; &lt;x&gt;") < xml.index("T2 &amp; &lt;x&gt;") and "T1" not in xml and "<description>P ｜ soon</description>" in xml


def test_directories_of_relays(spark):
    """One directory as an array, one as an object, one that is missing and one that is no JSON; probes lie over the first."""
    folder = tempfile.mkdtemp(prefix="spark-")

    def put(name, x):
        with open(f"{folder}/{name}", "w") as f:
            f.write(x if isinstance(x, str) else json.dumps(x))
        return f"{folder}/{name}"

    one = put("one.json", [{"id": "a", "name": "A", "homeUrl": "https://www.a.example.com", "tags": ["x"]}, None, {"id": "b", "name": "B", "homeUrl": "https://b.example.com", "online": True}])
    live = put("live.json", {"probes": [
        {"id": "a", "online": False, "latencyMs": 5, "checkedAt": "1", "models": [{"name": "m%d" % k} for k in range(10)], "announcements": [{"text": "n" * 200}], "mirrors": [{"homeUrl": "u", "online": False}, {"homeUrl": "v"}]},
        {"id": "b", "error": "timeout", "modelsSource": "login-required"},
    ]})
    two = put("two.json", {"stations": [{"id": "c", "name": "C", "homeUrl": "https://a.example.com/other", "online": True, "latencyMs": 9, "checkedAt": "2", "bonus": "$1", "tags": ["y", "x"]}]})
    bad = put("bad.json", "<html>")
    got, meta = relays.read_directories(spark, [relays.Directory("one", one, live), relays.Directory("none", f"{folder}/none.json"), relays.Directory("two", two, f"{folder}/none.json"), relays.Directory("bad", bad)])
    assert sorted((r.source, r.ok, r.sites, r.live) for r in meta.collect()) == [("bad", False, 0, 0), ("none", False, 0, 0), ("one", True, 3, 2), ("two", True, 1, 0)]
    records = {r.id: r for r in got.collect()}
    a, b = records["a"], records["b"]
    assert (a.online, a.latencyMs, len(a.models), a.modelsCount, len(a.announcement), a.mirror) == (False, 5, 8, 10, 130, "v")
    assert (b.online, b.modelsNote) == (False, "models are shown after login")
    merged = {r.host: r for r in relays.merged_relays(got).orderBy(*relays.relay_order()).collect()}
    m = merged["a.example.com"]
    assert (m.id, m.online, m.latencyMs, m.checkedAt, m.bonus, m.tags, m.sources) == ("a", True, 5, "2", "$1", ["x", "y"], ["one", "two"])
    assert views.relay_counts(relays.merged_relays(got)).first()["total"] == 2
    assert relays.merged_relays(got.limit(0)).collect() == []
