"""BM25 search and chat formatting against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import chat_format, topk_search
from tidemark.llm.queries import QUERIES, SQL


def plain_bm25(rows, queries, k):
    docs = [(i, Counter(re.findall("[a-z0-9\u0080-\U0010ffff]+", (t or "").lower()))) for i, t in rows]
    n, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for q in queries:
        weights = {w: math.floor(1000 * m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) + 0.5) for w, m in dict(docs)[q].items()}
        found = []
        for i, c in docs:
            length = sum(c.values())
            score = sum(weights[w] * math.floor(1000 * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / (words / n))) + 0.5) for w in weights if w in c)
            if score:
                found.append((-score, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard_bytes", "common", "block"), [(1 << 30, 256, 64), (900, 3, 2), (300, 1, 4)])
def test_search_by_brute_force(spark, shard_bytes, common, block):
    rng = random.Random(2)
    vocabulary = ["w%d" % k for k in range(40)]
    rows = [(k, " ".join(rng.choices(vocabulary, weights=range(40, 0, -1), k=rng.randint(1, 30)))) for k in range(80)]
    rows += [(90, None), (91, ""), (92, rows[0][1]), (100, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = topk_search.search(df, F.col("doc_id") % 20 == 0, 5, shard_bytes, common, block, 3)
    assert sorted(tuple(r) for r in got.collect()) == plain_bm25(rows, [i for i, _ in rows if i % 20 == 0], 5)


def shuffled_bytes(spark, run) -> int:
    """Bytes that the stages of run() write to shuffles."""
    sc, quantiles = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(found.apply, range(found.size()))}
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().stageList(None, False, False, quantiles, None)
    before = stages()
    run()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().stageList(None, False, False, quantiles, None)
    return sum(n for k, n in stages().items() if k not in before)


def test_queries_are_not_dealt_to_every_shard(spark):
    """600 queries of 40 words against about 50 shards: hashes and weights would be 16 bytes a word, query and shard."""
    rng = random.Random(4)
    rows = [(k, " ".join("w%d" % rng.randrange(5000) for _ in range(40))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    n = shuffled_bytes(spark, lambda: got.extend(topk_search.search(df, F.col("doc_id") >= 0, 1, sum(len(t) for _, t in rows) // 50).collect()))
    assert sorted((r.query_id, r.doc_id) for r in got) == [(k, k) for k in range(600)]
    assert n < 600 * 40 * 50 * 16 / 6


@pytest.mark.parametrize(("slab_bytes", "groups", "batch"), [(1 << 30, 2, 128), (200, 3, 1), (900, 1, 2), (1, 64, 3)])
def test_search_in_slabs_and_groups(spark, slab_bytes, groups, batch):
    """Shards of a group one after the other, some of them without words, and ids that are null or repeated."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices("abcdefghijkl", k=rng.randint(0, 12)))) for k in range(70)] + [(71, "a b c")] * 3 + [(None, "a b l")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).localCheckpoint()
    is_query = F.col("doc_id").isNull() | (F.col("doc_id") % 4 < 2)
    want = topk_search.search(df, is_query, 6, 1 << 30)
    got = topk_search.search(df, is_query, 6, 100, 2, 4, batch, slab_bytes, groups)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_search_without_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert topk_search.search_documents(df).collect() == []


@pytest.mark.parametrize("name", list(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SMALL)
    want = con.execute(SQL[name]).fetch_df()
    assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == sorted(tuple(r) for r in want[sorted(df.columns)].itertuples(index=False))


def test_snapshots_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", None)
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [a, ("assistant", "no")], 7: [a, b, ("user", "")]}
    rows = [(i, k, r, t, 0) for i, turns in convs.items() for k, (r, t) in enumerate(turns)] + [(3, 0, *a, 0), (None, 0, "user", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, hashes int")
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert sorted(got) == [3, 5, 6, 7]
    assert got[3].n_equal == 2 and got[3].n_turns == 3
    assert got[3].text == "<|user|>\nhi\n<|assistant|>\nyes\n<|user|>\n\n"
    assert chat_format.format_chats(df.limit(0)).collect() == []


def test_long_and_repeated_conversations(spark):
    """One conversation of 3000 turns, a snapshot of it, one with two turns swapped, and one row a thousand times."""
    rows = [(1, k, "user" if k % 2 else None, f"t{k}") for k in range(3000)]
    rows += [(2, *r[1:]) for r in rows[:2000]] + [(3, k, r[2], r[3]) for k, r in enumerate([rows[2], rows[1], rows[0]])]
    rows += [(4, 0, "user", "again")] * 1000 + [(5, None, "user", None), (5, None, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r.conv_id: (r.n_turns, r.n_equal) for r in chat_format.format_chats(df).collect()}
    assert got == {1: (3000, 1), 3: (3, 1), 4: (1, 1), 5: (2, 1)}
