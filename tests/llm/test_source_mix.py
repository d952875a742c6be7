"""Mixing against a plain version, its targets against stepwise resharing, and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import source_mix
from tidemark.llm.queries import QUERIES, SQL


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare what is above a cap by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = dict.fromkeys(order, 0.0), set()
    rest = sum(sizes.values())
    while rest > 1e-9:
        free = [s for s in order if s not in full]
        share = rest / sum(w[s] for s in free)
        for s in free:
            target[s] += share * w[s]
        rest = 0.0
        for s in free:
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                full.add(s)
    return target


def plain_mix(docs, weight, seed=1):
    sized = [(i, s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, s in docs]
    sizes = {s: sum(n for _, k, n in sized if k == s) for s in {k for _, k, _ in sized}}
    target = plain_targets(sizes)
    out = []
    for source, size in sizes.items():
        goal = math.floor(target[source] + 0.5)
        epochs, rest = divmod(goal, max(size, 1))
        key = {}
        for (i, t, s), (_, _, n) in zip(docs, sized, strict=True):
            if s == source:
                u = (int(hashlib.md5(f"{seed}-{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 1) / 2**52
                key.setdefault((-math.log(u) / weight(t), -1 if i is None else i, n), []).append(t)
        for k in sorted(key):
            for _ in key[k]:
                more = max(0, min(k[2], rest))
                rest -= more
                out.append((None if k[1] < 0 else k[1], k[2], size, round(target[source], 6), epochs * k[2] + more))
    return sorted(out, key=repr)


def prose(text):
    text = text or ""
    kept = re.sub(r"[^\x20\x09-\x0Da-z一-鿿]", "", text)
    return 1 + 7 * (len(kept) / max(len(text), 1)) ** 4


def rows_of(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


def corpus(seed, many, sources):
    rng = random.Random(seed)
    words = ["and", "THE", "of!!", "x", "##", "中文", "word"]
    return [(i, " ".join(rng.choices(words, k=int(rng.expovariate(1 / 40)))), rng.choice(sources)) for i in range(many)]


@pytest.mark.parametrize("sources", [["a"], ["a", "b", None], ["s%d" % k for k in range(9)] + ["s0"] * 20, ["é", "z", "Z", "\U0001f600", "ﬁ"]])
def test_mix_by_a_plain_version(spark, sources):
    docs = corpus(len(sources), 500, sources)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    got = rows_of(source_mix.plan_mix(df))
    assert got == plain_mix(docs, prose)
    for source in set(sources):
        ids = {i for i, _, s in docs if s == source}
        own = [r for r in got if r[0] in ids]
        assert sum(r[4] for r in own) == math.floor(own[0][3] + 0.5)  # the words taken are the target, rounded
        assert all(0 <= r[4] <= 3 * r[1] for r in own)


def test_joins_by_key_where_sources_are_many(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "SMALL", 0)
    docs = corpus(3, 300, ["s%d" % k for k in range(40)] + [None])
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert rows_of(source_mix.plan_mix(df)) == plain_mix(docs, prose)


def test_layout_does_not_matter(spark):
    docs = corpus(4, 400, ["a", "b", "c"])
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert rows_of(source_mix.plan_mix(df.repartition(1))) == rows_of(source_mix.plan_mix(df.repartition(7, "text")))
    assert rows_of(source_mix.plan_mix(df)) != rows_of(source_mix.plan_mix(df, seed=2))


def test_quality_decides_who_is_taken(spark):
    docs = [(i, "word " * 10, "small" if i < 3000 else "large") for i in range(9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = source_mix.plan_mix(df, weights=(1, 1), quality=F.when(F.col("doc_id") % 2 == 0, 8.0).otherwise(1.0))
    share = got.where("doc_id >= 3000").groupBy((F.col("doc_id") % 2).alias("odd")).agg((F.sum("taken") / F.sum("size")).alias("x")).collect()
    share = {r.odd: r.x for r in share}
    # three quarters of the large source are taken: of weights 8 and 1, all but a few and about half
    assert share[0] > 0.97 and 0.4 < share[1] < 0.6


def test_odd_rows(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, " \t\r\n", "b"), (None, "x y", None), (None, "x y", None), (5, "w " * 5000, "a"), (5, "w " * 5000, "a"), (6, "\x0bq\x0c", "b"), (7, "p", "empty?")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(docs)], "doc_id long, text string, source string, taken long")
    assert rows_of(source_mix.plan_mix(df)) == plain_mix(docs, prose)
    assert source_mix.plan_mix(df.limit(0)).collect() == []
    nothing = source_mix.plan_mix(df.where("doc_id < 4")).collect()
    assert {(r["size"], r.target, r.taken) for r in nothing} == {(0, 0.0, 0)} and len(nothing) == 3


def test_texts_of_the_mix(spark):
    docs = [(i, "  " + " ".join(f"{s}{i}.{k}" for k in range(i % 7)), s, 9) for i, s in enumerate("aaaaaaaabbbbcc" * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size int")
    plan = {r.doc_id: r.taken for r in source_mix.plan_mix(df.drop("size")).collect()}
    got = source_mix.mixed(df)
    assert got.columns == df.columns
    words = {}
    for r in got.collect():
        assert docs[r.doc_id][1].split()[: len(r.text.split())] == r.text.split()
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in plan.items() if n}


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    df = QUERIES["op12_weighted_mix"](spark, SMALL)
    want = con.execute(SQL["op12_weighted_mix"]).fetch_df()
    assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == sorted(tuple(r) for r in want[sorted(df.columns)].itertuples(index=False))
