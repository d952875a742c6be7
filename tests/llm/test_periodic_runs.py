"""Periodic runs against brute force, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from tidemark.llm import periodic_runs
from tidemark.llm.queries import QUERIES

def brute(words, least=24):
    """Every longest stretch of each period, without those that have a smaller one."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x = np.array([number[w] for w in words])
    found = []
    for p in range(1, len(x) // 3 + 1):
        edge = np.flatnonzero(np.diff((x[:-p] == x[p:]).astype(int), prepend=0, append=0))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            own = x[i : j + p]
            if len(own) >= max(least, 3 * p) and not any((own[q:] == own[:-q]).all() for q in range(1, p)):
                found.append((i, len(own), p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts_with_runs(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        words = []
        for _ in range(rng.randint(1, 4)):
            unit = [rng.choice("abc") for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 40)))]
            words += (unit * rng.randint(1, 30))[: rng.randint(5, 200)] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        yield words


@pytest.mark.parametrize("probes", [1 << 18, 50, 7])
def test_runs_by_brute_force(probes):
    texts = list(texts_with_runs(probes, 150)) + [["x"] * 23, ["x"] * 24, ["x", "y", "z", "w", "v", "u", "t", "s"] * 3, [], ["a"]]
    x = np.array([ord(w[0]) for t in texts for w in t])
    begin = np.cumsum([0, *map(len, texts)])
    got = periodic_runs.runs_of(x, begin, probes=probes)
    for found, words in zip(got, texts, strict=True):
        assert sorted(found, key=lambda r: (r[0], r[2])) == brute(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120), st.integers(3, 24))
def test_runs_of_two_words(bits, least):
    got = periodic_runs.runs_of(np.array(bits, np.int64), np.array([0, len(bits)]), least, 64)[0]
    assert sorted(got, key=lambda r: (r[0], r[2])) == brute(bits, least)


def test_long_matches_are_compared_in_chunks():
    unit = list(range(700))
    x = np.array([*range(1000, 1500), *unit * 5, *unit[:33], *range(2000, 2100)])
    assert periodic_runs.runs_of(x, np.array([0, len(x)])) == [[(500, 3533, 700)]]
    same = np.ones(200_000, np.int64)
    assert periodic_runs.runs_of(same, np.array([0, len(same)])) == [[(0, 200_000, 1)]]


def test_query_by_brute_force(spark):
    got = QUERIES["op13_periodic_runs"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in got.collect()) == sorted(digest(r.doc_id, r.text) for r in docs)


def test_odd_rows(spark):
    rng = random.Random(5)
    odd = [None, "", " \t\n", "one", "é\xa0ü " * 40, "a b " * 30, "x\r\ny " * 25, "Ab ab " * 20]
    odd += [" ".join(w) for w in texts_with_runs(9, 40)]
    rows = [(i, t, i) for i, t in enumerate(odd)] + [(3, odd[4], 1), (3, odd[4], 1), (None, "z " * 50, 7)] + [(i, " ".join(rng.choices("abcdefghij", k=60)), 0) for i in range(100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs long").repartition(3)
    got = sorted((tuple(r) for r in periodic_runs.run_digests(df).collect()), key=repr)
    assert got == sorted((digest(i, t) for i, t, _ in rows), key=repr)
    assert sum(r[1] for r in got) > 20
    assert periodic_runs.run_digests(df.limit(0)).collect() == []
    kept = periodic_runs.collapse(df.where("doc_id = 4 OR doc_id = 0"))
    assert kept.columns == ["doc_id", "text", "n_runs"]
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == [(0, None, 0), (4, "é\xa0ü", 4)]
    listed = periodic_runs.find_runs(df.where("doc_id = 4 OR doc_id IS NULL")).collect()
    assert sorted((tuple(r) for r in listed), key=repr) == [(4, 0, 40, 1), (None, 0, 50, 1)]


def test_words_are_what_the_rule_takes(spark):
    """A document whose hash plants a repeat shows it."""
    i = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0 and (zlib.crc32(str(i).encode()) // 10) % 400 < 100)
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(400)))], "doc_id long, text string")
    row = periodic_runs.run_digests(df).collect()[0]
    assert tuple(row) == digest(i, df.first().text) and row.n_runs == 1
    assert periodic_runs.run_digests(df, plant=False).collect()[0].n_runs == 0
