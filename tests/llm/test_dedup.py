"""Substring and near-duplicate dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from tests.conftest import SMALL
from tidemark.llm import near_dedup, suffix_dedup
from tidemark.llm.tables import read


def covered(texts: list[bytes], length: int) -> list[list[bool]]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = [True] * length
        out.append(mask)
    return out


def expected_repeats(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, mask in zip(rows, raw, covered(raw, length), strict=True):
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
        runs = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
        out.append((i, len(t), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_of_the_small_table(spark):
    docs = read(spark, SMALL, "documents")
    got = sorted((tuple(r) for r in suffix_dedup.find(docs).collect()), key=repr)
    assert got == expected_repeats([(r.doc_id, r.text) for r in docs.collect()], 400)


@pytest.mark.parametrize("split_spans", [2, 1024])
def test_repeats_by_brute_force(spark, split_spans):
    rng = random.Random(3)
    passages = ["".join(rng.choices("abé ", k=rng.randint(30, 90))) for _ in range(5)]
    rows = [(k, "".join(rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.6 else "".join(rng.choices("xyz", k=9)) for _ in range(6))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "short"), (103, "ab" * 80), (None, rows[0][1]), (7, "a" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in suffix_dedup.find(df, 40, q=8, split_spans=split_spans, step=4).collect()), key=repr)
    assert got == expected_repeats(rows, 40)


def expected_passages(rows, width, min_words, min_bytes):
    """n_passage_bytes, n_passages of each row, by counting every string of `width` bytes."""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(raw[k : k + width] for raw in raws for k in range(len(raw) - width + 1))
    out = []
    for raw in raws:
        mask = [0] * len(raw)
        for k in range(len(raw) - width + 1):
            if seen[raw[k : k + width]] > 1:
                mask[k : k + width] = [1] * width
        runs = [m.span() for m in re.finditer("1+", "".join(map(str, mask)))]
        runs = [(a, b) for a, b in runs if b - a >= min_bytes or sum(raw[k : k + 1] != b" " and (k == 0 or raw[k - 1 : k] == b" ") for k in range(a, b)) >= min_words]
        out.append((sum(b - a for a, b in runs), len(runs)))
    return out


@pytest.mark.parametrize("split_spans", [2, 1024])
def test_repeats_and_passages_by_brute_force(spark, split_spans):
    rng = random.Random(8)
    passages = ["".join(rng.choices("abc  ", k=rng.randint(20, 70))) for _ in range(9)]
    rows = [(k, "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("wxyz ", k=25)) for _ in range(4))) for k in range(50)]
    rows += [(100, None), (101, ""), (102, "short"), (103, "ab " * 50), (None, rows[0][1]), (207, "a" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.find_with_passages(df, 40, 20, 6, q=8, split_spans=split_spans, step=4).collect()
    long = {r[0]: r for r in expected_repeats(rows, 40)}
    want = [(*long[i], *more) for (i, _), more in zip(rows, expected_passages(rows, 20, 6, 40), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(r.n_passage_bytes > 0 == r.n_removed for r in got) and any(0 < r.n_removed < r.n_passage_bytes for r in got)
    assert suffix_dedup.find_with_passages(df.limit(0)).collect() == []


def test_dedup_keeps_columns_with_clashing_names(spark):
    rows = [(1, "p" + "q" * 50, "a", 1), (2, "x" + "q" * 50, None, 2), (3, None, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string, windows int")
    got = {r.doc_id: r for r in suffix_dedup.dedup(df, 40, q=8).collect()}
    assert got[1].asDict() == {"doc_id": 1, "text": "p", "_row": "a", "windows": 1}
    assert got[3].text is None
    assert suffix_dedup.dedup(df.limit(0), 40, q=8).collect() == []


def shingles(text, size=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return set(zip(*(w[k:] for k in range(size)), strict=False)) or ({tuple(w)} if w else set())


def expected_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)], least[find(k)] == i) for k, (i, _) in enumerate(rows))


def test_near_copies_of_the_small_table(spark):
    docs = read(spark, SMALL, "documents")
    got = sorted(tuple(r) for r in near_dedup.find(docs).collect())
    assert got == expected_components([(r.doc_id, r.text) for r in docs.collect()], 85)


def test_near_copies_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(500)]
    rows = []
    for base in range(12):
        text = rng.choices(vocabulary, k=80)
        for copy in range(6):
            changed = list(text)
            for _ in range(copy):
                changed[rng.randrange(80)] = rng.choice(vocabulary)
            rows.append((10 * base + copy, " ".join(changed)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    assert sorted(tuple(r) for r in near_dedup.find(df, 0.8).collect()) == expected_components(rows, 80)


def test_large_regions_are_cut_and_stay_joined(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MAX_GROUP", 4)
    monkeypatch.setattr(near_dedup, "STAR_GROUP", 3)
    base = ["w%d" % k for k in range(400)]
    rows = [(k, " ".join(base[:k] + ["x%d" % k] + base[k + 1 :])) for k in range(0, 200, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_dedup.find(df).collect()} == {0}


def test_pairs_amid_a_family_under_the_threshold(spark, monkeypatch):
    """One template with many fillings, pairs just over the threshold: no region is small enough to be compared whole."""
    monkeypatch.setattr(near_dedup, "MAX_GROUP", 16)
    monkeypatch.setattr(near_dedup, "STAR_GROUP", 8)
    rng = random.Random(11)
    base = ["w%d" % k for k in range(360)]
    rows = []
    for k in range(150):
        filling = ["f%d" % rng.randrange(10**9) for _ in range(40)]
        other = filling[:15] + ["f%d" % rng.randrange(10**9) for _ in range(25)]
        rows += [(2 * k, " ".join(base[:200] + filling + base[200:])), (2 * k + 1, " ".join(base[:200] + other + base[200 : len(base) - k % 3]))]
    expected = expected_components(rows, 85)
    assert len({r[2] for r in expected}) == 150
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dedup.find(df).collect()) == expected


def test_prefixes_hold_a_shared_shingle():
    for percent in (80, 85, 100):
        for n in range(1, 60):
            for m in range(1, n + 1):
                shared = -(-percent * (n + m) // (100 + percent))  # the fewest that similar sets of n and m share
                if shared <= m:
                    high, low = near_dedup.prefixes_of(n, percent)[0], near_dedup.prefixes_of(m, percent)[1]
                    assert high >= n - shared + 1 and low >= m - shared + 1


def test_drop_near_copies_keeps_one_row_of_each(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(2, text, "a"), (1, text + " more", "b"), (1, text + " more", "c"), (None, text, "d"), (3, None, "e"), (4, "", "f"), (None, None, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _r string")
    got = near_dedup.drop_near_copies(df, 0.8).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 3, 4, None]
    assert near_dedup.drop_near_copies(df.limit(0)).collect() == []


def test_five_thousand_near_copies_with_the_real_limits(spark):
    """One family far beyond MAX_GROUP, some members of it linked by one other member only, amid texts of their own."""
    rng = random.Random(2)
    words = [f"v{k}" for k in range(5000)]
    base = rng.choices(words, k=160)
    rows = [(0, " ".join(base))]
    for k in range(1, 5000):
        text = list(base)
        text[rng.randrange(160)] = f"own{k}"
        rows.append((k, " ".join(text)))
    for k in range(5000, 5010):  # 0.87 like their partner, 0.82 or less like all others
        text = rows[k - 4000][1].split()
        text[3], text[80] = f"far{k}", f"far{k}x"
        rows.append((k, " ".join(text)))
    rows += [(k, " ".join(rng.choices(words, k=160))) for k in range(6000, 6200)]
    assert len(rows) > 2 * near_dedup.MAX_GROUP
    got = {r.doc_id: r.component_id for r in near_dedup.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert {got[k] for k in range(5010)} == {0}
    assert all(got[k] == k for k in range(6000, 6200))


def test_hubs_of_many_regions(spark, monkeypatch):
    """Regions that are each small enough, around one hub that is not."""
    monkeypatch.setattr(near_dedup, "MAX_GROUP", 20)
    monkeypatch.setattr(near_dedup, "STAR_GROUP", 8)
    rng = random.Random(4)
    base = ["w%d" % k for k in range(120)]
    rows = [(0, " ".join(base)), (1, " ".join(base))]
    for k in range(2, 60):
        text = list(base)
        text[rng.randrange(120)] = "x%d" % k
        rows.append((k, " ".join(text)))
        text[rng.randrange(120)] = "y%d" % k
        rows.append((100 + k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dedup.find(df).collect()) == expected_components(rows, 85)
    monkeypatch.setattr(near_dedup, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(near_dedup, "MAX_GROUP", 2048)
    assert sorted(tuple(r) for r in near_dedup.find(df).collect()) == expected_components(rows, 85)


def test_near_copies_of_repeated_rows_and_no_rows(spark):
    rows = [(1, "one two three four five six", "x"), (1, "one two three four five six", "y"), (None, "one two three four five six", "z"), (2, None, "x"), (2, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.find(df).collect()), key=str) == [(1, 1, True), (1, 1, True), (2, 2, True), (2, 2, True), (None, 1, False)]
    assert near_dedup.find(df.limit(0)).collect() == []
