"""Leaks against brute force: items of every length, many equal items, documents without ids."""

from __future__ import annotations

import random

from tidemark.llm import decontaminate as d


def lcs(item, doc, at, shift):
    """Longest common subsequence of item words with document words at most `shift` from the place opposite."""
    best = {}
    for i, w in enumerate(item):
        for j in range(max(0, at + i - shift), min(len(doc), at + i + shift + 1)):
            up = max((v for (a, b), v in best.items() if a < i and b < j), default=0) + 1 if doc[j] == w else 0
            if up:
                best[i, j] = up
    return max(best.values(), default=0)


def found(item: list[str], doc: list[str]) -> bool:
    """The rule on every alignment that a seed hit may fix."""
    n = len(item)
    if n < d.MIN_WORDS:
        return any(doc[k : k + n] == item for k in range(len(doc) - n + 1))
    aligns = set()
    for mask in d.MASKS:
        use = [k for k, c in enumerate(mask) if c == "1"]
        for i in range(n - len(mask) + 1):
            for j in range(len(doc) - len(mask) + 1):
                if all(item[i + k] == doc[j + k] for k in use):
                    aligns.add(j - i)
    for a in aligns:
        if sum(0 <= a + k < len(doc) and doc[a + k] == w for k, w in enumerate(item)) >= d.OVERLAP * n - 1e-9:
            return True
        size = min(n, d.STRETCH)
        for k in range(n - size + 1):
            if lcs(item[k : k + size], doc, a + k, d.SHIFT) >= d.OVERLAP * size - 1e-9:
                return True
    return False


def test_every_length_by_brute_force(spark):
    rng = random.Random(23)
    words = [f"w{k}" for k in range(60)]
    items = [rng.choices(words, k=n) for n in range(1, 13) for _ in range(3)] + [rng.choices(words, k=30) for _ in range(4)]
    docs = []
    for _ in range(120):
        item = list(rng.choice(items))
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(item))
            item[k : k + 1] = rng.choice(([], ["zz"], [item[k], "zz"]))
            item = item or ["zz"]
        docs.append([f"d{rng.randrange(10**6)}" for _ in range(rng.randrange(6))] + item + [f"d{rng.randrange(10**6)}" for _ in range(5)])
    expected = sorted((i, j) for i, t in enumerate(docs) for j, item in enumerate(items) if found(item, t))
    assert len({len(items[j]) for _, j in expected}) >= 12
    rows = spark.createDataFrame([(i, " ".join(t).title()) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.find_leaks(rows, bench).collect()) == expected
    kept = {r.doc_id for r in d.drop_leaks(rows, bench).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in expected}


def test_many_equal_items_and_documents_without_id(spark):
    text = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(k % 50, text) for k in range(300)] + [(900, "four words it has")], "item_id long, text string")
    docs = spark.createDataFrame([(None, f"a {text} b", 1), (None, "clean", 2), (3, "it is four words it has here", 3), (3, "clean", 4)], "doc_id long, text string, _row int")
    got = [(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(None, k % 50) for k in range(300)] + [(3, 900)], key=str)
    kept = d.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r[2] for r in kept.collect()) == [2, 4]
