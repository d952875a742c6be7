"""The suffix tree's scores against a plain model with dictionaries; documents that occur again are known better."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SMALL
from tidemark.llm import suffix_tree_lm as lm
from tidemark.llm.tables import read

D = lm.DISCOUNT


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        low = low.replace(space, " ")
    return [*(w for w in low.split(" ") if w), None]


def word_hash(w):
    if w is None:
        return lm.END
    data = np.frombuffer(w.encode(), np.uint8)
    return lm.tokens(data, np.array([0, len(data)]))[0][0]


def can_be_state(context):
    h = np.array([word_hash(w) for w in context] + [np.uint64(0)], np.uint64)
    return len(lm.long_contexts(h, np.array([0, len(h)]))[0]) == 1


class Plain:
    """The model by the book: everything in dictionaries, every probability by recursion."""

    def __init__(self, texts):
        docs = [tokens(t) for t in texts]
        self.count = Counter(w for d in docs for w in d)
        self.n, self.v = sum(self.count.values()), len(self.count)
        grams = Counter(tuple(d[i : i + k]) for d in docs for k in range(1, lm.ORDER + 2) for i in range(len(d) - k + 1))
        least = max(lm.CONTEXT_P * self.n, 2)
        common = {g for g, n in grams.items() if n >= least}
        follow = defaultdict(dict)
        for g in common:
            # a string counts only if both its parts and its words are common
            if len(g) > 1 and all(g[i:j] in common for i in range(len(g)) for j in range(i + 1, len(g) + 1)):
                follow[g[:-1]][g[-1]] = grams[g]
        self.states = {}
        for c in sorted(follow, key=len):
            self._retain(c, grams[c], follow[c], lm.DIVERGENCE)
        deep = defaultdict(Counter)
        for d in docs:
            for i in range(lm.LONG, len(d)):
                deep[tuple(d[i - lm.LONG : i])][d[i]] += 1
        tested = {c: f for c, f in deep.items() if sum(f.values()) > 1 and can_be_state(c)}
        self.deep = {c for c, f in tested.items() if self._retain(c, sum(f.values()), f, lm.LONG_DIVERGENCE, 1)}

    def _retain(self, context, seen, follow, divergence, floor=0):
        p = {w: (n - D) / seen for w, n in follow.items()}
        rare = lambda w: floor and self.count[w] < 2
        q = {w: self.prob(context[1:], w) * ((2 / (self.n + self.v + 1)) / self.root(w) if rare(w) else 1) for w in follow}
        rest_p, rest_q = max(1 - sum(p.values()), 1e-9), max(1 - sum(q.values()), 1e-9)
        gain = seen * (sum(p[w] * math.log(p[w] / q[w]) for w in p) + rest_p * math.log(rest_p / rest_q))
        if gain < divergence:
            return False
        self.states[context] = (p, rest_p / rest_q)
        return True

    def root(self, w):
        return (self.count[w] + 1) / (self.n + self.v + 1)

    def prob(self, past, w):
        for k in range(min(len(past), lm.LONG), 0, -1):
            state = self.states.get(tuple(past[-k:]))
            if state:
                return state[0][w] if w in state[0] else state[1] * self.prob(past[len(past) - k + 1 :], w)
        return self.root(w)

    def score(self, text):
        d = tokens(text)
        return sum(math.log10(self.prob(d[max(0, i - lm.LONG) : i], d[i])) for i in range(len(d)))


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def corpus():
    rng = random.Random(31)
    words = [f"w{k}" for k in range(40)]
    lines = [" ".join(rng.choices(words, k=rng.randrange(5, 60))) for _ in range(30)]
    rows = [(k, " ".join(rng.choices(lines, k=rng.randrange(0, 4)) + rng.choices(words + ["new%d" % k], k=9))) for k in range(120)]
    return [*rows, (500, None), (501, ""), (502, "never seen words of mine")]


@pytest.mark.parametrize("what", ["made", "table"])
def test_scores_by_dictionaries(spark, what):
    rows = corpus() if what == "made" else [(r.doc_id, r.text) for r in read(spark, SMALL, "documents").where("n_chars < 2500").collect()]
    plain = Plain([t for i, t in rows if not held(i)])
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert what == "table" or plain.deep
    for i, text in rows:
        assert math.isclose(got[i].score, plain.score(text), rel_tol=1e-6, abs_tol=1e-6)


def test_documents_that_occur_again_are_known_better(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(words, k=600)) for _ in range(60)]
    ids = [k for k in range(400) if not held(k)]
    rows = list(zip(ids, texts + texts[:20], strict=False))
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    again = {t for t in texts[:20]}
    per = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in got}
    twice, once = ([per[i] for i, t in rows if (t in again) == x] for x in (True, False))
    assert min(twice) > max(once)


def test_every_context_that_occurs_again_can_be_a_state(spark):
    """Texts of six words of their own: each that occurs twice gains by both of its contexts, whatever their hashes are."""
    ids = [k for k in range(400) if not held(k)][:240]
    rows = [(i, " ".join(f"t{k % 120}x{j}" for j in range(6))) for k, i in enumerate(ids)]
    got = lm.score_documents(spark.createDataFrame([*rows, (10**9, "one of its own kind only")], "doc_id long, text string")).collect()
    assert all(r.score > r.base_score + 2 for r in got if r.doc_id < 10**9)
    t, at = np.arange(1, 60, dtype=np.uint64), np.array([0, 3, 10, 59])
    assert lm.long_contexts(t, at)[0].tolist() == [*range(7, 10), *range(14, 59)]


@pytest.mark.parametrize("bits", [0, 1, 5])
def test_places_come_back_from_their_shares(bits):
    rng = np.random.default_rng(3)
    n = 500
    c, key = rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    word, state = rng.integers(0, 9, n).astype(np.uint32), rng.integers(0, 70000, n).astype(np.uint32)
    row = rng.integers(-(1 << 62), 1 << 62, n)
    got = [x for b in lm._shares(bits, c, word, state, row, key) for x in b.to_pylist()]
    assert sum(x["n"] for x in got) == n and len(got) == 1 << bits
    for x in got:
        of = (c >> np.uint64(64 - bits) if bits else c * np.uint64(0)) == x["share"]
        assert np.array_equal(lm.unpacked(x["word"], x["n"], np.uint32), word[of]) and np.array_equal(lm.unpacked(x["state"], x["n"], np.uint32), state[of])
        step = lm.unpacked(x["step"], x["n"], np.uint64)
        assert np.array_equal(np.cumsum((step >> np.uint64(1)).view(np.int64) ^ -(step & np.uint64(1)).view(np.int64)), row[of])
        assert x["key"] == key[of & (word < 2)].tobytes() and len(x["c"]) == 5 * x["n"]
