"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are words (A-Z lowered, split at ASCII white space) and one end for each
text. The root predicts a token by its training count plus one. Below the root
stand contexts of one to ORDER words that are common enough (probability at
least CONTEXT_P, so at most 1 / CONTEXT_P at each length: the tree's size is
bounded however large the corpus is) and whose next-token distribution differs
enough from their suffix's (DIVERGENCE nats over all their occurrences). A state
knows the tokens that often follow it, each discounted; what is left goes to all
others in proportion to the suffix's prediction. A token is scored by the
longest suffix of its past that is a state.

The deepest contexts, of LONG words, are states from their second occurrence on
if they pass a divergence test of their own, so that what the model knows grows
with the corpus. Every place of every text takes part: all places are dealt by
the hash of the context before them, packed into arrays, and meet there once, to
be counted and scored. Contexts are told apart by the bits that name their share
and 40 more: 47 in all on half a gigabyte, more on more.

All counts are over all training texts. Words of probability WORD_P or more (at
most 1 / WORD_P) and the common contexts are broadcast; every rarer word meets
its count in a join, so nothing that grows with the corpus is broadcast or
collected.

Edge cases: null and empty texts are the end token alone; repeated rows are
scored and counted each; without training texts N and V are 0, every score is 0;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import crc_mod, stored, with_row
from tidemark.llm.textbytes import U64, each_chunk, lean, mix64, sum_rows, words

ORDER = 3
WORD_P = 1e-6
CONTEXT_P = 1e-5
DIVERGENCE = 30.0
DISCOUNT = 0.5
#: Words of the deepest contexts, and the nats that make them states.
LONG = 4
LONG_DIVERGENCE = 6.0
#: Tokens of a share of the deepest contexts, about; places that a task packs at once; sums that it holds.
SHARE = 1_000_000
PACK = 1_000_000
SUMS = 500_000
LOW40 = U64((1 << 40) - 1)
#: The hash of the end token.
END = U64(0x656E642D6F662D74)


class Lookup:
    """Places of 64-bit keys, by a table of the hashed keys' leading bits."""

    def __init__(self, keys: np.ndarray):
        mixed = mix64(keys)
        self.order = np.argsort(mixed)
        self.keys = mixed[self.order]
        self.bits = max(1, min(22, len(keys).bit_length()))
        edges = np.searchsorted(self.keys >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64))
        self.begin, self.size = edges[:-1].astype(np.int32), np.diff(edges).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among those given at first; -1: none."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        mixed = mix64(keys)
        slot = (mixed >> U64(64 - self.bits)).astype(np.int64)
        at, size = self.begin[slot], self.size[slot]
        todo = np.flatnonzero(size)
        step = 0
        while len(todo):
            place = at[todo] + step
            same = self.keys[place] == mixed[todo]
            out[todo[same]] = self.order[place[same]]
            step += 1
            todo = todo[~same]
            todo = todo[size[todo] > step]
        return out


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with the end of each text, and where each text's begin (n + 1)."""
    w, at = words(data, off)
    n_docs = len(off) - 1
    out = np.full(len(w) + n_docs, END, U64)
    out[np.arange(len(w)) + np.repeat(np.arange(n_docs), np.diff(at))] = w
    return out, at + np.arange(n_docs + 1)


class _Tally:
    """Distinct keys and their counts, merged as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > 2_000_000:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts] or [np.zeros(0, U64)])
        counts = np.concatenate([c for _, c in self.parts] or [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts

    def batch(self) -> Iterator[pa.RecordBatch]:
        keys, counts = self.merged()
        for lo in range(0, len(keys), 1 << 17):
            hi = lo + (1 << 17)
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi].view(np.int64)), pa.array(counts[lo:hi].astype(np.int64))], ["key", "n"])
        self.parts, self.size = [], 0


def _tallied(docs: DataFrame, keys_of) -> DataFrame:
    """Counts over all texts of what keys_of(tokens, at) names: (key, n), one row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for _, _, data, off in each_chunk(batch):
                tally.add(keys_of(*tokens(data, off)))
                if tally.size > 1_500_000:  # a long partition sends what it has
                    yield from tally.batch()
        yield from tally.batch()

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Strings:
    """The common strings of words by length; the word ids are ranks by count."""

    words: Lookup
    n_words: int
    n_common: int  # ids below are common enough for strings
    levels: list[Lookup]  # strings of 2, 3, ... words: key = place of all but the last * n_words + last

    def ids(self, t: np.ndarray) -> np.ndarray:
        return self.words(t)

    def places(self, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For lengths 1, 2, ...: the place of the string that ends at each token, -1 if none or not within the text."""
        out = [np.where((ids >= 0) & (ids < self.n_common), ids, -1)]
        first = np.zeros(len(ids), bool)
        first[at[:-1]] = True
        for level in self.levels:
            out.append(self._longer(out[-1], out[0], first, level))
        return out

    def _candidates(self, shorter: np.ndarray, one: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a common string one shorter ends just before a common word, both ends common; and the keys."""
        before = np.full(len(one), -1, np.int64)
        before[1:] = shorter[:-1]
        before[first] = -1
        where = np.flatnonzero((before >= 0) & (one >= 0) & (shorter >= 0))
        return where, (before[where] * self.n_words + one[where]).astype(U64)

    def _longer(self, shorter, one, first, level: Lookup) -> np.ndarray:
        where, keys = self._candidates(shorter, one, first)
        out = np.full(len(one), -1, np.int64)
        out[where] = level(keys)
        return out

    def next_keys(self, t: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys of all strings one longer than the longest level, whose parts are common."""
        first = np.zeros(len(t), bool)
        first[at[:-1]] = True
        known = self.places(self.ids(t), at)
        return self._candidates(known[-1], known[0], first)[1]


@dataclass
class Tree:
    strings: Strings
    root: np.ndarray  # log10 of each broadcast word's prediction at the root
    state_of: list[np.ndarray]  # by length of context: place -> state, -1 if not retained
    alpha: np.ndarray  # log10 of what a state leaves to its suffix
    parent: np.ndarray  # -1: the root
    entries: Lookup  # key: state * n_words + id
    value: np.ndarray  # log10

    def states(self, t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (-1: rare), and the state that each token is scored by (-1: the root)."""
        s = self.strings
        ids = s.ids(t)
        places = s.places(ids, at)
        first = np.zeros(len(t), bool)
        first[at[:-1]] = True
        state = np.full(len(t), -1, np.int64)
        for of, place in zip(self.state_of, places, strict=False):
            if not len(of):
                continue
            got = np.full(len(t), -1, np.int64)
            got[1:] = np.where(place[:-1] >= 0, of[np.maximum(place[:-1], 0)], -1)
            got[first] = -1
            state = np.where(got >= 0, got, state)
        return ids, state

    def score(self, t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids and the tree's log10 of each token, as `states` and `logs` have them."""
        ids, state = self.states(t, at)
        return ids, self.logs(ids, state)

    def logs(self, ids: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Each token's log10 probability; of rare words (id -1) without the root's share."""
        s, state = self.strings, state.copy()
        out = np.zeros(len(ids))
        todo = np.arange(len(ids))
        while len(todo):
            now = state[todo]
            at_root = now < 0
            end, todo, now = todo[at_root], todo[~at_root], now[~at_root]
            known = end[ids[end] >= 0]
            out[known] += self.root[ids[known]]
            hit = np.full(len(todo), -1, np.int64)
            common = np.flatnonzero(ids[todo] >= 0)
            hit[common] = self.entries((now[common] * s.n_words + ids[todo[common]]).astype(U64))
            found = hit >= 0
            out[todo[found]] += self.value[hit[found]]
            todo, now = todo[~found], now[~found]
            out[todo] += self.alpha[now]
            state[todo] = self.parent[now]
        return out


def grow(strings: Strings, word_n: np.ndarray, level_keys: list[np.ndarray], level_n: list[np.ndarray], total: int, distinct: int, divergence: float, discount: float) -> Tree:
    """Retain contexts by their divergence from their suffix and smooth what follows them."""
    n_words = strings.n_words
    root = np.log10((word_n + 1) / (total + distinct + 1)) if total else np.zeros(n_words)
    state_of: list[np.ndarray] = []
    alpha, parent = [], []
    entry_keys, entry_values = [], []
    known: dict[int, float] = {}  # all entries so far, for the suffix's prediction
    # suffix[k][place]: place among the strings one shorter of the string without its first word
    counts = [word_n[: strings.n_common], *level_n]
    suffix: list[np.ndarray] = [np.full(strings.n_common, -1, np.int64)]
    for k, keys in enumerate(level_keys):
        prefix, last = keys // n_words, keys % n_words
        if k == 0:
            suffix.append(last)
        else:
            suffix.append(strings.levels[k - 1]((suffix[k][prefix] * n_words + last).astype(U64)))

    def predict(state: int, w: int) -> float:
        got = 0.0
        while state >= 0:
            here = known.get(state * n_words + w)
            if here is not None:
                return got + here
            got += alpha[state]
            state = parent[state]
        return got + float(root[w])

    for k, keys in enumerate(level_keys):  # contexts of k + 1 words, followed by one
        context, follow = keys // n_words, keys % n_words
        order = np.argsort(context, kind="stable")
        context, follow, n_next = context[order], follow[order], level_n[k][order]
        heads = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        of = np.full(len(counts[k]), -1, np.int64)
        for lo, hi in zip(heads, np.append(heads[1:], len(context)), strict=True):
            c = int(context[lo])
            up = -1
            place, level = c, k
            while level > 0 and up < 0:  # the longest retained proper suffix
                place, level = int(suffix[level][place]), level - 1
                up = int(state_of[level][place]) if place >= 0 else -1
                if place < 0:
                    break
            seen = float(counts[k][c])
            p = (n_next[lo:hi] - discount) / seen
            q = np.power(10.0, [predict(up, int(w)) for w in follow[lo:hi]])
            rest_p, rest_q = max(1 - p.sum(), 1e-9), max(1 - q.sum(), 1e-9)
            gain = seen * (float((p * np.log(p / q)).sum()) + rest_p * np.log(rest_p / rest_q))
            if gain < divergence:
                continue
            state = len(alpha)
            of[c] = state
            parent.append(up)
            alpha.append(float(np.log10(rest_p / rest_q)))
            for w, v in zip(follow[lo:hi].tolist(), np.log10(p).tolist(), strict=True):
                known[state * n_words + w] = v
                entry_keys.append(state * n_words + w)
                entry_values.append(v)
        state_of.append(of)
    keys = np.array(entry_keys, np.int64).astype(U64)
    return Tree(strings, root, state_of, np.array(alpha), np.array(parent, np.int64), Lookup(keys), np.array(entry_values))


def _bounded(df: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys with at least `least` occurrences: most frequent first. At most total / least rows come."""
    got = df.where(F.col("n") >= float(max(least, 2))).toPandas()
    keys, n = got["key"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    order = np.lexsort((keys, -n))
    return keys[order], n[order]


def fit(docs: DataFrame, order: int = ORDER, word_p: float = WORD_P, context_p: float = CONTEXT_P, divergence: float = DIVERGENCE, discount: float = DISCOUNT) -> tuple[Tree, DataFrame, int, int]:
    """The tree, the vocabulary (key, n) as a table, tokens N and distinct tokens V of the training texts."""
    vocabulary = stored(_tallied(docs, lambda t, at: t), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    keys, word_n = _bounded(vocabulary, word_p * total)
    end = keys == END.astype(np.int64)
    if total and not end.any():
        ends = vocabulary.where(F.col("key") == int(END.astype(np.int64))).first()
        keys, word_n = np.append(keys, ends["key"]), np.append(word_n, ends["n"])
    common = int((word_n >= max(context_p * total, 2)).sum())
    strings = Strings(Lookup(keys.view(U64)), max(len(keys), 1), common, [])
    level_keys, level_n = [], []
    for _ in range(order):
        if not common:
            break
        found, n = _bounded(_tallied(docs, strings.next_keys), context_p * total)
        if not len(found):
            break
        level_keys.append(found)
        level_n.append(n)
        strings.levels.append(Lookup(found.view(U64)))
    tree = grow(strings, word_n, level_keys, level_n, total, distinct, divergence, discount)
    strings.levels = strings.levels[: max(order - 1, 0)]  # contexts have one word less than the strings counted last
    return tree, vocabulary, total, distinct


def long_contexts(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens after LONG others of their text, and the hash of each one's context."""
    n = max(len(t) - LONG, 0)
    c = np.full(n, 17, U64)
    for k in range(LONG):
        c = mix64(c * U64(31) + t[k : k + n])
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    k = np.flatnonzero(doc[:n] == doc[LONG:])
    return k + LONG, c[k]


def _scorer(tree: Tree):
    names = ["_row", "n_tokens", "n_common", "base", "tree", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            for lo, hi, data, off in each_chunk(batch):
                t, at = tokens(data, off)
                ids, logs = tree.score(t, at)
                known = ids >= 0
                base = np.zeros(len(t))
                base[known] = tree.root[ids[known]]
                rare = np.flatnonzero(~known)
                doc = np.repeat(np.arange(hi - lo), np.diff(at))[rare]
                order = np.lexsort((t[rare], doc))
                key, doc = t[rare][order], doc[order]
                first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)])
                times = np.diff(np.append(first, len(key)))
                lists_at = np.searchsorted(doc[first], np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(lists_at), pa.StructArray.from_arrays([pa.array(key[first].view(np.int64)), pa.array(times.astype(np.int32))], ["key", "times"])
                )
                cols = [pa.array(rows[lo:hi]), pa.array(np.diff(at)), pa.array(sum_rows(known, at).astype(np.int64)), pa.array(sum_rows(base, at)), pa.array(sum_rows(logs, at)), lists]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def packed(values: np.ndarray) -> list[bytes]:
    """Numbers as one compressed string for each of their bytes, low ones first; empty where all are 0."""
    planes = values.view(np.uint8).reshape(len(values), -1)
    return [pa.compress(np.ascontiguousarray(p), codec="zstd", asbytes=True) if p.any() else b"" for p in planes.T]


def unpacked(planes: list[bytes], n: int, kind: type) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    for k, p in enumerate(planes):
        if p:
            out[:, k] = np.frombuffer(pa.decompress(p, decompressed_size=n, codec="zstd"), np.uint8)
    return out.reshape(-1).view(kind)


_PLACES = "share int, n int, c binary, word array<binary>, state array<binary>, step array<binary>, key binary"


def _shares(bits: int, c: np.ndarray, word: np.ndarray, state: np.ndarray, row: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places in rows of one share each: c, word (2 id + 2, 0 rare; and 1 if held out), state + 1, row, and the key of rare words."""
    share = (c >> U64(64 - bits)).astype(np.uint16) if bits else np.zeros(len(c), np.uint16)
    order = np.argsort(share, kind="stable")
    share = share[order]
    heads = np.flatnonzero(np.append(True, share[1:] != share[:-1])[: len(share)])
    out = []
    for lo, hi in zip(heads.tolist(), np.append(heads[1:], len(share)).tolist(), strict=True):
        own = order[lo:hi]
        step = np.diff(row[own], prepend=0)
        low = (c[own] & LOW40).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
        rare = key[own][word[own] < 2].tobytes()
        out.append((int(share[lo]), hi - lo, low, packed(word[own]), packed(state[own]), packed((step << 1) ^ (step >> 63)), rare))
        if len(out) == 64 or hi == len(share):
            types = [pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.binary())] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), types, strict=True)], ["share", "n", "c", "word", "state", "step", "key"])
            out = []


def _places(tree: Tree, bits: int):
    """All places of all texts that follow LONG others, packed by share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            rows, held = batch.column("_row").to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint32)
            for lo, hi, data, off in each_chunk(batch):
                t, at = tokens(data, off)
                ids, state = tree.states(t, at)
                k, c = long_contexts(t, at)
                doc = lo + np.repeat(np.arange(hi - lo), np.diff(at))[k]
                parts.append((c, ((ids[k] + 1) << 1).astype(np.uint32) | held[doc], (state[k] + 1).astype(np.uint32), rows[doc], t[k]))
                size += len(k)
                if size >= PACK:
                    yield from _shares(bits, *(np.concatenate(x) for x in zip(*parts, strict=True)))
                    parts, size = [], 0
        if size:
            yield from _shares(bits, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def deep_gains(tree: Tree, c: np.ndarray, word: np.ndarray, state: np.ndarray, row: np.ndarray, key: np.ndarray, floor: float, discount: float, divergence: float) -> tuple[np.ndarray, ...]:
    """All places of some contexts -> of those after a retained context: the row, what the context changes in log10, whether the root's share goes, too, and the key.

    The tree's log10 has no root's share for rare words, and `floor` stands for
    that in the test.
    """
    order = np.argsort(c, kind="stable")
    c = c[order]
    new = np.append(True, c[1:] != c[:-1])[: len(c)]
    train = (word[order] & 1) == 0
    often = np.add.reduceat(train.astype(np.int64), np.flatnonzero(new)) > 1 if len(c) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    kept = often[group]
    order, group, train = order[kept], group[kept], train[kept]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros(0, U64)
    ids = (word[order] >> 1).astype(np.int64) - 1
    rare = ids < 0
    follow = np.where(rare, key[order], ids.astype(U64))
    again = np.lexsort((follow, rare, group))
    order, group, train, ids, rare, follow = order[again], group[again], train[again], ids[again], rare[again], follow[again]
    head = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]) | (rare[1:] != rare[:-1])))
    pair = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(group))))
    n = np.add.reduceat(train.astype(np.int64), head)
    v = tree.logs(ids[head], state[order[head]].astype(np.int64) - 1)
    seen = n > 0
    q = np.where(seen, np.minimum(np.power(10.0, v + np.where(rare[head], floor, 0.0)), 1 - 1e-9), 1.0)
    less = np.where(seen, n - discount, 0.0)
    first = np.flatnonzero(np.append(True, group[head][1:] != group[head][:-1]))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(head))))
    cross = less * (np.log(np.where(seen, less, 1.0)) - np.log(q))
    n_c, all_less, cross, all_q = (np.add.reduceat(x, first) for x in (n, less, cross, np.where(seen, q, 0.0)))
    rest_p, rest_q = np.maximum(1 - all_less / n_c, 1e-9), np.maximum(1 - all_q, 1e-9)
    gain = cross - np.log(n_c) * all_less + n_c * rest_p * np.log(rest_p / rest_q)
    change = np.where(seen, np.log10(np.where(seen, less, 1.0) / n_c[of]) - v, np.log10(rest_p / rest_q)[of])
    states = (gain >= divergence)[of][pair]
    return row[order[states]], change[pair[states]], (rare & seen[pair])[states], key[order[states]]


def _sums(row: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, place = np.unique(row, return_inverse=True)
    return rows, np.bincount(place, gain, len(rows))


def _gains(tree: Tree, floor: float, discount: float, divergence: float):
    """Packed places, those of a share one after the other -> _row and the sum of gains (key null), and _row and key of each rare word whose root's share goes."""

    def told(rows: np.ndarray, gain: np.ndarray | None, key: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(rows), 1 << 17):
            part = slice(lo, lo + (1 << 17))
            m = len(rows[part])
            cols = [pa.array(rows[part]), pa.nulls(m, pa.float64()) if gain is None else pa.array(gain[part]), pa.nulls(m, pa.int64()) if key is None else pa.array(key[part].view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["_row", "gain", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, sums = None, [], (np.zeros(0, np.int64), np.zeros(0))

        def counted() -> tuple[np.ndarray, ...]:
            return deep_gains(tree, *(np.concatenate(x) for x in zip(*parts, strict=True)), floor, discount, divergence)

        def added(got: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            nonlocal sums
            row, gain, rooted, key = got
            yield from told(row[rooted], None, key[rooted])
            sums = _sums(np.concatenate([sums[0], row]), np.concatenate([sums[1], gain]))
            if len(sums[0]) > SUMS:
                yield from told(*sums, None)
                sums = (np.zeros(0, np.int64), np.zeros(0))

        for batch in batches:
            for x in batch.to_pylist():
                if x["share"] != now and parts:
                    yield from added(counted())
                    parts = []
                now, n = x["share"], x["n"]
                low = np.zeros((n, 8), np.uint8)
                low[:, :5] = np.frombuffer(x["c"], np.uint8).reshape(n, 5)
                word, step = unpacked(x["word"], n, np.uint32), unpacked(x["step"], n, np.int64)
                key = np.zeros(n, U64)
                key[word < 2] = np.frombuffer(x["key"], U64)
                step = ((step.view(U64) >> U64(1)).view(np.int64)) ^ -(step & 1)
                parts.append((low.reshape(-1).view(U64), word, unpacked(x["state"], n, np.uint32), np.cumsum(step), key))
        if parts:
            yield from added(counted())
        yield from told(*sums, None)

    return run


def _deep_gain(rows: DataFrame, tree: Tree, total: int, distinct: int, discount: float, divergence: float) -> DataFrame:
    """What the deepest states change in each text's log10: _row, gain, with null keys, and _row, key of rare words that no longer take the root's share."""
    bits = min(max(math.ceil(math.log2(max(total, 1) / SHARE)), 0), 16)
    least = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 2)
    places = rows.select("_row", "held_out", "text").mapInArrow(lean(_places(tree, bits)), _PLACES).repartition(least, "share").sortWithinPartitions("share")
    floor = math.log10(2 / float(total + distinct + 1))
    return stored(places.mapInArrow(lean(_gains(tree, floor, discount, divergence)), "_row long, gain double, key long"), "gains")


def score(rows: DataFrame, tree: Tree, vocabulary: DataFrame, total: int, distinct: int, discount: float = DISCOUNT, long_divergence: float = LONG_DIVERGENCE) -> DataFrame:
    """rows (_row, held_out, text) -> _row, n_tokens, n_known, base_score, score; the deepest states are those of the rows not held out."""
    parts = stored(rows.select("_row", "text").mapInArrow(lean(_scorer(tree)), "_row long, n_tokens long, n_common long, base double, tree double, rare array<struct<key:long,times:int>>"), "scored")
    gains = _deep_gain(rows, tree, total, distinct, discount, long_divergence)
    rare = parts.select("_row", F.explode("rare").alias("x")).select("_row", "x.key", "x.times", F.col("x.times").alias("left"))
    gone = gains.where("key IS NOT NULL").groupBy("_row", "key").agg((-F.count(F.lit(1))).cast("int").alias("left")).select("_row", "key", F.lit(0).alias("times"), "left")
    n = F.coalesce("n", F.lit(0))
    root = F.log10((n + 1) / F.lit(float(total + distinct + 1)))
    met = (
        rare.unionAll(gone).join(vocabulary, "key", "left").groupBy("_row")
        .agg(F.sum(F.col("times") * root).alias("more"), F.sum(F.col("left") * root).alias("left"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"))
    )
    deep = gains.where("key IS NULL").groupBy("_row").agg(F.sum("gain").alias("gain"))
    more, left, gain = (F.coalesce(c, F.lit(0.0)) for c in ("more", "left", "gain"))
    return parts.drop("rare").join(met, "_row", "left").join(deep, "_row", "left").select(
        "_row", "n_tokens", (F.col("n_common") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("tree") + left + gain).alias("score")
    )


def score_documents(docs: DataFrame, **how) -> DataFrame:
    """All documents, by a tree of those whose crc32(doc_id) % 7 is not 2."""
    rows = with_row(docs.select("doc_id", "text")).withColumn("held_out", crc_mod("doc_id", 7) == 2)
    tree, vocabulary, total, distinct = fit(rows.where("NOT held_out"), **how)
    scored = score(rows, tree, vocabulary, total, distinct)
    return rows.select("_row", "doc_id", "held_out").join(scored, "_row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )
