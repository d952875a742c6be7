"""Line quality by a linear-chain conditional random field, summed up to documents.

Every line gets features of its own and of the lines before and after it; a
two-state chain (good, bad) over a document's lines is trained on documents with
a quality label, each line bearing its document's label. The score of a document
is the mean of its lines' forward-backward marginals of "good", weighted by
their lengths in bytes.

Training reads the whole texts of at most `max_docs` labelled documents (those of
the smallest hash of doc_id). Each document counts the same there, however many
lines it has; documents of more than CHAIN_LINES lines are several chains, whose
lines keep their neighbours' features. Scoring reads every whole text.

Edge cases: null and empty texts are one empty line and get a score like any
other; labels of null or repeated ids: null quality is ignored, repeated ids
take the greatest; with no label, or labels of one kind only, every score is 0.5
or near that kind's end; other columns are kept out of the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import crc_mod, set_aside, smallest_hashes
from tidemark.llm.textbytes import Rolling, each_chunk, lean, rows_of, sum_rows, word_bounds

THRESHOLD = 0.7
MAX_DOCS = 6000
CHAIN_LINES = 200

# byte classes: 0 lower or non-ASCII, 1 upper, 2 digit, 3 white space, 4 "!", 5 "|", 6 symbol, 7 other
_CLASS = np.full(256, 7, np.uint8)
_CLASS[97:123] = 0
_CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[ord("!")] = 4
_CLASS[ord("|")] = 5
_CLASS[[ord(c) for c in "#$%&*@^~_=<>{}[]\\/+`"]] = 6

N_OWN = 16
N_FEATURES = 3 * N_OWN + 3


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x N_FEATURES), bytes of each line, and where each document's lines begin."""
    n_docs = len(off) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([off[:-1], breaks + 1]))
    # a break that ends a document starts an empty line of its own document, not of the next one
    doc = np.sort(np.concatenate([np.arange(n_docs), np.searchsorted(off, breaks, "right") - 1]))
    at = np.searchsorted(doc, np.arange(n_docs + 1))
    n = len(start)
    end = np.empty(n, np.int64)
    end[:-1] = start[1:]
    end[at[1:] - 1] = off[1:]
    inner = np.ones(n, bool)
    inner[at[1:] - 1] = False
    end[inner] -= 1
    length = end - start

    line_of = np.repeat(np.arange(n), np.diff(np.append(start, len(data))))
    kinds = np.bincount(line_of * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8).astype(np.float64)

    w0, w1 = word_bounds(data, off)
    rolling = Rolling(data)
    hashes = rolling.of(w0, w1)
    wa = np.searchsorted(w0, start)
    wa = np.append(wa, len(w0))
    n_words = np.diff(wa).astype(np.float64)
    line_of_word = np.repeat(np.arange(n), np.diff(wa))
    def again(lag: int) -> np.ndarray:
        same = np.zeros(len(hashes))
        if len(hashes) > lag:
            same[lag:] = (hashes[lag:] == hashes[:-lag]) & (line_of_word[lag:] == line_of_word[:-lag])
        return same
    rep1 = sum_rows(again(1), wa)
    rep2 = sum_rows(np.maximum(again(2), again(3)), wa)
    wlen = (w1 - w0).astype(np.float64)
    mean_len = sum_rows(wlen, wa) / np.maximum(n_words, 1)
    var_len = np.maximum(sum_rows(wlen * wlen, wa) / np.maximum(n_words, 1) - mean_len**2, 0)

    # lines that occur again in their document
    key = rolling.of(start, end)
    order = np.lexsort((key, doc))
    same = np.zeros(n, bool)
    pair = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    same[order[1:]] |= pair
    same[order[:-1]] |= pair
    same &= length > 0

    last = np.where(length > 0, data[np.maximum(end - 1, 0)] if len(data) else 0, 0)
    first = np.where(length > 0, data[np.minimum(start, max(len(data) - 1, 0))] if len(data) else 0, 0)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    words = np.maximum(n_words, 1)
    doc_words = sum_rows(n_words, at)
    own = np.stack([
        kinds[:, 1] / letters, kinds[:, 2] / np.maximum(length, 1), np.minimum(kinds[:, 4] / words, 3),
        np.minimum(kinds[:, 5] / words, 2), np.minimum(kinds[:, 6] / words, 4), np.minimum(kinds[:, 7] / words, 2),
        np.minimum(mean_len, 30) / 10, np.minimum(np.sqrt(var_len), 30) / 10, rep1 / words, rep2 / words,
        same.astype(float), np.log1p(n_words) / 3, np.isin(last, [33, 46, 63, 58, 34]).astype(float),
        (_CLASS[first.astype(np.uint8)] == 1).astype(float), np.log1p(doc_words)[doc] / 3, np.log1p(np.diff(at))[doc] / 3,
    ], 1)
    x = np.zeros((n, N_FEATURES), np.float32)
    x[:, :N_OWN] = own
    has_before, has_after = np.ones(n, bool), np.ones(n, bool)
    has_before[at[:-1]] = False
    has_after[at[1:] - 1] = False
    x[1:, N_OWN : 2 * N_OWN] = own[:-1] * has_before[1:, None]
    x[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:] * has_after[:-1, None]
    x[:, -3], x[:, -2], x[:, -1] = ~has_before, ~has_after, 1
    return x, length, at


class Chain:
    """The positions of many chains by step, so that all chains advance together."""

    def __init__(self, at: np.ndarray):
        count = np.diff(at)
        order = np.argsort(-count, kind="stable")
        self.first, count = at[:-1][order], count[order]
        self.n = int(at[-1])
        steps = int(count[0]) if len(count) else 0
        self.alive = [int(x) for x in np.searchsorted(-count, -np.arange(steps), "left")] if steps else []
        self.last = self.first + count - 1

    def marginals(self, emit: np.ndarray, trans: np.ndarray, share: np.ndarray | None = None):
        """P(good) of each line; log Z; with `share` the sum of pair marginals, weighted by it. emit: lines x 2."""
        a = np.exp(trans - trans.max())
        top = emit.max(1, keepdims=True)
        e = np.exp(emit - top)
        fwd, bwd, scale = np.empty_like(e), np.ones_like(e), np.empty(self.n)
        for t, k in enumerate(self.alive):
            now = self.first[:k] + t
            v = e[now] if t == 0 else (fwd[now - 1] @ a) * e[now]
            s = v.sum(1)
            fwd[now], scale[now] = v / s[:, None], s
        for t in range(len(self.alive) - 2, -1, -1):
            k = self.alive[t + 1]
            now = self.first[:k] + t
            bwd[now] = (bwd[now + 1] * e[now + 1]) @ a.T / scale[now + 1][:, None]
        p = fwd * bwd
        p /= p.sum(1, keepdims=True)
        logz = np.log(scale).sum() + top.sum() + (self.n - len(self.first)) * trans.max()
        if share is None:
            return p[:, 1], logz, None
        after = np.ones(self.n, bool)
        after[self.first] = False
        i = np.flatnonzero(after)
        both = fwd[i - 1][:, :, None] * a[None] * (bwd[i] * e[i] / scale[i][:, None])[:, None, :]
        return p[:, 1], logz, (both * (share[i] / both.sum((1, 2)))[:, None, None]).sum(0)


def train(x: np.ndarray, at: np.ndarray, y: np.ndarray, rounds: int = 250, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights by gradient ascent (Adam) on the conditional log-likelihood of the lines' labels."""
    mean, std = x.mean(0), x.std(0)
    mean[-3:], std[std < 1e-6] = 0, 1
    std[-3:] = 1
    z = (x - mean) / std
    doc = np.repeat(np.arange(len(y)), np.diff(at))
    label = y[doc]
    share = 1 / (np.diff(at)[doc] * len(y))  # each document counts the same, however many lines it has
    cut = np.flatnonzero((np.arange(len(doc)) - at[doc]) % CHAIN_LINES == 0)
    chain = Chain(np.append(cut, len(doc)))
    inner = np.ones(len(label), bool)
    inner[cut] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[i - 1], label[i]), share[i])
    w, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    emit = np.zeros((len(z), 2))
    for k in range(1, rounds + 1):
        emit[:, 1] = z @ w
        p, _, pair = chain.marginals(emit, trans, share)
        g = np.concatenate([z.T @ ((label - p) * share) - l2 * w, (seen - pair - l2 * 10 * trans).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w += step[:-4]
        trans += step[-4:].reshape(2, 2)
    return {"w": w / std, "b": float(-(mean / std) @ w), "trans": trans}


def _document_scores(x, length, at, model) -> np.ndarray:
    emit = np.zeros((len(x), 2))
    emit[:, 1] = x @ model["w"] + model["b"]
    p, _, _ = Chain(at).marginals(emit, model["trans"])
    weight = np.maximum(length, 1).astype(np.float64)
    return np.clip(sum_rows(p * weight, at) / sum_rows(weight, at), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, train_on: Column, max_docs: int = MAX_DOCS) -> dict:
    """Train on at most max_docs labelled documents where `train_on` (of doc_id) holds."""
    labelled = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & train_on)
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("_y"))
    )
    chosen = smallest_hashes(labelled, "_id", max_docs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("_y").to_numpy()
            for lo, hi, data, off in each_chunk(batch):
                x, _, at = line_features(data, off)
                rows = [x[at[k] : at[k + 1]].astype("<f4").tobytes() for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(y[lo:hi]), pa.array(rows, pa.binary())], ["y", "x"])

    # at most max_docs rows of (id, label): a proven bound for the broadcast
    texts = docs.select(F.col("doc_id").alias("_doc"), "text")
    picked = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_y", "text")
    got = picked.mapInArrow(lean(features), "y int, x binary").toPandas()
    got = got.sort_values("x", ignore_index=True)  # one order whatever the partitions
    if not len(got) or got["y"].nunique() < 1:
        return {"w": np.zeros(N_FEATURES), "b": 0.0, "trans": np.zeros((2, 2))}
    parts = [np.frombuffer(b, "<f4").reshape(-1, N_FEATURES) for b in got["x"]]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return train(np.concatenate(parts).astype(np.float64), at, (got["y"].to_numpy() > 0).astype(np.int64))


def with_scores(docs: DataFrame, model: dict) -> DataFrame:
    """docs with a double column `quality_score` added."""
    schema = docs.withColumn("quality_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for lo, hi, data, off in each_chunk(batch):
                scores[lo:hi] = _document_scores(*line_features(data, off), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "quality_score"])

    return docs.mapInArrow(lean(run), schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels with crc32 % 4 = 2 are held out."""
    model = fit(docs, labels, crc_mod("doc_id", 4) != 2)
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (all columns) whose score reaches the threshold."""
    hidden, back = set_aside(docs, "quality_score")
    scored = with_scores(hidden, fit(docs, labels, crc_mod("doc_id", 4) != 2))
    return back(scored.where(F.col("quality_score") >= threshold).drop("quality_score"))
