"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte 2-, 3- and 4-grams
(letters lowered, anything else one space); a softmax layer above gives the
languages. Embeddings and layer are trained together by stochastic gradient
descent in numpy on the whole texts of a sample of at most `max_docs` documents of
each language, and on short random cuts of them so that short texts are known
too. A temperature and a rejection bound are calibrated on a tenth of the sample
that training does not see.

Since the layer is linear, scoring looks up each gram's embedding times the
layer: the same numbers with less work.

Edge cases: null, empty and letterless texts are `und` with score 0; with no
labelled document every text is `und`; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import crc_mod, smallest_hashes
from tidemark.llm.textbytes import each_chunk, utf8

BUCKETS = 1 << 14
DIM = 16
#: Training documents of one language.
MAX_DOCS = 1500
ORDERS = (2, 3, 4)
#: The share of right answers among calibration texts that the bound may reject.
REJECT_SHARE = 0.01

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the gram that starts at each byte (len - order + 1)."""
    n = len(data) - order + 1
    code = np.full(max(n, 0), order, np.uint32)
    for k in range(order):
        code = code * np.uint32(257) + data[k : k + max(n, 0)]
    code *= np.uint32(2654435761)
    return (code >> np.uint32(18)).astype(np.int32)


def _counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = _FOLD[np.frombuffer(text, np.uint8)]
    every = np.concatenate([gram_buckets(data, k) for k in ORDERS]) if len(data) else np.zeros(0, np.int32)
    b, c = np.unique(every, return_counts=True)
    return b, (c / max(c.sum(), 1)).astype(np.float32)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for k, (b, v) in enumerate(rows):
        x[k, b] = v
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(texts: list[bytes], langs: list[str], epochs: int = 6, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    cuts, owner = [], []
    for k, t in enumerate(texts):
        cuts.append(t)
        owner.append(k)
        w = t.split()
        for size in (1, 3, 8):
            if len(w) > size:
                i = int(rng.integers(0, len(w) - size))
                cuts.append(b" ".join(w[i : i + size]))
                owner.append(k)
    owner = np.array(owner)
    rows = [_counts(b" " + c + b" ") for c in cuts]
    held = (np.arange(len(texts)) % 10 == 9)[owner]
    label = y[owner]
    fit_on = np.flatnonzero(~held) if len(texts) >= 20 else np.arange(len(rows))
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        rate = np.float32(8.0 * (1 - epoch / epochs))
        rng.shuffle(fit_on)
        for lo in range(0, len(fit_on), 64):
            k = fit_on[lo : lo + 64]
            used = np.unique(np.concatenate([rows[i][0] for i in k]))
            x = np.zeros((len(k), len(used)), np.float32)
            for r, i in enumerate(k):
                x[r, np.searchsorted(used, rows[i][0])] = rows[i][1]
            h = x @ emb[used]
            g = _softmax(h @ out + bias)
            g[np.arange(len(k)), label[k]] -= 1
            g /= len(k)
            g_h = g @ out.T
            out -= rate * 0.25 * (h.T @ g)
            bias -= rate * 0.02 * g.sum(0)
            emb[used] -= rate * len(k) * (x.T @ g_h)
    model = {"names": names, "table": emb @ out, "bias": bias, "heat": 1.0, "bound": 0.0}
    check = np.flatnonzero(held)
    if len(check):
        logits = np.stack([(model["table"][rows[i][0]] * rows[i][1][:, None]).sum(0) + bias for i in check])
        heats = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(check)), label[check]] + 1e-9).mean() for t in heats]
        model["heat"] = heats[int(np.argmin(loss))]
        p = _softmax(logits / model["heat"])
        right = p.argmax(1) == label[check]
        if right.any():
            model["bound"] = float(np.quantile(p.max(1)[right], REJECT_SHARE))
    return model


def fit(docs: DataFrame, train_on: Column, max_docs: int = MAX_DOCS) -> dict | None:
    """Train on those with letters of the max_docs documents of each lang that have the smallest doc_id hashes."""
    texts = docs.where(F.col("lang").isNotNull() & train_on).select("doc_id", "lang", "text")
    chosen = smallest_hashes(texts, "doc_id", max_docs, "lang").where(F.col("text").rlike(r"\p{L}")).toPandas()
    chosen = chosen.sort_values(["doc_id", "text"], ignore_index=True)
    if not len(chosen):
        return None
    return train([t.encode() for t in chosen["text"]], chosen["lang"].tolist())


def _logits(data: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    """Mean logits of the texts; grams do not cross texts, each of which has a space around it."""
    n_docs, n_langs = len(off) - 1, len(model["names"])
    padded = np.full(len(data) + 2 * n_docs, 32, np.uint8)
    shift = np.repeat(np.arange(n_docs) * 2 + 1, np.diff(off))
    padded[np.arange(len(data)) + shift] = _FOLD[data]
    at = off + 2 * np.arange(n_docs + 1)
    total, count = np.zeros((n_docs, n_langs)), np.zeros(n_docs)
    for order in ORDERS:
        b = gram_buckets(padded, order)
        size = np.maximum(np.diff(at) - order + 1, 0)
        n = np.minimum(at[:-1] + size, len(b))
        each = model["table"][b].astype(np.float32)
        # sums over [at[i], n[i]): reduceat over alternating starts and ends
        edges = np.minimum(np.stack([at[:-1], n], 1).ravel(), len(b) - 1) if len(b) else None
        if edges is None:
            continue
        got = np.add.reduceat(each, edges, axis=0)[::2]
        total += np.where((size > 0)[:, None], got, 0)
        count += size
    return total / np.maximum(count, 1)[:, None] + model["bias"]


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected (the score is under the calibrated bound)."""
    texts = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred = np.full(batch.num_rows, -1)
            score = np.zeros(batch.num_rows)
            if model:
                for lo, hi, data, off in each_chunk(batch):
                    p = _softmax(_logits(data, off, model) / model["heat"])
                    pred[lo:hi], score[lo:hi] = p.argmax(1), p.max(1)
                none = ~batch.column("letters").to_numpy(zero_copy_only=False)
                pred[none], score[none] = -1, 0
            names = np.array([*(model["names"] if model else []), "und"], object)
            low = (pred < 0) | (score < (model["bound"] if model else 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[pred], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(low)], ["doc_id", "lang_pred", "score", "rejected"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Predictions for all documents; those with crc32 % 4 = 2 are held out of training."""
    model = fit(docs, crc_mod("doc_id", 4) != 2)
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
