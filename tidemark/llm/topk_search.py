"""Exact BM25 top-k search: an inverted index per shard with block-max pruning.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lowered; a query
is all words of its text. A document's impact for a word is
round(1000 * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))), a query's weight
round(1000 * qtf * ln(1 + (N - df + 0.5) / (df + 0.5))), and a score the sum of
their products, a whole number, so that shards merge exactly and ties are ties.
N, df and avgdl are those of all documents.

Documents are dealt to shards of bounded size. A shard builds its inverted index,
orders its documents so that like ones are neighbours, and cuts them into blocks
of BLOCK documents. For a batch of queries the lists of rarer words are summed
exactly; those of the COMMON most frequent words give only their greatest impact
in each block. The sum of both bounds a block. Blocks go by falling bound, and a
block whose bound is under a query's k-th score so far is skipped for it; in the
others the common words' impacts are added in single precision, and what reaches
the k-th score but for the rounding is scored again exactly.

Every query meets every shard, in blocks: work grows with queries times
documents, as exact search over a stated query set must. What is written and sent
does not: queries are stored once, packed in batches, and read again where shards
meet them, in slabs of bounded size. A task takes one shard after the other of one
of at most GROUPS groups and hands on each query's best, so that a query comes to
the merge, a window over it, with at most k rows a group.

Edge cases: null and empty texts have no words, find nothing and are not found;
only documents with a score over 0 are results; ties go to the smallest doc_id,
null last, then row; repeated rows are documents and queries of their own; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import stored, with_row
from tidemark.llm.textbytes import NOT_ALNUM, U64, each_chunk, lean, words

K = 10
K1 = 1.2
B = 0.75
SCALE = 1000
#: Bytes of text of one shard, about; and the words whose lists are bounded by blocks.
SHARD_BYTES = 48_000_000
COMMON = 256
BLOCK = 64
BATCH = 128
#: Bytes of text whose words are hashed at once.
TEXT_BYTES = 1 << 19
#: Bytes of packed queries that a task holds, about; and the groups of shards, each of them one task a slab.
SLAB_BYTES = 64_000_000
GROUPS = 64
#: Low bits of a posting that hold its impact, which is at most SCALE * (K1 + 1).
IMPACT_BITS = 12


def _term_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, word): row, word hash, how often; and words of each row."""
    w, at = words(data, off, NOT_ALNUM)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(at))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        w[lo:hi].sort()
    first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (row[1:] != row[:-1]))[: len(w)])
    return row[first], w[first], np.diff(np.append(first, len(w))), np.diff(at)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a part: (term, df); term 0 bears the number of words, too."""
    parts: list[np.ndarray] = []
    size = total = 0

    def send() -> pa.RecordBatch:
        terms = np.concatenate(parts)
        parts.clear()
        terms.sort()
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])[: len(terms)])
        terms, df = terms[first], np.diff(np.append(first, len(terms)))
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df)], ["term", "df"])

    for batch in batches:
        for _, _, data, off in each_chunk(batch, limit=TEXT_BYTES):
            _, term, _, n = _term_counts(data, off)
            parts.append(term)
            size, total = size + len(term), total + int(n.sum())
            if size > 4_000_000:
                yield send()
                size = 0
    if parts:
        yield send()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ids = batch.column("_row").to_numpy(), batch.column("doc_id")
        for lo, _, data, off in each_chunk(batch, limit=TEXT_BYTES):
            row, term, n, _ = _term_counts(data, off)
            yield pa.RecordBatch.from_arrays([pa.array(rows[lo + row]), ids.take(pa.array(lo + row)), pa.array(term.view(np.int64)), pa.array(n)], ["q_row", "query_id", "term", "qtf"])


PACKED = "size long, q_rows binary, ids binary, known binary, lengths binary, terms binary, places binary, weights binary"
PACKED_NAMES = [x.split()[0] for x in PACKED.split(", ")]


class Batch:
    """Queries that are answered together: (q_row, query_id) of each, their distinct terms, rising, and for each query its terms' places among them and weights."""

    def __init__(self, queries: list[tuple[int, int | None]], terms: np.ndarray, at: np.ndarray, places: np.ndarray, weights: np.ndarray):
        """at: where each query's places and weights begin (n + 1)."""
        self.queries, self.terms, self.at, self.places, self.weights = queries, terms, at, places, weights

    @staticmethod
    def of(row: dict) -> Batch:
        """From a row of PACKED."""
        got = {c: np.frombuffer(row[c], kind) for c, kind in (("q_rows", np.int64), ("ids", np.int64), ("known", bool), ("lengths", np.int32), ("terms", U64), ("places", np.int32))}
        ids = [i if known else None for i, known in zip(got["ids"].tolist(), got["known"].tolist(), strict=True)]
        weights = np.frombuffer(row["weights"], np.int32 if len(row["weights"]) == len(row["places"]) else np.int64)
        return Batch(list(zip(got["q_rows"].tolist(), ids, strict=True)), got["terms"], np.append(0, np.cumsum(got["lengths"])), got["places"], weights)


def _packed(batch_size: int):
    """Queries, in rows of at most batch_size: bytes, and the arrays of a Batch; weights in 4 bytes each where they fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def send() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            lists = t["terms"].combine_chunks()
            lengths = np.diff(lists.offsets.to_numpy()).astype(np.int32)
            terms, places = np.unique(lists.flatten().to_numpy().view(U64), return_inverse=True)
            weights = t["weights"].combine_chunks().flatten().to_numpy()
            if weights.max(initial=0) < 1 << 31:
                weights = weights.astype(np.int32)
            cols = [t["q_row"].to_numpy(), t["query_id"].fill_null(0).to_numpy(), t["query_id"].is_valid().to_numpy(), lengths, terms, places.astype(np.int32), weights]
            return pa.RecordBatch.from_arrays([pa.array([sum(c.nbytes for c in cols)], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], PACKED_NAMES)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, batch_size - sum(w.num_rows for w in waiting))
                waiting.append(part)
                batch = batch.slice(part.num_rows)
                if sum(w.num_rows for w in waiting) == batch_size:
                    yield send()
        if waiting:
            yield send()

    return run


class Best:
    """The k best so far of each query of a batch: scores, doc_ids, rows, best first."""

    def __init__(self, queries: list[tuple[int, int | None]], k: int):
        self.queries, self.k = queries, k
        self.found = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        self.least = np.full((len(queries), k), 0.5)  # their scores, rising; scores are whole: results have 1 at least

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        both = [np.concatenate(x) for x in zip(self.found[q], (score, ids, rows), strict=True)]
        order = np.lexsort((both[2], both[1], -both[0]))[: self.k]
        self.found[q] = tuple(x[order] for x in both)
        self.least[q] = 0.5
        self.least[q, self.k - len(order) :] = both[0][order[::-1]]


class Shard:
    """The index of one shard."""

    def __init__(self, rows: list[int], ids: list[int | None], postings: tuple[list[np.ndarray], ...], lengths: list[np.ndarray], common: int, block: int):
        """postings: documents within the shard, words and impacts of one chunk of documents after the other; emptied here."""
        self.block = block
        n_docs = len(rows)
        length = np.concatenate(lengths)
        term = np.concatenate(postings[1])
        postings[1].clear()
        order = np.argsort(term, kind="stable")
        term = term[order]
        doc, impact = (np.concatenate(x)[order] for x in (postings[0], postings[2]))
        for x in postings:
            x.clear()
        del order
        head = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        self.terms, df = term[head], np.diff(np.append(head, len(term)))
        del term
        often = np.sort(np.argsort(-df, kind="stable")[:common])
        self.column = np.full(len(df), -1, np.int64)  # of common terms: their column in the dense part
        self.column[often] = np.arange(len(often))
        # impacts are small whole numbers: single precision stores them exactly; sums are made in double precision
        dense = np.zeros((n_docs, len(often)), np.float32)
        for c, t in enumerate(often):
            span = slice(head[t], head[t] + df[t])
            dense[doc[span], c] = impact[span]
        place = self._arrange(dense, length)
        # documents by their place; the last block is filled up with empty ones
        self.n_blocks = -(-n_docs // block)
        self.n_places = self.n_blocks * block
        self.rows = np.full(self.n_places, -1, np.int64)
        self.rows[place] = rows
        self.ids = np.full(self.n_places, np.iinfo(np.int64).max)
        self.ids[place] = [np.iinfo(np.int64).max if i is None else i for i in ids]
        self.dense = np.zeros((self.n_places, len(often)), np.float32)
        self.dense[place] = dense
        self.dense_max = self.dense.reshape(self.n_blocks, block, -1).max(1).astype(np.float64)
        self.begin, self.df = head, df
        self.posts = place[doc]  # by term: where the document is, and its impact
        self.posts <<= IMPACT_BITS
        self.posts |= impact

    @staticmethod
    def _arrange(dense: np.ndarray, length: np.ndarray, groups: int = 8) -> np.ndarray:
        """A place for each document: by a few rounds of k-means over the common words, then by length."""
        unit = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1)
        centre = unit[np.linspace(0, len(unit) - 1, min(groups, len(unit))).astype(int)]
        for _ in range(4):
            near = (unit @ centre.T).argmax(1)
            for g in range(len(centre)):
                if (near == g).any():
                    centre[g] = unit[near == g].mean(0)
        place = np.empty(len(unit), np.int64)
        place[np.lexsort((length, near))] = np.arange(len(unit))
        return place

    def search(self, batch: Batch, best: Best) -> None:
        """Adds what this shard has to the k best of each query."""
        n = len(batch.queries)
        at = np.searchsorted(self.terms, batch.terms)
        at[at == len(self.terms)] = 0
        found = self.terms[at] == batch.terms
        column, begin = np.where(found, self.column[at], -1)[batch.places], self.begin[at]
        df = np.where(found & (self.column[at] < 0), self.df[at], 0)
        common = np.zeros((n, self.dense.shape[1]))
        some = np.flatnonzero(column >= 0)
        common[np.repeat(np.arange(n), np.diff(batch.at))[some], column[some]] = batch.weights[some]
        rare = np.zeros((n, self.n_places))
        for q in range(n):
            span = slice(batch.at[q], batch.at[q + 1])
            places = batch.places[span]
            many = df[places]
            ends = np.cumsum(many)
            if len(ends) and ends[-1]:
                p = np.repeat(begin[places] - ends + many, many)
                p += np.arange(ends[-1])
                post = self.posts.take(p)
                part = np.repeat(batch.weights[span].astype(np.float64), many)
                part *= post & ((1 << IMPACT_BITS) - 1)
                post >>= IMPACT_BITS
                rare[q] = np.bincount(post, part, self.n_places)
        bound = common @ self.dense_max.T + rare.reshape(n, self.n_blocks, self.block).max(2)
        single = common.astype(np.float32)
        # sums of that many positive products in single precision are right but for this part of them
        above = 1 + (common.shape[1] + 8) * 2.0**-23
        least = best.least.copy()
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        for b in np.argsort(-bound.max(0)).tolist():
            alive = np.flatnonzero(bound[:, b] >= least[:, 0])
            if not len(alive):
                continue
            span = slice(b * self.block, (b + 1) * self.block)
            near = single[alive] @ self.dense[span].T * above + rare[alive, span] >= least[alive, :1]
            some = near.any(1)
            alive, near = alive[some], near[some]
            if not len(alive):
                continue
            score = np.zeros(near.shape)
            i, j = np.nonzero(near)
            score[i, j] = rare[alive[i], j + b * self.block] + np.einsum("ij,ij->i", common[alive[i]], self.dense[j + b * self.block].astype(np.float64))
            both = np.concatenate([least[alive], score], 1)
            both.partition(both.shape[1] - best.k, axis=1)
            least[alive] = np.sort(both[:, -best.k :], 1)
            good = score >= least[alive, :1]
            for i in np.flatnonzero(good.any(1)):
                j = np.flatnonzero(good[i])
                kept[alive[i]].append((j + b * self.block, score[i, j]))
        for q in range(n):
            if kept[q]:
                place, score = (np.concatenate(x) for x in zip(*kept[q], strict=True))
                enough = score >= least[q, 0]
                place, score = place[enough], score[enough]
                best.add(q, score, self.ids[place], self.rows[place])


def _shard_search(average: float, k: int, common: int, block: int):
    names = ["q_row", "query_id", "_row", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, index = None, None
        rows: list[int] = []
        ids: list[int | None] = []
        postings: tuple[list[np.ndarray], ...] = ([], [], [])
        lengths: list[np.ndarray] = []
        best: dict[int, Best] = {}  # by the first query of a batch

        def built() -> Shard | None:
            got = Shard(rows, ids, postings, lengths, common, block) if any(map(len, postings[1])) else None
            for x in (rows, ids, *postings, lengths):
                x.clear()
            return got

        for batch in batches:
            shards, is_end = batch.column("shard").to_numpy(), batch.column("is_end").to_numpy(zero_copy_only=False)
            # runs of rows of one shard and kind
            edges = np.flatnonzero(np.append(True, (np.diff(shards) != 0) | (np.diff(is_end.astype(np.int8)) != 0))[: len(shards)])
            for lo, hi in zip(edges, np.append(edges[1:], len(shards)), strict=True):
                if shards[lo] != number:
                    number, index = shards[lo], None
                    built()
                part = batch.slice(lo, hi - lo)
                if not is_end[lo]:
                    before = len(rows)
                    rows += part.column("_row").to_pylist()
                    ids += part.column("doc_id").to_pylist()
                    for at, _, data, off in each_chunk(part, limit=TEXT_BYTES):
                        doc, term, tf, length = _term_counts(data, off)
                        impact = np.floor(SCALE * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average)) + 0.5)
                        for kept, x in zip(postings, ((doc + (before + at)).astype(np.int32), term, impact.astype(np.int16)), strict=True):
                            kept.append(x)
                        lengths.append(length.astype(np.float32))
                    continue
                if rows:
                    index = built()
                if index is None:
                    continue
                for i in range(hi - lo):
                    queries = Batch.of({c: part.column(c)[i].as_py() for c in PACKED_NAMES[1:]})
                    key = queries.queries[0][0]
                    if key not in best:
                        best[key] = Best(queries.queries, k)
                    index.search(queries, best[key])
        for x in best.values():
            n = [len(f[0]) for f in x.found]
            score, doc, row = (np.concatenate(c) for c in zip(*x.found, strict=True))
            cols = [
                pa.array(np.repeat([q for q, _ in x.queries], n)), pa.array([i for (_, i), m in zip(x.queries, n, strict=True) for _ in range(m)], pa.int64()), pa.array(row),
                pa.array(doc, mask=doc == np.iinfo(np.int64).max), pa.array(score.astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in cols], names)

    return run


def _meet(dealt: DataFrame, packed: DataFrame, n_shards: int, n_slabs: int, n_groups: int) -> DataFrame:
    """Each shard's rows, then every packed row of a slab, in one task for each group of shards and slab. Nothing but the documents is shuffled."""
    ends = dealt.sparkSession.range(n_shards).select(F.col("id").alias("shard"), F.lit(True).alias("is_end"), *(F.lit(None).cast(dealt.schema[c].dataType).alias(c) for c in ("_row", "doc_id", "text")))
    # the number after the sort is for the optimiser, which takes away a sort under a join
    shards = (
        dealt.unionAll(ends).repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "is_end")
        .withColumn("place", F.monotonically_increasing_id()).coalesce(n_groups)
    )
    # a slab begins with an empty row, which the documents meet; the end of a shard meets all others
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    slabs = packed.drop("size").coalesce(n_slabs).withColumn("first", first)
    slabs = slabs.withColumn("opens", F.explode(F.when(F.col("first"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))).drop("first")
    slabs = slabs.select("opens", *(F.when(~F.col("opens"), F.col(c)).alias(c) for c in slabs.columns if c != "opens"))
    return shards.hint("shuffle_replicate_nl").join(slabs.hint("shuffle_replicate_nl"), F.col("is_end") != F.col("opens"))


def search(
    docs: DataFrame, is_query: Column, k: int = K, shard_bytes: int = SHARD_BYTES, common: int = COMMON, block: int = BLOCK, batch: int = BATCH, slab_bytes: int = SLAB_BYTES, groups: int = GROUPS
) -> DataFrame:
    """The k best documents for each row where `is_query` holds: query_id, rank, doc_id, score."""
    rows = with_row(docs.select(F.col("doc_id").cast("long"), "text"))
    n_docs, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_shards = max(1, -(-n_bytes // shard_bytes))
    df = stored(rows.select("text").mapInArrow(lean(_frequencies), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
    n_words = df.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    average = max(n_words, 1) / max(n_docs, 1)
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = rows.where(is_query).select("_row", "doc_id", "text").mapInArrow(_query_terms, "q_row long, query_id long, term long, qtf long")
    weighted = terms.join(df.where("term IS NOT NULL"), "term").select("q_row", "query_id", "term", F.floor(SCALE * F.col("qtf") * idf + 0.5).alias("weight"))
    queries = (
        weighted.groupBy("q_row", "query_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("x"))
        .select("q_row", "query_id", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
    )
    packed = stored(queries.mapInArrow(_packed(batch), PACKED), "queries")
    n_slabs = max(1, -(-packed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // slab_bytes))
    dealt = rows.select(F.pmod(F.xxhash64("_row"), F.lit(n_shards)).alias("shard"), F.lit(False).alias("is_end"), "_row", "doc_id", "text")
    met = _meet(dealt, packed, n_shards, n_slabs, min(n_shards, groups))
    found = met.mapInArrow(lean(_shard_search(average, k, common, block)), "q_row long, query_id long, _row long, doc_id long, score long")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame) -> DataFrame:
    """Documents whose id is divisible by 50 as queries, against all documents."""
    return search(docs, F.col("doc_id") % 50 == 0)


SQL = """
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS n FROM w GROUP BY ALL),
dl AS (SELECT doc_id, sum(n) AS len FROM tf GROUP BY ALL),
c AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM w) AS words),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT doc_id AS query_id, t, CAST(floor(1000 * n * ln(1 + (docs - df + 0.5) / (df + 0.5)) + 0.5) AS BIGINT) AS weight
      FROM tf JOIN df USING (t), c WHERE doc_id % 50 = 0),
d AS (SELECT doc_id, t, CAST(floor(1000 * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / (words * 1.0 / docs))) + 0.5) AS BIGINT) AS impact
      FROM tf JOIN dl USING (doc_id), c),
s AS (SELECT query_id, doc_id, CAST(sum(weight * impact) AS BIGINT) AS score FROM q JOIN d USING (t) GROUP BY ALL HAVING score > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""
