"""Benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters, digits and non-ASCII bytes; A-Z and the Latin-1
capitals are lowered. Fixed masks pick some of several consecutive words and ignore the others; hashes of
the picked words of benchmark items and of documents are joined. Each hit fixes
an alignment of item and document; there all words of the item are compared with
the words opposite, so substituted words cost no more than themselves. An item
is found where at least `overlap` of its words agree on one alignment, or where
that share of any STRETCH consecutive words of it (all, if it has fewer) follow
each other in the document, none more than SHIFT words from the place that the
alignment gives it. So a long quotation counts however long the item is, and
inserted or left out words do not split it. n_matched counts the words that
agree on the alignment itself, that with the most; word_start is where the
item's first word would be, and is negative where a quotation lacks its start.

Items, their seeds and the documents' hits are tables throughout, and the joins
are left to Spark. A map of SEED_BITS bits, the only thing that goes through the
driver, tells most places of a document that no seed of the benchmark is theirs;
it has a fixed size, and the more seeds there are the more places go to the join.

Edge cases: null or empty texts on either side match nothing; items without
item_id are left out; items shorter than MIN_WORDS are found whole and exact
only; repeated items or documents each give their own rows, documents without
doc_id a row with null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import set_aside, stored, with_row
from tidemark.llm.textbytes import NOT_ALNUM, U64, each_chunk, lean, mix64, words

#: 1: the word counts, 0: it is ignored.
MASKS = ("1111", "11011", "110101", "101011", "1100011")
OVERLAP = 0.8
#: Words of an item that are enough to find it, and how far inserted and left out words may move them.
STRETCH = 13
SHIFT = 3
#: Items with fewer words are compared whole.
MIN_WORDS = 8
SEED_BITS = 1 << 24
#: A document's items are verified in as many parts, each with its text.
ITEM_PARTS = 64

_SCHEMA = "doc_id long, item_id long, n_item_words long, n_matched long, word_start long"


def _masked(tokens: np.ndarray, mask: str, whole: bool = False) -> np.ndarray:
    """The seed hash at each place where the whole mask fits; whole items have hashes of their own."""
    n = len(tokens) - len(mask) + 1
    out = np.full(max(n, 0), int(mask, 2) * 7919 + len(mask) + (whole << 40), U64)
    for k, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out = (out ^ tokens[k : k + n]) * U64(0x9E3779B97F4A7C15)
            out ^= out >> U64(29)
    return mix64(out)


def _fold(data: np.ndarray) -> np.ndarray:
    """Latin-1 capitals (two bytes, the first 0xC3) in lower case; word hashing lowers A-Z itself."""
    out = data.copy()
    tail = out[1:]
    tail[(data[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 32
    return out


def _words(column: str):
    """Word hashes of each text of the batch, null where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in each_chunk(batch, column):
                tokens, at = words(_fold(data), off, NOT_ALNUM)
                part = batch.slice(lo, hi - lo)
                cols = [pa.array(np.diff(at)), pa.array([tokens[at[k] : at[k + 1]].tobytes() for k in range(hi - lo)], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("item_id"), *cols], ["item_id", "n", "words"])

    return run


def _item_seeds(masks: tuple[str, ...], min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), strict=True):
                t = np.frombuffer(raw, U64)
                h = [_masked(t, m) for m in masks] if len(t) >= min_words else [_masked(t, "1" * len(t), True)]
                place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in h])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.full(len(place), item)), pa.array(place)], ["seed", "item", "place"])

    return run


def seed_bits(seeds: DataFrame) -> np.ndarray:
    """One bit for each seed's last bits, from at most SEED_BITS / 64 rows."""
    slot = F.expr(f"pmod(seed, {SEED_BITS}L)")
    packed = seeds.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(slot % 64)))").alias("bits")).toPandas()
    out = np.zeros(SEED_BITS // 64, np.int64)
    out[packed["at"].to_numpy(np.int64)] = packed["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _document_hits(masks: list[tuple[str, bool]], packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            for lo, hi, data, off in each_chunk(batch):
                tokens, at = words(_fold(data), off, NOT_ALNUM)
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                for mask, whole in masks:
                    h = _masked(tokens, mask, whole)
                    k = np.flatnonzero(maybe[(h & U64(SEED_BITS - 1)).astype(np.int64)])
                    k = k[doc[k] == doc[k + len(mask) - 1]]
                    cols = [pa.array(h[k].view(np.int64)), pa.array(rows[lo + doc[k]]), pa.array((k - at[doc[k]]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["seed", "_row", "at"])

    return run


class _Items:
    """Items one after the other, and what of them a document has."""

    def __init__(self, words_of: list[bytes]):
        self.tokens = np.frombuffer(b"".join(words_of), U64)
        self.length = np.array([len(w) // 8 for w in words_of], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])

    def verify(self, tokens: np.ndarray, at: np.ndarray, item: np.ndarray, align: np.ndarray, row: np.ndarray, overlap: float, min_words: int, stretch: int, shift: int):
        """Words that agree on each alignment within its document, and which alignments are enough."""
        out_n = np.zeros(len(item), np.int64)
        enough = np.zeros(len(item), bool)
        room = np.cumsum(self.length[item]) >> 20
        for some in np.split(np.arange(len(item)), np.flatnonzero(np.diff(room)) + 1):
            it, al = item[some], align[some]
            length = self.length[it]
            ends = np.cumsum(length)
            inner = np.arange(ends[-1]) - np.repeat(ends - length, length)
            pos = np.repeat(al, length) + inner
            own = self.tokens[np.repeat(self.begin[it], length) + inner]
            lo, hi = np.repeat(at[row[some]], length), np.repeat(at[row[some] + 1], length)
            same = [(p >= lo) & (p < hi) & (tokens[np.clip(p, 0, len(tokens) - 1)] == own) for p in (pos + d for d in range(-shift, shift + 1))]
            n = np.add.reduceat(same[shift], ends - length)
            good = np.where(length < min_words, n == length, n >= overlap * length - 1e-9) & (n > 0)
            # stretches whose words are all near enough, in whatever order
            size = np.repeat(np.minimum(length, stretch), length)
            near = np.concatenate([[0], np.cumsum(np.logical_or.reduce(same))])
            first = np.flatnonzero(np.repeat(~good & (length >= min_words), length) & (inner + size <= np.repeat(length, length)))
            least = np.ceil(overlap * size[first] - 1e-9)
            first, least = (x[near[first + size[first]] - near[first] >= least] for x in (first, least))
            found = first[_in_order(same, first, size[first]) >= least]
            good[np.searchsorted(ends, found, "right")] = True
            out_n[some], enough[some] = n, good
        return out_n, enough


def _in_order(same: list[np.ndarray], first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The longest common subsequence of each stretch with the document, no word further off than the band `same`.

    same[d][i]: item word i is the document's word d - shift places from the one opposite.
    """
    best = [np.zeros(len(first), np.int64) for _ in same]
    for k in range(int(size.max(initial=0))):
        at = np.minimum(first + k, len(same[0]) - 1)
        now: list[np.ndarray] = []
        for d, agree in enumerate(same):
            got = np.maximum(best[d] + (agree[at] & (k < size)), best[min(d + 1, len(same) - 1)])
            now.append(np.maximum(got, now[-1]) if now else got)
        best = now
    return best[-1]


def _verifier(overlap: float, min_words: int, stretch: int, shift: int):
    """Rows of one document and some of its items: the items that are found, each at its best alignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            item_at = items.offsets.to_numpy() - items.offsets[0].as_py()
            flat = items.flatten()
            for lo, hi, data, off in each_chunk(batch):
                tokens, at = words(_fold(data), off, NOT_ALNUM)
                part = flat.slice(item_at[lo], item_at[hi] - item_at[lo])
                aligns = part.field("aligns")
                n_aligns = np.diff(aligns.offsets.to_numpy())
                item = np.repeat(np.arange(len(part)), n_aligns)
                row = np.repeat(np.arange(hi - lo), np.diff(item_at[lo : hi + 1]))[item]
                align = aligns.flatten().to_numpy() + at[row]
                index = _Items(part.field("words").to_pylist())
                n, good = index.verify(tokens, at, item, align, row, overlap, min_words, stretch, shift)
                item, n, row, align = item[good], n[good], row[good], align[good]
                # the best alignment of each (document, item); of equal ones the first
                order = np.lexsort((align, -n, item))
                order = order[np.append(True, np.diff(item[order]) != 0)[: len(order)]]
                item, n, row, align = item[order], n[order], row[order], align[order]
                own = batch.slice(lo, hi - lo)
                cols = [own.column(c).take(pa.array(row)) for c in ("_row", "doc_id")]
                cols += [part.field("item_id").take(pa.array(item)), pa.array(index.length[item]), pa.array(n), pa.array(align - at[row])]
                yield pa.RecordBatch.from_arrays(cols, ["_row", "doc_id", "item_id", "n_item_words", "n_matched", "word_start"])

    return run


def _find(rows: DataFrame, benchmark: DataFrame, masks: tuple[str, ...], overlap: float, min_words: int, stretch: int, shift: int) -> DataFrame:
    """rows (_row, doc_id, text) -> _row and the columns of find_leaks."""
    spark = rows.sparkSession
    named = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    items = stored(named.mapInArrow(_words("text"), "item_id long, n long, words binary").where("n > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    short = sorted(r.n for r in items.where(F.col("n") < min_words).select("n").distinct().collect())
    seeds = stored(items.select("item", "words").mapInArrow(_item_seeds(masks, min_words), "seed long, item long, place int"), "seeds")
    if seeds.isEmpty():
        return spark.createDataFrame([], f"_row long, {_SCHEMA}")
    packed = np.packbits(seed_bits(seeds), bitorder="little").tobytes()
    fits = [(m, False) for m in masks] + [("1" * n, True) for n in short]
    hits = rows.select("_row", "text").mapInArrow(lean(_document_hits(fits, packed)), "seed long, _row long, at int")
    met = hits.join(seeds, "seed").groupBy("_row", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("aligns"))
    listed = met.join(items, "item").groupBy("_row", F.pmod("item", F.lit(ITEM_PARTS)).alias("part")).agg(F.collect_list(F.struct("item_id", "words", "aligns")).alias("items"))
    found = rows.select("_row", "doc_id", "text").join(listed, "_row").select("_row", "doc_id", "text", "items")
    return found.mapInArrow(lean(_verifier(overlap, min_words, stretch, shift)), f"_row long, {_SCHEMA}")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, overlap: float = OVERLAP, min_words: int = MIN_WORDS, stretch: int = STRETCH, shift: int = SHIFT
) -> DataFrame:
    """One row per document and benchmark item found in it, at the best alignment."""
    rows = with_row(docs.select(F.col("doc_id").cast("long"), "text"))
    return _find(rows, benchmark, masks, overlap, min_words, stretch, shift).drop("_row")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, overlap: float = OVERLAP, min_words: int = MIN_WORDS, stretch: int = STRETCH, shift: int = SHIFT) -> DataFrame:
    """docs without those rows in which a benchmark item is found (all columns kept)."""
    hidden, back = set_aside(docs, "_row", "_leak")
    rows = with_row(hidden)
    bad = _find(rows.select("_row", F.col("doc_id").cast("long"), "text"), benchmark, masks, overlap, min_words, stretch, shift)
    return back(rows.join(bad.select(F.col("_row").alias("_leak")).distinct(), F.col("_row") == F.col("_leak"), "left_anti").drop("_row"))
