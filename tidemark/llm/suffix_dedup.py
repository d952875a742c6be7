"""Exact substring dedup: sampled suffixes in buckets that bucket pointers refine.

A byte goes if a string of `length` bytes that covers it starts anywhere else too.

1. Each window of `length` bytes names one of its q-grams, the leftmost of least
   hash. Equal windows name equal q-grams, so windows that share a string share a
   bucket, and consecutive windows with the same q-gram form one span. Within a
   document, windows that come again are settled at once and only the first of
   each goes on.
2. Spans whose q-gram occurs once in the corpus are done. Of the others the text
   is cut out; equal spans meet as one.
3. Each q-gram's bucket of spans is refined: suffixes are sorted by the hash of
   their first 50 bytes, then buckets with more than one suffix are sorted by the
   bucket pointers of the suffixes 50, 100 and 200 bytes later, which earlier
   rounds have refined already, until suffixes agree on `length` bytes. Windows
   that still share a bucket are repeats.
4. Spans of a q-gram with many occurrences are cut into pieces of STEP windows
   each, and a piece's bucket is named by all the bytes that its windows have in
   common, so that a passage in many documents leaves only its two edges open.
   Buckets that still hold many distinct pieces are split by piece; windows left
   in one split then meet by a 128-bit hash of their bytes.

No step holds more than a chunk of texts or a split of a bucket in one task, and
no pairs are made.

Texts that are equal as a whole are settled before the first step: all their windows
are repeated, and one text of each group stands for it in the search.

`dedup` can look for passages: with `min_words`, repeated strings of fewer bytes
are sought, and of the runs that they cover those stay that have fewer words than
that and fewer bytes than LENGTH. `find_with_passages` tells of both: strings of
`passage` bytes that come again are sought in all texts, those of `length` bytes
in the stretches where such strings follow one another for long enough, which are
cut out, for no other text can hold them.

Edge cases: null and empty texts have no bytes and lose none; texts shorter than
`length` lose none; rows that repeat remove each other wholly if long enough;
rows with a null or repeated doc_id are documents of their own; other columns
are ignored by `find` and kept by `dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import set_aside, stored, with_row
from tidemark.llm.textbytes import U64, Rolling, each_chunk, lean, mix64

LENGTH = 400
#: A passage: this many bytes that come again, and this many words.
PASSAGE, PASSAGE_WORDS = 200, 50
Q = 32
#: Spans of one split of a bucket, about.
SPLIT_SPANS = 1024
#: Windows of one piece of a span in a large bucket.
STEP = 16
#: Bytes of one batch of cut text, and spans that a task remembers to send their text once.
OUT_BYTES = 1 << 22
MAX_SEEN = 300_000
#: Bytes that are sorted together.
SORT_BYTES = 1 << 20
#: The first buckets are those of the grams of FIRST bytes, of a quarter of the length if that is less; each round doubles the bytes.
FIRST = 50

_MAX = U64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i:i + width], by doubling."""
    n, have, out = len(x) - width + 1, 1, x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return op(out[:n], out[rest : rest + n]) if rest else out[:n]


def _doc_spans(data: np.ndarray, off: np.ndarray, length: int, q: int):
    """Spans (document, q-gram, its place, first window, windows) and settled windows (document, first, windows)."""
    empty = np.zeros(0, np.int64)
    none = (empty, empty.astype(U64), empty, empty, empty), (empty, empty, empty)
    if len(data) < length:
        return none
    rolling = Rolling(data)
    gram = rolling.fixed(q)
    doc_of = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    same_doc = doc_of[: len(data) - q + 1] == doc_of[q - 1 :]
    gram[~same_doc] = _MAX
    width = length - q + 1
    least = _sliding(gram, width, np.minimum)
    valid = doc_of[: len(data) - length + 1] == doc_of[length - 1 :]
    if not valid.any():
        return none
    # a gram is an anchor if it is the least of some valid window around it
    seen = np.zeros(len(least) + 2 * (width - 1), U64)
    seen[width - 1 : width - 1 + len(least)] = np.where(valid, least, U64(0))
    anchors = np.flatnonzero((gram == _sliding(seen, width, np.maximum)[: len(gram)]) & (gram != _MAX))
    before = np.zeros(len(least), bool)
    inside = anchors[anchors < len(least) - 1]
    before[inside + 1] = True
    at = np.flatnonzero(valid)
    owner = np.cumsum(before)[at]
    wrong = np.flatnonzero(gram[anchors[owner]] != least[at])
    while len(wrong):
        owner[wrong] += 1
        wrong = wrong[gram[anchors[owner[wrong]]] != least[at[wrong]]]

    # documents that name a gram twice may repeat windows: settle those here
    anchor_doc, anchor_gram = doc_of[anchors], gram[anchors]
    order = np.lexsort((anchor_gram, anchor_doc))
    twice = (anchor_gram[order][1:] == anchor_gram[order][:-1]) & (anchor_doc[order][1:] == anchor_doc[order][:-1])
    settled = none[1]
    if twice.any():
        again = np.zeros(len(off) - 1, bool)
        again[anchor_doc[order[1:]][twice]] = True
        part = np.flatnonzero(again[doc_of[at]])
        s = at[part]
        key = rolling.of(s, s + length)
        by = np.lexsort((s, key, doc_of[s]))
        first = np.ones(len(by), bool)
        first[1:] = (key[by][1:] != key[by][:-1]) | (doc_of[s[by]][1:] != doc_of[s[by]][:-1])
        alone = first.copy()
        alone[:-1] &= first[1:]
        repeated = np.sort(s[by[~alone]])
        if len(repeated):
            cut = np.flatnonzero(np.diff(repeated, prepend=-2) != 1)
            settled = (doc_of[repeated[cut]].astype(np.int64), repeated[cut], np.diff(np.append(cut, len(repeated))))
            keep = np.ones(len(at), bool)
            keep[part[by[~first]]] = False
            at, owner = at[keep], owner[keep]
    head = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
    n = np.diff(np.append(head, len(at)))
    doc = doc_of[at[head]].astype(np.int64)
    anchor = anchors[owner[head]]
    spans = (doc, gram[anchor], anchor - off[doc], at[head] - off[doc], n)
    return spans, (settled[0], settled[1] - off[settled[0]] if len(settled[0]) else settled[1], settled[2])


def _spans(length: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            for lo, _, data, off in each_chunk(batch, limit=1 << 20):
                (doc, gram, anchor, start, n), (s_doc, s_start, s_n) = _doc_spans(data, off, length, q)
                keys = pa.array(np.concatenate([gram.view(np.int64), np.zeros(len(s_doc), np.int64)]), mask=np.arange(len(doc) + len(s_doc)) >= len(doc))
                numbers = (np.concatenate(x) for x in ((anchor, s_start), (start, s_start), (n, s_n)))
                cols = [pa.array(rows[lo + np.concatenate([doc, s_doc])]), keys, *(pa.array(x.astype(np.int32)) for x in numbers)]
                yield pa.RecordBatch.from_arrays(cols, ["_row", "gram", "anchor", "start", "n"])

    return run


def _pieces(gram, anchor, start, n, off, doc, rolling: Rolling, length: int, step: int):
    """Spans cut into pieces: windows whose distance to the gram falls into the same STEP. Which span, bucket, first window, windows."""
    nearest, farthest = (anchor - start - n + 1) // step, (anchor - start) // step
    many = farthest - nearest + 1
    of = np.repeat(np.arange(len(gram)), many)
    band = np.repeat(nearest, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    # the bytes common to all windows of the band, whether or not the span has all of them
    core = anchor[of] - band * step
    until = anchor[of] - (band + 1) * step + 1 + length
    core_hash = rolling.of(off[doc[of]] + core, off[doc[of]] + until)
    first = np.maximum(start[of], anchor[of] - (band + 1) * step + 1)
    last = np.minimum(start[of] + n[of] - 1, core)
    key = mix64(gram.view(U64)[of] ^ core_hash ^ (band.astype(U64) * U64(0x9E3779B97F4A7C15)))
    return of, key.view(np.int64), first, last - first + 1


def _runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes."""
    run = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.append(True, run[1:] != run[:-1])[: len(run)])
    return zip(edges, np.append(edges[1:], len(run)), strict=True)


def _cut(length: int, split_spans: int, step: int):
    """Cut the spans' text out. Of equal spans in a task the first bears the text, the second a mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            spans = batch.column("spans")
            span_at = spans.offsets.to_numpy() - spans.offsets[0].as_py()
            flat = spans.flatten()
            fields = [flat.field(k).to_numpy().astype(np.int64) for k in ("gram", "anchor", "start", "n", "many")]
            for lo, hi, data, off in each_chunk(batch, limit=1 << 20):
                gram, anchor, start, n, many = (x[span_at[lo] : span_at[hi]] for x in fields)
                doc = np.repeat(np.arange(hi - lo), np.diff(span_at[lo : hi + 1]))
                rolling = Rolling(data)
                large = many > split_spans
                of, key, first, count = _pieces(gram[large], anchor[large], start[large], n[large], off, doc[large], rolling, length, step)
                doc = np.concatenate([doc[~large], doc[large][of]])
                gram, start, n = np.concatenate([gram[~large], key]), np.concatenate([start[~large], first]), np.concatenate([n[~large], count])
                large = np.arange(len(doc)) >= len(doc) - len(of)
                s = off[doc] + start
                e = s + n - 1 + length
                k1 = rolling.of(s, e).view(np.int64)
                k2 = Rolling(data, salt=11).of(s, e).view(np.int64)
                names = ["_row", "gram", "large", "k1", "k2", "start", "n", "mark", "bytes"]
                cols = (rows[lo + doc], gram, large, k1, k2, start, n)
                # out in batches of bounded bytes: many spans can overlap
                for a, b in _runs(e - s, OUT_BYTES):
                    marks, texts = np.zeros(b - a, np.int32), []
                    for i, at in enumerate((k1[a:b] ^ gram[a:b]).tolist(), a):
                        times = seen.get(at, 0)
                        marks[i - a] = times
                        texts.append(data[s[i] : e[i]].tobytes() if times == 0 else None)
                        if times < 2:
                            seen[at] = times + 1
                    if len(seen) > MAX_SEEN:
                        seen.clear()
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[a:b]) for x in cols), pa.array(marks), pa.array(texts, pa.binary())], names)

    return run


def refine_buckets(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `length` bytes within the spans [begin, end) of data, and a bucket each.

    Windows are in the same bucket exactly when their bytes are equal.
    """
    left = np.repeat(end, end - begin) - np.arange(len(data))  # bytes from each place to its span's end
    depth = min(-(-length // 4), FIRST)
    key = np.zeros(len(data), U64)
    grams = Rolling(data).fixed(depth)
    key[: len(grams)] = grams
    at = np.flatnonzero(left >= depth)
    pointer = np.full(len(data), -1, np.int64)
    order = np.argsort(key[at])
    at, ranked = at[order], key[at[order]]

    def point(at: np.ndarray, head: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Give each suffix its bucket's pointer; suffixes of larger buckets go on."""
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(at)))
        pointer[at] = np.repeat(base[first], size)
        return at[np.repeat(size, size) > 1]

    head = np.ones(len(at), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    at = point(at, head, np.arange(len(at)))
    while depth < length:
        step = min(depth, length - depth)
        at = at[left[at] >= depth + step]
        own, later = pointer[at], pointer[at + step]
        order = np.argsort(own * (len(data) + 1) + later)
        at, own, later = at[order], own[order], later[order]
        if not len(at):
            break
        new = np.ones(len(at), bool)
        new[1:] = own[1:] != own[:-1]
        start = np.flatnonzero(new)
        inner = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        new[1:] |= later[1:] != later[:-1]
        at = point(at, new, own + inner)
        depth += step
    window = np.flatnonzero(left >= length)
    return window, pointer[window]


def _settle(length: int):
    """Refine whole buckets, as many together as SORT_BYTES takes."""
    names = ["kind", "k1", "k2", "lo", "n", "w1", "w2"]
    kinds = (pa.int32(), *[pa.int64()] * 6)

    def out(cols: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def solve(spans: list[tuple[int, int, int, bytes, bool]]) -> Iterator[pa.RecordBatch]:
        """spans: k1, k2, times seen, bytes, of a split bucket."""
        data = np.frombuffer(b"".join(s[3] for s in spans), np.uint8)
        sizes = np.array([len(s[3]) for s in spans], np.int64)
        end = np.cumsum(sizes)
        begin = end - sizes
        k1, k2 = (np.array([s[i] for s in spans], np.int64) for i in (0, 1))
        several = np.array([s[2] > 1 for s in spans])
        split = np.array([s[4] for s in spans])
        window, bucket = refine_buckets(data, begin, end, length)
        span = np.searchsorted(end, window, "right")
        count = np.bincount(bucket, minlength=1)
        dup = (count[bucket] > 1) | several[span]
        w, sp = window[dup], span[dup]
        head = np.flatnonzero((np.diff(w, prepend=-2) != 1) | (np.diff(sp, prepend=-1) != 0))
        n = np.diff(np.append(head, len(w)))
        sp, lo = sp[head], w[head] - begin[sp[head]]
        zero = np.zeros(len(head), np.int64)
        if len(head):
            yield out([zero, k1[sp], k2[sp], lo, n, zero, zero])
        if split.any():
            _, first = np.unique(bucket, return_index=True)
            first = first[split[span[first]]]
            w, sp = window[first], span[first]
            one = np.ones(len(w), np.int64)
            a, b = (Rolling(data, salt=s).of(w, w + length).view(np.int64) for s in (3, 5))
            yield out([one, k1[sp], k2[sp], w - begin[sp], one, a, b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[int, int, int, bytes, bool]] = []
        room = 0
        bucket, now = None, {}

        def close() -> None:
            nonlocal room
            if len(now) > 1 or any(v[0] > 1 or v[2] for v in now.values()):
                for (k1, k2), (times, text, split) in now.items():
                    ready.append((k1, k2, times, text, split))
                    room += len(text)
            now.clear()

        for batch in batches:
            for gram, split, k1, k2, mark, text in zip(*(batch.column(c).to_pylist() for c in ("gram", "split", "k1", "k2", "mark", "bytes")), strict=True):
                if (gram, split) != bucket:
                    close()
                    bucket = (gram, split)
                    if room >= SORT_BYTES:
                        yield from solve(ready)
                        ready, room = [], 0
                have = now.get((k1, k2))
                if have is None:
                    now[k1, k2] = [1, text, split >= 0]
                else:
                    have[0] += 1
                    have[1] = have[1] or text
        close()
        if ready:
            yield from solve(ready)

    return run


def whole_copies(texts: DataFrame, length: int) -> DataFrame:
    """(_row, first, n): texts of at least `length` bytes that are equal to another, the smallest _row of each group, and their bytes.

    A group is known by its texts' length and 128-bit hash; its rows are summed before they are dealt.
    """
    raw = F.col("text").cast("binary")
    digests = texts.where(F.octet_length("text") >= length).select("_row", F.octet_length("text").cast("long").alias("n"), F.md5(raw).alias("k"))
    groups = digests.groupBy("k", "n").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    return digests.join(groups, ["k", "n"]).select("_row", "first", "n")


def repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, split_spans: int = SPLIT_SPANS, step: int = STEP) -> DataFrame:
    """docs (_row, text) -> (_row, windows): the repeated windows as (first, number), where there are any.

    All windows of a text that is equal to another are repeated: such rows are settled first, and one of each group goes on, for others to meet.
    """
    copies = stored(whole_copies(docs.select("_row", "text"), length), "copies")
    texts = docs.select("_row", "text").join(copies.where("_row != first").select("_row"), "_row", "left_anti")
    spans = stored(texts.mapInArrow(lean(_spans(length, q)), "_row long, gram long, anchor int, start int, n int"), "spans")
    named = spans.where(F.col("gram").isNotNull())
    shared = named.groupBy("gram").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    by_doc = named.join(shared, "gram").groupBy("_row").agg(F.collect_list(F.struct("gram", "anchor", "start", "n", "many")).alias("spans"))
    cut = stored(
        texts.join(by_doc, "_row").mapInArrow(
            lean(_cut(length, split_spans, step)), "_row long, gram long, large boolean, k1 long, k2 long, start long, n long, mark int, bytes binary"
        ),
        "cut",
    )
    payload = cut.where("mark < 2")
    whole = payload.where("NOT large").withColumn("split", F.lit(-1).cast("long"))
    # of the pieces only those that others share a bucket with, and how many do
    sizes = payload.where("large").groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    split = F.when(F.col("size") > split_spans, F.pmod("k1", F.ceil(F.col("size") / split_spans))).otherwise(-1)
    parts = payload.where("large").join(sizes, "gram").withColumn("split", split.cast("long"))
    names = ["gram", "split", "k1", "k2", "mark", "bytes"]
    met = whole.select(names).unionAll(parts.select(names))
    met = met.repartition("gram", "split").sortWithinPartitions("gram", "split")
    solved = stored(met.mapInArrow(lean(_settle(length)), "kind int, k1 long, k2 long, lo long, n long, w1 long, w2 long"), "solved")
    across = (
        solved.where("kind = 1").groupBy("w1", "w2").agg(F.collect_list(F.struct("k1", "k2", "lo", "n")).alias("at"))
        .where(F.size("at") > 1).select(F.explode("at").alias("x")).select("x.*")
    )
    by_span = solved.where("kind = 0").select("k1", "k2", "lo", "n").unionAll(across).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "n")).alias("in_span"))
    found = (
        cut.select("_row", "k1", "k2", "start").join(by_span, ["k1", "k2"])
        .select("_row", F.transform("in_span", lambda x: F.struct((x["lo"] + F.col("start")).alias("lo"), x["n"].alias("n"))).alias("w"))
    )
    within = spans.where(F.col("gram").isNull()).select("_row", F.array(F.struct(F.col("start").cast("long").alias("lo"), F.col("n").cast("long").alias("n"))).alias("w"))
    every = copies.select("_row", F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.col("n") - length + 1).alias("n"))).alias("w"))
    return found.unionAll(within).unionAll(every).groupBy("_row").agg(F.flatten(F.collect_list("w")).alias("windows"))


def _covered(n_bytes: int, lo: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """The bytes of a document that its repeated windows cover."""
    edge = np.zeros(n_bytes + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


_SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def _passages(mask: np.ndarray, raw: bytes, min_words: int, min_bytes: int) -> np.ndarray:
    """mask without its runs of fewer than min_words words and fewer than min_bytes bytes."""
    space = _SPACES[np.frombuffer(raw, np.uint8)]
    starts = ~space
    starts[1:] &= space[:-1]
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    before = np.concatenate([[0], np.cumsum(starts)])
    for k in np.flatnonzero((before[end] - before[begin] < min_words) & (end - begin < min_bytes)):
        mask[begin[k] : end[k]] = False
    return mask


def _long_runs(width: int, length: int):
    """The stretches of text in which windows of `width` bytes repeat one after the other, where they hold a string of `length` bytes: `at`, text."""

    def stretches(lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
        order = np.argsort(lo)
        begin, end = lo[order], np.maximum.accumulate((lo + n)[order])
        head = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
        return zip(begin[head].tolist(), (end[np.append(head[1:], len(end)) - 1] - 1 + width).tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for row, text, w in zip(batch.column("_row").to_pylist(), batch.column("text"), batch.column("short"), strict=True):
                raw = memoryview(text.as_buffer())
                out += [(row, a, raw[a:b]) for a, b in stretches(w.values.field("lo").to_numpy(), w.values.field("n").to_numpy()) if b - a >= length]
            of, at, texts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(at, pa.int64()), pa.array(map(bytes, texts), pa.binary())], ["_doc", "at", "text"])

    return run


def _apply(length: int, digest: bool, schema, min_words: int = 0, passage: int = 0):
    """Windows applied to texts. With `passage`, column `short` has the windows of that length, and passages are counted, too."""
    names = [f.name for f in schema]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())[: len(names) - 1]

    def passages(raw: bytes, win) -> tuple[int, int]:
        if not win.is_valid:
            return 0, 0
        mask = _covered(len(raw), win.values.field("lo").to_numpy(), win.values.field("n").to_numpy(), passage)
        mask = _passages(mask, raw, min_words, length)
        return int(mask.sum()), int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            windows = batch.column("windows")
            for text, win, short in zip(batch.column("text"), windows, batch.column("short") if passage else windows, strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                more = passages(raw, short) if passage else ()
                removed, runs = 0, 0
                if win.is_valid:
                    flat = win.values
                    mask = _covered(len(raw), flat.field("lo").to_numpy(), flat.field("n").to_numpy(), length)
                    mask = _passages(mask, raw, min_words, LENGTH) if min_words and not passage else mask
                    removed = int(mask.sum())
                    runs = int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum())
                    raw = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                if digest:
                    rows.append((len(raw) + removed, removed, runs, hashlib.sha256(raw).hexdigest(), *more))
                else:
                    # a cut inside a character leaves bytes that are no text: those go too
                    rows.append(raw.decode("utf-8", "ignore") if removed else text.as_py())
            if digest:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names)
            else:
                kept = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(rows, pa.string())}
                yield pa.RecordBatch.from_arrays([kept[n] for n in names], names)

    return run


def find(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = with_row(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").schema
    return rows.join(repeats(rows, length, **how), "_row", "left").select("doc_id", "text", "windows").mapInArrow(lean(_apply(length, True, schema)), schema)


def find_with_passages(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, min_words: int = PASSAGE_WORDS, **how) -> DataFrame:
    """The columns of `find`, and n_passage_bytes and n_passages.

    A passage is a longest run of bytes covered by strings of `passage` bytes that
    start anywhere else too, if it has `min_words` words or `length` bytes.
    """
    if passage > length:
        raise ValueError("passage must not be longer than length")
    rows = with_row(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, n_passages long").schema
    short = stored(repeats(rows, passage, **how).withColumnRenamed("windows", "short"), "short")
    # a string of `length` bytes that comes again lies in a stretch of shorter ones that do: only those are searched
    cut = rows.join(short, "_row").mapInArrow(lean(_long_runs(passage, length)), "_doc long, at long, text binary")
    parts = stored(cut.withColumn("_row", F.monotonically_increasing_id()), "stretches")
    moved = F.transform("windows", lambda x: F.struct((x["lo"] + F.col("at")).alias("lo"), x["n"].alias("n")))
    long = parts.select("_row", "_doc", "at").join(repeats(parts, length, **how), "_row").groupBy(F.col("_doc").alias("_row")).agg(F.flatten(F.collect_list(moved)).alias("windows"))
    both = short.join(long, "_row", "left")
    joined = rows.join(both, "_row", "left").select("doc_id", "text", "windows", "short")
    return joined.mapInArrow(lean(_apply(length, True, schema, min_words, passage)), schema)


def dedup(docs: DataFrame, length: int = LENGTH, min_words: int = 0, **how) -> DataFrame:
    """docs (all columns) with the repeated bytes, or with min_words the repeated passages, taken out of text."""
    hidden, back = set_aside(docs, "_row", "_r", "windows")
    rows = with_row(hidden)
    joined = rows.join(repeats(rows, length, **how).withColumnRenamed("_row", "_r"), F.col("_row") == F.col("_r"), "left")
    return back(joined.select(*hidden.columns, "windows").mapInArrow(lean(_apply(length, False, hidden.schema, min_words)), hidden.schema))
