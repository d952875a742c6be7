"""Near-duplicate detection with an LSH forest over MinHash signatures.

1. Each document becomes the set of its 5-word shingles and a MinHash signature;
   equal sets meet as one class, and from here on classes stand for documents.
2. The forest has several orders of the signature, each beginning at another
   place. Classes that share some leading values in an order are neighbours by
   longest common prefix. Where a region holds more than MAX_GROUP classes, it is
   cut at greater depth until it does not, level by level; there every class is
   also compared with the region's hub, which takes one row a class. That links
   most of a region cheaply; what it leaves open is decided by step 5.
3. The neighbours of one region gather around its hub, the class that most
   documents share (ties by hash), so that the same classes meet once and not
   once a tree. Their full shingle sets are compared exactly: first all with the
   hub, then those not yet linked with all others of the group by counting
   shared shingles. Only links that join two parts of a group are emitted. A hub
   that gathers more than MAX_GROUP classes or GROUP_BYTES of sets from its
   regions is dealt with like an oversized region: in shares, with the hub only.
4. Links form components by min-label propagation, in tables.
5. The classes of all oversized regions and hubs meet once more, by a prefix-filter join
   that misses no pair: each set is ordered by a common order, rare shingles
   first, and two similar sets share one of their first few. Pairs already in one
   component are left out; the others are compared on their full sets, and their
   links join components. The order comes from counts in SKETCH slots, which have
   a fixed size; they, too, tell which shingles are dealt over several tasks.

Two sets at the threshold of 0.85 share no prefix of 4 values in any of 16 trees
with a chance of (1 - 0.85**4)**16, under one in 100,000; lower thresholds take
21 trees and prefixes of 3, for 0.8 with a chance of one in 3 million. That
chance is all that can be missed: in oversized regions step 5 is exact.

Edge cases: documents without words have no shingles, link with nothing and are
kept; with fewer than five words the whole sequence is the one shingle; null
text is like no text; repeated rows are copies of each other; rows with null
doc_id get a null component and are kept by `drop_near_copies`; other columns
are ignored by `find` and kept by `drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import set_aside, stored, with_row
from tidemark.llm.textbytes import U64, each_chunk, lean, mix64, words

SHINGLE = 5
SIMILARITY = 0.85
HASHES = 64
#: Leading values that neighbours share at least; the forest has HASHES // depth trees.
DEPTH, DEPTH_LOW = 4, 3
#: Depths at which a region that is too large is cut again.
DEEPER = (6, 8, 11, 15, 20, 28, 40, 64)
MAX_GROUP = 2048
#: Classes of an oversized region that one task compares with the hub, and bytes of sets that a group may have.
STAR_GROUP = 2048
GROUP_BYTES = 64 << 20
#: Slots in which the shingles of oversized regions are counted.
SKETCH = 1 << 20

_FACTORS = mix64(np.arange(1, HASHES + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where they begin (n + 1)."""
    w, at = words(data, off)
    n_docs, n = len(off) - 1, len(w)
    count = np.diff(at)
    pos_doc = np.repeat(np.arange(n_docs), count)
    left = np.repeat(at[1:], count) - np.arange(n)  # words from here to the document's end
    h = np.full(n, 17, U64)
    for k in range(size):
        take = np.flatnonzero(left > k) if k else slice(None)
        if k == 0:
            h = mix64(h * U64(31) + w)
        else:
            h[take] = mix64(h[take] * U64(31) + w[take + k])
    # whole shingles, and the first place of documents shorter than one
    keep = (left >= size) | ((np.arange(n) == at[pos_doc]) & (count[pos_doc] < size))
    h, doc = h[keep], pos_doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_row, doc_id, n, two hashes of the set, and the signature as 32-bit integers."""
    for batch in batches:
        for lo, hi, data, off in each_chunk(batch):
            h, at = shingle_sets(data, off)
            n = np.diff(at)
            full = np.flatnonzero(n)
            sig = np.zeros((hi - lo, HASHES), np.uint32)
            s1, s2 = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            if len(full):
                for k, factor in enumerate(_FACTORS):
                    sig[full, k] = np.minimum.reduceat(h * factor, at[full]) >> U64(20)
                s1[full] = np.add.reduceat(mix64(h + U64(1)), at[full]).view(np.int64)
                s2[full] = np.add.reduceat(mix64(h ^ U64(0x5851F42D4C957F2D)), at[full]).view(np.int64)
            part = batch.slice(lo, hi - lo)
            sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * HASHES), hi - lo, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("_row"), part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2), sigs], ["_row", "doc_id", "n", "s1", "s2", "sig"]
            )


def _prefixes(depth: int, first: int):
    """Each class's key in every tree: the tree and a hash of the `depth` leading values of its order.

    Trees begin `first` values apart.
    """
    trees = HASHES // first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, n = (batch.column(c).to_numpy() for c in ("id", "copies", "n"))
            sig = np.array([np.frombuffer(x, np.uint32) for x in batch.column("sig").to_pylist()]).reshape(-1, HASHES).astype(U64)
            keys = np.empty((len(ids), trees), U64)
            for t in range(trees):
                key = np.full(len(ids), t + 1, U64)
                for k in range(depth):
                    key = mix64(key * U64(31) + sig[:, (t * first + k) % HASHES])
                keys[:, t] = key
            cols = [*(np.repeat(x, trees) for x in (ids, copies, n)), np.tile(np.arange(trees, dtype=np.int32), len(ids)), keys.ravel().view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "copies", "n", "tree", "key"])

    return run


def _groups(classes: DataFrame, first: int) -> tuple[DataFrame, DataFrame | None]:
    """Which classes are compared: (hub, id, part), and the ids of the classes of oversized regions and hubs, if there are any.

    part -1: all of the group; else a share of an oversized one, hub only.
    """
    hub = F.max(F.struct("copies", F.xxhash64("id").alias("x"), "id"))["id"].alias("hub")
    close, shares, crowds, todo, over = [], [], [], classes, None
    for depth in (first, *DEEPER):
        keyed = todo.select("id", "copies", "n", "sig").mapInArrow(_prefixes(depth, first), "id long, copies long, n long, tree int, key long")
        if over is not None:  # only in the trees where the region above was too large
            keyed = keyed.join(over.select("id", "tree"), ["id", "tree"])
        keyed = stored(keyed, "prefixes")
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("size > 1")
        shared = stored(keyed.join(shared, "key"), "shared")
        regions = shared.groupBy("key").agg(hub)
        members = shared.join(regions, "key")
        close.append(members.where(F.col("size") <= MAX_GROUP).select("hub", "id", "n"))
        if shared.where(F.col("size") > MAX_GROUP).isEmpty():
            break
        over = stored(members.where(F.col("size") > MAX_GROUP).select("id", "tree", "size", "weight", "hub"), "oversized")
        shares.append(over.select("hub", "id", _share()))
        crowds += [over.select("id")] if not crowds else []  # what is cut deeper is among these
        todo = classes.join(over.select("id").distinct(), "id", "left_semi")
    near = stored(reduce(DataFrame.unionAll, close).distinct(), "near")
    sizes = near.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    large = stored(near.join(sizes.where((F.col("size") > MAX_GROUP) | (F.col("weight") > GROUP_BYTES // 8)), "hub"), "hubs")
    groups = near.select("hub", "id", F.lit(-1).cast("long").alias("part"))
    if not large.isEmpty():
        groups = groups.join(large.select("hub").distinct(), "hub", "left_anti")
        shares.append(large.select("hub", "id", _share()))
        crowds.append(large.select("id"))
    crowd = stored(reduce(DataFrame.unionAll, crowds).distinct(), "crowd-ids") if crowds else None
    return stored(reduce(DataFrame.unionAll, [groups, *shares]).distinct(), "groups") if shares else groups, crowd


def _share() -> Column:
    """The share of a group of `size` classes and `weight` shingles that a class is in."""
    return F.pmod(F.xxhash64("id"), F.ceil(F.greatest(F.col("size") / STAR_GROUP, F.col("weight") / (GROUP_BYTES // 8)))).alias("part")


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group a class is in, with its full set."""
    for batch in batches:
        ids = batch.column("id").to_numpy()
        groups = batch.column("groups")
        group_at = groups.offsets.to_numpy() - groups.offsets[0].as_py()
        flat = groups.flatten()
        hub, part = flat.field("hub").to_numpy(), flat.field("part").to_numpy()
        for lo, hi, data, off in each_chunk(batch):
            h, at = shingle_sets(data, off)
            sets = [h[at[k] : at[k + 1]].tobytes() for k in range(hi - lo)]
            for a in range(group_at[lo], group_at[hi], 1024):
                b = min(a + 1024, group_at[hi])
                own = np.searchsorted(group_at, np.arange(a, b), "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hub[a:b]), pa.array(part[a:b]), pa.array(ids[own]), pa.array([sets[k - lo] for k in own], pa.binary())], ["hub", "part", "id", "shingles"]
                )


def _similar(inter: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n + sizes - inter)


def group_links(ids: np.ndarray, sets: list[np.ndarray], hub: int, star_only: bool, percent: int) -> list[tuple[int, int]]:
    """Links between different parts of a group, enough to join all that the threshold joins."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets)
    root = np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links: list[tuple[int, int]] = []

    def join(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                links.append((int(ids[i]), int(ids[j])))

    start = int(np.flatnonzero(ids == hub)[0])
    inter = np.bincount(owner[np.isin(elements, sets[start])], minlength=len(sets))
    near = _similar(inter, len(sets[start]), sizes, percent)
    near[start] = False
    join(start, np.flatnonzero(near))
    if star_only:
        return links
    todo = np.flatnonzero(~near)
    todo = todo[todo != start]
    if not len(todo):
        return links
    # classes by shingle: which classes hold each
    order = np.argsort(elements, kind="stable")
    ranked = elements[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(elements), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    held = np.diff(np.append(first, len(ranked)))
    holder = owner[order]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for i in todo.tolist():
        own = number[begin[i] : begin[i + 1]]
        own = own[held[own] > 1]
        many = held[own]
        if not len(own):
            continue
        ends = np.cumsum(many)
        inter = np.bincount(holder[np.repeat(first[own] - ends + many, many) + np.arange(ends[-1])], minlength=len(sets))
        near = _similar(inter, int(sizes[i]), sizes, percent)
        near[i] = False
        join(i, np.flatnonzero(near))
    return links


def _linker(percent: int):
    """Groups arrive sorted by (hub, part), the hub first where it comes as a row with part = -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1 and group[0] in ids:
                links = group_links(np.array(ids), sets, group[0], group[1] >= 0, percent)
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            ids.clear()
            sets.clear()

        for batch in batches:
            for hub, part, one, shingles in zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "id", "shingles")), strict=True):
                if (hub, part) != group:
                    yield from close()
                    group = (hub, part)
                ids.append(one)
                sets.append(np.frombuffer(shingles, U64))
        yield from close()

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, label): every linked id with the smallest id of its component, by min-label propagation with shortcuts."""
    edges = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        heard = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(heard, labels["id"] == heard["a"]).select("id", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        # the label's own label: paths halve with each round
        own = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        step = stored(step.join(own, "label", "left").select("id", "was", F.coalesce("next", "label").alias("label")), "labels")
        changed = not step.where("label <> was").isEmpty()
        labels = step.select("id", "label")
        if not changed:
            return labels


def _compared(rows: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) that the full sets confirm within groups (hub, id, part)."""
    # an oversized region's hub goes to every part of it
    hubs = groups.where("part >= 0").select("hub", F.col("hub").alias("id"), "part")
    by_class = groups.unionAll(hubs).distinct().groupBy("id").agg(F.collect_list(F.struct("hub", "part")).alias("groups"))
    # the text is shuffled at every size: by_class grows with the corpus, so that it is not for broadcasting
    sets = rows.select(F.col("_row").alias("id"), "text").join(by_class.hint("merge"), "id").mapInArrow(lean(_with_sets), "hub long, part long, id long, shingles binary")
    return sets.repartition("hub", "part").sortWithinPartitions("hub", "part").mapInArrow(lean(_linker(percent)), "a long, b long")


def _slots(h: np.ndarray) -> np.ndarray:
    return (mix64(h) & U64(SKETCH - 1)).astype(np.int64)


def _crowd_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label and full set of each class."""
    for batch in batches:
        for lo, hi, data, off in each_chunk(batch):
            h, at = shingle_sets(data, off)
            part = batch.slice(lo, hi - lo)
            sets = [h[at[k] : at[k + 1]].tobytes() for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(sets, pa.binary())], ["id", "label", "shingles"])


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(SKETCH, np.int64)
    for batch in batches:
        seen += np.bincount(_slots(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), U64)), minlength=SKETCH)
    slot = np.flatnonzero(seen)
    for lo in range(0, len(slot), 1 << 17):
        some = slot[lo : lo + (1 << 17)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["slot", "n"])


def prefixes_of(n: int, percent: int) -> tuple[int, int]:
    """How many first shingles of a set of n can meet those of a set at most as large, and of one at least as large."""
    least = -(-percent * n // 100)
    return n + 1 + (-percent * (n + least)) // (100 + percent), n + 1 + (-percent * 2 * n) // (100 + percent)


def _postings(seen: np.ndarray, percent: int, share: int):
    """The first shingles of each class: is_low where they also meet larger sets, spread for the tasks that a shingle is dealt over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            for lo in range(0, len(ids), 1024):
                cols = []
                for k in range(lo, min(lo + 1024, len(ids))):
                    h = np.frombuffer(batch.column("shingles")[k].as_py(), U64)
                    many = seen[_slots(h)]
                    high, low = prefixes_of(len(h), percent)
                    order = np.lexsort((h, many))[:high]
                    pos = np.arange(len(order))
                    cols.append((h[order].view(np.int64), np.full(len(pos), ids[k]), np.full(len(pos), labels[k]), np.full(len(pos), len(h)), pos, pos < low, -(-many[order] // share)))
                merged = [pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)]
                yield pa.RecordBatch.from_arrays(merged, ["shingle", "id", "label", "n", "pos", "is_low", "spread"])

    return run


def _crowd_groups(rows: DataFrame, crowd: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Groups (hub, id, part) of all pairs of the crowd that may be similar and are in different components; hub only."""
    named = crowd.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    texts = rows.select(F.col("_row").alias("id"), "text").join(named.hint("merge"), "id")
    sets = stored(texts.mapInArrow(lean(_crowd_sets), "id long, label long, shingles binary"), "crowd")
    counts = sets.select("shingles").mapInArrow(_count_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(SKETCH, np.int64)
    seen[counts["slot"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    firsts = stored(sets.mapInArrow(lean(_postings(seen, percent, MAX_GROUP)), "shingle long, id long, label long, n long, pos long, is_low boolean, spread long"), "postings")
    low = firsts.where("is_low").withColumn("share", F.pmod(F.xxhash64("id"), "spread")).select("shingle", "share", *(F.col(c).alias(f"{c}_b") for c in ("id", "label", "n", "pos")))
    high = firsts.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spread") - 1)))
    both = high.hint("merge").join(low, ["shingle", "share"]).where(
        "label <> label_b and (n > n_b or (n = n_b and id > id_b))"
        f" and 100 * n_b >= {percent} * n"
        # what can still be shared from here on, at the first shingle that both share
        f" and {100 + percent} * (1 + least(n - 1 - pos, n_b - 1 - pos_b)) >= {percent} * (n + n_b)"
    )
    pairs = stored(both.select(F.col("id").alias("hub"), F.col("id_b").alias("id")).distinct(), "pairs")
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    return pairs.join(sizes, "hub").select("hub", "id", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / STAR_GROUP)).alias("part"))


def _find(rows: DataFrame, similarity: float) -> DataFrame:
    """rows (_row, doc_id, text) -> _row, doc_id, n_shingles, label (a row of the component), component_id."""
    percent = round(similarity * 100)
    signed = stored(
        rows.select("_row", F.col("doc_id").cast("long"), "text").mapInArrow(lean(_sign), "_row long, doc_id long, n long, s1 long, s2 long, sig binary"), "signed"
    )
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    classes = stored(
        signed.where("n > 0").groupBy("n", "s1", "s2").agg(least.alias("m"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
        .select("n", "s1", "s2", F.col("m._row").alias("id"), F.col("m.doc_id").alias("first_doc"), "copies", "sig"),
        "classes",
    )
    groups, crowd = _groups(classes, DEPTH if similarity >= SIMILARITY else DEPTH_LOW)
    labels = components(_compared(rows, groups, percent))
    named = classes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    if crowd is not None:
        named = stored(named, "named")
        more = _compared(rows, _crowd_groups(rows, crowd, labels, percent), percent)
        for end in ("a", "b"):
            more = more.join(named.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end)
        joined = components(more.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
        named = named.join(joined.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    # the component's smallest doc_id; labels are row numbers and need not follow doc_ids
    heads = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    by_set = named.join(heads, "label").select("n", "s1", "s2", "label", "component_id")
    return signed.select("_row", "doc_id", "n", "s1", "s2").join(by_set, ["n", "s1", "s2"], "left").select(
        "_row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "_row").alias("label"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def find(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) of every document."""
    found = _find(with_row(docs.select("doc_id", "text")), similarity)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs (all columns) with one row of each component: the first of its smallest doc_id."""
    hidden, back = set_aside(docs, "_row", "_r")
    rows = with_row(hidden)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"].alias("_r")
    keep = _find(rows, similarity).groupBy("label").agg(first).select("_r")
    return back(rows.join(keep, F.col("_row") == F.col("_r"), "left_semi").drop("_row"))
