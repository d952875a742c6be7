"""Vector code compression: product codes learned by Lloyd rounds with Hamerly's bounds.

Components become integers floor(1024 x); vectors are cut into PARTS equal parts,
each with a codebook of its own that starts as that part of the vectors of the
ENTRIES smallest vec_ids. Each round assigns every part to its nearest entry and
moves each entry to the floored mean of its parts; a last assignment follows.

Each part keeps two bounds from round to round, in the table that the round writes:
an upper bound of the distance to its own entry and a lower bound of that to the
second nearest. When entries move, the upper bound grows by its entry's move and
the lower one shrinks by the largest move of another entry. While the upper bound
is strictly under the lower one, or strictly under half the distance from its entry
to the nearest other entry, the part stays where it is. Else the upper bound is
made exact, and if it is still not strictly under, all entries are compared in
integers, ties going to the lower index. Bounds are rounded outwards, so that no
rounding error hides a tie.

A round is one pass of mapInArrow over the vectors. With its rows each task writes
the sums of its parts by entry, so that an update reads no vector again. Codebooks,
and nothing else, go through the driver: ENTRIES vectors. A round's table goes once
the next one is written; a lost executor costs a reread of the last.

Edge cases: rows whose vector is null, empty or holds null or non-finite components
are dropped, and so are vectors of another length than that of the smallest vec_id;
that length must be divisible by PARTS. With fewer vectors than ENTRIES there are
fewer entries. A null vec_id is larger than any; of equal vec_ids the smaller vector
comes first. Null labels share one sum. An empty table gives no rows. Components
so large that a squared distance would pass 63 bits are an error. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import discard, stored, stored_at

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are compared with all entries together.
BLOCK = 4096
#: Sums of squares below this are exact in float64, so that a matrix product gives integers.
_EXACT = float(1 << 52)
_OUT, _IN = 1 + 1e-12, 1 - 1e-12


def integer_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, v: the vectors without null or non-finite components, as integers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * float(SCALE)))
    return table.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine).select("vec_id", "label", ints.alias("v"))


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each part (rows) to each entry, as int64."""
    width = max(parts.shape[1], 1)
    most = float(max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * width * most * most < _EXACT:
        a, b = parts.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    if 4 * width * PARTS * most * most >= float(1 << 62):
        raise ValueError("components are too large for squared distances of 63 bits")
    out = np.empty((len(parts), len(entries)), np.int64)
    for k, entry in enumerate(entries):
        gap = parts - entry
        out[:, k] = (gap * gap).sum(1)
    return out


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry moved, rounded up."""
    gap = (new - old).astype(np.float64)
    return np.sqrt((gap * gap).sum(-1)) * _OUT


def nearest_other(entries: np.ndarray) -> np.ndarray:
    """Half the distance from each entry to the nearest other one, rounded down."""
    d = distances(entries, entries).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(d.min(1)) * _IN / 2


class Round:
    """One assignment: the codebooks, and how they moved since the bounds were written."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None):
        self.books = books
        self.half = np.stack([nearest_other(b) for b in books])
        if before is not None:
            self.move = moved(before, books)
            order = np.sort(self.move, axis=1)
            second = order[:, -2] if order.shape[1] > 1 else np.zeros(len(books))
            # the largest move of another entry: for the one that moved most it is the second largest
            self.shrink = np.where(self.move >= order[:, -1:], second[:, None], order[:, -1:])

    def assign(self, k: int, parts: np.ndarray, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
        """Codes, upper and lower bounds of the parts at position k, and how many were compared with all entries."""
        n = len(parts)
        if code is None:
            code, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
            scan = np.arange(n)
        else:
            code, upper, lower = code.copy(), (upper + self.move[k][code]) * _OUT, lower - self.shrink[k][code]
            lower = np.where(lower > 0, lower * _IN, 0.0)
            bound = np.maximum(lower, self.half[k][code])
            loose = np.flatnonzero(~(upper < bound))
            gap = parts[loose] - self.books[k][code[loose]]
            upper[loose] = np.sqrt((gap * gap).sum(1).astype(np.float64)) * _OUT
            scan = loose[~(upper[loose] < bound[loose])]
        for lo in range(0, len(scan), BLOCK):
            at = scan[lo : lo + BLOCK]
            d = distances(parts[at], self.books[k])
            best = d.argmin(1)  # the first of equals
            rows = np.arange(len(at))
            code[at], upper[at] = best, np.sqrt(d[rows, best].astype(np.float64)) * _OUT
            if d.shape[1] > 1:
                d[rows, best] = np.iinfo(np.int64).max
                lower[at] = np.sqrt(d.min(1).astype(np.float64)) * _IN
            else:
                lower[at] = np.inf
        return code, upper, lower, len(scan)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """A list column without nulls, of lists of equal length, as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1 if len(column) else 0), kind)


_STATE = "vec_id {id}, label {label}, v array<long>, code array<int>, upper array<double>, lower array<double>, part int, entry int, n long, scanned long, total array<long>"
_NAMES = [f.split()[0] for f in _STATE.split(", ")]


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel(), kind))


def _round(now: Round, first: bool):
    """The rows with new codes and bounds; at a task's end its sums by part and entry."""
    parts, entries, width = now.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        scanned, kinds = np.zeros(parts, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(c).type for c in ("vec_id", "label")]
            v = _matrix(batch.column("v"), np.int64)
            had = None if first else [_matrix(batch.column(c), k) for c, k in (("code", np.int32), ("upper", np.float64), ("lower", np.float64))]
            code, upper, lower = np.empty((len(v), parts), np.int32), np.empty((len(v), parts)), np.empty((len(v), parts))
            for k in range(parts):
                own = v[:, k * width : (k + 1) * width]
                code[:, k], upper[:, k], lower[:, k], n = now.assign(k, own, *((None,) * 3 if first else (x[:, k] for x in had)))
                scanned[k] += n
                order = np.argsort(code[:, k], kind="stable")
                used, begin = np.unique(code[order, k], return_index=True)
                total[k, used] += np.add.reduceat(own[order], begin, axis=0)
                count[k] += np.bincount(code[:, k], minlength=entries)
            none = [pa.nulls(len(v), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            cols = [_lists(code, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), *cols, *none], _NAMES)
        if kinds is None:
            return
        k, e = np.nonzero(count)
        n = len(k)
        none = [pa.nulls(n, t) for t in (*kinds, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))]
        scans = pa.array(np.where(np.append(True, k[1:] != k[:-1]), scanned[k], 0))
        sums = [pa.array(k.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[k, e]), scans, _lists(total[k, e], pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, *sums], _NAMES)

    return run


def _update(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """New codebooks: the floored mean of each entry's parts; entries without parts stay."""
    sums = state.where(F.col("part").isNotNull()).select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    means = sums.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # as many rows as the codebooks have components
    new = books.copy()
    for r in means:
        new[r.part, r.entry, r.at] = r.x // r.n
    return new


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """The codebooks (part, entry, component) of the smallest vec_ids; None without vectors."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    head = vectors.orderBy(*order).limit(1).collect()
    if not head:
        return None
    dims = len(head[0].v)
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    rows = vectors.where(F.size("v") == dims).orderBy(*order).limit(entries).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, dims // parts).transpose(1, 0, 2)


def books_sha256(books: np.ndarray) -> str:
    """Of all components as decimal integers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]] | None:
    """(assigned rows, final codebooks, parts compared with all entries in each assignment); None without vectors."""
    books = first_books(vectors, parts, entries)
    if books is None:
        return None
    kinds = {k: vectors.schema[c].dataType.simpleString() for k, c in (("id", "vec_id"), ("label", "label"))}
    state = vectors.where(F.size("v") == parts * books.shape[2])
    before, scans, last = None, [], None
    for k in range(rounds + 1):
        state, path = stored_at(state.mapInArrow(_round(Round(books, before), k == 0), _STATE.format(**kinds)), f"codes-{k}")
        if last is not None:
            discard(vectors.sparkSession, last)
        last = path
        scans.append(int(state.agg(F.sum("scanned")).first()[0] or 0))
        if k < rounds:
            before, books = books, _update(state, books)
        state = state.where(F.col("part").isNull())
    return state.select("vec_id", "label", "v", "code"), books, scans


def _finish(books: np.ndarray, names: list[str]):
    """Rows to their code in hex and the sum of their squared distances."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, code = _matrix(batch.column("v"), np.int64), _matrix(batch.column("code"), np.int32)
            gap = v - np.concatenate([books[k][code[:, k]] for k in range(parts)], axis=1) if len(v) else v
            raw = code.astype(np.uint8).tobytes().hex()
            hexes = [raw[i : i + 2 * parts] for i in range(0, len(raw), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(hexes, pa.string()), pa.array((gap * gap).sum(1), pa.int64())], names)

    return run


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, code, error of the vectors (vec_id, label, v), and the codebooks that decode them. At most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits names at most 256 entries")
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    trained = train(vectors, parts, entries, rounds)
    if trained is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    assigned, books, _ = trained
    return assigned.mapInArrow(_finish(books, ["vec_id", "label", "code", "error"]), schema), books


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes (all columns) with v: the entries that the code names, as integers."""
    parts = books.shape[0]
    entry = [F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int") for k in range(parts)]
    tables = [F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in book]) for book in books]
    return codes.withColumn("v", F.concat(*[F.get(t, e) for t, e in zip(tables, entry, strict=True)]))


def encode_vectors(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    coded, books = encode(integer_vectors(table), parts, entries, rounds)
    coded = stored(coded, "coded")
    labels = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = F.lit(books_sha256(books) if books is not None else None).cast("string")
    met = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rows in SQL: every part against every entry, in each round."""
    steps = [
        f"""
k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {entries})"""
    ]
    for r in range(rounds + 1):
        # the squared distance is a sum of integers far under 2^53, so that doubles hold it exactly
        steps.append(
            f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, p.part, any_value(x) AS x, min({{'d': list_inner_product(list_transform(list_zip(x, c), lambda t: CAST(t[1] - t[2] AS DOUBLE)),
    list_transform(list_zip(x, c), lambda t: CAST(t[1] - t[2] AS DOUBLE))), 'e': entry}}) AS best FROM p JOIN b{r} b ON p.part = b.part GROUP BY vec_id, label, p.part)"""
        )
        if r < rounds:
            steps.append(
                f"""
m{r} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
    SELECT part, best.e AS entry, i, CAST(sum(x[i]) AS DOUBLE) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) GROUP BY ALL) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)"""
            )
    return f"""WITH {",".join(steps)},
o AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM o
"""


SQL = _sql()
