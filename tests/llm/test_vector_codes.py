"""Vector codes against plain Lloyd rounds in Python integers, ties and odd rows among them."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tests.conftest import SMALL
from tidemark.llm import vector_codes
from tidemark.llm.queries import QUERIES, SQL


def plain(rows, parts, entries, rounds):
    """rows (vec_id, integers, label) -> sorted (vec_id, code, error, label_error), codebooks."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    w = len(rows[0][1]) // parts
    cut = lambda v, k: v[k * w : (k + 1) * w]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(r[1], k) for r in rows[:entries]] for k in range(parts)]
    near = lambda v, k: min(range(len(books[k])), key=lambda e: (gap(cut(v, k), books[k][e]), e))
    for _ in range(rounds):
        codes = [[near(r[1], k) for k in range(parts)] for r in rows]
        for k in range(parts):
            for e in range(len(books[k])):
                own = [cut(r[1], k) for r, c in zip(rows, codes, strict=True) if c[k] == e]
                if own:
                    books[k][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for i, v, label in rows:
        code = [near(v, k) for k in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c in code), sum(gap(cut(v, k), books[k][c]) for k, c in enumerate(code)), label))
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    return sorted(((i, c, e, sums[label]) for i, c, e, label in out), key=repr), books


def sha(books):
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize(("spread", "dims", "entries"), [(2, 4, 8), (3, 8, 16), (40, 8, 16), (2000, 16, 5)])
def test_codes_by_plain_rounds(spark, spread, dims, entries):
    rng = random.Random(spread)
    rows = [(i, [rng.randint(-spread, spread) for _ in range(dims)], rng.choice([None, 0, 1, 2])) for i in range(400)]
    df = spark.createDataFrame([(i, v, k) for i, v, k in rows], "vec_id long, v array<long>, label int").repartition(5)
    got, books = vector_codes.encode(df, 4, entries, 4)
    want, plain_books = plain(rows, 4, entries, 4)
    assert books.tolist() == plain_books
    by_label = {r[0]: r[:3] for r in want}
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == sorted(by_label.values())


def test_bounds_save_scans_and_change_nothing(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 800, (12, 32))
    v = np.floor(middle[rng.integers(0, 12, 3000)] + rng.normal(0, 20, (3000, 32))).astype(int)
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, label int")
    assigned, books, scans = vector_codes.train(df, 4, 24, 4)
    assert scans[0] == 4 * 3000 and sum(scans[1:]) < 0.6 * 4 * scans[0]
    want, plain_books = plain([r for r in rows], 4, 24, 4)
    assert books.tolist() == plain_books
    codes = {r.vec_id: "".join(f"{c:02x}" for c in r.code) for r in assigned.collect()}
    assert codes == {r[0]: r[1] for r in want}


def test_large_components_stay_exact():
    rng = np.random.default_rng(5)
    for scale in (1 << 10, 1 << 24, 1 << 28):
        a, b = rng.integers(-scale, scale, (20, 4)), rng.integers(-scale, scale, (7, 4))
        assert vector_codes.distances(a, b).tolist() == [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    with pytest.raises(ValueError, match="63 bits"):
        vector_codes.distances(np.full((1, 4), 1 << 40), np.zeros((1, 4), np.int64))


def test_odd_rows(spark):
    rng = random.Random(8)
    fine = [(i, [rng.choice([-0.5, 0.25, 0.5, -0.001, 0.0]) for _ in range(8)], rng.choice(["a", None])) for i in range(60)]
    fine += [(7, fine[7][1], "a"), (7, [0.125] * 8, None), (None, [0.5] * 8, "b")]
    bad = [(100, None, "a"), (101, [], "a"), (102, [0.1, None] + [0.0] * 6, "a"), (103, [math.nan] + [0.0] * 7, None), (104, [math.inf] + [0.0] * 7, None), (105, [-math.inf] * 8, "a"), (106, [0.0] * 4, "a")]
    df = spark.createDataFrame([(i, v, k, 1) for i, v, k in fine + bad], "vec_id long, embedding array<float>, label string, code int").repartition(3)
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], k) for i, v, k in fine]
    want, books = plain(ints, 4, 256, 4)
    got = vector_codes.encode_vectors(df).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want
    assert {r.codebooks_sha256 for r in got} == {sha(books)}
    assert vector_codes.encode_vectors(df.where("vec_id >= 100 AND vec_id < 106")).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encode_vectors(spark.createDataFrame([(1, [0.5] * 6, "a")], "vec_id long, embedding array<float>, label string"))


def test_decode(spark):
    rows = [(i, [i * 10, -i, 5, i % 3], 0) for i in range(5)]
    codes, books = vector_codes.encode(spark.createDataFrame(rows, "vec_id long, v array<long>, label int"), 4, 8, 2)
    assert sorted((r.vec_id, list(r.v)) for r in vector_codes.decode(codes, books).collect()) == [(i, v) for i, v, _ in rows]  # as many entries as vectors


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    df = QUERIES["op11_hamerly_codes"](spark, SMALL)
    want = con.execute(SQL["op11_hamerly_codes"]).fetch_df()
    assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == sorted(tuple(r) for r in want[sorted(df.columns)].itertuples(index=False))
