"""Periodic runs of words: harmonic grid probing.

A run is a longest stretch of words in which words p apart are identical, p being
its smallest period, with at least three periods and MIN_WORDS words.

1. For each period p the grid points 0, p, 2p, ... are probed: a run of three
   periods holds grid points jp and (j+1)p whose words equal those p later. All
   periods together make about n ln n probes, which numpy compares in blocks.
2. Points that survive a few more probes between them are extended to both sides by
   comparing chunks of words that double until two words differ.
3. Periods go upwards. Grid points within a run that is already found are skipped:
   a run of a smaller period either explains the match or rules a new run out. So
   no found run has a smaller period.

Each text is taken whole, in the task that reads it; nothing is shuffled, and the
memory beyond the text's words is bounded by PROBES.

`op13`'s rows also carry planted repeats (`plant`), by which a corpus without
periodic texts can show that runs are found.

Edge cases: null and empty texts have no words, no run and the hash of the empty
string; texts of fewer than MIN_WORDS words have no run; words are compared as
bytes, case counts; rows with a null doc_id keep their words as they are; rows that
repeat give a result each; other columns are ignored by `find_runs` and kept by
`collapse`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.textbytes import each_chunk, rows_of, word_bounds

MIN_WORDS, MIN_PERIODS = 24, 3
#: Probes that are made together.
PROBES = 1 << 18
#: Words that are compared first when a match is extended; each further chunk has twice as many.
CHUNK = 32


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal exactly where the words' bytes are equal."""
    if not len(start):
        return np.zeros(0, np.int32)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] = 1
    edge[end] -= 1  # 0 where one text's last word meets the next text's first
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words.dictionary_encode().indices.to_numpy()


def _stretch(x: np.ndarray, at: int, period: int, step: int) -> int:
    """How many places from `at` on, in the direction of step, hold words equal to those a period later."""
    done, size = 0, CHUNK
    while True:
        if step > 0:
            a, b = x[at + done : at + done + size], x[at + done + period : at + done + period + size]
            a = a[: len(b)]
        else:
            low = max(at - done - size + 1, 0)
            a, b = x[low : at - done + 1][::-1], x[low + period : at - done + 1 + period][::-1]
        differ = a != b
        if differ.any():
            return done + int(differ.argmax())
        done += len(a)
        if len(a) < size:
            return done
        size *= 2


def _survivors(x: np.ndarray, begin: np.ndarray, period: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid points that pass: begin of the text, period and number of points for each (text, period) -> which of these, place in x."""
    of = np.repeat(np.arange(len(period)), points)
    p = period[of]
    at = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(points) - points, points)) * p
    # this grid point and the next, then places between them
    for shift in (lambda p: 0, lambda p: p, lambda p: p // 2, lambda p: np.minimum(1, p - 1), lambda p: np.minimum(2, p - 1)):
        place = at + shift(p)
        hit = np.flatnonzero(x[place] == x[place + p])
        of, at, p = of[hit], at[hit], p[hit]
    return of, at


def _stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """The ranges of equal neighbours."""
    edges = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)
    return zip(edges.tolist(), [*edges[1:].tolist(), len(x)][: len(edges)], strict=True)


def _within(low: np.ndarray, high: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of the stretches [low, high] lie within a found run."""
    if not runs:
        return np.zeros(len(low), bool)
    found = np.array(sorted((s, s + n - 1) for s, n, _ in runs))
    reach = np.maximum.accumulate(found[:, 1])
    before = np.searchsorted(found[:, 0], low, "right")
    return (before > 0) & (reach[before - 1] >= high)


def _extend(x: np.ndarray, at: np.ndarray, period: np.ndarray, runs: list[tuple[int, int, int]], min_words: int) -> None:
    """Survivors of one text (sorted by period) to runs (start, length, period), which are added."""
    while len(at):
        i, p = int(at[0]), int(period[0])
        left, right = _stretch(x, i, p, -1), _stretch(x, i, p, 1)
        start, length = i - left + 1, left + right - 1 + p
        # a match that breaks off before the second grid point may be the tail of a run that is found
        if right > p and length >= max(min_words, MIN_PERIODS * p):
            runs.append((start, length, p))
            rest = (at < start) | (at + 2 * period > start + length - 1)
        else:  # all survivors of this period within the stretch end as it does
            rest = (period != p) | (at < start) | (at >= i + right)
        rest[0] = False
        at, period = at[rest], period[rest]


def runs_of(x: np.ndarray, begin: np.ndarray, min_words: int = MIN_WORDS, probes: int = PROBES) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text; text i has the words x[begin[i]:begin[i + 1]]."""
    n = np.diff(begin)
    out: list[list[tuple[int, int, int]]] = [[] for _ in n]
    most = np.where(n >= min_words, n // MIN_PERIODS, 0)
    text = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (n[text] - 1) // period - 1
    for lo, hi in _stretches(np.cumsum(points) // probes):
        t, p = text[lo:hi], period[lo:hi]
        # a text whose smaller periods fell into an earlier block: what is explained needs no probe
        if out[t[0]] and t[0] == t[-1] and _within(np.zeros(1, int), n[t[:1]] - 1, out[t[0]])[0]:
            continue
        of, at = _survivors(x, begin[t], p, points[lo:hi])
        for a, b in _stretches(t[of]):
            k = int(t[of[a]])
            own, place, q = x[begin[k] : begin[k + 1]], at[a:b] - begin[k], p[of[a:b]]
            new = ~_within(place, place + 2 * q, out[k])
            _extend(own, place[new], q[new], out[k], min_words)
    return out


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word each word becomes, for texts that get a planted repeat: a rule on the id's hash."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _texts(batches: Iterator[pa.RecordBatch], plant: bool, min_words: int):
    """For each chunk of a batch: its rows, and for each text its words' starts and ends (after planting), the bytes and the runs."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist() if plant else None
        for lo, hi, data, off in each_chunk(batch):
            start, end = word_bounds(data, off)
            begin = rows_of(start, off)
            x = word_ids(data, start, end)
            order = np.arange(len(start))
            for k in range(hi - lo) if plant else ():
                source = planted(int(begin[k + 1] - begin[k]), ids[lo + k])
                if source is not None:
                    order[begin[k] : begin[k + 1]] = begin[k] + source
            if plant:
                x, start, end = x[order], start[order], end[order]
            yield batch, lo, hi, data, start, end, begin, runs_of(x, begin, min_words)


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words a run repeats: all of it after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period, exactly; of equals the first, then the one of the smaller period."""
    best = None
    for run in runs:
        if best is not None:
            more = run[1] * best[2] - best[1] * run[2]
            if more < 0 or (more == 0 and (run[0], run[2]) > (best[0], best[2])):
                continue
        best = run
    return best


def _joined(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    return b" ".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])


def _digest(plant: bool, min_words: int, names: list[str]):
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, start, end, begin, found in _texts(batches, plant, min_words):
            rows, raw = [], data.tobytes()
            for k, runs in enumerate(found):
                s, e = start[begin[k] : begin[k + 1]], end[begin[k] : begin[k + 1]]
                if runs:
                    keep = ~dropped(len(s), runs)
                    s, e = s[keep], e[keep]
                collapsed = _joined(raw, s, e)
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2])))
                best = strongest(runs)
                top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                rows.append((len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
            cols = [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def run_digests(docs: DataFrame, plant: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the strongest run, runs_sha256, collapsed_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return docs.select("doc_id", "text").mapInArrow(_digest(plant, min_words, names), schema)


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, length, period: one row for each run of each text."""
    names = ["doc_id", "start", "length", "period"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, _, _, _, _, _, found in _texts(batches, False, min_words):
            flat = [(lo + k, *r) for k, runs in enumerate(found) for r in sorted(runs, key=lambda r: (r[0], r[2]))]
            of, *cols = zip(*flat, strict=True) if flat else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, period long")


def collapse(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (all columns): of each run its first period stays. Texts without a run stay as they are, of others words are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, start, end, begin, found in _texts(batches, False, min_words):
            part = batch.slice(lo, hi - lo)
            texts = part.column("text").to_pylist()
            for k, runs in enumerate(found):
                if runs:
                    keep = begin[k] + np.flatnonzero(~dropped(int(begin[k + 1] - begin[k]), runs))
                    texts[k] = _joined(data.tobytes(), start[keep], end[keep]).decode()
            at = part.schema.names.index("text")
            yield part.set_column(at, "text", pa.array(texts, part.column(at).type))

    return docs.mapInArrow(run, docs.schema)
