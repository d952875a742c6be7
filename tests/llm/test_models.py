"""Quality, language, suffix tree and leaks: held-out accuracy, exact sums, brute force, odd rows; the pipeline on small rows."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import MIDDLE, SMALL
from tidemark.llm import decontaminate, language, quality, suffix_tree_lm
from tidemark.llm.queries import QUERIES
from tidemark.llm.tables import read


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    weight = {y: math.exp(sum(emit[k, y[k]] for k in range(4)) + sum(trans[y[k], y[k + 1]] for k in range(3))) for y in itertools.product((0, 1), repeat=4)}
    got, logz, _ = quality.Chain(np.array([0, 4])).marginals(emit, trans)
    z = sum(weight.values())
    assert np.allclose(got, [sum(w for y, w in weight.items() if y[k]) / z for k in range(4)])
    assert math.isclose(logz, math.log(z))


def test_held_out_quality_and_language(spark):
    labels = {r.doc_id: r.quality for r in read(spark, MIDDLE, "labels").collect()}
    scored = QUERIES["op1_quality_crf"](spark, MIDDLE).collect()
    held = [r for r in scored if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held) > 0
    langs = {r.doc_id: r.lang for r in read(spark, MIDDLE, "documents").collect()}
    held = [r for r in QUERIES["op8_language_id"](spark, MIDDLE).collect() if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held) > 0


ODD = [(None, None), (1, ""), (2, " \n"), (3, "..."), (4, "word " * 30000), (4, "again"), (5, "Plain words here.\nAnd a line.")]


def test_odd_rows_get_results(spark):
    df = spark.createDataFrame([(*r, "en", 1, "x") for r in ODD], "doc_id long, text string, lang string, score int, quality_score string")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, None), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for got in (quality.score_documents(df, labels).collect(), language.identify_documents(df).collect(), suffix_tree_lm.score_documents(df).collect()):
        assert len(got) == len(ODD)
    assert {r.doc_id: r.lang_pred for r in language.identify_documents(df).collect()}[3] == "und"
    assert all(0 <= r.score <= 1 for r in quality.score_documents(df, labels.limit(0)).collect())
    assert quality.keep_good(df, labels, 0.0).columns == df.columns
    for run in (lambda d: quality.score_documents(d, labels), language.identify_documents, suffix_tree_lm.score_documents):
        assert run(df.limit(0)).collect() == []


def test_suffix_tree_scores(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SMALL, "documents").collect()]
    got = {r.doc_id: r for r in QUERIES["op4_suffix_tree_scores"](spark, SMALL).collect()}

    def tokens(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    count = Counter(w for i, t in rows if not got[i].held_out for w in tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens(t)), sum(w in count for w in tokens(t)), n)
        assert math.isclose(got[i].base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_states_predict_distributions(spark):
    df = spark.createDataFrame([(k, "a b a c a b d " * 40) for k in range(9)], "_row long, text string")
    tree, _, _, _ = suffix_tree_lm.fit(df, context_p=0.001, divergence=1.0)
    assert len(tree.alpha)
    words = [f"{x}" for x in "abcd"]
    for context in ("", "a", "b a", "d"):
        total = 0.0
        for w in words:
            data = np.frombuffer(f"{context} {w}".encode(), np.uint8)
            t, at = suffix_tree_lm.tokens(data, np.array([0, len(data)]))
            total += 10 ** tree.score(t, at)[1][-2]
        data = np.frombuffer(context.encode(), np.uint8)
        t, at = suffix_tree_lm.tokens(data, np.array([0, len(data)]))
        total += 10 ** tree.score(t, at)[1][-1]
        assert 0.98 < total <= 1.0001


def test_leaks_by_brute_force(spark):
    words = [f"w{k}" for k in range(40)]
    item = " ".join(words[:20])
    swapped = " ".join("x" if k in (4, 9, 15) else w for k, w in enumerate(words[:20]))
    half = " ".join(words[:10] + ["y"] * 10)
    rows = [(1, f"before {item} after"), (2, f"p q {swapped.upper()} r"), (3, half), (4, None), (5, ""), (6, item), (6, item), (7, "short one"), (8, "a short one here")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, _leak int")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one"), (None, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == Counter([(1, 1), (2, 1), (6, 1), (6, 1), (7, 4), (8, 4)])
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.find_leaks(docs.limit(0), bench).collect() == []
    assert decontaminate.find_leaks(docs, bench.limit(0)).collect() == []


def test_leaks_of_parts_and_shifted_words(spark):
    words = [f"w{k}" for k in range(50)]
    short = [f"s{k}" for k in range(12)]
    item = " ".join(words)
    leaks = [
        item, " ".join(words[:39]), " ".join(words[37:]),  # whole, 78 % of it, its last 13 words at the document's start
        " ".join(words[:20][:10] + ["new"] + words[10:20]), " ".join(words[20:29] + words[30:40]),  # one word more, one word less
        " ".join(words[5:10] + ["x"] + words[11:15] + ["y", "z"] + words[15:18]), " ".join(short[:6] + ["new"] + short[6:]),
    ]
    clean = [
        " ".join(words[:10] + ["y"] * 10), " ".join(reversed(words)), " ".join(w for k in range(50) for w in (words[k], "y")),
        " ".join(words[:5] + ["y"] * 9 + words[5:10] + ["y"] * 9 + words[10:15]), " ".join(short[:6] + ["y"] * 5 + short[6:]), "plain words",
    ]
    rows = list(enumerate(leaks + clean))
    # a passage that the end of one document and the start of the next would make together
    rows += [(90, " ".join(words[:7])), (91, " ".join(words[7:14]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, item), (2, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert sorted(got) == [(k, 2 if k == 6 else 1) for k in range(len(leaks))]
    assert [got[k, 1].n_matched for k in range(3)] == [50, 39, 13]
    assert got[2, 1].word_start == -37


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], read(spark, SMALL, "documents").schema)
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, SMALL)
    assert name == "pack" or got.columns == docs.columns
    got.collect()
    assert stage(spark, docs.limit(0), SMALL).collect() == []


def test_pipeline_packs_what_is_left(spark):
    got = corpus_pipeline.run(spark, SMALL).collect()
    ids = {r.doc_id for r in got}
    assert ids and ids < {r.doc_id for r in read(spark, SMALL, "documents").collect()}
    assert max(sum(r.length for r in g) for _, g in itertools.groupby(sorted(got, key=lambda r: r.sequence_id), key=lambda r: r.sequence_id)) <= 4096
