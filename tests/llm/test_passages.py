"""Passages of over 50 words planted in prose that shares nothing else."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tidemark.llm import suffix_dedup
from tidemark.llm.tables import read


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """Own words, then perhaps a passage, then own words; passages of 51 words stand in 2 and in 40 documents, one of 45 words in 2."""
    rng = random.Random(17)
    rows, kept = [], {}
    for words, copies in ((51, 2), (51, 40), (120, 3), (45, 2)):
        passage = prose(rng, words)
        for _ in range(copies):
            before, after = prose(rng, 60), prose(rng, 60)
            kept[len(rows)] = (before, passage, after, words > 50)
            rows.append((len(rows), f"{before} {passage} {after}"))
    rows += [(len(rows) + k, prose(rng, 150)) for k in range(20)]
    return rows, kept


def test_planted_passages_go_and_other_text_stays(spark, planted):
    rows, kept = planted
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], read(spark, SMALL, "documents").schema)
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, SMALL).collect()}
    for i, text in rows:
        before, passage, after, goes = kept.get(i, (text, "", "", False))
        if not goes:
            assert got[i].text == text
            continue
        # a few letters next to the passage may agree by chance, and go with it
        assert got[i].text.startswith(before[:-4]) and got[i].text.endswith(after[4:])
        assert len(got[i].text) <= len(before + after) + 2
        assert got[i].n_chars == len(got[i].text)


def test_runs_of_few_words_stay():
    raw = b"one two three four five six"
    mask = np.array([c != 32 or k > 15 for k, c in enumerate(raw)])
    assert suffix_dedup._passages(mask.copy(), raw, 2, 400).tolist() == [k > 13 for k in range(len(raw))]
    assert suffix_dedup._passages(mask.copy(), raw, 2, 3).tolist() == mask.tolist()
