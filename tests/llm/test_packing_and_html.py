"""Packing against the tokenizer itself; page text on small pages."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tidemark.llm import html_text, packing
from tidemark.llm.tables import read


def pieces_of(rows, capacity=4096):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.setdefault((i, k), []).append((start, len(part), zlib.crc32(part.tobytes())))
    return out


def check_places(got, capacity=4096):
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_small_table_is_packed_tightly(spark):
    docs = read(spark, SMALL, "documents")
    got = packing.pack_documents(docs).collect()
    want = pieces_of([(r.doc_id, r.text) for r in docs.collect()])
    assert {(r.doc_id, r.piece): [(r.start, r.length, r.ids_crc32)] for r in got} == want
    assert len(got) == len(want)
    assert check_places(got) <= -(-sum(r.length for r in got) // 4096) + 2


def test_odd_texts_have_the_tokenizers_ids(spark):
    texts = [
        None, "", " ", "It's we'll I'D", "naïve ÀÉ ÿ ß µ ª", "a.b,c 1234 x9", "tab\tnew\nline\r\x0bvt\x0c ff", "<|endoftext|> and <|startoftext|>x", "日本語 текст 🙂🙂",
        "é́ ǅ İ ŉ", "nb sp 　 wide", "word. word, Word.", "...", "!?#", "'s 's", "a" * 5000, "x " * 9000, "same", "same",
    ]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "none"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(df).collect()
    mine = {}
    for r in got:
        mine.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in pieces_of(rows).items()}
    check_places(got)
    assert packing.pack_documents(df.limit(0)).collect() == []


def test_rounds_merge_what_groups_could_not_fill(spark):
    rng = random.Random(1)
    items = spark.createDataFrame([(k, rng.randint(1, 60)) for k in range(600)], "item long, length long")
    got = packing.pack(items, capacity=100, group_items=20).join(items, "item").collect()
    assert check_places(got, 100) <= 1.06 * -(-sum(r.length for r in got) // 100) + 1


def test_pages(spark):
    rows = [
        (1, "u", "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; more</h1>"
         "<p>One  <b>bold</b>\n line.</p><aside>side</aside><p>Two&nbsp;&eacute;<script>var x='</p>';</script></p></article><div id=comments>bad</div><footer>f</footer></body></html>"),
        (2, None, None), (3, "u", ""), (4, "u", "plain text only"), (5, "u", "<nav>only menu</nav>"),
        (6, "u", "<div class=sidebar>s</div><p>" + "long text here " * 20 + "</p><p>" + "second part " * 20),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract_pages(df).collect()}
    assert got[1].text == "Head & more\nOne bold line.\nTwo é"
    assert got[2].text == got[3].text == got[5].text == ""
    assert got[4].text == "plain text only"
    assert got[6].text == ("long text here " * 20).strip() + "\n" + ("second part " * 20).strip()
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_other_vocabularies_have_their_own_ids(spark):
    assert packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")).by_word
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two  words, and\n a line", "", "It's 12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.token_pieces(docs, "byte_bpe_50k.json").collect():
        ids = np.array([*whole.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
