"""Line-block distribution: what surge and dive decide, with and without tags that help."""

from __future__ import annotations

import pytest

from tidemark.llm import html_text
from tidemark.llm.html_text import main_text

LONG = "A sentence of the article that goes on for a while, so that windows over it are high."
PARAGRAPHS = [f"{k}. {LONG} {LONG}" for k in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = "\n".join(PARAGRAPHS)
LINKS = "".join(f"<li><a href=/{k}>Menu entry number {k} with some words</a></li>" for k in range(9))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<section><ul>{LINKS}</ul></section><section>{BODY}</section><section>Short words.</section>", TEXT),  # no telling tag: links and lengths decide
        (f"<div>Own blog</div><div>{BODY}</div><section>All rights reserved.</section>", "Own blog\n" + TEXT),  # a title next to the text
        (f"<section>{BODY}</section><div class=advert>{LONG}{LONG}</div><p>A closing paragraph that has more than eighty-six characters in it, as the last ones have.",
         TEXT + "\nA closing paragraph that has more than eighty-six characters in it, as the last ones have."),
        (f"<section>{BODY}</section><form>{LONG}</form><p>Short.</p><form>{LONG}</form><section>{BODY}</section>", f"{TEXT}\nShort.\n{TEXT}"),  # within the body
        (f"<article><h2>Teaser</h2>Read on</article><div>{BODY}</div>", TEXT),  # the element holds no surging text
        (f"<article>{BODY}</article><article>A teaser that itself has more than eighty-six characters, but few of all that there are.</article>", TEXT),
        (f"<article>{BODY}<aside>{LONG}</aside><p>End.</p></article><section>{LONG}</section><div id=comments>{BODY}</div>", TEXT + "\nEnd."),
        ("<article><h1>Few</h1><p>words</p></article>", "Few\nwords"),
        ("<p>no markup to speak of", "no markup to speak of"),
        (f"<nav>{LONG}</nav>", ""),
    ],
)
def test_surge_and_dive(page, text):
    assert main_text(f"<html><body>{page}</body></html>") == text


def test_lengths_alone_find_the_article():
    page = f"<nav><ul>{LINKS}</ul></nav><div class=ad>Buy this now.</div><article>{BODY}</article><footer>&copy; someone, all rights</footer>"
    assert main_text(page, by_tags=False) == main_text(page) == TEXT


def test_the_windows_decide(monkeypatch):
    """With a surge that any line reaches, short text far from the article is kept, too."""
    page = f"<section>{BODY}</section><section>Short words.</section>"
    assert main_text(page) == TEXT
    monkeypatch.setattr(html_text, "SURGE", 1)
    assert main_text(page) == TEXT + "\nShort words."


def test_pages_of_any_shape(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    long = "<article>" + "<p>word</p>" * 60_000 + "</article>"
    rows = [(1, "a", long, 7, "x"), (2, "b", "<p>same</p>", 1, None), (2, "b", "<p>same</p>", 1, None), (None, None, "<<<>< &#0; &bogus; </p></div>", None, None), (3, "c", "<p" * 5000, 0, "")]
    got = html_text.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[-3:] == [(2, 4), (2, 4), (3, len(main_text("<p" * 5000)))]
    assert next(r.n_chars for r in got if r.page_id == 1) == 60_000 * 5 - 1
    assert html_text.extract_pages(spark.createDataFrame([], schema)).collect() == []
