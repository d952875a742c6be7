"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text; the edges of containers
are blank lines, several at those of sections. A line counts with its length in
characters. Lengths are summed over windows of WINDOW lines: a stretch begins
where the sum rises from 0 and ends where it falls back to 0, and it surges if a
window in it reaches SURGE characters (on pages of little text, PEAK_SHARE of the
page's highest window). The text is what stands from the first surge to the dive
after the last one.

Tags tell two things beside that. Lines inside menus, headers, footers, sidebars,
notices, adverts, forms, comments and other furniture, and lines outside of
articles that are mostly links, count 0 and are never text. And where article or
main elements hold SCOPE_SHARE of the surging text or more, the text is all lines
of those elements that surge, without those that hold less than SCOPE_SHARE of
what the largest holds (teasers); else the elements are ignored.

Edge cases: null, empty and textless pages give the empty string; unclosed and
stray tags are tolerated; equal pages give equal rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
#: Characters of a window that make a surge, and the share of a page's highest window that is enough.
SURGE = 86
PEAK_SHARE = 0.5
#: Most share of linked text of a line that counts outside of articles.
LINK_SHARE = 0.5
#: Least share of the surging text that makes article elements the text, and of the largest such element's.
SCOPE_SHARE = 0.2

# possessive: a tag that does not end is given up at once, and a "<" outside of quotes ends it
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*+"|'[^']*+')*+)>""", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "svg", "template")}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
_SPACE_TAGS = frozenset(("br", "td", "th"))
_FURNITURE = frozenset("nav header footer aside form menu dialog button select head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs cookie cookies consent notice notices banner popup modal newsletter subscribe signup share sharing social comment "
    "comments disqus related recommended footer header masthead toolbar widget pagination pager disclaimer alert".split()
)
_ATTR = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"))
_SCOPE = ("article", "main")
_SECTIONS = _FURNITURE | frozenset(("article", "main", "section"))


def _is_furniture(tag: str, attrs: str) -> bool:
    if tag in _FURNITURE:
        return True
    if tag in ("html", "body", "article", "main") or not attrs.strip():
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "hidden":
            return "hidden" in re.sub(r""""[^"]*"|'[^']*'""", "", attrs).lower()
        if name == "role":
            if value in _ROLES:
                return True
        elif not _WORDS.isdisjoint(_SPLIT.split(value)):
            return True
    return False


def lines(page: str, by_tags: bool = True) -> list[tuple[str, int, bool, int]]:
    """Lines as (raw text, linked characters, furniture, number of the outermost article or main element, -1: none).

    Without `by_tags` no line is furniture or in an element.
    """
    out: list[tuple[str, int, bool, int]] = []
    buf: list[str] = []
    linked = 0
    off: list[str] = []  # open furniture and what is open within it
    scope, links, n_scopes = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buf:
            out.append(("".join(buf), linked, bool(off), n_scopes if scope else -1))
            buf.clear()
            linked = 0

    def blank(n: int) -> None:
        out.extend([("", 0, True, n_scopes if scope else -1)] * n)

    pos, n, last = 0, len(page), page.rfind(">")
    while pos < n:
        m = _TOKEN.search(page, pos) if pos <= last or page.find("<!--", pos) >= 0 else None
        text = page[pos : m.start() if m else n]
        if text:
            buf.append(text)
            linked += len(text) if links else 0
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag, close, attrs = tag.lower(), bool(m[1]), m[3]
        if tag in _RAW:
            if not close and not attrs.endswith("/"):
                end = _RAW[tag].search(page, pos)
                pos = end.end() if end else n
            continue
        if tag == "a":
            links = 0 if close else 1
        if tag in _SPACE_TAGS:
            buf.append(" ")
        if tag in _BLOCK:
            flush()
        if tag in _VOID or attrs.endswith("/"):
            continue
        if tag in _SECTIONS:
            blank(WINDOW)
        elif tag == "div":
            blank(1)
        if not by_tags:
            continue
        if close:
            if tag in off:
                flush()
                while off.pop() != tag:
                    pass
                if not off:
                    blank(WINDOW)
            if tag in _SCOPE and scope and not off:
                scope -= 1
                blank(WINDOW)
        elif tag in _SCOPE:
            if off and off[-1] in ("nav", "header", "menu", "ul", "li", "div", "head"):
                off.clear()  # what was left open before the article
            if not off:
                n_scopes += not scope
                scope += 1
            blank(WINDOW)
        elif off:
            if tag in _BLOCK or tag == off[0]:
                if tag in ("p", "li", "dt", "dd", "option", "tr") and off[-1] == tag:
                    off.pop()
                off.append(tag)
        elif _is_furniture(tag, attrs):
            flush()
            blank(WINDOW)
            off.append(tag)
    flush()
    return out


def main_text(page: str | None, by_tags: bool = True) -> str:
    """The page's text; without `by_tags` by the distribution of lengths and links alone."""
    if not page:
        return ""
    texts, scopes = [], []
    for raw, linked, furniture, scope in lines(page, by_tags):
        counts = raw and not furniture and (scope >= 0 or linked <= LINK_SHARE * len(raw))
        texts.append(" ".join(html.unescape(raw).split()) if counts else "")
        scopes.append(scope)
    sums = _window_sums([len(t) for t in texts])
    least = min(SURGE, PEAK_SHARE * max(sums, default=0))
    surging: list[tuple[int, int]] = []  # from the line of the surge to that before the dive
    held: dict[int, int] = {}
    i, n = 0, len(sums)
    while i < n:
        if sums[i] == 0:
            i += 1
            continue
        surge = i
        while i < n and sums[i]:
            i += 1
        if max(sums[surge:i]) >= least:  # sums[k] covers lines k - WINDOW + 1 .. k
            surging.append((surge, i - WINDOW + 1))
            for k in range(surge, i - WINDOW + 1):
                held[scopes[k]] = held.get(scopes[k], 0) + len(texts[k])
    if not surging:
        return ""
    outside = held.pop(-1, 0)
    if held and sum(held.values()) >= SCOPE_SHARE * (outside + sum(held.values())):
        enough = SCOPE_SHARE * max(held.values())
        return "\n".join(t for t, s in zip(texts, scopes, strict=True) if t and held.get(s, 0) >= enough)
    return "\n".join(t for t in texts[surging[0][0] : surging[-1][1]] if t)


def _window_sums(lengths: list[int]) -> list[int]:
    """The sum over each window of WINDOW lines, by its last line; windows may stand out at both ends."""
    out, now = [], 0
    for i in range(len(lengths) + WINDOW - 1):
        now += lengths[i] if i < len(lengths) else 0
        now -= lengths[i - WINDOW] if i >= WINDOW else 0
        out.append(now)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
