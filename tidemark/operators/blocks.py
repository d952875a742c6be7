"""Pages to blocks of text, block scores, and candidate passages.

The page walker is the one step that built-ins cannot express; it runs per page
inside Arrow batches. Scoring, the greedy cover of hits and the best candidates
of a page are expressions over the page's array of blocks and one window.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import blank, clean_text, has_any, let
from tidemark.sources.tables import spread

BLOCK = "struct<pos:int,text:string,href:string,tag:string,heading:string>"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_LEAF = frozenset((*HEADINGS, "p", "li", "td", "th", "dd", "dt", "blockquote", "pre", "figcaption", "summary"))
_NESTING = frozenset(("p", "li", "td", "th", "dd", "dt", "blockquote"))
_NOISE = frozenset(("script", "style", "noscript", "svg", "iframe", "template", "nav", "footer"))
_NOISE_CLASS = frozenset(("sidebar", "menu", "breadcrumb", "toc"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr")}


class _Walker(HTMLParser):
    """Collects the leaf blocks and table rows of one page in document order."""

    def __init__(self, base: str, scope: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.scope, self.matched = base, scope, False
        self.stack: list[dict] = []
        self.noisy = self.scoped = 0  # elements of the stack that are noise, or the scope
        self.blocks: list[dict] = []
        self.rows: list[list[dict]] = []
        self.text: list[str] = []

    def _in_scope(self) -> bool:
        return self.scope is None or self.scoped > 0

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns are asked by nobody here."""
        return j

    def _matches(self, tag: str, attrs: dict) -> bool:
        """Whether this is the scope: the first element that the selector names."""
        if self.matched or not self.scope:
            return False
        self.matched = self._named(tag, attrs)
        return self.matched

    def _named(self, tag: str, attrs: dict) -> bool:
        want = self.scope or ""
        if want.startswith("#"):
            return attrs.get("id") == want[1:]
        return want[1:] in (attrs.get("class") or "").split() if want.startswith(".") else tag == want

    def handle_starttag(self, tag: str, attrs_list: list) -> None:
        for other in _CLOSES.get(tag, ("p",) if tag in _LEAF else ()):
            if any(e["tag"] == other for e in self.stack[-3:]):
                self.handle_endtag(other)
        if tag in _VOID:
            if tag == "br":
                self.handle_data("\n")
            return
        attrs = dict(attrs_list)
        noise = tag in _NOISE or bool(attrs) and (attrs.get("role") == "navigation" or not _NOISE_CLASS.isdisjoint((attrs.get("class") or "").split()))
        if tag in ("p", "li", "table"):
            for e in self.stack:
                e["nested"] = True
        href = urljoin(self.base, attrs["href"]) if tag == "a" and attrs.get("href") else None
        if href:
            for e in self.stack:
                e["href"] = e["href"] or href
        above = self.stack[-1]["link"] if self.stack else None
        entry = {"tag": tag, "noise": noise, "nested": False, "href": None, "link": href or above, "parts": [], "scope": not (noise or self.noisy) and self._matches(tag, attrs)}
        self.stack.append(entry)
        self.noisy += noise
        self.scoped += entry["scope"]
        if self.noisy or not self._in_scope():
            return
        if tag in _LEAF:
            self.blocks.append(entry)
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(entry)

    def handle_endtag(self, tag: str) -> None:
        if not any(e["tag"] == tag for e in self.stack):
            return
        while True:
            e = self.stack.pop()
            self.noisy -= e["noise"]
            self.scoped -= e["scope"]
            if e["tag"] == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.noisy or not self._in_scope():
            return
        self.text.append(data)
        for e in self.stack:
            e["parts"].append(data)


def _tidy(text: str) -> str:
    return "\n".join(" ".join(line.split()) for line in text.split("\n")).strip()


def _segments(text: str, size: int = 500, least: int = 10) -> list[str]:
    """Sentences packed one after the other up to `size` characters."""
    parts, now = [], ""
    for mark in "。！？；":
        text = text.replace(mark, mark + "\n")
    for piece in filter(None, (p.strip() for p in text.split("\n"))):
        if now and len(now) + len(piece) > size:
            parts.append(now)
            now = ""
        now += piece
    return [p for p in (*parts, now) if len(p) >= least]


def page_blocks(page: str | None, base: str | None, scope: str | None = None) -> list[dict]:
    walker = _Walker(base or "", scope)
    walker.feed(page or "")
    walker.close()
    if scope and not walker.matched:
        return page_blocks(page, base)
    found, heading = [], None
    for e in walker.blocks:
        text = _tidy("".join(e["parts"]))
        if text and not (e["tag"] in _NESTING and e["nested"]):
            found.append({"text": text, "href": e["href"] or e["link"], "tag": e["tag"], "heading": heading})
            heading = text if e["tag"] in HEADINGS else heading
    for cells in walker.rows:
        texts = [t for t in (_tidy("".join(c["parts"])) for c in cells) if t]
        if len(texts) >= 2:
            found.append({"text": " | ".join(texts)[:800], "href": next((c["href"] for c in cells if c["href"]), None), "tag": "tr", "heading": None})
    whole = _tidy("".join(walker.text))
    if sum(len(b["text"]) for b in found) < 200 < len(whole):
        found = [{"text": t, "href": None, "tag": "p", "heading": None} for t in _segments(whole)]
    return [{"pos": k, **b} for k, b in enumerate(found)]


def html_blocks(pages: DataFrame, scope: str | None = None) -> DataFrame:
    """page_id, url, blocks: the leaf blocks of each page, then its table rows. `scope`: tag, .class or #id; pages may have their own in a column of that name."""
    own = "scope" in pages.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scopes = f["scope"].where(f["scope"].notna(), scope) if own else [scope] * len(f)
            blocks = [page_blocks(h, u, s) for h, u, s in zip(f["html"], f["url"], scopes, strict=True)]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "blocks": blocks})

    columns = ["page_id", "url", "html", *(["scope"] if own else [])]
    return spread(pages.select(*columns)).mapInPandas(run, f"page_id long, url string, blocks array<{BLOCK}>")


def is_price_table(text: Column, profile: rules.Profile = rules.OFFERS) -> Column:
    return text.rlike(rules.PRICE_UNIT) & ~has_any(text, profile.gift_words)


def block_score(text: Column, profile: rules.Profile = rules.OFFERS) -> Column:
    """Signals of an offer added up; under 12 characters 0."""
    t = blank(text)
    points = F.lit(0)
    for words, weight in ((profile.strong, 3), (profile.weak, 1), (profile.negative, -4)):
        for w in words:
            points = points + F.when(t.contains(w), weight).otherwise(0)
    for hit, weight in (
        (is_price_table(t, profile), -8), (t.rlike(r"(?U)之前为\s*[\d.]+\s*(?:美元|元)|\d+\s*美元[/／]|起(?:为|调整)"), -6),
        (t.rlike(r"(?U)\d+\s*(?:亿|万|k|K|M)\s*(?:个)?\s*(?:token|Token|TOKEN)"), 6), (t.rlike(r"(?U)(?:¥|￥|\$)\s*\d+"), 3),
        (t.rlike(r"(?U)\d{1,2}\s*月\s*\d{1,2}\s*日|\d{1,2}[/-]\d{1,2}"), 2), (F.length(t) > 600, -2),
    ):
        points = points + F.when(hit, weight).otherwise(0)
    return F.when(F.length(t) < 12, 0).otherwise(points)


def candidates(paged: DataFrame, min_score: int = 6, most: int = 25, profile: rules.Profile = rules.OFFERS, nearest_heading: bool = True) -> DataFrame:
    """(page_id, blocks) -> page_id, block_index, title, context, href, score: the best `most` passages of each page.

    A hit takes itself and what follows up to the next heading, five blocks at
    most; hits within what an earlier one took are part of it.
    """
    headings = F.filter(F.transform("blocks", lambda b: F.when(b["tag"].isin(*HEADINGS), b["pos"])), lambda p: p.isNotNull())
    marked = paged.withColumn("headings", headings)

    def until(pos: Column) -> Column:
        nexts = F.filter("headings", lambda h: h > pos)
        return F.least(pos + 5, F.coalesce(F.array_min(nexts), pos + 5), F.size("blocks"))

    def chosen(scores: Column) -> Column:
        def step(acc: Column, b: Column) -> Column:
            hit = (b["pos"] >= acc["until"]) & (b["tag"] != "tr") & (F.get(scores, b["pos"]) >= min_score)
            return F.when(hit, F.struct(until(b["pos"]).alias("until"), F.array_append(acc["hits"], b["pos"]).alias("hits"))).otherwise(acc)

        start = F.struct(F.lit(0).alias("until"), F.array().cast("array<int>").alias("hits"))
        return F.transform(F.aggregate("blocks", start, step)["hits"], lambda h: F.struct(h.alias("block_index"), F.get(scores, h).alias("own")))

    # bound by `let`: as a column of its own the optimizer would put it into the loop over blocks
    hits = let(F.transform("blocks", lambda b: block_score(b["text"], profile)), chosen)
    hits = marked.select("page_id", "blocks", "headings", F.explode(hits).alias("hit")).select("page_id", "blocks", "headings", "hit.*")
    own = F.get("blocks", F.col("block_index"))
    part = F.slice("blocks", F.col("block_index") + 1, until(F.col("block_index")) - F.col("block_index"))
    before = F.array_max(F.filter("headings", lambda h: (h < F.col("block_index")) & (h >= F.col("block_index") - 3)))
    own_heading = own["heading"] if nearest_heading else F.lit(None).cast("string")
    title = F.coalesce(own_heading, F.get("blocks", before)["text"], F.substring(F.get(F.split(own["text"], "\n"), F.lit(0)), 1, 90))
    context = clean_text(F.array_join(F.transform(part, lambda b: b["text"]), "\n"))
    href = F.coalesce(own["href"], F.get(F.filter(F.transform(part, lambda b: b["href"]), lambda h: h.isNotNull()), F.lit(0)))
    found = hits.select(
        "page_id", "block_index", F.substring(clean_text(title), 1, 120).alias("title"), F.explode(F.filter(F.array(context), lambda c: F.length(c) >= 12)).alias("full"), href.alias("href"), "own"
    )  # passages that are long enough; a filter on them would work each out twice
    ranked = found.select("page_id", "block_index", "title", F.substring("full", 1, 2000).alias("context"), "href", F.greatest("own", block_score(F.col("full"), profile)).alias("score"))
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "block_index")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
