"""Main text of raw pages as Markdown-like text.

A small tokenizer in Python turns each page into blocks, (container, text) in page order; which container is the main
one and what its text is follows from the blocks in Spark expressions, page by page and without a shuffle.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.operators.settle import settle

# workers get this helper by value, so a job needs no extra files on the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DROPPED = {"script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "svg",
           "template", "button", "select", "head"}
# first parts of class and id names, such as the whole of "sidebar" and the first part of "ad-top"
BOILERPLATE = {"ad", "ads", "advert", "banner", "breadcrumb", "cookie", "menu", "promo", "related", "share", "sidebar", "social"}
FAIR_SHARE = 0.3  # of a page's text, for its article to be taken alone
BLOCKS = {"p", "div", "section", "ul", "ol", "table", "tr", "pre", "figure", "article", "main", "body", "dl"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`"}


def _boilerplate(named: str) -> bool:
    return any(re.split("[-_]", name)[0] in BOILERPLATE for name in named.lower().split())


CONTAINERS = ("article", "main", "body")
BLOCK = "struct<container:string,text:string>"


class _Tokenizer(HTMLParser):
    """Emits the blocks of a page; text in dropped elements is passed over."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url = url
        self.muted: list[str] = []  # open tags since a dropped one
        self.open: list[str] = []  # open tags around it
        self.blocks: list[dict] = []
        self.inside = {"article": 0, "main": 0}
        self.links: list[str] = []

    def _emit(self, text: str) -> None:
        place = next((k for k in ("article", "main") if self.inside[k]), "body")
        self.blocks.append({"container": place, "text": text})

    def handle_starttag(self, tag, attrs):
        if self.muted:
            if tag not in VOID:
                self.muted.append(tag)
            return
        at = dict(attrs)
        named = f"{at.get('class') or ''} {at.get('id') or ''}"
        inner = self.inside["article"] or self.inside["main"]
        if tag in DROPPED and not (tag == "header" and inner) or (
            tag not in ("article", "main", "body", "html") and _boilerplate(named)
        ):
            if tag not in VOID:
                self.muted.append(tag)
            return
        if tag not in VOID:
            self.open.append(tag)
        if tag in self.inside:
            self.inside[tag] += 1
        if re.fullmatch("h[1-6]", tag):
            self._emit("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self._emit("\n- ")
        elif tag == "blockquote":
            self._emit("\n\n> ")
        elif tag == "br":
            self._emit("\n")
        elif tag in BLOCKS:
            self._emit("\n\n")
        elif tag in MARKS:
            self._emit(MARKS[tag])
        elif tag == "a":
            self.links.append(urljoin(self.url, at.get("href") or ""))
            self._emit("[")

    def handle_endtag(self, tag):
        if self.muted:
            if tag in self.muted:
                while self.muted.pop() != tag:
                    pass
                return
            if tag not in self.open:
                return
            self.muted.clear()  # an unclosed dropped element ends with its parent
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag in MARKS:
            self._emit(MARKS[tag])
        elif tag == "a" and self.links:
            self._emit(f"]({self.links.pop()})")
        elif tag in BLOCKS or tag == "blockquote" or re.fullmatch("h[1-6]", tag):
            self._emit("\n\n")
        if tag in self.inside and self.inside[tag]:
            self.inside[tag] -= 1

    def handle_data(self, data):
        if not self.muted:
            self._emit(re.sub(r"\s+", " ", data))


def _blocks_of(html: str | None, url: str | None) -> list[dict]:
    tokenizer = _Tokenizer(url or "")
    try:
        tokenizer.feed(html or "")
        tokenizer.close()
    except (AssertionError, ValueError):
        return []  # a page that cannot be read has no text
    return tokenizer.blocks


def page_blocks(pages: DataFrame, max_bytes: int = 0) -> DataFrame:
    """page_id, url, blocks (container and text, in page order) of (page_id, url, html) rows, from whole pages.
    With ``max_bytes`` set, input beyond it is not read, as when a page was loaded in part."""
    cap = F.col("html")
    if max_bytes > 0:
        # characters first (cheap, JVM-side), exact bytes in the worker
        cap = F.when(F.octet_length("html") > max_bytes, F.substring("html", 1, max_bytes)).otherwise(F.col("html"))
    kind = pa.list_(pa.struct([("container", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for html, url in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist()):
                if html is not None and max_bytes > 0:
                    html = html.encode("utf-8")[:max_bytes].decode("utf-8", "ignore")
                found.append(_blocks_of(html, url))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, kind)], names=["page_id", "url", "blocks"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", cap.alias("html")).mapInArrow(
        run, f"page_id long, url string, blocks array<{BLOCK}>")


def block_rows(blocks: DataFrame) -> DataFrame:
    """page_id, url, block (from 0), container, text: the blocks of ``page_blocks`` as rows."""
    return blocks.select("page_id", "url", F.posexplode("blocks").alias("block", "_b")).select("page_id", "url", "block", "_b.*")


def _joined(blocks: Column, container: str) -> Column:
    """Text of a container; empty marks, spaces around line ends and blank lines beyond one are dropped."""
    mine = F.filter(blocks, lambda b: b["container"] == container)
    text = F.array_join(F.transform(mine, lambda b: b["text"]), "")
    text = F.regexp_replace(text, r"\*\*\s*\*\*|\[\s*\]\([^)]*\)", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n")
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def _words(blocks: Column, container: str) -> Column:
    words = lambda b: F.regexp_count(b["text"], F.lit(r"\S+"))
    mine = F.filter(blocks, lambda b: b["container"] == container)
    return F.aggregate(F.transform(mine, words), F.lit(0), lambda a, n: a + n)


def main_text(blocks: DataFrame) -> DataFrame:
    """page_id, url, full_content: the article or main text if it is a fair share of the page's words, else that of
    the largest container; null where there is none."""
    kept = ["page_id", "url"]
    named = blocks.select(*kept, F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")).alias("blocks"))
    sized = settle(named, [*kept, "blocks"], {f"_{c}": _words(F.col("blocks"), c) for c in CONTAINERS})
    total = sum((F.col(f"_{c}") for c in CONTAINERS), F.lit(0))
    ranked = []
    for i, c in enumerate(CONTAINERS):
        size = F.col(f"_{c}")
        fair = (size >= F.lit(FAIR_SHARE) * total) & F.lit(c != "body")
        # fair containers first in their order, then the largest
        ranked.append(F.struct(
            F.when(fair, 0).otherwise(1).alias("a"), F.when(fair, i).otherwise(-size).alias("b"), F.lit(i).alias("c"),
            _joined(F.col("blocks"), c).alias("text")))
    best = F.array_min(F.filter(F.array(*ranked), lambda r: r["text"] != ""))
    return sized.select(*kept, best["text"].alias("full_content"))


def page_main_text(pages: DataFrame, max_bytes: int = 0) -> DataFrame:
    """(page_id, url, html) rows to (page_id, url, full_content); ``max_bytes`` as in ``page_blocks``."""
    return main_text(page_blocks(pages, max_bytes))
