"""Main text of web pages, by removing what a site repeats.

A first pass hashes the element subtrees of every page (tag, class, id, text) and counts, per host, on how
many pages of different content each occurs, and how many different contents the host has; copies of an
article count once. A subtree is the site's template if it recurs on FRAME_SHARE of the host's contents, on
at least FEWEST of them, and in any case if it recurs on RECURS_ON. The second pass deletes templates, next
to elements that name themselves as no article (``nav``, ``footer``, ``aside``, classes such as ``ad`` or
``comments``).

The main container is the ``article`` or ``main`` that holds a fair share of the page's words, else the
innermost element that holds most of them. It is chosen anew where it does not hold most of what the
templates leave. An article may share a passage with others. Prose (paragraphs, headings, list items, and anything of more than PROSE_WORDS words) therefore stays
in a declared container (``article``, ``main``), however often it recurs, and is deleted from any other only
if it recurs on PROSE_SHARE of the host's contents, again on at least FEWEST of them.

Defined results: a null, empty or text-only page gives its own text, "" if none; a null url is a host of
its own; broken markup is closed at its parent's end; repeated rows are each given; an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.shared import written
from signalsieve.llm.words import slices

FRAME_SHARE = 0.2  # of a host's different contents, for a subtree to be its template
FEWEST = 3  # contents that a template is on, however few the host has
RECURS_ON = 10  # contents that are enough, however many the host has
PROSE_SHARE = 0.5  # of a host's different contents, for prose inside a container that is not declared
HOST_PARTS = 16
HELD_TEMPLATES = 1_000_000  # template subtrees (8 bytes each) that a task may hold
PROSE_WORDS = 40
FAIR_SHARE = 0.3  # of the page's words, for an article or main element to be the container
MAX_DEPTH = 150
MOST = 0.7  # of an element's words, for its child to be looked into
OUT = "page_id long, url string, text string, n_chars long"

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript textarea title iframe object svg math select".split())
RAW_TEXT = set("script style textarea title iframe".split())  # end at their own end tag only; the rest of RAW holds elements
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
             "strike strong sub sup time tt u var wbr".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th caption figcaption".split())
BLOCKS_THAT_END_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                        "header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = set("html body div article section main table ul ol dl form td th header footer nav aside blockquote".split())
GONE_TAGS = set("head nav footer aside form button menu dialog header input".split())
GONE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner cookie cookies consent gdpr notice notices alert sidebar "
    "rail nav navbar navigation menu menus topbar footer header masthead comment comments reply replies respond "
    "disqus discussion share sharing social follow related recommended recommendations promo promotion "
    "promoted sponsored sponsor newsletter subscribe subscription signup login popup popover modal overlay breadcrumb "
    "breadcrumbs pagination pager toolbar skip widget widgets".split())
# names of parts that may well be longer than the article, and still are no article
READERS = set("comment comments reply replies respond disqus discussion related recommended recommendations".split())
GONE_ROLES = set("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
MODIFIERS = set("no has with without is not hide hides".split())

MARKUP = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
# possessive: the first sign of each piece decides, so that going back never finds another reading
TOKEN = re.compile(
    MARKUP + r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?P<close>>)?", re.S)
# behind a tag or quote that never ends: quotes say nothing, and a tag that is not closed before the next one is text
BROKEN = re.compile(MARKUP + r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attrs>[^<>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "children", "own", "words", "left", "gone", "hash")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []
        self.own = self.words = self.left = self.hash = 0  # words: in its own text, in all, in what is not gone
        self.gone = False

    def named(self) -> dict[str, str]:
        return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.attrs)}


def parse(text: str) -> Node:
    """The element tree of a page; unclosed elements end with their parent. Every part of the page is read a bounded
    number of times, however broken its markup is."""
    root = Node("#page")
    stack = [root]
    beside: dict[tuple[int, str], int] = {}  # open elements beyond MAX_DEPTH, by place in the stack and tag
    at, end_of_text, token = 0, len(text), TOKEN
    while at < end_of_text:
        m = token.search(text, at)
        if token is TOKEN and m and m["tag"] and not m["close"]:  # read to the end of the page, which happens once
            token = BROKEN
            m = token.search(text, at)
        if m is None:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            depth = 0
            for k in range(len(stack) - 1, 0, -1):
                if beside and beside.get((k, tag)):
                    beside[k, tag] -= 1  # of an element that was not pushed
                    del stack[k + 1 :]
                    depth = -1
                    break
                if stack[k].tag == tag:
                    depth = k
                    break
            # an inline end tag does not close blocks around it
            if depth > 0 and not (tag in INLINE and any(n.tag in SCOPES for n in stack[depth + 1 :])):
                del stack[depth:]
            if beside:
                beside = {key: n for key, n in beside.items() if n and key[0] < len(stack)}
            continue
        closes = ENDS.get(tag) or ({"p"} if tag in BLOCKS_THAT_END_P else None)
        if closes:
            implied = next((key for key in beside if key[0] == len(stack) - 1 and key[1] in closes and beside[key]), None)
            if implied:
                beside[implied] -= 1
            for k in range(len(stack) - 1, 0, -1):
                if implied:
                    break
                if stack[k].tag in closes:
                    del stack[k:]
                    beside = {key: n for key, n in beside.items() if key[0] < len(stack)}
                    break
                if stack[k].tag in ("template", "object") or stack[k].tag in SCOPES and stack[k].tag not in closes:
                    break
        node = Node(tag, m["attrs"])
        stack[-1].children.append(node)
        if tag in RAW_TEXT and not m["attrs"].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            at = end.end() if end else end_of_text
        elif tag in VOID or tag in ("svg", "math") and m["attrs"].endswith("/"):
            continue
        elif len(stack) < MAX_DEPTH or tag in RAW and stack[-1].tag not in RAW:
            stack.append(node)
        else:  # deeper elements lie side by side; their text stays
            key = len(stack) - 1, tag
            beside[key] = beside.get(key, 0) + 1
    return root


def _names(node: Node) -> set[str]:
    """The words by which class, id, role or style say that an element is no article."""
    if not node.attrs or node.attrs.isspace():
        return set()
    own = node.named()
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", "")):
        return {"hidden"}
    if own.get("role", "").lower() in GONE_ROLES:
        return {own["role"].lower()}
    found = set()
    for name in (own.get("class", "") + " " + own.get("id", "")).lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if parts and parts[0] not in MODIFIERS:
            found |= GONE_NAMES.intersection(parts)
    return found


def weigh(node: Node, host: str) -> None:
    """Fills the words and hashes of a tree, bottom up."""
    digest = xxhash.xxh64(f"{host}\n{node.tag}\n{node.attrs}")
    if node.tag in RAW:
        node.children.clear()
    for child in node.children:
        if isinstance(child, str):
            words = child.split()
            if words:
                node.own += len(words)
                digest.update(" ".join(words))
        else:
            weigh(child, host)
            node.words += child.words
            digest.update(child.hash.to_bytes(8, "little"))
    node.words += node.own
    node.hash = digest.intdigest()
    if node.tag in RAW:
        node.words = 0


def elements(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node):
            yield child
            yield from elements(child)


def mark(root: Node, most: float = MOST) -> Node:
    """Marks elements that are no article as gone, and returns the main container of what is not gone. Where none is
    declared, an element's child is looked into if it holds ``most`` of the words."""
    articles: list[Node] = []

    outer: set[int] = set()  # articles that lie in no other

    def walk(node: Node, in_article: bool, nested: bool) -> None:
        node.left = node.own
        for child in node.children:
            if isinstance(child, str) or child.gone:
                continue
            if child.tag in RAW:
                child.gone = True
                continue
            main = child.tag in ("article", "main") or "main" in child.attrs and child.named().get("role") == "main"
            held = len(articles)
            walk(child, in_article or main, nested or child.tag == "article")
            named = _names(child) if child.tag not in ("html", "body", "main") else set()
            if named == {"header"} and in_article:
                child.tag, named = "header", set()  # of an article's own header, the headings stay
            tagged = child.tag in GONE_TAGS and not (child.tag == "header" and in_article)
            # what holds an article, or is a form around most of a page, is not gone
            holds = any(a.left for a in articles[held:])
            around = child.words > max(PROSE_WORDS, root.words // 2)
            layout = around and not named & READERS and "hidden" not in named and child.tag in ("div", "section", "table", "td")
            if (named and (main or not holds) and not layout) or (
                tagged and not holds and not (around and child.tag == "form")
            ):
                child.gone = True
                del articles[held:]
                continue
            if main:
                articles.append(child)
                if child.tag == "article" and not nested:
                    outer.add(id(child))
            node.left += child.left

    walk(root, False, False)
    # the largest article that is fair in size, innermost among near equals
    own = [a for a in articles if a.tag == "article"]
    top = max(own, key=kept_words, default=None)
    if top is not None and top.left and top.left >= FAIR_SHARE * root.left and top.left >= MOST * sum(
        a.left for a in own if id(a) in outer
    ):
        return top
    best = max(articles, key=kept_words, default=None)
    if best is not None and best.left and best.left >= FAIR_SHARE * root.left:
        inner = [a for a in articles if a.tag == "article" and a.left >= MOST * best.left]
        return inner[0] if inner else best
    node = root
    while True:
        heavy = [c for c in node.children if isinstance(c, Node) and c.tag not in PROSE and c.tag not in INLINE
                 and kept_words(c) >= most * node.left]
        if not node.left or not heavy:
            return node
        node = heavy[0]


def kept_words(node: Node) -> int:
    return 0 if node.gone else node.left


def _host(url: str | None) -> str:
    if url is None:
        return ""
    found = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    return (found[1] if found else url.split("/")[0]).lower()


def blocks_of(node: Node) -> list[str]:
    """Text blocks in page order, character references decoded, white space inside them made one space."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        words = entities.unescape("".join(held)).split()
        if words:
            out.append(" ".join(words))
        held.clear()

    def walk(n: Node) -> None:
        for child in n.children:
            if isinstance(child, str):
                held.append(child)
            elif child.gone:
                if child.tag not in INLINE:
                    close()
            elif child.tag == "br":
                held.append(" ")
            elif child.tag in INLINE:
                walk(child)
            elif child.tag == "header":
                close()
                for part in elements(child):
                    if re.fullmatch(r"h[1-6]", part.tag) and not part.gone:
                        walk(part)
                        close()
            else:
                close()
                walk(child)
                close()

    walk(node)
    close()
    return out


def prepared(url: str | None, page: str | None) -> tuple[Node, Node]:
    """(tree, main container) of a page, weighed and marked."""
    root = parse(page or "")
    weigh(root, _host(url))
    return root, mark(root)


def _is_prose(node: Node) -> bool:
    return node.tag in PROSE or node.words > PROSE_WORDS


def _declared(main: Node) -> bool:
    return main.tag in ("article", "main") or "main" in main.attrs and main.named().get("role") == "main"


def removable(root: Node, main: Node) -> Iterator[tuple[Node, int]]:
    """(subtree, key) of those that are deleted where they recur: all outside the container, what is not prose inside
    it, and prose inside a container that is not declared. The key is the hash, its last bit set for such prose."""
    holds_main: set[int] = set()
    declared = _declared(main)

    def holders(node: Node) -> bool:
        found = node is main
        for child in node.children:
            if isinstance(child, Node) and holders(child):
                found = True
        if found:
            holds_main.add(id(node))
        return found

    holders(root)

    def walk(node: Node, inside: bool) -> Iterator[tuple[Node, int]]:
        for child in node.children:
            if isinstance(child, str) or child.tag in RAW or child.tag in INLINE or not child.words:
                continue
            if id(child) in holds_main:
                yield from walk(child, inside or child is main)
            elif not inside:
                yield child, child.hash & ~1
                yield from walk(child, False)
            elif not _is_prose(child):
                yield child, child.hash & ~1
            else:
                if not declared:
                    yield child, child.hash | 1
                if child.tag not in PROSE:
                    yield from walk(child, True)

    yield from walk(root, root is main)


def page_text(url: str | None, page: str | None, is_template) -> str:
    """The main text; ``is_template(keys)`` tells which subtrees recur on the host."""
    root, main = prepared(url, page)
    found = list(removable(root, main))
    drops = is_template([key for _, key in found]) if found else ()
    deleted = [node for (node, _), drop in zip(found, drops) if drop and not node.gone]
    for node in deleted:
        node.gone = True
    if deleted:
        again = mark(root, 1.0)  # without the frame, the article is all that is left
        if main.left < MOST * root.left:
            main = again
    return " ".join(blocks_of(main))


def _sites(pages: DataFrame) -> DataFrame:
    """(host, key, content): the removable subtrees of each page with the hash of its main text, and one row of each
    page without a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "html"):
                seen: set[tuple[int, int, int]] = set()
                pages_of: set[tuple[int, int]] = set()
                for url, page in zip(rows.column("url").to_pylist(), rows.column("html").to_pylist()):
                    root, main = prepared(url, page)
                    host = xxhash.xxh64_intdigest(_host(url))
                    content = xxhash.xxh64_intdigest(" ".join(blocks_of(main)))
                    pages_of.add((host, content))
                    seen.update((host, key, content) for _, key in removable(root, main))
                whole = np.array(list(pages_of), np.uint64).reshape(-1, 2).view(np.int64)
                parts = np.array(list(seen), np.uint64).reshape(-1, 3).view(np.int64)
                keys = pa.concat_arrays([pa.nulls(len(whole), pa.int64()), pa.array(parts[:, 1])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([whole[:, 0], parts[:, 0]])), keys,
                     pa.array(np.concatenate([whole[:, 1], parts[:, 2]]))], names=["host", "key", "content"])

    return pages.select("url", "html").mapInArrow(run, "host long, key long, content long")


def templates(pages: DataFrame, recurs_on: int = RECURS_ON, fewest: int = FEWEST) -> DataFrame:
    """(key) of the subtrees that recur on their host; the hash behind a key includes the host.

    Counted by host, key and content, then by host and key: a subtree on a third of all pages is combined in
    every task before it is shuffled. What recurs at all meets its host's number of contents, which lies in
    HOST_PARTS copies, so that the templates of one host are not one task's.
    """
    counted = written(
        _sites(pages).distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("key").isNull() | (F.col("n") >= min(fewest, recurs_on))), "html-counts")
    hosts = counted.where("key IS NULL").select(
        "host", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))).alias("part"), F.col("n").alias("contents"))
    found = counted.where("key IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(HOST_PARTS)).cast("int"))
    prose = F.col("key").bitwiseAND(F.lit(1)) == 1
    enough = F.greatest(F.lit(fewest), F.ceil(F.col("contents") * F.when(prose, PROSE_SHARE).otherwise(FRAME_SHARE)))
    enough = F.when(prose, enough).otherwise(F.least(F.lit(recurs_on), enough))
    return found.join(hosts, ["host", "part"]).where(F.col("n") >= enough).select("key")


def main_text(pages: DataFrame, recurs_on: int = RECURS_ON, held: int = HELD_TEMPLATES) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The template keys, while they are few enough to be ``held``, go to every task. Beyond that they are
    taken in parts: a pass for each part adds to each page which of its subtrees recur.
    """
    known = written(templates(pages, recurs_on), "html-templates")
    count = known.count()
    parts = max(1, -(-count // held))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.array().cast("array<bigint>").alias("found"))
    for k in range(parts):
        part = known if parts == 1 else known.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
        table = np.sort(part.toArrow().column("key").to_numpy().view(np.uint64))
        rows = _last(rows, table) if k == parts - 1 else _marked(rows, table)
    return rows


def _lookup(table: np.ndarray):
    def which(hashes: list[int]) -> np.ndarray:
        asked = np.array(hashes, np.uint64)
        if not len(table):
            return np.zeros(len(asked), bool)
        return table[np.minimum(np.searchsorted(table, asked), len(table) - 1)] == asked

    return which


def _marked(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``rows`` with the keys of a part of the templates added to ``found``."""
    which = _lookup(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for row in part.to_pylist():
                    hashes = [key for _, key in removable(*prepared(row["url"], row["html"]))]
                    mine = np.array(hashes, np.uint64)[which(hashes)].view(np.int64).tolist() if hashes else []
                    out.append(row["found"] + mine)
                columns = [*part.columns[:3], pa.array(out, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _last(rows: DataFrame, table: np.ndarray) -> DataFrame:
    which = _lookup(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for row in part.to_pylist():
                    before = np.array(row["found"], np.int64).view(np.uint64)
                    texts.append(page_text(row["url"], row["html"], lambda h: which(h) | np.isin(np.array(h, np.uint64), before)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, OUT)
