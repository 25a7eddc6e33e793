"""Operators over pages and archives."""

import gzip
import hashlib
import random
import time

import pytest

from signalsieve.llm import html_text, queries, warc

SF = "/root/testdata/sf0.001"


def text_of(page, url="http://h.example/x", drop=()):
    return html_text.page_text(url, page, lambda hashes: [h in drop for h in hashes])


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain &amp; text\n here", "plain & text here"),
    ("<nav>menu</nav><article><h1>T</h1><p>a<b>b</b> c&nbsp;d</p><p>e</p></article><footer>f</footer>", "T ab c d e"),
    ("<article><p><b>open<br><p>next</article>", "open next"),
    ('<div class="wrap no-sidebar"><p>kept words here</p></div>', "kept words here"),
    ("<form><div><p>" + "word " * 60 + "</p></div></form>", ("word " * 60).strip()),
    ("<article>Teaser</article><div id=c><p>" + "long text " * 60 + "</p></div>", ("long text " * 60).strip()),
    ("<article><p>text</p><div class='comments'><p>me too</p></div><div class=share>fb</div><aside>x</aside></article>", "text"),
    ("<article><p>one</p></article><section id='comments'><article class='comment'>reply reply reply</article></section>", "one"),
    ("<main><h1>T</h1><table><tr><td>1</td><td>2</td></tr></table><ul><li>x<li>y</ul></main>", "T 1 2 x y"),
    ("<article><p>a</p><script>var x='<p>no</p>';</script><style>p{}</style><!-- no --><p hidden>no</p><p>b</p></article>", "a b"),
    ("<article><p>a &lt;b&gt; &#233; &unknown; c</p></article>", "a <b> é &unknown; c"),
    ("<body><header><h1>Site</h1></header><article><header><h1>Title</h1><span>by me</span></header><p>x</p></article>", "Title x"),
    ("<div><div class='cookie-notice'>accept</div><div class='ad'>buy</div><p>the text of it</p></div>", "the text of it"),
    ("<main><article><p>" + "own " * 30 + "</p></article><div>" + "other " * 25 + "</div></main>", ("own " * 30).strip()),
    ("<div class='content-with-sidebar'><p>" + "body " * 50 + "</p><div class='sidebar'>links here</div></div><p>x</p>", ("body " * 50).strip()),
    ("<article><div class='post-header'><h1>T</h1><span>by me</span></div><p>text</p></article>", "T text"),
    ("<div><p>short</p></div><div class='comments'>" + "long talk " * 60 + "</div>", "short"),
    ("<article><p>1 < 2 and <notclosed", "1 < 2 and <notclosed"),
])
def test_single_pages(page, want):
    assert text_of(page) == want


def test_deep_and_long_pages():
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    long_page = "<article>" + "".join(f"<p>para {i} of many</p>" for i in range(20_000)) + "</article>"
    assert len(text_of(long_page).split()) == 80_000


SHARED = "a passage of more than forty words that many pages of the site have in common " * 4
LEGAL = "<p>" + "terms that stand below the text of every page of this site and are of no interest to anyone " * 3 + "</p>"
LINKS = "<div>" + "".join(f"<div>more from this site number {k}</div>" for k in range(40)) + "</div>"


def site(n, menu="<div><div>Home Shop About</div></div>"):
    """Pages without any telling tag or class: the same frame on all, links that are longer than the articles, a
    passage on two of five articles, and copies of one article."""
    def page(i):
        body = f"article {i if i % 4 else 0} " + " ".join(f"own{i if i % 4 else 0}_{k}" for k in range(80))
        shared = f"<p>{SHARED}</p>" if i % 5 < 2 else f"<p>the end of {i if i % 4 else 0}</p>"
        return (f"<html><body>{menu}<div><div>{body}</div>{shared}<div>Read it aloud</div>{LEGAL}</div>{LINKS}"
                "<div>All rights with us</div></body></html>")

    return [(i, f"http://site.example/{i}", page(i)) for i in range(n)]


def plain_texts(pages):
    """The texts by counting subtrees of all pages in one dictionary."""
    on, contents = {}, {}
    for _, url, page in pages:
        root, main = html_text.prepared(url, page)
        content = " ".join(html_text.blocks_of(main))
        contents.setdefault(html_text._host(url), set()).add(content)
        for _, key in html_text.removable(root, main):
            on.setdefault((html_text._host(url), key), set()).add(content)

    def recurs(url):
        host = html_text._host(url)

        def which(keys):
            out = []
            for key in keys:
                n, of = len(on[host, key]), len(contents[host])
                out.append(n >= 3 and (n >= 0.5 * of if key % 2 else n >= 10 or n >= 0.2 * of))
            return out
        return which

    return {i: html_text.page_text(url, page, recurs(url)) for i, url, page in pages}


@pytest.mark.parametrize("tag", ["select", "svg", "math", "object", "template", "noscript"])
def test_unclosed_elements_end_with_their_parent(tag):
    page = f"<body><article><div><{tag}><b>gone</div><p>the rest of the article stays</p></article></body>"
    assert html_text.page_text("u", page, lambda h: [False] * len(h)) == "the rest of the article stays"
    page = f"<body><article><{tag}><b>gone</b></{tag}><p>the text</p></article></body>"
    assert html_text.page_text("u", page, lambda h: [False] * len(h)) == "the text"


def test_ends_of_deep_elements_close_nothing_else():
    deep = "<div>" * 200 + "deep" + "<select><option>gone</select>" + "</div>" * 200
    page = f"<body><p>outside</p><div><article>{deep}<p>the rest of the article stays</p></article></div></body>"
    assert html_text.page_text("u", page, lambda h: [False] * len(h)) == "deep the rest of the article stays"


@pytest.mark.parametrize("n", [40, 7])
def test_frames_are_removed_and_passages_stay(spark, n):
    pages = spark.createDataFrame([(*p, "x") for p in site(n)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    for i in range(n):
        own = i if i % 4 else 0
        words = " ".join(f"own{own}_{k}" for k in range(80))
        end = SHARED.strip() if i % 5 < 2 else f"the end of {own}"
        assert got[i].startswith(f"article {own} {words}") and LEGAL[3:40] not in got[i] and "more from" not in got[i]
        assert n < 40 or got[i] == f"article {own} {words} {end}"
    assert not any("Home" in t or "Read it aloud" in t or "All rights" in t for t in got.values())


def test_without_its_templates_a_page_is_read_elsewhere():
    [(_, url, page)] = site(1)
    assert "more from this site number 0 more" in html_text.page_text(url, page, lambda keys: [False] * len(keys))


def test_two_pages_prove_no_frame(spark):
    pages = spark.createDataFrame(site(3)[1:], "page_id long, url string, html string")
    assert all("Read it aloud" in r.text or "more from" in r.text for r in html_text.main_text(pages).collect())


def test_prose_of_a_declared_article_stays(spark):
    rows = [(i, "http://d.example/", f"<nav>menu</nav><article><h1>Weather</h1><p>own words {i}</p>{LEGAL}<div>Share it</div></article>")
            for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_text.main_text(pages).collect():
        assert r.text == f"Weather own words {r.page_id} {LEGAL[3:-4].strip()}"


def test_counts_and_removals_agree_with_plain_counting(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        host = rng.choice(["big", "big", "big", "small", "tiny", f"one{i}"])
        parts = [f"<div>own text {rng.randrange(60)} {'word ' * rng.randrange(30)}</div>"]
        parts += [f"<{tag}>part {k} of {host} {'more ' * size}</{tag}>" for k, (tag, size, odds) in enumerate(
            [("div", 2, 0.9), ("div", 60, 0.7), ("p", 5, 0.6), ("p", 50, 0.4), ("li", 3, 0.3), ("section", 4, 0.15)])
            if rng.random() < odds]
        rng.shuffle(parts)
        tag = rng.choice(["div", "div", "article"])
        rows.append((i, f"http://{host}.example/{i}", f"<body>{parts[0]}<{tag}>{''.join(parts[1:])}</{tag}></body>"))
    want = plain_texts(rows)
    assert want != {i: html_text.page_text(u, p, lambda keys: [False] * len(keys)) for i, u, p in rows}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in html_text.main_text(pages).collect()} == want
    assert {r.page_id: r.text for r in html_text.main_text(pages, held=2).collect()} == want


def test_copies_of_a_page_are_no_template(spark):
    page = "<div><div>the one article that all copies have</div><div>with two parts of text</div></div>"
    pages = spark.createDataFrame([(i, "http://c.example/", page) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in html_text.main_text(pages).collect()} == {"the one article that all copies have with two parts of text"}


def test_parts_of_templates_agree(spark):
    pages = spark.createDataFrame(site(24), "page_id long, url string, html string")
    n = html_text.templates(pages).count()
    assert n > 3
    assert sorted(html_text.main_text(pages).collect()) == sorted(html_text.main_text(pages, held=-(-n // 3)).collect())


def test_odd_page_rows(spark):
    rows = [(None, None, None), (1, None, "<p>x</p>"), (2, "", ""), (2, "", ""), (3, "no address", "<article>y</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.main_text(pages).collect())
    assert got == [("1", "x", 1), ("2", "", 0), ("2", "", 0), ("3", "y", 1), ("None", "", 0)]
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_given_pages_keep_their_article(spark):
    import html as entities
    import re

    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.sub(r"</?(b|i|em|strong|a|span)\b[^>]*>", "", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        want[r.page_id] = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", body)).split())
    got = queries.op5_html_text(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


# --- archives


PAGES = [(1, "http://a/ b\n", "x" * 1000), (2, None, "x" * 1000), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "short"),
         (6, "http://f", "short"), (7, "http://g", "é" * 600 + "\r\n\r\nWARC/1.1\r\n\n"), (None, "http://h", "x" * 1000),
         (8, "http://i", "z" * 3_000_000), (8, "http://i", "z" * 3_000_000), (9, "http://j", "y" * 999), (10, "http://k", "y" * 999)]


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, file int").repartition(3)
    arc, out = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    warc.write_arc(pages, arc)
    records = warc.read_arc(spark, arc)
    assert {r.version for r in records.collect()} == {1, 2}
    assert records.where("mime <> 'filedesc' AND error IS NULL").count() == len(PAGES)
    warc.to_warc(spark, arc, out)
    got = warc.read_warc(spark, out).where("record_type <> 'warcinfo'").collect()
    assert len(got) == len(PAGES) and len({r.record_id for r in got}) == len(PAGES)
    by_id = {}
    for r in got:
        by_id.setdefault(r.row_id, []).append(r)
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        for r in by_id[page_id]:
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
    kind = lambda i: [(r.record_type, r.refers_to_row) for r in by_id[i]]
    assert kind(2) == [("response", None)] and kind(1) == kind(None) == [("revisit", 2)]
    assert sorted(kind(8)) == [("response", None), ("revisit", 8)]
    assert all(kind(i) == [("response", None)] for i in (3, 4, 5, 6, 7, 9, 10))
    ids = {r.row_id: r.record_id for r in got if r.record_type == "response"}
    assert all(r.refers_to == ids[r.refers_to_row] for r in got if r.record_type == "revisit")


def test_archives_of_nothing(spark, tmp_path):
    warc.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    warc.to_warc(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/w")
    assert warc.read_warc(spark, f"file://{tmp_path}/w").where("record_type <> 'warcinfo'").count() == 0


def test_versions_dates_and_broken_files(spark, tmp_path):
    head = "filedesc://x.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 test\nURL IP-address Archive-date Content-type Archive-length\n"
    body = "HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhello"
    head = head.replace(" 76\n", f" {len(head.split(chr(10), 1)[1])}\n")
    one = f"{head}\nhttp://a b/c 1.2.3.4 199609231421 text/html {len(body)}\n{body}\n"
    dns = "dns:a 1.2.3.4 19960923 text/dns 4\n1.2.\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.arc").write_bytes((one + dns).encode())
    (tmp_path / "in/two.arc.gz").write_bytes(gzip.compress(one.encode()) + gzip.compress(b"http://x 1.2.3.4 2 text/html 900\nshort"))
    got = warc.read_arc(spark, f"file://{tmp_path}/in").collect()
    assert sum(r.error is not None for r in got) == 1
    good = [r for r in got if r.error is None and r.mime != "filedesc"]
    assert [r.url for r in good].count("http://a b/c") == 2 and {bytes(r.payload) for r in good} == {b"hello", b"1.2."}
    warc.to_warc(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    out = {(r.record_type, r.url, r.date) for r in warc.read_warc(spark, f"file://{tmp_path}/out").collect()}
    assert ("response", "http://a b/c", "1996-09-23T14:21:00Z") in out and ("resource", "dns:a", "1996-09-23T00:00:00Z") in out
    assert any(kind == "warcinfo" for kind, _, _ in out)


@pytest.mark.parametrize("piece", ["<", "<a", '<a "', "<b x ", "<a '", '<i x="', "</a ", "<!", "<p<", '"<b>'])
def test_long_broken_markup_is_read_in_linear_time(piece):
    page = "<p>first</p>" + (piece * (500_000 // len(piece)) if piece != "<a" else "<" + "a" * 500_000)
    began = time.process_time()
    root = html_text.parse(page)
    assert time.process_time() - began < 3
    assert root.children[0].tag == "p" and root.children[0].children == ["first"]


def test_text_behind_broken_markup_stays():
    def text(page):
        return html_text.page_text("http://a/b", page, lambda hashes: [False] * len(hashes))

    assert text('<p>one</p><p>two <a href="x>three</a> four</p><p>five</p>').split()[:2] == ["one", "two"]
    assert text('<p>one</p><p>two <a href="x>three</a> four</p><p>five</p>').endswith("five")
    assert text("if a <b then c") == "if a <b then c"
    assert text('<p title="a > b">one <b class=\'<i>\'>two</b></p>') == "one two"


def _arc(version, *records):
    return warc.arc_head(version, "x.arc") + b"\n" + b"".join(r + b"\n" for r in records)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("harm", [b"a stray line\n", b"http://a/ 0.0.0.0 20240101000000 text/html -3\n", b"\xff\xfe\x00\n\n1 2 3\n",
                                  b"http://a/ 0.0.0.0 20240101000000 text/html 99999999\n"])
def test_damaged_archives_keep_what_follows(spark, tmp_path, version, harm):
    records = [warc.arc_record(version, "x.arc", k, f"http://h/{k}", b"payload %d" % k, 0) for k in range(4)]
    data = _arc(version, records[0], records[1]) + harm + b"".join(r + b"\n" for r in records[2:])
    got = list(warc.parse_arc("x.arc", data))
    assert [r[9] for r in got if r[-1] is None and r[6] != "filedesc"] == [b"payload %d" % k for k in range(4)]
    errors = [r for r in got if r[-1] is not None]
    assert len(errors) == 1 and data[errors[0][1]:].startswith(harm[:1])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.arc").write_bytes(data)
    paths = [f"file://{tmp_path}/{n}" for n in ("in", "out", "errors")]
    warc.to_warc(spark, paths[0], paths[1], errors_path=paths[2])
    assert warc.read_warc(spark, paths[1]).where("record_type = 'response' AND error IS NULL").count() == 4
    assert [r.offset for r in spark.read.parquet(paths[2]).collect()] == [errors[0][1]]


def test_damaged_warc_keeps_what_follows():
    def record(k, length=None):
        return (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: u{k}\r\nContent-Length: "
                f"{length if length is not None else 4}\r\n\r\nbody\r\n\r\n").encode()

    got = list(warc.parse_warc("x", record(1) + b"junk\n" + record(2) + record(3, -4) + record(4) + record(5, 10 ** 9) + record(6)))
    assert [r[4] for r in got if r[-1] is None] == ["u1", "u2", "u4", "u6"]
    assert sum(r[-1] is not None for r in got) == 3
