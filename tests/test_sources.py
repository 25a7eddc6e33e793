import json

from pyspark.sql import functions as F

from signalsieve import schemas
from signalsieve.functions import fixed_values as fv
from signalsieve.operators import catalog as C
from signalsieve.sources import directories as DIR
from signalsieve.sources import victims as V
from signalsieve.sources.feeds import author_name, feed_date, read_feed_files, scan_feed_xml
from signalsieve.sources.pages import block_rows, page_blocks, page_main_text
from signalsieve.sources.tables import INPUT_PARTITIONS, scan_items, spread


def test_feed_dates_and_authors(values):
    assert values(feed_date, ["Tue, 02 Jan 2024 10:00:00 GMT", "2 Jan 2024 10:00 +0100", "2024-01-02T03:04:05Z", "soon", None,
                              "2024-01-02 03:04:05"]) == [
        "2024-01-02T10:00:00Z", "2024-01-02T09:00:00Z", "2024-01-02T03:04:05Z", "", "", "2024-01-02T03:04:05Z"]
    assert values(author_name, ["a@b.org (Ann B)", "Ann B <a@b.org>", "a@b.org", "Ann"]) == ["Ann B", "Ann B", "", "Ann"]


def test_scan_rss_and_atom(spark):
    rss = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title>
      <item><title> One </title><link> https://a/1 </link><description>&lt;p&gt;x&lt;/p&gt; https://f/a.zip.</description>
        <dc:creator>Bo</dc:creator><category>k</category><category/><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>
      <item><title>no link</title></item><item><link>https://a/3</link></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>[x] Two</title><link rel="enclosure" href="e"/>
      <link href="https://b/2"/><updated>2024-01-02T03:04:05Z</updated><author><name>Al</name></author></entry></feed>"""
    df = spark.createDataFrame([("s", rss), ("t", atom), ("u", "broken <"), ("v", "")], "site_name string, xml string")
    rows = {r.link: r for r in scan_feed_xml(df).collect()}
    assert set(rows) == {"https://a/1", "https://b/2"}
    one, two = rows["https://a/1"], rows["https://b/2"]
    assert (one.title, one.author, one.category, one.content) == ("[s] One", "Bo", "k", "x https://f/a.zip.")
    assert one.pub_date == "2024-01-02T10:00:00Z" and one.download_links == ["https://f/a.zip"]
    assert (two.title, two.author, two.pub_date, two.position) == ("[x] Two", "Al", "2024-01-02T03:04:05Z", 0)


def test_feed_files_batch_and_stream(spark, tmp_path):
    doc = "<rss><channel><item><title>T</title><link>https://a/{}</link></item></channel></rss>"
    for site in ("my site", "b"):
        (tmp_path / "in" / site).mkdir(parents=True)
        (tmp_path / "in" / site / "f.xml").write_text(doc.format(site[0]))
    rows = scan_feed_xml(read_feed_files(spark, str(tmp_path / "in"))).collect()
    assert sorted(r.title for r in rows) == ["[b] T", "[my site] T"]
    stream = scan_feed_xml(read_feed_files(spark, str(tmp_path / "in"), streaming=True)).select("link", "site_name")
    run = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.link, r.site_name) for r in got) == [("https://a/b", "b"), ("https://a/m", "my site")]


def test_victim_lists(spark, tmp_path):
    live = [{"victim": "V", "group": "g", "attackdate": "d", "country": "US", "activity": "A", "description": "D"},
            {"victim": "W", "group": "g", "claim_url": "https://c"}]
    df = spark.createDataFrame([("s", json.dumps(live))], "site_name string, json string")
    a, b = V.scan_victims_live(df).orderBy("position").collect()
    assert (a.title, a.link, a.content) == ("[G] V (US)", fv.VICTIMS_LIVE_LINK, "[A] D")
    assert (b.title, b.link, b.content, b.pub_date) == ("[G] W", "https://c", "", "")
    posts = [{"post_title": f"P {i}", "group_name": "G"} for i in range(250)] + [{"post_title": ""}]
    df = spark.createDataFrame([("s", json.dumps(posts))], "site_name string, json string")
    assert V.scan_victims_watch(df).count() == 250 and V.scan_victims_watch(df, 200).count() == 200
    assert V.scan_victims_watch(df, limit=0).count() == 250
    [look] = V.scan_victims_look(df.limit(1)).filter("position = 3").collect()
    assert look.link == fv.VICTIMS_LOOK_PREFIX + "g#p-3"
    (tmp_path / "v.json").write_text(json.dumps(live, indent=1))
    landed = V.read_victims(spark, str(tmp_path / "v.json"))
    assert landed.first().site_name == "v" and V.scan_victims_live(landed).count() == 2


def test_main_text(spark):
    html = ("<html><head><title>x</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>Head</h1>"
            "<p>One <b>two</b> <a href='/x'>link</a></p><script>no()</script><ul><li>a<li>b</ul></article><footer>f</footer></body></html>")
    pages = {
        html: "# Head\n\nOne **two** [link](https://e.org/x)\n\n- a\n- b",
        "<body><p>only</p></body>": "only",
        "<nav>x</nav>": None,
        None: None,
        '<div class="wrap no-sidebar"><p>kept</p></div><div class="ad-top">x</div>': "kept",
        "<form><p>forum post</p></form>": "forum post",
        "<div><nav>unclosed</div><p>rest</p>": "rest",
        "<article>hi</article><div>" + "long text " * 9 + "</div>": ("long text " * 9).strip(),
        "<article> </article><main>in main</main><p>some other words out here</p>": "some other words out here",
        "<article>two words</article><main>and two</main><p>x y</p>": "two words",
        "<p>a &amp; b&nbsp;&lt;c&gt;</p><b> </b><a href='u'> </a>": "a & b <c>",
    }
    order = list(pages)
    df = spark.createDataFrame([(i, "https://e.org/p", h) for i, h in enumerate(order)], "page_id long, url string, html string")
    found = {r.page_id: r.full_content for r in page_main_text(df).collect()}
    assert [found[i] for i in range(len(order))] == [pages[h] for h in order]
    assert page_main_text(df.limit(0)).count() == 0


def test_page_blocks(spark):
    html = "<nav>menu</nav><article>one<br>two</article>three"
    df = spark.createDataFrame([(1, None, html), (1, None, html), (None, "u", None)], "page_id long, url string, html string")
    rows = block_rows(page_blocks(df))
    got = sorted((r.block, r.container, r.text) for r in rows.filter("page_id = 1").collect() if r.text.strip())
    assert got == sorted(2 * [(1, "article", "one"), (3, "article", "two"), (5, "body", "three")])
    assert rows.filter("page_id IS NULL").count() == 0 and page_main_text(df).count() == 3


def test_capped_pages(spark):
    html = "<article><h1>Head</h1><p>x</p></article>"
    df = spark.createDataFrame([(1, "u", html), (2, "u", ""), (3, "u", "<p>" + "é" * 50)], "page_id long, url string, html string")
    rows = {r.page_id: r.full_content for r in page_main_text(df, max_bytes=0).collect()}
    assert rows[2] is None and rows[1].startswith("# Head") and len(rows[3]) == 50
    capped = {r.page_id: r.full_content for r in page_main_text(df, max_bytes=10).collect()}
    assert capped[3] == "é" * 3  # 10 bytes: the tag and three two-byte characters


def test_directory_links(spark):
    lines = [(1, "| [A (mirror)](https://a.org/) ONLINE | [B](https://b.org) | ONLINE |"), (2, "[A2](https://a.org)ONLINE"),
             (3, "[C](https://c.onion) ONLINE"), (4, "[D](http://d.org) ONLINE [E](https://e.org) OFFLINE")]
    df = spark.createDataFrame(lines, "line_no long, line string")
    assert sorted((r.name, r.base) for r in DIR.directory_links(df).collect()) == [("A", "https://a.org")]
    got = sorted((r.name, r.base) for r in DIR.directory_links(df, "next_cell").collect())
    assert got == [("B", "https://b.org")]


def test_table_feed_urls(spark):
    lines = [(1, "h|ONLINE|https://h/rss.xml|x|y"), (2, "---|ONLINE|https://h2/rss|x|y"),
             (3, "| [N](x) | https://a/feed/?q=1 z | ONLINE | https://b/r.atom |"), (4, "| none | https://c/rss | ONLINE | https://d/x.xml |"),
             (5, "| [M](x) | https://a/feed/?q=1 | ONLINE | y |"), (6, "| [M](x) | https://z.onion/rss | ONLINE | y |"), (7, "| https://q/rss | ONLINE")]
    df = spark.createDataFrame(lines, "line_no long, line string")
    got = [(r.name, r.rss_url) for r in DIR.table_feed_urls(df).orderBy("line_no", "cell").collect()]
    assert got == [("N (ransom)", "https://a/feed/?q=1"), ("N (ransom)", "https://b/r.atom"),
                   ("https://c/rss (ransom)", "https://c/rss"), ("https://c/rss (ransom)", "https://d/x.xml")]


def test_read_lines_numbers_in_order(spark, tmp_path):
    (tmp_path / "d.md").write_text("a\nb\r\nc")
    rows = DIR.read_lines(spark, str(tmp_path / "d.md")).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == [(1, "a"), (2, "b"), (3, "c")]


def test_outlines(spark):
    opml = """<opml><body><outline text="Leaked"><outline text="Data &amp; Breach" title="t" xmlUrl="https://a?x=1&amp;y=2">
      <outline text='deep paste > x' xmlUrl='https://b'/></outline></outline><outline text="food" xmlUrl="https://c"/></body></opml>"""
    df = spark.createDataFrame([(opml,)], "opml string")
    assert [(r.name, r.rss_url) for r in DIR.outline_feeds(df).orderBy("position").collect()] == [
        ("Data & Breach", "https://a?x=1&y=2"), ("deep paste > x", "https://b")]


def source_rows(spark, rows):
    return spark.createDataFrame(rows, "name string, rss_url string, enabled boolean, position int")


def test_merge_sources_priority(spark):
    seed = source_rows(spark, [("A", "seed", True, 0), ("B", "seed", True, 1), ("C", "seed", True, 2)])
    found = source_rows(spark, [("a", "found", True, 0), ("D", "first", True, 1), ("d", "second", True, 2)])
    local = source_rows(spark, [("b", "local", True, 0), ("C", "", True, 1)])
    remote = source_rows(spark, [("B", "remote", False, 0), ("E", "remote", True, 1), ("", "x", True, 2)])
    got = sorted((r.source_key, r.rss_url, r.origin) for r in C.merge_sources(seed, found, local, remote).collect())
    assert got == [("a", "seed", "seed"), ("c", "seed", "seed"), ("d", "first", "discovered"), ("e", "remote", "remote")]


def test_probing(spark):
    bases = spark.createDataFrame([("n", "https://a"), ("m", "https://b")], "name string, base string")
    cand = C.probe_candidates(bases)
    assert cand.count() == 2 * len(fv.FEED_PATHS)
    probes = spark.createDataFrame(
        [("https://a/feed/", 200, "<rss"), ("https://a/rss.xml", 200, "<feed"), ("https://b/feed/", 200, "<html>"),
         ("https://b/rss.xml", 404, "<rss"), ("https://b/index.rss", None, "<rss")], "url string, status int, body string")
    assert [(r.base, r.rss_url) for r in C.first_live_endpoint(cand, probes).collect()] == [("https://a", "https://a/feed/")]
    late_body = F.concat(F.repeat(F.lit(" "), 4096), "body")
    assert probes.select(C.is_feed_payload(F.lit(200), late_body).alias("x")).where("x").count() > 0
    late = probes.select(C.is_feed_payload(F.lit(200), late_body, 4096).alias("x"))
    assert not any(r.x for r in late.collect())
    sources = spark.createDataFrame([("i", "internal://x"), ("l", "https://a/feed/"), ("d", "https://dead")], "name string, rss_url string")
    assert sorted(r.name for r in C.alive_sources(sources, probes).collect()) == ["i", "l"]


def test_toggles(spark):
    src = source_rows(spark, [("my.feed", "u", True, 0), ("other", "u", False, 1)])
    sw = spark.createDataFrame([("MY_FEED", False)], "toggle_key string, enabled boolean")
    assert {r.name: r.enabled for r in C.toggle_sources(src, sw).collect()} == {"my.feed": False, "other": False}


def test_scan_items_adds_columns(spark, tmp_path):
    spark.createDataFrame([(1, "t", "l")], "id long, title string, link string").write.parquet(str(tmp_path / "i"))
    assert scan_items(spark, str(tmp_path / "i")).columns == schemas.ITEMS.fieldNames()


def test_spread_follows_its_setting(spark):
    df = spark.range(10, numPartitions=1)
    assert spread(df).rdd.getNumPartitions() == int(spark.conf.get(INPUT_PARTITIONS))
    own = spark.newSession()
    own.conf.unset(INPUT_PARTITIONS)
    if own.conf.get(INPUT_PARTITIONS, None) is None:
        assert spread(own.range(10, numPartitions=1)).rdd.getNumPartitions() == 1


def test_resolve_catalogue(spark):
    from signalsieve.plans.catalogue import DirectoryDocuments, discovered_sources, resolve_sources

    def lines(*texts):
        return spark.createDataFrame(list(enumerate(texts, 1)), "line_no long, line string")

    docs = DirectoryDocuments(
        forum_lines=lines("[Forum](https://f.org/) ONLINE", "[Dead](https://dead.org) ONLINE"),
        ransom_lines=lines("h", "-", "| [Gang](x) | https://g.org/rss | ONLINE | y |"),
        market_lines=lines("[Forum](https://m.org) | ONLINE"),
        feed_maps=spark.sql("select map('k', named_struct('rss_url', 'https://map.org', 'website_name', 'Mapped')) as feeds"),
        outlines=spark.createDataFrame([('<outline text="Data breach" xmlUrl="https://o.org"/>',)], "opml string"),
    )
    probes = spark.createDataFrame(
        [(u, 200, "<rss") for u in ("https://f.org/feed/", "https://m.org/rss.xml", "https://g.org/rss", "https://o.org", "https://seed")],
        "url string, status int, body string")
    found = discovered_sources(docs, probes)
    assert sorted((r.name, r.rss_url) for r in found.collect()) == [
        ("Data breach", "https://o.org"), ("Forum", "https://f.org/feed/"), ("Gang (ransom)", "https://g.org/rss"),
        ("Mapped", "https://map.org")]
    seed = source_rows(spark, [("forum", "https://seed", True, 0)])
    local = source_rows(spark, [("gang ransom", "https://local", True, 0)])
    remote = source_rows(spark, [("inner", "internal://x", True, 0)])
    sw = spark.createDataFrame([("GANG RANSOM", False)], "toggle_key string, enabled boolean")
    rows = resolve_sources(seed, found, local, remote, sw, probes).collect()
    assert sorted(r.rss_url for r in rows) == ["https://o.org", "https://seed", "internal://x"]


def test_feed_forms(spark):
    from signalsieve.sources.feeds import scan_feed_xml, unreadable_feeds

    rdf = ('<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" '
           'xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title></channel><item><title>One</title>'
           '<link>https://e/1</link><dc:date>2024-01-02T10:00:00Z</dc:date><dc:creator>Ann</dc:creator><dc:subject>x</dc:subject></item></rdf:RDF>')
    js = json.dumps({"version": "https://jsonfeed.org/version/1.1", "items": [
        {"id": "1", "url": "https://e/2", "title": "Two", "content_html": "<p>b</p>", "date_published": "2024-01-02T10:00:00Z",
         "authors": [{"name": "Bob"}], "tags": ["t", "u"]}, {"id": "no title"}]})
    bare = ("<rss><channel><item><title>A & B &nbsp;C</title><link>https://e/3?a=1&b=2</link>"
            "<description>x &amp; y</description></item></channel></rss>")
    rows = [("s", x) for x in (rdf, js, bare, "<rss><channel><item><title>cut off", "", None, "no feed")]
    df = spark.createDataFrame(rows, "site_name string, xml string")
    got = {r.link: r for r in scan_feed_xml(df).collect()}
    assert set(got) == {"https://e/1", "https://e/2", "https://e/3?a=1&b=2"}
    assert (got["https://e/1"].author, got["https://e/1"].category, got["https://e/1"].pub_date) == ("Ann", "x", "2024-01-02T10:00:00Z")
    assert (got["https://e/2"].author, got["https://e/2"].category, got["https://e/2"].content) == ("Bob", "t, u", "b")
    assert got["https://e/3?a=1&b=2"].title.startswith("[s] A & B")
    assert {r.xml for r in unreadable_feeds(df).collect()} == {"<rss><channel><item><title>cut off", "no feed"}
