"""RSS (also in RDF form), Atom and JSON feed payloads to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsieve.functions.matching import let
from signalsieve.functions.text import (
    download_links,
    first_filled,
    join_categories,
    prefix_title,
    teaser,
    text_or_empty,
    trim_space,
)
from signalsieve.operators.settle import settle

# The parts of the feed formats that are read.
RSS_SCHEMA = (
    "channel struct<item: array<struct<"
    "title: string, link: string, description: string, `content:encoded`: string, author: string, "
    "`dc:creator`: string, category: array<string>, pubDate: string, `dc:date`: string>>>"
)
ATOM_SCHEMA = (
    "entry array<struct<"
    "title: string, link: array<struct<_href: string, _rel: string>>, summary: string, content: string, "
    "author: struct<name: string>, category: array<struct<_term: string>>, published: string, updated: string>>"
)
RDF_SCHEMA = (
    "item array<struct<title: string, link: string, description: string, `content:encoded`: string, author: string, "
    "`dc:creator`: string, `dc:subject`: array<string>, pubDate: string, `dc:date`: string>>"
)
JSON_SCHEMA = (
    "items array<struct<id: string, url: string, external_url: string, title: string, content_html: string, "
    "content_text: string, summary: string, date_published: string, date_modified: string, "
    "author: struct<name: string>, authors: array<struct<name: string>>, tags: array<string>>>"
)
ENTRIES = ("array<struct<link:string,title:string,published:string,updated:string,author:string,"
           "categories:array<string>,content:string,description:string>>")
# an ampersand that begins none of the five names and no number that XML knows
BARE_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#[xX][0-9A-Fa-f]+);)"
# Date forms in feeds, tried in this order after the day name is cut off.
DATE_FORMS = [
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm Z",
    "d MMM yyyy HH:mm:ss z",
    "d MMM yy HH:mm:ss Z",
    "d MMM yyyy",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
]
XML_OPTIONS = {"mode": "PERMISSIVE", "attributePrefix": "_"}


def feed_date(raw: Column) -> Column:
    """A feed's date as RFC3339 text in UTC; empty when it cannot be read."""
    text = trim_space(text_or_empty(raw))
    text = F.regexp_replace(text, r"^[A-Za-z]{3,9},[ ]*", "")
    text = F.regexp_replace(text, r" (GMT|UTC|UT|Z)$", " +0000")

    def read(t: Column) -> Column:
        iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), F.try_to_timestamp(t))
        return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(form)) for form in DATE_FORMS])

    # an absent date is not worth nine attempts
    at = let(text, lambda t: F.when(t != "", read(t)))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def author_name(raw: Column) -> Column:
    """The name in ``mail (name)`` or ``name (mail)`` forms; a bare mail has no name."""

    def read(t: Column) -> Column:
        mail_first = r"^[^ @]+@[^ ]+ \(([^)]*)\)$"
        name_first = r"^([^@]+?) ?[(<][^ @]+@[^ ]+[)>]$"
        return (
            F.when(~t.contains("@"), t)
            .when(t.rlike(mail_first), F.regexp_extract(t, mail_first, 1))
            .when(t.rlike(name_first), F.regexp_extract(t, name_first, 1))
            .when(t.rlike(r"^[^ @]+@[^ ]+$"), "")
            .otherwise(t)
        )

    return let(trim_space(text_or_empty(raw)), read)


def _rss_entries(items: Column, category: str = "category") -> Column:
    return F.transform(
        items,
        lambda e: F.struct(
            text_or_empty(e["link"]).alias("link"),
            text_or_empty(e["title"]).alias("title"),
            first_filled(e["pubDate"], e["dc:date"]).alias("published"),
            F.lit("").alias("updated"),
            first_filled(author_name(e["author"]), text_or_empty(e["dc:creator"])).alias("author"),
            e[category].alias("categories"),
            e["content:encoded"].alias("content"),
            e["description"].alias("description"),
        ),
    )


def _atom_entries(doc: Column) -> Column:
    def link(entry: Column) -> Column:
        links = F.filter(entry["link"], lambda k: text_or_empty(k["_href"]) != "")
        main = F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
        return F.coalesce(F.get(main, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"], F.lit(""))

    return F.transform(
        doc["entry"],
        lambda e: F.struct(
            link(e).alias("link"),
            text_or_empty(e["title"]).alias("title"),
            text_or_empty(e["published"]).alias("published"),
            text_or_empty(e["updated"]).alias("updated"),
            text_or_empty(e["author"]["name"]).alias("author"),
            F.transform(e["category"], lambda c: c["_term"]).alias("categories"),
            e["content"].alias("content"),
            e["summary"].alias("description"),
        ),
    )


def _json_entries(doc: Column) -> Column:
    return F.transform(
        doc["items"],
        lambda e: F.struct(
            first_filled(e["url"], e["external_url"], e["id"]).alias("link"),
            text_or_empty(e["title"]).alias("title"),
            text_or_empty(e["date_published"]).alias("published"),
            text_or_empty(e["date_modified"]).alias("updated"),
            first_filled(F.get(e["authors"], F.lit(0))["name"], e["author"]["name"]).alias("author"),
            e["tags"].alias("categories"),
            first_filled(e["content_html"], e["content_text"]).alias("content"),
            e["summary"].alias("description"),
        ),
    )


def _xml_entries(text: Column) -> Column:
    """Entries of an XML feed; null where it does not parse."""
    def root(name: str) -> Column:
        return text.rlike(rf"<(?:[A-Za-z]+:)?{name}[ \t\r\n>]")

    def read(schema: str) -> Column:
        return F.from_xml(text, schema, XML_OPTIONS)

    return (
        F.when(root("feed"), _atom_entries(read(ATOM_SCHEMA)))
        .when(root("RDF"), _rss_entries(read(RDF_SCHEMA)["item"], "dc:subject"))
        .otherwise(_rss_entries(read(RSS_SCHEMA)["channel"]["item"]))
    )


def _with_entries(payloads: DataFrame) -> DataFrame:
    """``payloads`` with ``entries``, the list of a document of any form; an empty one where there are none.

    XML that gives none is read again with its bare ampersands written out, which is the usual fault. Both
    readings are settled, so that no filter behind them repeats a parse: a document is parsed once, and once more
    only if it gave nothing.
    """
    none = F.array().cast(ENTRIES)
    given = text_or_empty(F.col("xml"))
    as_json = F.from_json(given, JSON_SCHEMA)
    first = F.when(trim_space(given).startswith("{"), _json_entries(as_json).cast(ENTRIES)).otherwise(
        _xml_entries(given).cast(ENTRIES))
    read = settle(payloads, payloads.columns, {"_first": F.coalesce(first, none)})
    again = _xml_entries(F.regexp_replace(given, BARE_AMPERSAND, "&amp;")).cast(ENTRIES)
    empty = (F.size("_first") == 0) & ~trim_space(given).startswith("{") & given.contains("&")
    entries = F.when(empty, F.coalesce(again, none)).otherwise(F.col("_first"))
    return settle(read, payloads.columns, {"entries": entries})


def unreadable_feeds(payloads: DataFrame) -> DataFrame:
    """(site_name, xml) documents that are not blank and give no entry at all."""
    blank = trim_space(text_or_empty(F.col("xml"))) == ""
    return _with_entries(payloads).where(~blank & (F.size("entries") == 0)).select(*payloads.columns)


def scan_feed_xml(payloads: DataFrame) -> DataFrame:
    """(site_name, xml) rows to items, one per entry with a link and a title.

    ``position`` is the place of the entry in its feed. What stays unreadable is in ``unreadable_feeds``.
    """
    parsed = _with_entries(payloads.select("site_name", "xml"))
    rows = parsed.select("site_name", F.posexplode("entries").alias("position", "e"))
    e = F.col("e")
    rows = rows.select(
        "site_name",
        "position",
        trim_space(e["link"]).alias("link"),
        trim_space(e["title"]).alias("_title"),
        first_filled(feed_date(e["published"]), feed_date(e["updated"])).alias("pub_date"),
        e["author"].alias("author"),
        join_categories(e["categories"]).alias("category"),
        teaser(e["content"], e["description"]).alias("content"),
    ).filter((F.col("link") != "") & (F.col("_title") != ""))
    return rows.select(
        prefix_title(F.col("_title"), F.col("site_name")).alias("title"),
        "link", "pub_date", "author", "category", "content",
        F.lit("").alias("full_content"),
        download_links(F.col("content")).alias("download_links"),
        "site_name", "position",
    )


FEED_FILE_SCHEMA = "value string"


def read_feed_files(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """Landed feed documents as payload rows for ``scan_feed_xml``: one file per document,
    below ``folder/<site name>/``. With ``streaming`` every new file is one input row."""
    reader = (spark.readStream if streaming else spark.read).schema(FEED_FILE_SCHEMA)
    files = reader.option("wholetext", True).format("text").load(f"{folder}/*/*")
    site = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return files.select(F.url_decode(site).alias("site_name"), F.col("value").alias("xml"))
