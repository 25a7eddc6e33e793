"""Scalar text operators (Column in, Column out), all JVM-side.

Whitespace and word classes are spelled out in ASCII: Java's ``\\s`` and ``\\b`` are
wider than the classes the results are defined with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.matching import any_contains, first_class, let

# Whitespace and link patterns.
ASCII_SPACE = r"[\t\n\f\r ]"
# a lone space stays as it is, so only places that change are matched
COLLAPSIBLE_SPACE = r"[\t\n\f\r ]{2,}|[\t\n\f\r]"
UNICODE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TAG = r"<[^>]+>"
LOGIN_NOTICE = r"(?i)You must be registered for see (links|images attach)"
FILE_LINK = r"""(?i)https?://[^\t\n\f\r "<>]+\.(?:zip|rar|7z|txt|csv|xlsx|pdf|exe|iso|torrent|json|xml)"""
HREF_LINK = r"""(?i)href=["'](https?://[^\t\n\f\r "<>']+)["']"""
LABELLED_LINK = r"""(?i)download[\t\n\f\r ]*[:：][\t\n\f\r ]*(https?://[^\t\n\f\r "<>]+)"""
PATH_LINK = r"""(?i)(https?://[^\t\n\f\r "<>]+/(?:download|files?)/[^\t\n\f\r "<>]+)"""
HOSTER_LINK = (
    r"""(?i)(https?://(?:mega\.nz|mediafire\.com|sendspace\.com|4shared\.com)/[^\t\n\f\r "<>]+)"""
)
NAME_SUFFIX = r"(?i)[\t\n\f\r ]*\((?:deep|dark|mirror|backup|onion)[^)]*\)"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def trim_space(col: Column) -> Column:
    """Trim every Unicode white space character, not just U+0020."""
    return F.trim(col, F.lit(UNICODE_SPACE))


def strip_html(col: Column) -> Column:
    """Tags become spaces, login notices go, white space collapses."""
    text = F.regexp_replace(col, TAG, " ")
    text = F.regexp_replace(text, LOGIN_NOTICE, "")
    return trim_space(F.regexp_replace(text, COLLAPSIBLE_SPACE, " "))


def join_categories(names: Column) -> Column:
    """Non-empty names joined with a comma."""
    kept = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    return F.coalesce(F.array_join(kept, ", "), F.lit(""))


def teaser(content: Column, description: Column) -> Column:
    """The feed content, else the description, as plain text."""
    return strip_html(first_filled(content, description))


def download_links(text: Column) -> Column:
    """T4: download addresses in pattern order, distinct, first seen first."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(FILE_LINK), F.lit(0)),
        F.regexp_extract_all(text, F.lit(HREF_LINK), F.lit(1)),
        F.regexp_extract_all(text, F.lit(LABELLED_LINK), F.lit(1)),
        F.regexp_extract_all(text, F.lit(PATH_LINK), F.lit(1)),
        F.regexp_extract_all(text, F.lit(HOSTER_LINK), F.lit(1)),
    )
    bare = F.transform(found, lambda u: F.rtrim(u, F.lit(".,;)")))
    kept = F.filter(
        bare, lambda u: u.startswith("http") & ~any_contains(F.lower(u), fv.LINK_EXCLUDES)
    )
    # only links starting with lower-case "http" survive, so other texts skip the patterns
    return F.when(text.contains("http"), F.array_distinct(kept)).otherwise(
        F.array().cast("array<string>")
    )


def prefix_title(title: Column, site: Column) -> Column:
    """T5: put the site in front unless the title already starts with a bracket."""
    return F.when(title.startswith("["), title).otherwise(F.concat(F.lit("["), site, F.lit("] "), title))


def preview(col: Column, n: int) -> Column:
    """At most n characters, an ellipsis after a cut."""
    return F.when(F.char_length(col) > n, F.concat(F.substring(col, 1, n), F.lit("…"))).otherwise(col)


def shorten(col: Column, n: int) -> Column:
    """T6, fixed total length: at most n characters including the three dots."""
    cut = F.substring(col, 1, n) if n <= 3 else F.concat(F.substring(col, 1, n - 3), F.lit("..."))
    return F.when(F.char_length(col) > n, cut).otherwise(col)


def effective_body(full: Column, short: Column, max_chars: int = 0) -> Column:
    """The full page when there is one, else the teaser; cut only on request."""
    body = first_filled(full, short)
    return let(trim_space(body), lambda b: shorten(b, max_chars)) if max_chars > 0 else body


def site_badge(site: Column) -> Column:
    """Badge class of a site name."""
    return first_class(F.lower(site), fv.SITE_BADGES, fv.DEFAULT_SITE_BADGE)


def score_badge(score: Column) -> Column:
    """Badge of a score."""
    out = None
    for low, badge in fv.SCORE_BADGES:
        out = F.when(score >= low, badge) if out is None else out.when(score >= low, badge)
    return out.otherwise(fv.DEFAULT_SCORE_BADGE)


def escape_markup(col: Column) -> Column:
    """Backslash before every reserved character."""
    reserved = "".join("\\" + c for c in fv.RICH_TEXT_RESERVED)
    return F.regexp_replace(col, f"([{reserved}])", r"\\$1")


def escape_url(col: Column) -> Column:
    """T10 for link targets: only the backslash and the closing parenthesis."""
    return F.regexp_replace(col, r"([\\)])", r"\\$1")


def comma_number(n: Column) -> Column:
    """Thousands separators."""
    return F.format_number(n, 0)


def normalize_key(name: Column) -> Column:
    """Key under which two source names are the same source."""
    return F.lower(F.translate(trim_space(name), " .-()", "___"))


def sanitize_name(name: Column) -> Column:
    """A directory name without its "(mirror ...)" style suffixes."""
    return trim_space(F.regexp_replace(name, NAME_SUFFIX, ""))
