"""Wording of summaries, reports and alerts; another set can be passed wherever one is taken."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Phrases:
    vendor_summary: str
    combo_summary: str
    summary: str  # site, category, size, types, freshness
    category_names: dict[str, str]
    other_category: str
    size_millions: str
    size_count: str
    size_unknown: str
    types_unknown: str
    types_joiner: str
    fresh_note: str
    stale_note: str
    site_unknown: str
    all_failed: str
    daily_title: str
    weekly_title: str
    alltime_title: str
    total_line: str
    updated_line: str
    stats_headings: dict[str, str]
    by_source_heading: str
    source_line: str
    detail_headings: dict[str, str]
    site_line: str
    found_line: str
    footer: str
    feed_titles: dict[str, str]
    feed_descriptions: dict[str, str]
    notice_total: str
    top_heading: str
    rich_site: str
    rich_targets: str
    rich_types: str
    rich_records: str
    rich_link: str
    plain_link: str
    link_text: str
    embed_site: str
    embed_time: str
    embed_link: str
    embed_open: str
    embed_daily: str
    embed_weekly: str
    embed_footers: dict[str, str] = field(default_factory=dict)
    language: str = "English"


ENGLISH = Phrases(
    vendor_summary="{site}: vendor advert or low-value post, no leak of its own.",
    combo_summary="{site}: combined credential list, an aggregate and not a fresh leak.",
    summary="{site}: {category}, {size}, data types: {types}.{freshness}",
    category_names={
        "credential_leak": "credential leak",
        "database_dump": "database leak",
        "financial_data": "financial data leak",
        "personal_info": "personal information leak",
        "access_sale": "access for sale",
        "general_discussion": "general discussion",
    },
    other_category="data leak",
    size_millions="about {n} million records",
    size_count="about {n} records",
    size_unknown="size unknown",
    types_unknown="unknown",
    types_joiner=", ",
    fresh_note=" Data looks recent.",
    stale_note=" Data may be old.",
    site_unknown="unknown source",
    all_failed="No provider gave a result; default low score.",
    daily_title="Daily leak report {period}",
    weekly_title="Weekly leak report {period}",
    alltime_title="Leak monitoring overview",
    total_line="**{n}** items collected",
    updated_line="Last updated: {at}",
    stats_headings={"daily": "## Today in numbers", "weekly": "## This week in numbers",
                    "alltime": "## All time in numbers"},
    by_source_heading="### By source",
    source_line="- {site}: {n}",
    detail_headings={"daily": "## Today in detail", "weekly": "## This week in detail",
                     "alltime": "## All items"},
    site_line="- **Source**: {site}",
    found_line="- **Found at**: {at}",
    footer="Generated by signalsieve",
    feed_titles={"daily": "Daily leak feed {period}", "weekly": "Weekly leak feed {period}"},
    feed_descriptions={"daily": "Leak items of {period}", "weekly": "Leak items of the week {period}"},
    notice_total="{n} leak items collected",
    top_heading="\n\n📊 Today's top {n}:\n",
    rich_site="📌 Source: `{v}`",
    rich_targets="🎯 Targets: {v}",
    rich_types="📦 Types: {v}",
    rich_records="📊 Size: ≈{v} records",
    rich_link="🔗 [Open post]({v})",
    plain_link="Link: ",
    link_text="Link",
    embed_site="Source",
    embed_time="Sent at",
    embed_link="Link",
    embed_open="Open",
    embed_daily="Summary of the day",
    embed_weekly="Report",
    embed_footers={"urgent": "Urgent alert", "weekly": "Weekly report", "daily": "Daily report",
                   "normal": "Item", "startup": "Startup"},
    language="English",
)


# what the rules say about their score
REASONING_VENDOR = 'Rules: wording of sellers or spam, "{word}"'
REASONING_COMBO = "Rules: a collection of credentials, {score} points at most"
REASONING_RULES = (
    "Rules: size {base}, data types {types_boost}, recency {freshness}, site {site}: {final} points. "
    "Records {records}, types ({types})"
)


def fill(template: str, **columns):
    """A template with ``{name}`` slots as a concat of literals and Columns."""
    import re

    from pyspark.sql import functions as F

    parts = []
    for literal, slot in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if slot:
            parts.append(columns[slot].cast("string"))
    return F.concat(*parts)
