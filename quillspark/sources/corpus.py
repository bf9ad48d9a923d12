"""Document-model rows from plain text, web pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Elements with their inner markup, tags in either case.
HEADING = r"(?is)(<h[1-6]\b[^>]*>.*?)</h[1-6]>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title>"


def text_paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, block_index, text: a paragraph for each line of a text; a null text has one empty paragraph."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return documents.select("doc_id", F.posexplode(lines).alias("block_index", "text"))


def _plain(x):
    """Markup out, the common entities back."""
    s = F.regexp_replace(x, "<[^>]*>", "")
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(ch))
    return F.trim(s)


def page_headings(pages: DataFrame) -> DataFrame:
    """page_id, ord, level, text of all <h1> to <h6>."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HEADING), F.lit(1))
    rows = pages.select("page_id", F.posexplode(tags).alias("ord", "tag"))
    return rows.select("page_id", F.col("ord").cast("long").alias("ord"), F.substring("tag", 3, 1).cast("long").alias("level"), _plain(F.col("tag")).alias("text"))


def page_titles(pages: DataFrame) -> DataFrame:
    """page_id, title, heading (the first h1); empty where a page has none."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", _plain(F.regexp_extract(html, TITLE, 1)).alias("title"), _plain(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)).alias("heading"))


def turns(conversations: DataFrame) -> DataFrame:
    """Conversations as ordered blocks: user turns head what follows, at a level of 1 to 3 by their number."""
    level = F.when(F.col("role") == "user", (F.col("turn") / 2).cast("long") % 3 + 1)
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_index"), "text", level.alias("level"))
