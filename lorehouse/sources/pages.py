"""HTML pages to readable text."""

from __future__ import annotations

import html as html_library

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorehouse.functions.text import SPACE, is_blank, strip
from lorehouse.session import once
from lorehouse.sources.urls import canonical_url

DROPPED_ELEMENTS = ("script", "style", "noscript", "nav", "header", "footer", "aside", "title")
BLOCK_TAGS = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|main|body|html|head|blockquote|pre"

# The five markup entities; every other one goes through the standard library.
_SIMPLE = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
_OTHER_ENTITY = r"&(?!(?:amp|lt|gt|quot|#39);)(?:#|[A-Za-z])"


@F.arrow_udf(T.StringType())
def _unescape_any(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else html_library.unescape(t) for t in texts.to_pylist()], pa.string()
    )


def unescape(text: Column) -> Column:
    """Resolve HTML entities; rows holding none but the markup five never leave the JVM."""
    simple = text
    for entity, character in _SIMPLE.items():
        simple = F.replace(simple, F.lit(entity), F.lit(character))
    rare = text.rlike(_OTHER_ENTITY)
    return F.when(rare, _unescape_any(F.when(rare, text))).otherwise(simple)


def _raw_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_title(html: Column, url: Column) -> Column:
    """First ``<title>``, else the canonical URL."""
    return _title_or_url(_raw_title(html), url)


def _title_or_url(raw: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(strip(unescape(raw)), F.lit("")), canonical_url(url))


def readable_markup(html: Column) -> Column:
    """Page text with entities still escaped: one block per line, navigation dropped."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    dropped = "|".join(DROPPED_ELEMENTS)
    text = F.regexp_replace(text, rf"(?is)<({dropped})\b[^>]*>.*?</\1\s*>", "\n")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[A-Za-z/!][^>]*>", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(text, rf" ?\n{SPACE}*", "\n"))


def with_text(pages: DataFrame, html: str, text: str = "text") -> DataFrame:
    """Add the readable text of an HTML column."""
    staged = once(pages, "_markup", readable_markup(F.col(html)))
    return staged.withColumn(text, strip(unescape(F.col("_markup")))).drop("_markup")


def extract_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(url, html)`` rows into loaded documents and rejects with a reason."""
    staged = with_text(once(pages, "_title", _raw_title(F.col("html"))), "html")
    loaded = staged.select(
        canonical_url(F.col("url")).alias("source_path"),
        _title_or_url(F.col("_title"), F.col("url")).alias("title"),
        "text",
        F.lit("url").alias("source_kind"),
        *[F.col(c) for c in pages.columns if c not in ("url", "html")],
    )
    blank = F.coalesce(is_blank(F.col("text")), F.lit(True))
    rejects = loaded.filter(blank).select("source_path", F.lit("no text").alias("reason"))
    return loaded.filter(~blank), rejects
