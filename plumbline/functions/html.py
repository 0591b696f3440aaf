"""Web pages to text: a title, and every text node stripped on a line of its own.

A page is cut at its markup by one pattern that reads every character once: comments and
declarations, script and style elements with all that is in them, and tags.  What isn't
closed reaches to the end of the page.  Between the cuts is text, in which entities are
resolved.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute values in quotes may hold what closes a tag; a quote that isn't closed is a character like others.
_REST = r"""(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+(?:>|\Z)"""
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-z][^\s/>]*){_REST}|<[!?/][^>]*(?:>|\Z)", re.S | re.I
)


def read(html: str | None) -> tuple[str, str]:
    """Title and text of a page; null counts as empty."""
    html = html or ""
    title, lines, at, inside = "", [], 0, False
    for cut in [*_MARKUP.finditer(html), None]:
        text = unescape(html[at : cut.start() if cut else len(html)])
        if inside:
            title += text
        elif text := text.strip():
            lines.append(text)
        if cut:
            at = cut.end()
            if (cut["name"] or "").lower() == "title":
                inside = not cut["end"]
    return title.strip(), "\n".join(lines)


def page_text(html: Column) -> Column:
    """A struct of title and text."""

    @F.pandas_udf("title string, text string")
    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(p) for p in pages], columns=["title", "text"])

    return parse(html)
