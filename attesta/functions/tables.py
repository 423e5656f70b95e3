"""Table functions for SQL: a page's links and dated cards, a text's chunks, and gaps in archive pages.

``register`` names them in a session.  Functions of a scalar are used by LATERAL joins; ``page_gaps`` takes
a TABLE argument with PARTITION BY and holds one number of each partition.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .text import chunked

LINK = re.compile(r"(?i)<(?:a|link)\s[^>]*?href=[\"']([^\"']+)")


@udtf(returnType="position int, link string")
class PageLinks:
    """Targets of anchors and feed links in order; none of null."""

    def eval(self, html: str):
        for i, m in enumerate(LINK.finditer(html or "")):
            yield i, m.group(1)


@udtf(returnType="position int, date string, title string, link string")
class PageCards:
    """Dated cards of a page by four patterns; an incomplete card is an error, not a gap."""

    def eval(self, html: str, item: str, date: str, title: str, link: str):
        for i, block in enumerate(re.finditer(item, html or "")):
            got = [re.search(p, block.group()) for p in (date, title, link)]
            if not all(m and m.group(1) for m in got):
                raise ValueError("incomplete card")
            yield i, *(m.group(1) for m in got)


@udtf(returnType="part int, chunk string")
class TextChunks:
    """Parts of a text of at most so many characters, cut at blanks; none of null and empty texts."""

    def eval(self, text: str, limit: int):
        yield from enumerate(chunked(text, limit))


@udtf(returnType="source string, after long, next long")
class PageGaps:
    """(source, after, next) where page numbers of a source, given in order, leave some out.

    Rows are (source, page); repeated pages are no gap.
    """

    def __init__(self):
        self.last = None

    def eval(self, row):
        source, page = row[0], row[1]
        if page is None:
            return
        if self.last is not None and page > self.last + 1:
            yield source, self.last, page
        self.last = page


def register(spark: SparkSession) -> None:
    """page_links(html), page_cards(html, item, date, title, link), text_chunks(text, limit), page_gaps(TABLE ...)."""
    for name, function in (("page_links", PageLinks), ("page_cards", PageCards), ("text_chunks", TextChunks), ("page_gaps", PageGaps)):
        spark.udtf.register(name, function)
