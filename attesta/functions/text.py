"""Text functions: normalising, terms, quotes, HTML and chunks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def normalized(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, case folding and single spaces; null stays null."""
    for some in texts:
        yield some.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()), na_action="ignore")


def normalized_ascii(text: Column) -> Column:
    """The same for ASCII texts, without leaving the JVM."""
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")))


def has_term(text: Column, term: str) -> Column:
    """Whether the term stands at word boundaries of any script."""
    quoted = "\\Q" + term.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.lower(text).rlike(rf"(?U)(?<!\w){quoted}(?!\w)")


def listed_terms(text: Column, terms: list[str]) -> Column:
    """The terms of a short list whose words follow each other in a text, without a
    join: one pattern for all goes ahead of one for each."""
    word, gap = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]+"
    own = {t: gap.join("\\Q" + w + "\\E" for w in t.split()) for t in terms}
    whole = lambda p: rf"(?<!{word})(?:{p})(?!{word})"
    low = F.lower(text)
    found = F.array_compact(F.array(*(F.when(low.rlike(whole(p)), F.lit(t)) for t, p in own.items())))
    return F.when(low.rlike(whole("|".join(own.values()))), found).otherwise(F.array().cast("array<string>"))


def matched_terms(docs: DataFrame, text: str, terms: DataFrame, term: str, longest: int) -> DataFrame:
    """Documents joined with the terms they hold, by word n-grams.

    Texts are cut into words once and their n-grams of up to ``longest`` words
    meet the terms in a hash join; terms are lower-case words with single
    spaces.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), 0)
    rows = docs.withColumn("_w", words)
    parts = []
    for n in range(1, longest + 1):
        gram = word_grams(n)
        parts.append(rows.where(F.size("_w") >= n).select(*docs.columns, F.explode(F.array_distinct(gram)).alias(term)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.join(terms, term)


def word_grams(n: int) -> Column:
    """n-word windows of the word array ``_w``."""
    return F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))


def grounded(quote: Column, source: Column) -> Column:
    """Whether the quote is an exact part of the source."""
    return F.coalesce(F.instr(source, quote) > 0, F.lit(False)) & (quote != "")


@F.pandas_udf(T.StringType())
def repaired_quote(quotes: pd.Series, sources: pd.Series) -> pd.Series:
    """The source's own wording of a quote: exact, or equal words (three or more); else null."""
    import re

    def words(text: str) -> list[tuple[str, int, int]]:
        return [(m.group().casefold(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]

    def one(quote: str | None, source: str | None) -> str | None:
        if not quote or not source:
            return None
        if quote in source:
            return quote
        want, have = [w for w, _, _ in words(quote)], words(source)
        n = len(want)
        if n < 3:
            return None
        for i in range(len(have) - n + 1):
            if have[i][0] == want[0] and [w for w, _, _ in have[i : i + n]] == want:
                return source[have[i][1] : have[i + n - 1][2]]
        return None

    return pd.Series([one(q, s) for q, s in zip(quotes, sources)], dtype=object)


def locate_quote(quote: Column, sections: Column, preferred: str = "transcript") -> Column:
    """Id of the section holding the quote, the preferred one first."""
    holding = F.filter(sections, lambda s: F.contains(s["text"], quote))
    best = F.filter(holding, lambda s: s["id"] == preferred)
    return F.coalesce(F.try_element_at(best, F.lit(1))["id"], F.try_element_at(holding, F.lit(1))["id"])


def token_overlap(a: Column, b: Column) -> Column:
    """Distinct words two texts share."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0))
    return F.size(F.array_intersect(words(a), words(b)))


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset(("script", "style", "nav", "aside", "footer", "noscript"))


class _Picker(HTMLParser):
    """Text of the first element that ``match`` accepts, without skipped parts."""

    def __init__(self, match):
        super().__init__(convert_charrefs=True)
        self.match, self.depth, self.hidden, self.parts, self.done = match, 0, 0, [], False

    def handle_starttag(self, tag, attrs):
        if self.done or tag in VOID:
            return
        if self.depth:
            self.depth += 1
            if self.hidden or tag in SKIPPED:
                self.hidden += 1
        elif self.match(tag, dict(attrs)):
            self.depth = 1

    def handle_endtag(self, tag):
        if self.done or tag in VOID or not self.depth:
            return
        self.depth -= 1
        self.hidden = max(0, self.hidden - 1)
        self.done = self.depth == 0

    def handle_data(self, data):
        if self.depth and not self.hidden and not self.done:
            self.parts.append(data)

    def text(self) -> str:
        return " ".join(" ".join(self.parts).split())


def _picked(html: str | None, match) -> str:
    p = _Picker(match)
    p.feed(html or "")
    p.close()
    return p.text()


def main_text(tags: tuple[str, ...] = ("main", "article")):
    """UDF: text of the first of the tags, without scripts, navigation and footers."""

    @F.pandas_udf(T.StringType())
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in pages:
            yield html.map(lambda h: _picked(h, lambda tag, attrs: tag in tags), na_action="ignore")

    return run


def _block(html: str | None, name: str) -> str:
    return _picked(html, lambda tag, attrs: name == attrs.get("id") or name == attrs.get("itemprop") or name in (attrs.get("class") or "").split())


@F.pandas_udf(T.StringType())
def block_text(pages: pd.Series, selectors: pd.Series) -> pd.Series:
    """Text of the first element with the class or id; of several, joined by ``+``, in their order."""
    return pd.Series([" ".join(filter(None, (_block(h, n) for n in s.split("+")))) for h, s in zip(pages, selectors)], dtype=object)


def links(html: Column) -> Column:
    """Targets of anchors and feed links, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<(?:a|link)\s[^>]*?href=[\"']([^\"']+)"), 1)


def cards(html: Column, item: str, date: str, title: str, link: str) -> Column:
    """Dated cards as structs; an incomplete card is an error, not a gap."""
    blocks = F.regexp_extract_all(html, F.lit(item), 0)

    def one(b: Column) -> Column:
        got = {n: F.nullif(F.regexp_extract(b, p, 1), F.lit("")) for n, p in (("date", date), ("title", title), ("link", link))}
        whole = got["date"].isNotNull() & got["title"].isNotNull() & got["link"].isNotNull()
        return F.when(whole, F.struct(*(c.alias(n) for n, c in got.items()))).otherwise(F.raise_error(F.lit("incomplete card")).cast("struct<date:string,title:string,link:string>"))

    return F.transform(blocks, one)


def chunked(text: str | None, limit: int) -> list[str]:
    """Parts of at most ``limit`` characters, cut at the last blank of their second
    half, or at the limit where that has none."""
    text, out, at = text or "", [], 0
    while at < len(text):
        end = min(len(text), at + limit)
        if end < len(text):
            blank = text.rfind(" ", at + limit // 2, end)
            end = blank if blank > at else end
        out.append(text[at:end].strip())
        at = end
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks(texts: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series([chunked(t, int(n)) for t, n in zip(texts, limits)], dtype=object)


#: Where a source's article is, and how long it is at least.  ``stored``
#: is the text that came with the entry, ``main`` the main element.
ARTICLES = (
    ("CA", "news-release-container", 80), ("CN", "Artical_Content", 80), ("US", "wp-block-post-content", 40), ("AM", "news-text", 40), ("BE", "wysiwyg__content", 40),
    ("NO", "article-body", 40), ("SM", "stored", 40), ("MT", "stored", 40), ("UA", "editor-content", 40), ("TR", "news-detail", 40), ("ES", "contentArticleBody", 40),
    ("XK", "elementor-widget-theme-post-content", 40), ("AZ", "page-content", 40), ("LU", "cmp-text", 40), ("VA", "articleBody", 40), ("ME", "ui-article", 40), ("MC", "prose", 40),
    ("RO", "pageDescription", 40), ("LI", "main-text", 40), ("MK", "blog-content", 40), ("KZ", "articles__container", 40), ("PT", "body", 40), ("HU", "main", 40), ("CZ", "article", 40),
    ("PL", "main-content", 40), ("SK", "page-content", 40), ("SI", "intro+content-blocks", 40), ("DK", "content-rte", 40), ("DE", "bpa-richtext", 40), ("SE", "has-wordExplanation", 40),
    ("IT", "field-name-body", 40), ("GB", "govspeak", 40), ("BG", "view", 40), ("HR", "article-intro+article-content", 40), ("MD", "news-post", 40), ("IS", "main", 40),
    ("GR", "entry-content", 40), ("AD", "float-left", 40), ("RS", "article-text+text-content", 40), ("BY", "wysiwyg", 1), ("GE", "stored", 1),
)
#: Marks ahead of which a page is not read, notices instead of articles.
AFTER = {"SI": "<main", "DE": 'id="rs_reading_area_content"'}
NOTICES = {"CN": r"(?i)Please see (?:the )?attachment for .*full text", "DE": r"(?i)^Die Pressemitteilung finden Sie im Anhang\.?$"}


def article_text(pages: DataFrame, source: str = "source", stored: str = "stored", fallback: int = 250) -> DataFrame:
    """Adds ``article`` and ``fault`` to pages with ``html``.

    Sources of ARTICLES have the text of their blocks; what is too short is a
    fault (empty without one for RO), as a notice of an attachment is.  Others
    have the stored text over ``fallback`` characters, else the main element.
    The rules are some forty rows, so they are broadcast.
    """
    spark = pages.sparkSession
    rules = spark.createDataFrame([(c, b, n) for c, b, n in ARTICLES], "_code string, _blocks string, _least int")
    rows = pages.join(F.broadcast(rules), F.col(source) == F.col("_code"), "left")
    html = F.coalesce("html", F.lit(""))
    for code, mark in AFTER.items():
        at = F.instr(html, mark)
        html = F.when(F.col(source).eqNullSafe(code), F.when(at > 0, F.substring(html, at, F.length(html))).otherwise("")).otherwise(html)
    html = F.when(F.col(source).eqNullSafe("CA"), F.regexp_replace(html, r'(?s)<p class="teaser hidden">.*?</p>', "")).otherwise(html)
    block = block_text(html, F.coalesce("_blocks", F.lit("")))
    block = F.when(F.col(source).eqNullSafe("CA"), F.split(block, " Contacts ")[0]).otherwise(block)
    kept = F.coalesce(stored, F.lit(""))
    ruled = F.when(F.col("_blocks") == "stored", kept).when(F.col("_blocks") == "main", main_text()("html")).otherwise(block)
    other = F.when(F.length(kept) > fallback, kept).otherwise(main_text()("html"))
    rows = rows.withColumn("_text", F.coalesce(F.when(F.col("_code").isNotNull(), ruled).otherwise(other), F.lit("")))
    notice = F.lit(False)
    for code, pattern in NOTICES.items():
        notice = notice | (F.col(source).eqNullSafe(code) & F.col("_text").rlike(pattern))
    short = F.length("_text") < F.col("_least")
    fault = F.when(notice, "attachment notice").when(short & (F.col(source) != "RO"), "no usable article body")
    rows = rows.withColumn("fault", fault)
    return rows.withColumn("article", F.when(F.col("fault").isNull(), F.when(F.coalesce(short, F.lit(False)), "").otherwise(F.col("_text")))).drop("_code", "_blocks", "_least", "_text")


#: Fixed value: words that say AI in public copy.
AI_COPY = r"(?iU)(?<!\w)(?:AI|AGI)(?!\w)|\b(?:artificial intelligence|machine learning|large language model|foundation model|super[ -]?intelligence)\b"
#: Ways of saying that a source was missing.
NO_SOURCE = (
    r"\b(?:no|missing|without)\s+(?:full\s+)?(?:press release|article|source|document|text)",
    r"\b(?:press release|article|source|document|text)(?:\s+text)?\s+(?:is\s+|was\s+|were\s+)?not\s+(?:provided|included|available)\b",
    r"\b(?:press release|article|source|document|text).{0,30}\battached\b",
)


def ai_copy_faults(topics: Column, summary: Column, ticker: Column, rationale: Column, relevance: Column, confidence: Column) -> Column:
    """What holds a generated label back: an AI topic whose public copy does not
    name AI in summary and ticker, and an unsure answer that says its source was
    missing."""
    said = lambda c: F.coalesce(c.rlike(AI_COPY), F.lit(False))
    unnamed = F.coalesce(F.array_contains(topics, "artificial_intelligence"), F.lit(False)) & ~(said(summary) & said(ticker))
    copy = F.concat_ws(" ", F.coalesce(ticker, F.lit("")), F.coalesce(rationale, F.lit("")))
    unsure = F.coalesce(relevance == "unclear", F.lit(False)) & (F.coalesce(confidence, F.lit(1.0)) <= 0.1)
    return F.array_compact(F.array(F.when(unnamed, "AI not named"), F.when(unsure & copy.rlike("(?i)" + "|".join(NO_SOURCE)), "source missing")))
