"""Page extraction over a ``pages(page_id, url, html)`` table.

HTML needs a real parser, which Spark SQL lacks, so one ``mapInPandas``
pass (Arrow batches, the standard-library ``html.parser``) turns each page
into plain columns: visible text, the text and source of one container
element, the first heading and the song-category label. Everything after
that (year search, ids, title stripping, record shaping) is JVM-side column
work. Regex link extraction needs no parser and lives in the query layer.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import extract_year_min, genre_from_label, stable_id, strip_title

PARSED_SCHEMA = ("page_text string, block_text string, block_html string, "
                 "heading string, category_label string, parse_error string")
SKIP_TEXT = {"script", "style", "template"}


class _PageParser(HTMLParser):
    """Collects text nodes (stripped, empty ones dropped, entities decoded,
    script/style/comments skipped) for the whole page and for the first
    element matching (tag, id, class)."""

    def __init__(self, tag, el_id, el_class, label_marker):
        super().__init__(convert_charrefs=True)
        self.tag, self.el_id, self.el_class, self.marker = tag, el_id, el_class, label_marker
        self.page, self.block = [], []
        self.skip = 0
        self.depth = 0          # >0 while inside the matched block
        self.done = False
        self.start_pos = self.end_pos = None
        self.in_h1, self.heading = False, None
        self.in_strong, self.strong_parts, self.label = False, [], None

    def _matches(self, tag, attrs):
        if tag != self.tag:
            return False
        a = dict(attrs)
        if self.el_id is not None and a.get("id") != self.el_id:
            return False
        if self.el_class is not None and self.el_class not in (a.get("class") or "").split():
            return False
        return True

    def handle_starttag(self, tag, attrs):
        if tag in SKIP_TEXT:
            self.skip += 1
        if self.depth > 0 and tag == self.tag:
            self.depth += 1
        elif not self.done and self.depth == 0 and self._matches(tag, attrs):
            self.depth = 1
            self.start_pos = self.getpos()
        if tag == "h1" and self.heading is None:
            self.in_h1, self._h = True, []
        if tag == "strong":
            self.in_strong, self.strong_parts = True, []

    def handle_endtag(self, tag):
        if tag in SKIP_TEXT and self.skip:
            self.skip -= 1
        if self.depth > 0 and tag == self.tag:
            self.depth -= 1
            if self.depth == 0:
                self.done = True
                self.end_pos = self.getpos()
        if tag == "h1" and self.in_h1:
            self.in_h1 = False
            self.heading = " ".join(x for x in self._h if x)
        if tag == "strong" and self.in_strong:
            self.in_strong = False
            txt = "".join(self.strong_parts).strip()
            if self.label is None and self.marker in txt:
                self.label = txt

    def handle_data(self, data):
        if self.skip:
            return
        s = data.strip()
        if s:
            self.page.append(s)
            if self.depth > 0:
                self.block.append(s)
            if self.in_h1:
                self._h.append(s)
        if self.in_strong:
            self.strong_parts.append(data)


def _offset(html: str, pos) -> int:
    line, col = pos
    idx = 0
    for _ in range(line - 1):
        idx = html.index("\n", idx) + 1
    return idx + col


def parse_page(html: str | None, tag: str, el_id: str | None, el_class: str | None,
               marker: str = fixed.GENRE_LABEL_MARKER):
    """-> (page_text, block_text, block_html, heading, category_label)."""
    if html is None:
        return None, None, None, None, None
    p = _PageParser(tag, el_id, el_class, marker)
    p.feed(html)
    p.close()
    block_html = None
    if p.start_pos is not None:
        start = _offset(html, p.start_pos)
        if p.end_pos is not None:
            end = html.find(">", _offset(html, p.end_pos)) + 1
        else:
            end = len(html)
        block_html = html[start:end]
    block_text = "\n".join(p.block) if p.start_pos is not None else None
    return " ".join(p.page), block_text, block_html, p.heading, p.label


def try_parse_page(html: str | None, *args):
    """:func:`parse_page` plus an error text: one malformed page gives a row
    of nulls with the reason, not a failed job."""
    try:
        return *parse_page(html, *args), None
    except (AssertionError, ValueError, IndexError) as e:      # what html.parser raises on broken markup
        return None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]


def parse_pages(pages: DataFrame, html: str = "html", tag: str = "article",
                el_id: str | None = None, el_class: str | None = None, keep=("page_id", "url")) -> DataFrame:
    """Per page: page_text (visible text, ' '-joined), block_text (text of
    the first matching container, '\\n'-joined), block_html (its source),
    heading (first h1) and category_label (first <strong> with the marker);
    a page the parser cannot read has nulls and ``parse_error``."""
    keep = list(keep)
    schema = ", ".join(f"{n} {t}" for n, t in
                       [(f.name, f.dataType.simpleString()) for f in pages.schema.fields if f.name in keep])
    schema = f"{schema}, {PARSED_SCHEMA}"

    def run(batches):
        import pandas as pd
        for pdf in batches:
            rows = [try_parse_page(h, tag, el_id, el_class) for h in pdf[html]]
            out = pd.DataFrame(rows, columns=["page_text", "block_text", "block_html",
                                              "heading", "category_label", "parse_error"])
            for k in reversed(keep):
                out.insert(0, k, pdf[k].values)
            yield out

    return pages.select(*keep, html).mapInPandas(run, schema)


def page_to_record(parsed: DataFrame, as_of_year: int, scrape_date: str) -> DataFrame:
    """Parsed page -> the crawler's 14-column record (lyric with the title
    removed, year = smallest plausible year in the page text)."""
    title = F.coalesce(F.col("heading"), F.lit(""))
    return parsed.select(
        stable_id("url").alias("id"), F.lit(fixed.CRAWL_PLATFORM).alias("platform"),
        F.lit(fixed.CRAWL_PLATFORM_TYPE).alias("platform_type"), "url",
        F.lit(fixed.CRAWL_CONTENT_TYPE).alias("content_type"),
        F.lit(fixed.CRAWL_SCRAPER_MODULE).alias("scraper_module"),
        title.alias("song_title"),
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("artist"),
        extract_year_min(F.col("page_text"), as_of_year).alias("release_year"),
        genre_from_label("category_label").alias("genre"),
        F.lit(fixed.CRAWL_LANGUAGE_VARIANT).alias("language_variant"),
        strip_title(F.coalesce(F.col("block_text"), F.lit("")), title).alias("lyric_text"),
        F.coalesce(F.col("block_html"), F.lit("")).alias("raw_text"),
        F.lit(scrape_date).alias("scrape_date"))
