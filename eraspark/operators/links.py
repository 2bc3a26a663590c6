"""Links of saved pages, and the request worklists that a crawl makes of them.

One parser run a page lists all its anchors with their attributes as an array
column; choosing links (by href prefix, by title prefix, by class) is column
work on the exploded rows. Batches are Arrow, the parser is the standard
library's, and a page is handled by itself, so nothing is shuffled.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import absolute_url, url_quote
from .records import anti_seen_urls

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not a page's text.
HIDDEN = frozenset(("script", "style", "template"))
LINK = "struct<pos: bigint, href: string, title: string, classes: array<string>, text: string>"


class _Anchors(HTMLParser):
    """Every anchor in the order of its start tag. An end tag closes all that
    was opened within its element; one that matches nothing is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[tuple[str, int | None]] = []     # (element, its number if an anchor)
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        number = None
        if tag == "a":
            a = {k: v or "" for k, v in attrs}
            number = len(self.found)
            self.found.append({"pos": number + 1, "href": a.get("href"), "title": a.get("title"),
                               "classes": (a.get("class") or "").split(), "text": []})
        if tag not in VOID:
            self.open.append((tag, number))
            self.hidden += tag in HIDDEN

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self.hidden -= sum(t in HIDDEN for t, _ in self.open[depth:])
                del self.open[depth:]
                return

    def handle_data(self, data):
        if not self.hidden:
            for _, number in self.open:
                if number is not None:
                    self.found[number]["text"].append(data)


def anchors(html: str | None) -> list[dict]:
    """pos (from 1), href, title (null without the attribute), classes and text
    (all text within, stripped) of each anchor. What a page that cannot be read
    to its end has given so far counts; a null page has none."""
    p = _Anchors()
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError, IndexError):      # what html.parser raises on broken markup
        pass
    return [x | {"text": "".join(x["text"]).strip()} for x in p.found]


def page_links(pages: DataFrame, html: str = "html", keep=("page_id", "url")) -> DataFrame:
    """One row an anchor: ``keep``, pos, href, title, classes, text."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", links array<{LINK}>"

    def run(batches):
        import pyarrow as pa
        of = pa.struct([("pos", pa.int64()), ("href", pa.string()), ("title", pa.string()),
                        ("classes", pa.list_(pa.string())), ("text", pa.string())])
        for b in batches:
            links = pa.array([anchors(h) for h in b.column(len(keep)).to_pylist()], pa.list_(of))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], links], [*keep, "links"])

    parsed = pages.select(*keep, F.col(html).alias("_html")).mapInArrow(run, schema)
    return parsed.select(*keep, F.explode("links").alias("_l")).select(*keep, "_l.*")


# ---------------------------------------------------------------- the three ways to choose
def by_href(links: DataFrame, prefix: str) -> DataFrame:
    return links.filter(F.col("href").startswith(prefix))


def by_title(links: DataFrame, prefix: str) -> DataFrame:
    return links.filter(F.col("title").startswith(prefix))


def by_class(links: DataFrame, name: str) -> DataFrame:
    return links.filter(F.array_contains("classes", name))


def first_by_class(links: DataFrame, name: str, page: str = "page_id") -> DataFrame:
    """The first link of a class on each page (a search result's first hit)."""
    row = F.struct(*links.columns)
    return by_class(links, name).groupBy(page).agg(F.min_by(row, "pos").alias("_r")).select("_r.*")


def song_links(links: DataFrame, base: str | Column, seen: DataFrame | None = None) -> DataFrame:
    """Song pages to fetch: links whose title starts with the lyrics word,
    without the one that is called just that, each url once (its least title
    and text), without the urls in ``seen``."""
    named = by_title(links, fixed.SONG_TITLE_PREFIX).filter(F.col("text") != fixed.LYRICS_PLACEHOLDER_TITLE)
    urls = (named.filter(F.col("href").isNotNull()).select(absolute_url("href", base).alias("url"), F.col("text").alias("song_title"))
            .groupBy("url").agg(F.min("song_title").alias("song_title")))
    return anti_seen_urls(urls, seen) if seen is not None else urls


def artist_links(links: DataFrame, base: str | Column) -> DataFrame:
    """Artist pages to fetch: links under the artist path, each url once."""
    return (by_href(links, fixed.ARTIST_HREF_PREFIX).select(absolute_url("href", base).alias("url"), F.col("text").alias("artist"))
            .groupBy("url").agg(F.min("artist").alias("artist")))


# ---------------------------------------------------------------- requests
def index_requests(bases: DataFrame, base: str = "base") -> DataFrame:
    """(base, letter, url): the index page of each letter of each site."""
    letters = F.array(*[F.lit(x) for x in fixed.THAI_INDEX_LETTERS])
    return (bases.select(base).distinct().select(base, F.explode(letters).alias("letter"))
            .select(base, "letter", F.concat(F.col(base), F.lit(fixed.INDEX_PATH), F.col("letter")).alias("url")))


def search_requests(songs: DataFrame, title: str = "title", artist: str = "artist") -> DataFrame:
    """``songs`` with one row for each search that can be asked about a song:
    ``form`` and ``url``. A song without artist is searched by its title alone
    where a form allows it; a null title or artist counts as empty elsewhere.

    lyrics: title and artist, quoted; year: artist, title, keyword, quoted;
    plain: the three joined by plus signs as they are; check: the words for
    a check by hand, blanks as plus signs."""
    t, a = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(artist), F.lit(""))
    both = F.when(a != "", F.concat_ws(" ", t, a)).otherwise(t)
    year = F.concat_ws(" ", a, t, F.lit(fixed.SEARCH_YEAR_KEYWORD))
    check = F.concat_ws(" ", t, a, F.lit(fixed.CHECK_YEAR_KEYWORDS))
    urls = [("lyrics", F.concat(F.lit(fixed.LYRICS_SEARCH_URL), url_quote(both))),
            ("year", F.concat(F.lit(fixed.YEAR_SEARCH_URL), url_quote(year))),
            ("plain", F.concat(F.lit(fixed.YEAR_SEARCH_URL), F.concat_ws("+", t, a, F.lit(fixed.SEARCH_YEAR_KEYWORD)))),
            ("check", F.concat(F.lit(fixed.CHECK_SEARCH_URL), F.replace(check, F.lit(" "), F.lit("+"))))]
    rows = F.array(*[F.struct(F.lit(form).alias("form"), url.alias("url")) for form, url in urls])
    return songs.select("*", F.explode(rows).alias("_x")).select(*songs.columns, "_x.*")
