"""Registered queries: links of pages in their three forms, crawl worklists,
search requests, page text and page records (SURVEY §2.3, 2.9).

The given pages have plain anchors in one list. ``marked_pages`` rewrites them
by page number, in Spark, into the forms a crawl meets: titles, several classes,
nested and unclosed tags, single and absent quotes, upper-case names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import links as L
from ..operators import pages as P
from ..operators import records as R
from ..sources.tables import songs, table
from . import sqltext as S
from .q_ingest import BASE_RE, HOST_RE, _strip_title_sql, _year_min_sql
from .registry import register

AS_OF_YEAR = 2026
HIT_TITLE = fixed.SONG_TITLE_PREFIX + " ฮิต"
ITEM = '<li><a href="(/[^"]*)">([^<]*)</a></li>'


def marked_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    m = F.col("page_id") % 4
    first = f"<nav><ul><li><a title='{fixed.LYRICS_PLACEHOLDER_TITLE}' href='/all'> {fixed.LYRICS_PLACEHOLDER_TITLE} </a></li>"
    hit = F.replace(F.regexp_replace("html", ITEM, f"<li><a title='{HIT_TITLE}' class='  song hit ' href=\"$1\"><b>$2</b><!-- $2 --><br> </a></li>"),
                    F.lit("<nav><ul>"), F.lit(first))
    artist = F.regexp_replace("html", ITEM, f"<LI><A data-href=\"/x\" CLASS=artist HREF=\"{fixed.ARTIST_HREF_PREFIX}$1\">$2</LI>")
    other = F.regexp_replace("html", ITEM, "<li><a class='songs SONG' title href=\"http://other.example$1\">$2</a><script>var a='<a href=/no>no</a>'</script></li>")
    return p.select("page_id", "url", F.when(m == 1, hit).when(m == 2, artist).when(m == 3, other).otherwise(F.col("html")).alias("html"))


def _text_sql(x: str) -> str:
    """Character references of the pages, decoded."""
    x = f"replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


ITEMS_SQL = f"""li AS (SELECT page_id, regexp_extract(url, '{BASE_RE}', 1) AS base,
         regexp_extract_all(html, '{ITEM}', 1) AS hrefs, regexp_extract_all(html, '{ITEM}', 2) AS texts FROM pages),
li1 AS (SELECT page_id, base, CAST(generate_subscripts(hrefs, 1) AS BIGINT) AS pos, unnest(hrefs) AS h, unnest(texts) AS t FROM li),
items AS (SELECT page_id, base, pos, {_text_sql('h')} AS href, {S.strip(_text_sql('t'))} AS text FROM li1)"""


def _base():
    return F.regexp_extract("url", BASE_RE, 1)


@register("extract_links", f"WITH {ITEMS_SQL} SELECT page_id, pos, text, base || href AS url FROM items")
def q_extract_links(spark, sf_dir):
    """Anchors whose href starts with a prefix ('/'), with absolute urls."""
    links = L.by_href(L.page_links(table(spark, sf_dir, "pages")), "/")
    return links.select("page_id", "pos", "text", L.absolute_url("href", _base()).alias("url"))


@register("extract_links_forms", f"""WITH {ITEMS_SQL}
SELECT page_id, pos + CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END AS pos,
       CASE page_id % 4 WHEN 2 THEN '{fixed.ARTIST_HREF_PREFIX}' || href WHEN 3 THEN 'http://other.example' || href ELSE href END AS href,
       CASE page_id % 4 WHEN 1 THEN '{HIT_TITLE}' WHEN 3 THEN '' END AS title,
       CASE page_id % 4 WHEN 1 THEN 'song hit' WHEN 2 THEN 'artist' WHEN 3 THEN 'songs SONG' ELSE '' END AS classes, text FROM items
UNION ALL SELECT page_id, 1, '/all', '{fixed.LYRICS_PLACEHOLDER_TITLE}', '', '{fixed.LYRICS_PLACEHOLDER_TITLE}' FROM pages
WHERE page_id % 4 = 1 AND contains(html, '<nav><ul>')""")
def q_extract_links_forms(spark, sf_dir):
    """All anchors of the marked pages with their attributes."""
    return L.page_links(marked_pages(spark, sf_dir)).select(
        "page_id", "pos", "href", "title", F.array_join("classes", " ").alias("classes"), "text")


@register("extract_links_title", f"""WITH {ITEMS_SQL},
u AS (SELECT base || href AS url, text, page_id FROM items WHERE page_id % 4 = 1 AND text <> '{fixed.LYRICS_PLACEHOLDER_TITLE}')
SELECT url, min(text) AS song_title FROM u WHERE url NOT IN (SELECT url FROM u WHERE page_id % 8 = 1) GROUP BY url""")
def q_extract_links_title(spark, sf_dir):
    """Song pages to fetch: links by title prefix, without what was seen."""
    links = L.page_links(marked_pages(spark, sf_dir))
    seen = L.song_links(links.filter("page_id % 8 = 1"), _base())
    return L.song_links(links, _base(), seen.select("url"))


@register("extract_links_artist", f"""WITH {ITEMS_SQL}
SELECT base || '{fixed.ARTIST_HREF_PREFIX}' || href AS url, min(text) AS artist FROM items WHERE page_id % 4 = 2 GROUP BY ALL""")
def q_extract_links_artist(spark, sf_dir):
    """Artist pages to fetch: links by href prefix."""
    return L.artist_links(L.page_links(marked_pages(spark, sf_dir)), _base())


@register("extract_links_class", f"""WITH {ITEMS_SQL}
SELECT page_id, pos + 1 AS pos, text, base || href AS url FROM items WHERE page_id % 4 = 1 AND pos = 1""")
def q_extract_links_class(spark, sf_dir):
    """The first search hit of each page: link by class."""
    hits = L.first_by_class(L.page_links(marked_pages(spark, sf_dir)), fixed.RESULT_LINK_CLASS)
    return hits.select("page_id", "pos", "text", L.absolute_url("href", _base()).alias("url"))


# ---------------------------------------------------------------- requests
@register("index_worklist", f"""SELECT base, letter, base || '{fixed.INDEX_PATH}' || letter AS url
FROM (SELECT DISTINCT regexp_extract(url, '{BASE_RE}', 1) AS base FROM pages), (SELECT unnest(string_split('{fixed.THAI_INDEX_LETTERS}', '')) AS letter)""")
def q_index_worklist(spark, sf_dir):
    """The index pages of every letter on every site of the pages."""
    return L.index_requests(table(spark, sf_dir, "pages").select(_base().alias("base")))


_QUOTE = "replace(url_encode({}), '%2F', '/')"


@register("search_worklist", f"""WITH {S.SONGS_CTE},
s AS (SELECT id, coalesce(title, '') AS t, CASE WHEN id % 3 = 0 THEN '' ELSE coalesce(tag, '') END AS a FROM songs)
SELECT id, 'lyrics' AS form, '{fixed.LYRICS_SEARCH_URL}' || {_QUOTE.format("CASE WHEN a <> '' THEN t || ' ' || a ELSE t END")} AS url FROM s
UNION ALL SELECT id, 'year', '{fixed.YEAR_SEARCH_URL}' || {_QUOTE.format(f"a || ' ' || t || ' {fixed.SEARCH_YEAR_KEYWORD}'")} FROM s
UNION ALL SELECT id, 'plain', '{fixed.YEAR_SEARCH_URL}' || t || '+' || a || '+{fixed.SEARCH_YEAR_KEYWORD}' FROM s
UNION ALL SELECT id, 'check', '{fixed.CHECK_SEARCH_URL}' || replace(t || ' ' || a || ' {fixed.CHECK_YEAR_KEYWORDS}', ' ', '+') FROM s""")
def q_search_worklist(spark, sf_dir):
    """Every search that can be asked about each song; some have no artist."""
    s = songs(spark, sf_dir).select("id", "title", F.when(F.col("id") % 3 != 0, F.col("tag")).alias("artist"))
    return L.search_requests(s).select("id", "form", "url")


# ---------------------------------------------------------------- page text and records
def parsed_pages(spark, sf_dir):
    return P.parse_pages(table(spark, sf_dir, "pages"), tag="article")


def _nodes(x: str, between: str) -> str:
    nodes = f"list_transform(regexp_split_to_array({x}, '<[^>]*>'), lambda n: {S.strip(_text_sql('n'))})"
    return f"array_to_string(list_filter({nodes}, lambda n: n <> ''), {between})"


PARSED_SQL = f"""pp0 AS (SELECT page_id, url, html,
    regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '<>', 'g') AS shown FROM pages),
pp1 AS (SELECT *, regexp_extract(shown, '(?s)<article[^>]*>(.*)</article>', 1) AS inner_html FROM pp0),
pp AS (SELECT page_id, url, {_nodes('shown', "' '")} AS page_text, {_nodes('inner_html', 'chr(10)')} AS block_text,
    regexp_extract(html, '(?s)<article[^>]*>.*</article>') AS block_html,
    {S.strip(_text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS heading FROM pp1)"""


@register("extract_block_text", f"WITH {PARSED_SQL} SELECT page_id, block_text, block_html FROM pp")
def q_extract_block_text(spark, sf_dir):
    return parsed_pages(spark, sf_dir).select("page_id", "block_text", "block_html")


@register("page_text", f"WITH {PARSED_SQL} SELECT page_id, page_text FROM pp")
def q_page_text(spark, sf_dir):
    return parsed_pages(spark, sf_dir).select("page_id", "page_text")


RECORD_SQL = f"""SELECT md5(url) AS id, '{fixed.CRAWL_PLATFORM}' AS platform, '{fixed.CRAWL_PLATFORM_TYPE}' AS platform_type, url,
  '{fixed.CRAWL_CONTENT_TYPE}' AS content_type, '{fixed.CRAWL_SCRAPER_MODULE}' AS scraper_module, heading AS song_title,
  regexp_extract(url, '{HOST_RE}', 1) AS artist, CAST({_year_min_sql('page_text')} AS VARCHAR) AS release_year, CAST(NULL AS VARCHAR) AS genre,
  '{fixed.CRAWL_LANGUAGE_VARIANT}' AS language_variant, {_strip_title_sql('block_text', 'heading')} AS lyric_text,
  block_html AS raw_text, '{R.DEFAULT_SCRAPE_DATE}' AS scrape_date FROM pp"""


@register("page_to_record", f"WITH {PARSED_SQL} {RECORD_SQL}")
def q_page_to_record(spark, sf_dir):
    return page_records(table(spark, sf_dir, "pages"))


def page_records(pages):
    """Crawl records of the pages; the year as text, since no page may have one."""
    records = P.page_to_record(P.parse_pages(pages, tag="article"), AS_OF_YEAR, R.DEFAULT_SCRAPE_DATE)
    return records.withColumn("release_year", F.col("release_year").cast("string"))
