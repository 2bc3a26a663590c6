"""Registered queries: record normalisation, year extraction, sources,
URLs, JSON payloads, links (SURVEY §2.1-2.4, 2.9).

Inputs are derived from the given ``pages``, ``documents`` and ``events``
tables by fixed rules that Spark and DuckDB apply identically (the driver
tables carry no crawl metadata of their own)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as TX
from ..operators import records as R
from ..sources.tables import table
from . import sqltext as S
from .registry import register

WS = S.WS
H1_RE = "(?s)<h1>(.*?)</h1>"
TITLE_RE = "(?s)<title>(.*?)</title>"
HOST_RE = "^https?://([^/?#]+)"
BASE_RE = "^(https?://[^/?#]+)"
LINK_RE = '(?s)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def _case(expr_spark, cases, default=None):
    out = None
    for k, v in cases:
        cond = expr_spark == k
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default) if default is not None else out


# ---------------------------------------------------------------- raw records
def raw_records(spark, sf_dir):
    """Scraped-record stand-ins built from ``pages`` (mixed-quality fields
    on purpose: padded ids, bad years, epoch/text/missing timestamps)."""
    return raw_records_from(table(spark, sf_dir, "pages"))


def raw_records_from(p):
    pid = F.col("page_id")
    h1 = F.regexp_extract("html", H1_RE, 1)
    lit = F.lit
    return p.select(
        F.when(pid % 7 == 0, F.concat(lit(" "), pid.cast("string"), lit(" "))).otherwise(pid.cast("string")).alias("id"),
        _case(pid % 6, [(i, lit(v)) for i, v in enumerate(fixed.PLATFORMS)], lit("unknown")).alias("platform"),
        _case(pid % 4, [(i, lit(v)) for i, v in enumerate(fixed.PLATFORM_TYPES)], lit("blog")).alias("platform_type"),
        F.col("url"),
        _case(pid % 4, [(i, lit(v)) for i, v in enumerate(fixed.CONTENT_TYPES)]).alias("content_type"),
        F.when(pid % 3 == 0, lit(None).cast("long")).when(pid % 5 == 0, lit(0).cast("long"))
         .otherwise(lit(1600000000) + pid * 3600).alias("ts_epoch"),
        F.when((pid % 3 == 0) & (pid % 2 == 0), lit("2024-05-01T10:00:00")).alias("ts_text"),
        lit("pages_job").alias("scraper_module"),
        F.when(pid % 2 == 0, F.concat(lit(" "), h1, lit(" "))).otherwise(h1).alias("song_title"),
        F.regexp_extract("url", HOST_RE, 1).alias("artist"),
        _case(pid % 6, [(0, lit(" 1999 ")), (1, lit("99")), (2, lit("19999")),
                        (4, (lit(1990) + pid % 30).cast("string")), (5, lit("abcd"))]).alias("release_year"),
        F.when(pid % 5 == 1, lit(None).cast("string")).otherwise(lit("en")).alias("language_variant"),
        F.when(pid % 9 == 0, lit(None).cast("string")).otherwise(F.regexp_extract("html", TITLE_RE, 1)).alias("text"),
        F.when(pid % 4 == 1, lit(None).cast("string")).otherwise(F.col("html")).alias("raw_text"),
        F.when(pid % 2 == 0, lit(None).cast("string")).otherwise(lit("2024-06-01 00:00:00")).alias("scrape_date"),
    )


def _sql_case(x, cases, default="NULL"):
    body = " ".join(f"WHEN {x} = {k} THEN {v}" for k, v in cases)
    return f"CASE {body} ELSE {default} END"


RAW_SQL = f"""raw AS (
  SELECT
    CASE WHEN page_id % 7 = 0 THEN ' ' || CAST(page_id AS VARCHAR) || ' ' ELSE CAST(page_id AS VARCHAR) END AS id,
    {_sql_case('page_id % 6', [(i, S.q(v)) for i, v in enumerate(fixed.PLATFORMS)], "'unknown'")} AS platform,
    {_sql_case('page_id % 4', [(i, S.q(v)) for i, v in enumerate(fixed.PLATFORM_TYPES)], "'blog'")} AS platform_type,
    url,
    {_sql_case('page_id % 4', [(i, S.q(v)) for i, v in enumerate(fixed.CONTENT_TYPES)])} AS content_type,
    CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 0 ELSE 1600000000 + page_id * 3600 END AS ts_epoch,
    CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN '2024-05-01T10:00:00' END AS ts_text,
    'pages_job' AS scraper_module,
    CASE WHEN page_id % 2 = 0 THEN ' ' || regexp_extract(html, '{H1_RE}', 1) || ' '
         ELSE regexp_extract(html, '{H1_RE}', 1) END AS song_title,
    regexp_extract(url, '{HOST_RE}', 1) AS artist,
    {_sql_case('page_id % 6', [(0, "' 1999 '"), (1, "'99'"), (2, "'19999'"),
                               (4, 'CAST(1990 + page_id % 30 AS VARCHAR)'), (5, "'abcd'")])} AS release_year,
    CASE WHEN page_id % 5 = 1 THEN NULL ELSE 'en' END AS language_variant,
    CASE WHEN page_id % 9 = 0 THEN NULL ELSE regexp_extract(html, '{TITLE_RE}', 1) END AS text,
    CASE WHEN page_id % 4 = 1 THEN NULL ELSE html END AS raw_text,
    CASE WHEN page_id % 2 = 0 THEN NULL ELSE '2024-06-01 00:00:00' END AS scrape_date
  FROM pages)"""


def _norm_sql(src: str = "raw") -> str:
    d = fixed.RECORD_DEFAULTS

    def trimmed(f):
        dv = d.get(f, "")
        return f"{S.strip(f'coalesce({f}, {S.q(dv)})')} AS {f}"

    cols = []
    for f in fixed.RECORD_FIELDS:
        if f == "timestamp":
            cols.append("CASE WHEN ts_epoch IS NOT NULL THEN (CASE WHEN ts_epoch = 0 THEN '' ELSE "
                        "strftime(make_timestamp(ts_epoch * 1000000), '%Y-%m-%d %H:%M:%S') END) "
                        "WHEN ts_text IS NOT NULL THEN ts_text ELSE '' END AS timestamp")
        elif f == "release_year":
            y = S.strip("CAST(release_year AS VARCHAR)")
            cols.append(f"CASE WHEN regexp_matches({y}, '^\\p{{Nd}}{{4}}$') THEN {y} END AS release_year")
        elif f in ("text", "raw_text"):
            cols.append(f"coalesce({f}, '') AS {f}")
        elif f == "scrape_date":
            cols.append(f"CASE WHEN coalesce(scrape_date, '') = '' THEN {S.q(R.DEFAULT_SCRAPE_DATE)} "
                        f"ELSE scrape_date END AS scrape_date")
        elif f in fixed.RECORD_TRIMMED:
            cols.append(trimmed(f))
        elif f in ("album", "genre"):
            cols.append(f"CAST(NULL AS VARCHAR) AS {f}")
        else:
            cols.append(f)
    return f"norm AS (SELECT {', '.join(cols)} FROM {src})"


NORM = _norm_sql()


@register("record_normalize", f"WITH {RAW_SQL}, {NORM} SELECT * FROM norm")
def q_record_normalize(spark, sf_dir):
    return R.record_normalize(raw_records(spark, sf_dir))


@register("record_project_ordered", f"""WITH {RAW_SQL}
SELECT {', '.join(f"coalesce(CAST({f} AS VARCHAR), '') AS {f}" if f not in ('timestamp', 'album', 'genre')
                  else f"'' AS {f}" for f in fixed.RECORD_FIELDS)} FROM raw""")
def q_record_project_ordered(spark, sf_dir):
    return R.record_project_ordered(raw_records(spark, sf_dir))


@register("domain_check", f"""WITH {RAW_SQL}, {NORM}
SELECT id, platform IN {S.in_list(fixed.PLATFORMS)} AS platform_ok,
       platform_type IN {S.in_list(fixed.PLATFORM_TYPES)} AS platform_type_ok,
       content_type IN {S.in_list(fixed.CONTENT_TYPES)} AS content_type_ok FROM norm""")
def q_domain_check(spark, sf_dir):
    return R.domain_check(R.record_normalize(raw_records(spark, sf_dir)))


# ---------------------------------------------------------------- crawl output
def crawl_output(spark, sf_dir):
    """The crawler's own output shape (``lyric_text``, int release_year,
    no album / timestamp / text), built from ``pages``."""
    p = table(spark, sf_dir, "pages")
    h1 = F.regexp_extract("html", H1_RE, 1)
    body = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    return p.select(
        F.md5("url").alias("id"), F.lit(fixed.CRAWL_PLATFORM).alias("platform"),
        F.lit(fixed.CRAWL_PLATFORM_TYPE).alias("platform_type"), "url",
        F.lit(fixed.CRAWL_CONTENT_TYPE).alias("content_type"),
        F.lit(fixed.CRAWL_SCRAPER_MODULE).alias("scraper_module"),
        h1.alias("song_title"), F.regexp_extract("url", HOST_RE, 1).alias("artist"),
        TX.extract_year_min(F.col("html"), 2026).alias("release_year"),
        F.lit(None).cast("string").alias("genre"),
        F.lit(fixed.CRAWL_LANGUAGE_VARIANT).alias("language_variant"),
        TX.strip_title(body, h1).alias("lyric_text"), body.alias("raw_text"),
        F.lit(R.DEFAULT_SCRAPE_DATE).alias("scrape_date"))


_YMIN_RE = "(19[5-9][0-9๐-๙]|20[0-2][0-9๐-๙])"


def _year_min_sql(x: str, as_of: int = 2026) -> str:
    return (f"list_min(list_filter(list_transform(regexp_extract_all({x}, '{_YMIN_RE}', 1), "
            f"lambda y: CAST(translate(y, '{fixed.THAI_DIGITS}', '0123456789') AS INTEGER)), "
            f"lambda y: y >= {fixed.YEAR_MIN_PLAUSIBLE} AND y <= {as_of}))")


def _strip_title_sql(full: str, title: str) -> str:
    return S.strip(f"CASE WHEN coalesce({title}, '') = '' THEN {full} ELSE replace({full}, {title}, '') END")


CRAWL_SQL = f"""crawl AS (
  SELECT md5(url) AS id, {S.q(fixed.CRAWL_PLATFORM)} AS platform, {S.q(fixed.CRAWL_PLATFORM_TYPE)} AS platform_type,
         url, {S.q(fixed.CRAWL_CONTENT_TYPE)} AS content_type, {S.q(fixed.CRAWL_SCRAPER_MODULE)} AS scraper_module,
         regexp_extract(html, '{H1_RE}', 1) AS song_title, regexp_extract(url, '{HOST_RE}', 1) AS artist,
         {_year_min_sql('html')} AS release_year, CAST(NULL AS VARCHAR) AS genre,
         {S.q(fixed.CRAWL_LANGUAGE_VARIANT)} AS language_variant,
         {_strip_title_sql("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)", f"regexp_extract(html, '{H1_RE}', 1)")} AS lyric_text,
         regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS raw_text,
         {S.q(R.DEFAULT_SCRAPE_DATE)} AS scrape_date
  FROM pages)"""


@register("schema_align", f"""WITH {RAW_SQL}, {NORM}, {CRAWL_SQL},
u AS (
  SELECT {', '.join(f"coalesce(CAST({f} AS VARCHAR), '') AS {f}" for f in fixed.RECORD_FIELDS)} FROM norm
  UNION ALL
  SELECT {', '.join(("coalesce(CAST(lyric_text AS VARCHAR), '') AS text" if f == 'text' else
                     f"'' AS {f}" if f in ('album', 'timestamp') else
                     f"coalesce(CAST({f} AS VARCHAR), '') AS {f}") for f in fixed.RECORD_FIELDS)} FROM crawl)
SELECT * FROM u""")
def q_schema_align(spark, sf_dir):
    return R.schema_align(crawl_output(spark, sf_dir), R.record_normalize(raw_records(spark, sf_dir)))


@register("sink_append_found_rows", f"""WITH {RAW_SQL}, {NORM}
SELECT {', '.join(fixed.RECORD_FIELDS)} FROM norm WHERE release_year IS NOT NULL""")
def q_found_records(spark, sf_dir):
    """Records that would be appended (a year was found), without writing."""
    n = R.record_normalize(raw_records(spark, sf_dir))
    return n.filter(F.col("release_year").isNotNull())


# ---------------------------------------------------------------- year search texts
def search_texts(spark, sf_dir):
    """Four search-result snippets per page (sources 1..4 in priority
    order), mixing every year-rule form, Thai digits and no-year text."""
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", TITLE_RE, 1).alias("title"),
        F.regexp_extract("url", HOST_RE, 1).alias("host"))
    p = p.withColumn("source", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])))
    pid, src = F.col("page_id"), F.col("source")
    y_be = (F.lit(2500) + (pid * 7 + src * 13) % 70).cast("string")
    y_ce = (F.lit(1960) + (pid * 11 + src * 5) % 66).cast("string")
    thai = ((pid * src) % 7) == 3
    y_be = F.when(thai, F.translate(y_be, "0123456789", fixed.THAI_DIGITS)).otherwise(y_be)
    kind = (pid + src) % 6
    lit = F.lit
    txt = (F.when(kind == 0, F.concat(lit(fixed.YEAR_BY_ARTIST_WORD + " "), F.col("host"), lit(" · พ.ศ. "), y_be))
           .when(kind == 1, F.concat(lit("ฟังเพลงได้" + fixed.YEAR_VIA_WORD + " Apple Music พ.ศ. "), y_be))
           .when(kind == 2, F.concat(F.col("title"), lit(" Release date: "), y_ce))
           .when(kind == 3, F.concat(lit("วางจำหน่าย "), y_ce, lit(" "), F.col("title")))
           .when(kind == 4, F.concat(F.col("title"), lit(" Apple Music\n"), y_ce))
           .otherwise(F.col("title")))
    return p.select("page_id", "source", txt.alias("text"))


SEARCH_SQL = f"""st0 AS (
  SELECT page_id, regexp_extract(html, '{TITLE_RE}', 1) AS title, regexp_extract(url, '{HOST_RE}', 1) AS host,
         unnest([1, 2, 3, 4]) AS source FROM pages),
st1 AS (
  SELECT *, CAST(2500 + (page_id * 7 + source * 13) % 70 AS VARCHAR) AS y_be0,
            CAST(1960 + (page_id * 11 + source * 5) % 66 AS VARCHAR) AS y_ce,
            (page_id + source) % 6 AS kind FROM st0),
st2 AS (
  SELECT *, CASE WHEN (page_id * source) % 7 = 3 THEN translate(y_be0, '0123456789', '{fixed.THAI_DIGITS}')
                 ELSE y_be0 END AS y_be FROM st1),
st AS (
  SELECT page_id, source, CASE
    WHEN kind = 0 THEN '{fixed.YEAR_BY_ARTIST_WORD} ' || host || ' · พ.ศ. ' || y_be
    WHEN kind = 1 THEN 'ฟังเพลงได้{fixed.YEAR_VIA_WORD} Apple Music พ.ศ. ' || y_be
    WHEN kind = 2 THEN title || ' Release date: ' || y_ce
    WHEN kind = 3 THEN 'วางจำหน่าย ' || y_ce || ' ' || title
    WHEN kind = 4 THEN title || ' Apple Music' || chr(10) || y_ce
    ELSE title END AS text FROM st2)"""

# RE2 forms of the year rules (Python \\s = Unicode whitespace + U+001C..U+001F).
_S = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_BE = rf"พ\.?{_S}*ศ\.?{_S}*([0-9๐-๙]{{4}})"
_R1 = rf"{fixed.YEAR_BY_ARTIST_WORD}{_S}+.+?[·•‧\-–—|]{_S}*{_BE}"
_R2 = rf"{fixed.YEAR_VIA_WORD}{_S}+[A-Za-zก-๙\s\p{{Z}}\x0b\x1c-\x1f\x85]+?{_S}*{_BE}"


def _be_sql(raw: str) -> str:
    return f"CAST(CAST(translate({raw}, '{fixed.THAI_DIGITS}', '0123456789') AS INTEGER) - 543 AS VARCHAR)"


def _snip_sql(x: str, kw: str) -> str:
    return (f"nullif(regexp_extract(regexp_extract({x}, '(?s){kw}(.{{0,{fixed.YEAR_SNIPPET_CHARS}}})', 1), "
            f"'(\\p{{Nd}}{{4}})', 1), '')")


def year_sql(x: str) -> str:
    r1 = f"nullif(regexp_extract({x}, '{_R1}', 1), '')"
    r2 = f"nullif(regexp_extract({x}, '{_R2}', 1), '')"
    r3 = (f"CASE WHEN regexp_matches({x}, '(?i)release') THEN {_snip_sql(x, '(?i)release')} "
          f"WHEN strpos({x}, 'วางจำหน่าย') > 0 THEN {_snip_sql(x, 'วางจำหน่าย')} "
          f"WHEN regexp_matches({x}, '(?i)Apple Music') THEN {_snip_sql(x, '(?i)Apple Music')} END")
    return f"coalesce({_be_sql(r1)}, {_be_sql(r2)}, {r3})"


@register("extract_year", f"WITH {SEARCH_SQL} SELECT page_id, source, {year_sql('text')} AS release_year FROM st")
def q_extract_year(spark, sf_dir):
    st = search_texts(spark, sf_dir)
    return st.select("page_id", "source", TX.extract_year("text").alias("release_year"))


# Rules 4a and 4b of the heavy search, RE2 forms.
_R4A = rf"พ\.ศ\.?{_S}*(\p{{Nd}}{{4}})"
_R4B = rf"\p{{Nd}}{{1,2}}{_S}*[ก-๙]+{_S}*(\p{{Nd}}{{4}})"


def heavy_year_sql(x: str) -> str:
    a, b = (f"nullif(regexp_extract({x}, '{r}', 1), '')" for r in (_R4A, _R4B))
    b = f"CAST(translate({b}, '{fixed.THAI_DIGITS}', '0123456789') AS INTEGER)"
    return (f"coalesce({year_sql(x)}, {_be_sql(a)}, "
            f"CAST(CASE WHEN {b} >= 2500 THEN {b} - {fixed.BUDDHIST_ERA_OFFSET} ELSE {b} END AS VARCHAR))")


HEAVY_FORMS = (" พ.ศ.{} {}", " 12 สิงหาคม {} ({})", " ๕ ก.ค. {} 3มกราคม {}", " {} {}")


def heavy_texts(spark, sf_dir):
    """The snippets; those without a year of the first rules get the forms of
    the heavy search, in the Buddhist or the common era."""
    st = search_texts(spark, sf_dir)
    pid, src = F.col("page_id"), F.col("source")
    era = F.when(pid % 3 == 0, (F.lit(1950) + (pid + src) % 70).cast("string")).otherwise((F.lit(2490) + (pid * 3 + src) % 80).cast("string"))
    era = F.when(pid % 5 == 2, F.translate(era, "0123456789", fixed.THAI_DIGITS)).otherwise(era)
    forms = [F.concat(*[x for p in f.split("{}") for x in (F.lit(p), era)][:-1]) for f in HEAVY_FORMS]
    added = _case(pid % 7, list(enumerate(forms)), F.lit(""))
    return st.select("page_id", "source", F.when((pid + src) % 6 == 5, F.concat("text", added)).otherwise(F.col("text")).alias("text"))


def _forms_sql() -> str:
    forms = [" || ".join(x for p in f.split("{}") for x in (S.q(p), "era"))[:-len(" || era")] for f in HEAVY_FORMS]
    return _sql_case("page_id % 7", list(enumerate(forms)), "''")


HEAVY_SQL = f"""{SEARCH_SQL},
hv AS (SELECT *, CAST(CASE WHEN page_id % 3 = 0 THEN 1950 + (page_id + source) % 70 ELSE 2490 + (page_id * 3 + source) % 80 END AS VARCHAR) AS era0 FROM st),
hv1 AS (SELECT *, CASE WHEN page_id % 5 = 2 THEN translate(era0, '0123456789', '{fixed.THAI_DIGITS}') ELSE era0 END AS era FROM hv),
ht AS (SELECT page_id, source, CASE WHEN (page_id + source) % 6 = 5 THEN text || {_forms_sql()} ELSE text END AS text FROM hv1)"""


@register("extract_year_heavy", f"WITH {HEAVY_SQL} SELECT page_id, source, {heavy_year_sql('text')} AS release_year FROM ht")
def q_extract_year_heavy(spark, sf_dir):
    """All rules, the two of the heavy search included."""
    return heavy_texts(spark, sf_dir).select("page_id", "source", TX.extract_year("text", heavy=True).alias("release_year"))


@register("extract_year_heavy_documents", f"SELECT doc_id, {heavy_year_sql('text')} AS release_year FROM documents")
def q_extract_year_heavy_documents(spark, sf_dir):
    """All rules over whole document texts."""
    from ..operators.corpus import with_computed
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_computed(d, "release_year", TX.extract_year("text", heavy=True)).select("doc_id", "release_year")


@register("thai_digits", f"""WITH {SEARCH_SQL}
SELECT page_id, source, translate(text, '{fixed.THAI_DIGITS}', '0123456789') AS text FROM st""")
def q_thai_digits(spark, sf_dir):
    st = search_texts(spark, sf_dir)
    return st.select("page_id", "source", TX.thai_digits("text").alias("text"))


@register("extract_year_min", f"""WITH {SEARCH_SQL},
agg AS (SELECT page_id, string_agg(text, ' ' ORDER BY source) AS txt FROM st GROUP BY page_id)
SELECT page_id, {_year_min_sql('txt')} AS year_min FROM agg""")
def q_extract_year_min(spark, sf_dir):
    st = search_texts(spark, sf_dir)
    agg = st.groupBy("page_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "text"))),
                                 lambda s: s["text"]), " ").alias("txt"))
    return agg.select("page_id", TX.extract_year_min("txt", 2026).alias("year_min"))


@register("coalesce_sources", f"""WITH {SEARCH_SQL},
y AS (SELECT page_id, source, {year_sql('text')} AS release_year FROM st)
SELECT page_id, arg_min(release_year, source) AS release_year, min(source) AS source
FROM y WHERE release_year IS NOT NULL GROUP BY page_id""")
def q_coalesce_sources(spark, sf_dir):
    from ..operators.corpus import with_computed
    st = search_texts(spark, sf_dir)
    # the year rules are many regexes: keep them out of the aggregation's
    # generated code (which would otherwise exceed the JVM method size)
    y = with_computed(st.select("page_id", "source", "text"), "release_year",
                      TX.extract_year("text")).drop("text")
    return R.coalesce_sources(y, "page_id", "source", "release_year")


@register("first_hit_source", f"""WITH {SEARCH_SQL},
e AS (SELECT page_id, source, CASE WHEN source = 1 AND page_id % 3 = 0 THEN ' ' ELSE text END AS text FROM st)
SELECT page_id, min(source) AS source, arg_min(text, source) AS text
FROM e WHERE {S.strip("coalesce(text, '')")} <> '' GROUP BY page_id""")
def q_first_hit_source(spark, sf_dir):
    st = search_texts(spark, sf_dir)
    e = st.withColumn("text", F.when((F.col("source") == 1) & (F.col("page_id") % 3 == 0), F.lit(" "))
                      .otherwise(F.col("text")))
    return R.first_hit_source(e, "page_id", "source", "text")


# ---------------------------------------------------------------- urls
@register("anti_seen_urls", """
WITH batch AS (SELECT url FROM pages UNION ALL SELECT url FROM pages WHERE page_id % 4 = 0),
seen AS (SELECT url FROM pages WHERE page_id % 3 = 0)
SELECT DISTINCT url FROM batch WHERE url NOT IN (SELECT url FROM seen)""")
def q_anti_seen_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    batch = p.select("url").unionByName(p.filter(F.col("page_id") % 4 == 0).select("url"))
    seen = p.filter(F.col("page_id") % 3 == 0).select("url")
    return R.anti_seen_urls(batch, seen)


@register("stable_id", "SELECT page_id, md5(url) AS record_id FROM pages")
def q_stable_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", TX.stable_id("url").alias("record_id"))


@register("epoch_format", """
SELECT event_id, e AS epoch,
       CASE WHEN e = 0 THEN '' ELSE strftime(make_timestamp(e * 1000000), '%Y-%m-%d %H:%M:%S') END AS formatted
FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS e FROM events)""")
def q_epoch_format(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    e = F.when(F.col("event_id") % 50 == 0, F.lit(0).cast("long")).otherwise(F.unix_seconds(F.col("ts").cast("timestamp")))
    return ev.select("event_id", e.alias("epoch")).select(
        "event_id", "epoch", TX.epoch_format("epoch").alias("formatted"))


def links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all("html", F.lit(LINK_RE), 1)
    texts = F.regexp_extract_all("html", F.lit(LINK_RE), 2)
    z = p.select("page_id", F.regexp_extract("url", BASE_RE, 1).alias("base"),
                 F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("text"))).alias("pos", "a"))
    return z.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "base",
                    F.col("a.href").alias("href"), TX.py_strip(F.col("a.text")).alias("text"))


LINKS_SQL = f"""lk AS (
  SELECT page_id, regexp_extract(url, '{BASE_RE}', 1) AS base,
         regexp_extract_all(html, '{LINK_RE}', 1) AS hrefs,
         regexp_extract_all(html, '{LINK_RE}', 2) AS texts FROM pages),
lx AS (SELECT page_id, base, generate_subscripts(hrefs, 1) AS pos, unnest(hrefs) AS href,
              unnest(texts) AS text0 FROM lk),
links AS (SELECT page_id, CAST(pos AS BIGINT) AS pos, base, href, {S.strip('text0')} AS text FROM lx)"""


@register("absolute_url", f"""WITH {LINKS_SQL}
SELECT page_id, pos, href, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://example.com' || href END AS url
FROM links""")
def q_absolute_url(spark, sf_dir):
    lk = links(spark, sf_dir)
    return lk.select("page_id", "pos", "href", TX.absolute_url("href", "https://example.com").alias("url"))


@register("search_url", f"""WITH {S.SONGS_CTE}
SELECT id, 'https://duckduckgo.com/html/?q=' ||
       replace(url_encode(concat_ws(' ', title, CASE WHEN coalesce(language, '') <> '' THEN language END,
                                    '{fixed.SEARCH_YEAR_KEYWORD}')), '%2F', '/') AS url
FROM songs""")
def q_search_url(spark, sf_dir):
    from ..sources.tables import songs
    s = songs(spark, sf_dir)
    return s.select("id", TX.search_url("https://duckduckgo.com/html/?q=", F.col("title"),
                                        F.col("language"), fixed.SEARCH_YEAR_KEYWORD).alias("url"))


# ---------------------------------------------------------------- text helpers
@register("strip_title", f"""WITH {S.SONGS_CTE}
SELECT id, {_strip_title_sql('lyrics', 'title')} AS lyric_text FROM songs WHERE lyrics IS NOT NULL""")
def q_strip_title(spark, sf_dir):
    from ..sources.tables import songs
    s = songs(spark, sf_dir).filter(F.col("lyrics").isNotNull())
    return s.select("id", TX.strip_title("lyrics", "title").alias("lyric_text"))


@register("genre_from_label", f"""WITH {S.SONGS_CTE},
l AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'other: ' || tag
                      ELSE '{fixed.GENRE_LABEL_MARKER} : ' || tag || ' ' END AS label FROM songs)
SELECT id, label, CASE WHEN strpos(label, '{fixed.GENRE_LABEL_MARKER}') > 0
                       THEN {S.strip("split_part(label, ':', -1)")} END AS genre FROM l""")
def q_genre_from_label(spark, sf_dir):
    from ..sources.tables import songs
    s = songs(spark, sf_dir)
    lab = F.when(F.col("id") % 3 == 0, F.concat(F.lit("other: "), F.col("tag"))) \
        .otherwise(F.concat(F.lit(f"{fixed.GENRE_LABEL_MARKER} : "), F.col("tag"), F.lit(" ")))
    return s.select("id", lab.alias("label")).select(
        "id", "label", TX.genre_from_label("label").alias("genre"))


@register("char_count", f"""SELECT doc_id, CAST(length({S.strip('text')}) AS INTEGER) AS n_chars FROM documents""")
def q_char_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", TX.char_count("text").alias("n_chars"))


def _pad_sql(length: int) -> str:
    return f"""WITH {S.CLEANED_CTE},
t AS (SELECT id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM
        (SELECT id, regexp_extract_all(lower(clean_lyrics), '({S.W}{{2,}})', 1) AS toks FROM era_docs)),
v AS (SELECT tok, row_number() OVER (ORDER BY tok) AS tid FROM (SELECT DISTINCT tok FROM t)),
ids AS (SELECT t.id, list(v.tid ORDER BY t.pos) AS ids FROM t JOIN v USING (tok) GROUP BY t.id)
SELECT e.id, CAST(coalesce(len(ids.ids), 0) AS INTEGER) AS n_tokens,
       array_to_string(list_resize(coalesce(ids.ids, []), {length}, 0), ' ') AS input_ids,
       CAST(least(coalesce(len(ids.ids), 0), {length}) AS INTEGER) AS mask_ones
FROM era_docs e LEFT JOIN ids USING (id)"""


def _padded(spark, sf_dir, length: int):
    """Token ids (1-based alphabetical vocabulary, 0 = pad) cut or padded to
    a fixed length with their attention mask. The vocabulary is that of all
    tokens; only the tokens before the cut are looked up."""
    from ..operators import corpus as C
    from ..operators import encode as EN
    from ..session import materialize
    from ..sources.tables import songs
    docs = materialize(C.prepare_songs(songs(spark, sf_dir)).select("id", TX.tokenize_word("clean_lyrics").alias("tokens")), keep_partitioning=False)
    words = EN.dictionary(docs.select(F.explode("tokens").alias("token"), F.lit(1).alias("n")), id_col="_w").withColumn("tid", F.col("_w") + 1)
    j = EN.encode(docs, "id", F.col("tokens"), words, "tid", "ids", first=length)
    padded, mask = TX.pad_truncate("ids", length)
    return j.select("id", "n_tokens", F.array_join(padded.cast("array<string>"), " ").alias("input_ids"),
                    F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("mask_ones"))


@register("pad_truncate", _pad_sql(fixed.TOKEN_MAX_LEN))
def q_pad_truncate(spark, sf_dir):
    return _padded(spark, sf_dir, fixed.TOKEN_MAX_LEN)


@register("pad_truncate_long", _pad_sql(fixed.YEAR_TOKEN_MAX_LEN))
def q_pad_truncate_long(spark, sf_dir):
    """The year model's length."""
    return _padded(spark, sf_dir, fixed.YEAR_TOKEN_MAX_LEN)


# ---------------------------------------------------------------- JSON payloads
def _payload_spark(ev):
    k = F.col("event_id") % 6
    v100 = F.round(F.col("value") * 100).cast("long").cast("string")
    et, u = F.col("event_type"), F.col("user_id")
    lit = F.lit
    js = (F.when(k == 0, F.concat(lit('{"era": "'), et, lit('", "era_confidence": '), v100, lit("e-2}")))
          .when(k == 1, F.concat(lit('{"predicted_era": "  ", "eraConfidence": "'), v100, lit('e-2 pts"}')))
          .when(k == 2, F.concat(lit('{"predictedEra": "'), et, lit('", "era_score": "abc", "eraConfidence": '),
                                 v100, lit("}")))
          .when(k == 3, F.concat(lit('{"era_label": '), F.col("user_id").cast("string"),
                                 lit(', "era": "", "era_score": "'), v100, lit('"}')))
          .when(k == 4, F.when(u % 3 == 0, lit("{}")).when(u % 3 == 1, F.concat(lit('{"predicted_genre": "'), et, lit('", "genre": " ", "genreConfidence": '), v100, lit("e-2}")))
                .otherwise(F.concat(lit('{"genre_label": "g", "genre_score": "'), v100, lit('e-2", "overallConfidence": "x", "confidence": '), v100, lit("}"))))
          .otherwise(F.col("props")))
    return ev.select("event_id", js.alias("payload"))


_PAYLOAD_SQL = """pl AS (
  SELECT event_id, CASE event_id % 6
    WHEN 0 THEN '{"era": "' || event_type || '", "era_confidence": ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || 'e-2}'
    WHEN 1 THEN '{"predicted_era": "  ", "eraConfidence": "' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || 'e-2 pts"}'
    WHEN 2 THEN '{"predictedEra": "' || event_type || '", "era_score": "abc", "eraConfidence": ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '}'
    WHEN 3 THEN '{"era_label": ' || CAST(user_id AS VARCHAR) || ', "era": "", "era_score": "' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '"}'
    WHEN 4 THEN CASE user_id % 3 WHEN 0 THEN '{}'
      WHEN 1 THEN '{"predicted_genre": "' || event_type || '", "genre": " ", "genreConfidence": ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || 'e-2}'
      ELSE '{"genre_label": "g", "genre_score": "' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || 'e-2", "overallConfidence": "x", "confidence": ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '}' END
    ELSE props END AS payload FROM events)"""


def _pick_str_sql(keys, default):
    out = S.q(default)
    for k in reversed(keys):
        val = f"json_extract_string(payload, '$.{k}')"
        out = (f"CASE WHEN coalesce(json_type(payload, '$.{k}') = 'VARCHAR' AND {S.strip(val)} <> '', false) "
               f"THEN {val} ELSE {out} END")
    return out


_PF = r"^[\s]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"


def _pick_num_sql(keys, default):
    out = str(default)
    for k in reversed(keys):
        raw = f"json_extract_string(payload, '$.{k}')"
        typ = f"json_type(payload, '$.{k}')"
        x = (f"(CASE WHEN {typ} IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'INTEGER', 'HUGEINT') THEN TRY_CAST({raw} AS DOUBLE) "
             f"WHEN {typ} = 'VARCHAR' THEN TRY_CAST(nullif(regexp_extract({raw}, '{_PF}', 1), '') AS DOUBLE) END)")
        ok = f"coalesce({x} IS NOT NULL AND isfinite({x}), false)"
        out = (f"CASE WHEN {ok} THEN CAST(greatest(0, least(100, floor({x} + 0.5))) AS INTEGER) "
               f"ELSE {out} END")
    return out


@register("pick_first_key", f"""WITH {_PAYLOAD_SQL},
p1 AS (SELECT event_id, payload, {_pick_str_sql(fixed.ERA_KEYS, fixed.DEFAULT_ERA)} AS era,
       {_pick_str_sql(fixed.GENRE_KEYS, fixed.DEFAULT_GENRE)} AS genre,
       {_pick_num_sql(fixed.ERA_CONFIDENCE_KEYS, 0)} AS era_confidence,
       {_pick_num_sql(fixed.GENRE_CONFIDENCE_KEYS, 0)} AS genre_confidence FROM pl)
SELECT event_id, era, genre, era_confidence, genre_confidence,
       {_pick_num_sql(fixed.OVERALL_CONFIDENCE_KEYS, "CAST(floor((era_confidence + genre_confidence) / 2 + 0.5) AS INTEGER)")} AS overall_confidence FROM p1""")
def q_pick_first_key(spark, sf_dir):
    """The whole prediction read from a payload: era, genre and their
    confidences; the overall confidence falls back to the mean of the two."""
    return R.map_prediction(_payload_spark(table(spark, sf_dir, "events")), "payload").select(
        "event_id", "era", "genre", "era_confidence", "genre_confidence", "overall_confidence")


def _track_json_spark(p):
    pid = F.col("page_id")
    h1 = F.replace(F.regexp_extract("html", H1_RE, 1), F.lit('"'), F.lit(""))
    host = F.regexp_extract("url", HOST_RE, 1)
    date = F.concat((F.lit(1960) + pid % 60).cast("string"), F.lit("-01-15"))
    item = F.concat(F.lit('{"name": "'), h1, F.lit('", "artists": [{"name": "'), host,
                    F.lit('"}], "album": {"release_date": "'), date, F.lit('"}}'))
    return p.select("page_id", F.when(pid % 5 == 0, F.lit('{"tracks": {"items": []}}'))
                    .otherwise(F.concat(F.lit('{"tracks": {"items": ['), item, F.lit("]}}"))).alias("response"))


@register("json_track_flatten", f"""WITH r AS (
  SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '{{"tracks": {{"items": []}}}}'
    ELSE '{{"tracks": {{"items": [{{"name": "' || replace(regexp_extract(html, '{H1_RE}', 1), '"', '')
         || '", "artists": [{{"name": "' || regexp_extract(url, '{HOST_RE}', 1)
         || '"}}], "album": {{"release_date": "' || CAST(1960 + page_id % 60 AS VARCHAR) || '-01-15"}}}}]}}}}' END
    AS response FROM pages)
SELECT page_id, json_extract_string(response, '$.tracks.items[0].name') AS song_title,
       json_extract_string(response, '$.tracks.items[0].artists[0].name') AS artist,
       json_extract_string(response, '$.tracks.items[0].album.release_date') AS release_date FROM r""")
def q_json_track_flatten(spark, sf_dir):
    r = _track_json_spark(table(spark, sf_dir, "pages"))
    return R.json_track_flatten(r, "response").select("page_id", "song_title", "artist", "release_date")
