"""Ingest records: normalisation, ordered projection, schema alignment,
domain checks, source priority, seen-url filtering, saved JSON responses.
All are column expressions or joins; nothing runs row-at-a-time in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import epoch_format, overall_confidence, py_strip

DEFAULT_SCRAPE_DATE = "2025-01-01 00:00:00"   # parameter, replaces the wall clock


def _trim(c: Column) -> Column:
    return py_strip(c)


def record_normalize(df: DataFrame, scrape_date: str = DEFAULT_SCRAPE_DATE) -> DataFrame:
    """Normalise raw lyric records.

    * timestamp: ``ts_epoch`` (int seconds) -> 'yyyy-MM-dd HH:mm:ss' in UTC,
      0 -> ''; else ``ts_text`` kept as is; else ''.
    * release_year kept only when, trimmed, it is exactly 4 digits.
    * id, platform, platform_type, url, content_type, song_title, artist,
      language_variant are stripped; defaults fill missing values.
    * text / raw_text: null -> ''; scrape_date: null or '' -> default.
    """
    cols = set(df.columns)

    def col(name, default=None, dtype="string"):
        if name in cols:
            return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))
        return F.lit(default).cast(dtype)

    epoch = col("ts_epoch", dtype="long")
    ts = F.when(epoch.isNotNull(), epoch_format(epoch)) \
        .when(col("ts_text").isNotNull(), col("ts_text")).otherwise(F.lit(""))
    y = _trim(col("release_year").cast("string"))
    year = F.when(y.rlike("^\\p{Nd}{4}$"), y)
    out = {}
    for f in fixed.RECORD_FIELDS:
        if f == "timestamp":
            out[f] = ts
        elif f == "release_year":
            out[f] = year
        elif f in ("text", "raw_text"):
            out[f] = col(f, "")
        elif f == "scrape_date":
            out[f] = F.when(F.coalesce(col(f), F.lit("")) == "", F.lit(scrape_date)).otherwise(col(f))
        elif f in fixed.RECORD_TRIMMED:
            out[f] = _trim(col(f, fixed.RECORD_DEFAULTS.get(f, "")))
        else:
            out[f] = col(f)
    return df.select(*[v.alias(k) for k, v in out.items()])


def record_project_ordered(df: DataFrame) -> DataFrame:
    """Exactly the configured fields, in order; missing -> ''."""
    cols = set(df.columns)
    return df.select(*[
        (F.coalesce(F.col(f).cast("string"), F.lit("")) if f in cols else F.lit("")).alias(f)
        for f in fixed.RECORD_FIELDS])


def schema_align(crawl: DataFrame, records: DataFrame) -> DataFrame:
    """Union crawl output (``lyric_text``, no album/timestamp/text) with
    normalised records by name; the lyric is carried into ``text`` instead
    of being lost."""
    c = crawl.withColumnRenamed("lyric_text", "text") if "lyric_text" in crawl.columns else crawl
    for f in fixed.RECORD_FIELDS:
        if f in c.columns:
            c = c.withColumn(f, F.col(f).cast("string"))
    return record_project_ordered(
        records.unionByName(c.select(*[x for x in c.columns if x in fixed.RECORD_FIELDS]),
                            allowMissingColumns=True))


def domain_check(df: DataFrame) -> DataFrame:
    """Data-quality flags: platform, platform_type, content_type in their
    allowed value sets."""
    return df.select(
        "id",
        F.col("platform").isin(*fixed.PLATFORMS).alias("platform_ok"),
        F.col("platform_type").isin(*fixed.PLATFORM_TYPES).alias("platform_type_ok"),
        F.col("content_type").isin(*fixed.CONTENT_TYPES).alias("content_type_ok"))


def coalesce_sources(df: DataFrame, key: str, priority: str, value: str) -> DataFrame:
    """Per key: the value from the highest-priority source (smallest
    ``priority``) that has one; keys with no value anywhere are dropped.
    One aggregation (min_by), no pivot, no window."""
    found = df.filter(F.col(value).isNotNull())
    return found.groupBy(key).agg(
        F.min_by(F.col(value), F.col(priority)).alias(value),
        F.min(priority).alias(priority))


def first_hit_source(df: DataFrame, key: str, priority: str, text: str) -> DataFrame:
    """Per key: the first source in priority order whose text is non-empty."""
    hit = df.filter(F.coalesce(py_strip(F.col(text)), F.lit("")) != "")
    return hit.groupBy(key).agg(
        F.min(priority).alias(priority),
        F.min_by(F.col(text), F.col(priority)).alias(text))


def anti_seen_urls(batch: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """New URLs of a batch: de-duplicated within the batch and not already
    stored (left anti join on the stored url set)."""
    return batch.dropDuplicates([url]).join(seen.select(url).distinct(), url, "left_anti")


def json_track_flatten(df: DataFrame, col: str) -> DataFrame:
    """First hit of a saved track-search response -> title, first artist,
    album release date (null when there is no hit)."""
    schema = ("struct<tracks: struct<items: array<struct<name: string, "
              "artists: array<struct<name: string>>, album: struct<release_date: string>>>>>")
    r = F.from_json(F.col(col), schema)
    first = F.get(r["tracks"]["items"], 0)
    return df.select("*", first["name"].alias("song_title"),
                     F.get(first["artists"], 0)["name"].alias("artist"),
                     first["album"]["release_date"].alias("release_date"))


def pick_first_key(df: DataFrame, col: str, keys, default: str, out: str) -> DataFrame:
    """First non-blank *string* among alternative JSON keys, else default."""
    v = F.try_parse_json(F.col(col))
    expr = F.lit(default)
    for k in reversed(list(keys)):
        val = F.try_variant_get(v, f"$.{k}", "string")
        is_str = F.schema_of_variant(F.variant_get(v, f"$.{k}", "variant")) == "STRING"
        ok = F.coalesce(is_str & (py_strip(val) != ""), F.lit(False))
        expr = F.when(ok, val).otherwise(expr)
    return df.withColumn(out, expr)


PARSE_FLOAT_RE = "^[\\s]*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)"


def pick_first_number(df: DataFrame, col: str, keys, default: int | Column, out: str) -> DataFrame:
    """First finite number among alternative JSON keys (a JSON number, or a
    string whose leading part parses as a float), clamped and rounded to an
    integer 0..100; else default."""
    v = F.try_parse_json(F.col(col))
    expr = default if isinstance(default, Column) else F.lit(default)
    for k in reversed(list(keys)):
        raw = F.try_variant_get(v, f"$.{k}", "string")
        typ = F.schema_of_variant(F.variant_get(v, f"$.{k}", "variant"))
        num = F.when(typ.rlike("^(DECIMAL|BIGINT|INT|DOUBLE|FLOAT|SMALLINT|TINYINT)"),
                     raw.try_cast("double"))
        parsed = F.when(typ == "STRING", F.nullif(F.regexp_extract(raw, PARSE_FLOAT_RE, 1), F.lit(""))
                        .try_cast("double"))
        x = F.coalesce(num, parsed)
        ok = F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(x + 0.5))).cast("int")
        expr = F.when(ok, clamped).otherwise(expr)
    return df.withColumn(out, expr)


def map_prediction(df: DataFrame, col: str) -> DataFrame:
    """A prediction payload (JSON text) as columns: era, genre, era_confidence,
    genre_confidence, overall_confidence (integers 0..100). The overall one
    falls back to the rounded mean of the other two, the rest to the defaults."""
    out = pick_first_key(df, col, fixed.ERA_KEYS, fixed.DEFAULT_ERA, "era")
    out = pick_first_key(out, col, fixed.GENRE_KEYS, fixed.DEFAULT_GENRE, "genre")
    out = pick_first_number(out, col, fixed.ERA_CONFIDENCE_KEYS, 0, "era_confidence")
    out = pick_first_number(out, col, fixed.GENRE_CONFIDENCE_KEYS, 0, "genre_confidence")
    mean = overall_confidence("era_confidence", "genre_confidence")
    return pick_first_number(out, col, fixed.OVERALL_CONFIDENCE_KEYS, mean, "overall_confidence")
