"""Corpus preparation: filters, coercion, cleaning, de-duplication, era bins,
stage funnel. All operators are ``DataFrame -> DataFrame`` (use with
``df.transform``) or ``Column -> Column``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import clean_lyrics, py_strip

NUMERIC_RE = "^\\s*[+-]?[0-9.]+([eE][+-]?[0-9]+)?\\s*$"


# ---------------------------------------------------------------- predicates
def filter_language(df: DataFrame, col: str = "language", lang: str = fixed.KEEP_LANGUAGE) -> DataFrame:
    return df.filter(F.col(col) == lang)


def is_present(c: str, dtype: str | None = None) -> Column:
    """Not missing: not null, and not NaN for floating columns."""
    cond = F.col(c).isNotNull()
    if dtype in ("double", "float"):
        cond = cond & ~F.isnan(F.col(c))
    return cond


def filter_notnull(df: DataFrame, cols) -> DataFrame:
    dtypes = dict(df.dtypes)
    return df.filter(reduce(lambda a, b: a & b, [is_present(c, dtypes.get(c)) for c in cols]))


def title_noise_pattern(keywords=fixed.NOISE_KEYWORDS) -> str:
    return "|".join(keywords)


def is_title_noise(title: str = "title", keywords=fixed.NOISE_KEYWORDS) -> Column:
    """Lower-cased title *contains* any keyword (substring, so 'discover'
    matches 'cover'); a missing title counts as ''."""
    return F.lower(F.coalesce(F.col(title), F.lit(""))).rlike(title_noise_pattern(keywords))


def filter_title_noise(df: DataFrame, title: str = "title", keywords=fixed.NOISE_KEYWORDS) -> DataFrame:
    return df.filter(~is_title_noise(title, keywords))


def filter_blank(df: DataFrame, col: str) -> DataFrame:
    return df.filter(py_strip(F.col(col)) != "")


def filter_min_length(df: DataFrame, col: str = "clean_lyrics", min_chars: int = fixed.MIN_CLEAN_CHARS) -> DataFrame:
    return df.filter(F.char_length(F.col(col)) > min_chars)


def in_year_range(col: str = "year", lo: int = fixed.YEAR_MIN, hi: int = fixed.YEAR_MAX) -> Column:
    return F.col(col).between(lo, hi)


def filter_year_range(df: DataFrame, col: str = "year") -> DataFrame:
    return df.filter(in_year_range(col))


def filter_in_genres(df: DataFrame, col: str = "tag", genres=fixed.GENRES) -> DataFrame:
    return df.filter(F.col(col).isin(*genres))


def filter_exclude_class(df: DataFrame, col: str = "tag", excluded: str = fixed.EXCLUDED_GENRE) -> DataFrame:
    """Drop one class; rows with a missing class go too (the reference drops
    them in the very next step)."""
    return df.filter((F.col(col) != excluded) & F.col(col).isNotNull())


def filter_sentinel_title(df: DataFrame, col: str = "song_title") -> DataFrame:
    t = F.coalesce(F.col(col), F.lit(""))
    return df.filter((t != "") & (t != fixed.LYRICS_PLACEHOLDER_TITLE))


# ---------------------------------------------------------------- casts
def coerce_numeric(c) -> Column:
    """String -> double; anything unparsable -> null (never an error).
    The guard rejects JVM-only forms such as '1990d'."""
    x = F.col(c) if isinstance(c, str) else c
    s = x.cast("string")
    return F.when(s.rlike(NUMERIC_RE), F.trim(s).try_cast("double"))


def cast_numeric_coerce(df: DataFrame, year: str = "year", views: str | None = "views") -> DataFrame:
    """year -> double and drop rows where it is missing; views -> double with
    missing -> 0."""
    out = df.withColumn(year, coerce_numeric(year))
    out = out.filter(F.col(year).isNotNull() & ~F.isnan(F.col(year)))
    if views and views in df.columns:
        v = coerce_numeric(views)
        out = out.withColumn(views, F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v))
    return out


def cast_target_float(df: DataFrame, col: str = "year", target: str = "labels") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("float")).withColumnRenamed(col, target)


# ---------------------------------------------------------------- era bins
def era_bin(c="year", edges=fixed.ERA_EDGES, labels=fixed.ERA_LABELS) -> Column:
    """Left-closed decade bins [1970,1980) ... [2020,2026); outside -> null."""
    y = F.col(c) if isinstance(c, str) else c
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (y >= lo) & (y < hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


# ---------------------------------------------------------------- dedup
def dedup_keep_first(df: DataFrame, text: str = "clean_lyrics", year: str = "year",
                     views: str | None = "views", tiebreak: str = "id") -> DataFrame:
    """One row per distinct text: the oldest year, then the most views, then
    the smallest id.

    Implemented as a grouped ``min_by`` so a hot text (one text holding a
    large share of the rows) is reduced map-side before the shuffle instead
    of landing whole in one window partition. The group key is the text's
    md5: 32 characters are sorted and shuffled, not whole texts."""
    order = [F.col(year)]
    if views and views in df.columns:
        order.append(-F.col(views))
    order.append(F.col(tiebreak))
    best = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order))
    return df.groupBy(F.md5(F.col(text)).alias("_k")).agg(best.alias("_w")).select("_w.*")


# ---------------------------------------------------------------- pipeline A
def with_computed(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add an expensive column that later filters refer to, evaluated once.

    A filter on a plain derived column is pushed below its projection with
    the expression inlined, so the expression runs twice (filter + project)
    and inside the scan task. Producing the value through a one-element
    ``explode`` (a Generate node) keeps the filter above it: the expression is
    evaluated once, after any repartition, while cheaper filters that do not
    use it still reach the scan."""
    return df.select("*", F.explode(F.array(expr)).alias(name))


def clean_stage(df: DataFrame) -> DataFrame:
    """language -> lyrics present -> title noise -> year coercion -> clean ->
    length filter. Equality/null filters come first so they reach the scan."""
    out = filter_language(df)
    out = out.filter(F.col("lyrics").isNotNull())
    out = filter_title_noise(out)
    out = cast_numeric_coerce(out, "year", "views" if "views" in df.columns else None)
    out = with_computed(out, "clean_lyrics", clean_lyrics("lyrics"))
    return filter_min_length(out)


def prepare_songs(df: DataFrame) -> DataFrame:
    """Raw songs -> (id, clean_lyrics, year, song_era): the reference's
    preparation job up to the split."""
    cleaned = clean_stage(df).select("id", "clean_lyrics", "year",
                                     *(["views"] if "views" in df.columns else []))
    dedup = dedup_keep_first(cleaned)
    return (filter_year_range(dedup)
            .withColumn("song_era", era_bin("year"))
            .select("id", "clean_lyrics", "year", "song_era"))


def stage_funnel(df: DataFrame) -> DataFrame:
    """Row counts after each preparation stage, from one scan and one
    evaluation of the cleaning chain.

    Rows are grouped by md5 of the cleaned text (null for rows that fail a
    row-level stage). Each group carries its row-level stage counts and its
    oldest year, and a second, global aggregation over that group table
    gives every count: the row-level stages as sums, dedup as the number of
    keys, year range as the keys whose kept (oldest) year is in range. The
    null group may be large; partial aggregation reduces it map-side."""
    lang = F.col("language") == fixed.KEEP_LANGUAGE
    s1 = F.coalesce(lang, F.lit(False))
    s2 = s1 & F.col("lyrics").isNotNull()
    s3 = s2 & ~is_title_noise()
    y = coerce_numeric("year")
    s4 = s3 & y.isNotNull() & ~F.isnan(y)
    flags = with_computed(df.select("language", "lyrics", "title", "year"), "_clean",
                          F.when(s4, clean_lyrics("lyrics")))
    s5 = F.col("_s4") & (F.char_length("_clean") > fixed.MIN_CLEAN_CHARS)
    flags = flags.select(s1.alias("_s1"), s2.alias("_s2"), s3.alias("_s3"), s4.alias("_s4"),
                         y.alias("_y"), "_clean")
    flags = flags.select("*", F.coalesce(s5, F.lit(False)).alias("_s5"))
    groups = flags.groupBy(F.when(F.col("_s5"), F.md5("_clean")).alias("_k")).agg(
        F.count(F.lit(1)).alias("n0"),
        *[F.sum(F.col(f"_s{i}").cast("long")).alias(f"n{i}") for i in range(1, 6)],
        F.min(F.when(F.col("_s5"), F.col("_y"))).alias("_ymin"))
    total = groups.agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(0, 6)],
        F.count("_k").alias("n6"),
        F.sum((F.col("_k").isNotNull()
               & F.col("_ymin").between(fixed.YEAR_MIN, fixed.YEAR_MAX)).cast("long")).alias("n7"))
    names = ["raw", "language", "lyrics_present", "title_noise", "year_valid",
             "min_length", "dedup", "year_range"]
    stack = ", ".join(f"{i}, '{n}', coalesce(n{i}, 0L)" for i, n in enumerate(names))
    out = total.selectExpr(f"stack({len(names)}, {stack}) AS (stage_no, stage, n_rows)")
    return out.select(F.col("stage_no").cast("int"), "stage", F.col("n_rows").cast("long"))


def project_training_cols(df: DataFrame) -> DataFrame:
    return df.select("id", "clean_lyrics", "year", "song_era")
