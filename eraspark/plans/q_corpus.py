"""Registered queries: scans, filters, casts, cleaning, tokenising, dedup,
funnel, labels, counts (SURVEY §2.1-2.3, 2.5, 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as TX
from ..operators import analytics as A
from ..operators import corpus as C
from ..operators.labels import label_binary, label_decode, label_encode, label_table
from ..operators.ranking import exact_rank, hex_bucket
from ..sources.tables import songs, table
from . import sqltext as S
from .registry import register

WITH_CLEAN = f"WITH {S.CLEANED_CTE}"
ERAS = fixed.ERA_LABELS


def era_docs(spark, sf_dir):
    return C.prepare_songs(songs(spark, sf_dir))


# ---------------------------------------------------------------- scans
@register("scan_songs", f"WITH {S.SONGS_CTE} SELECT * FROM songs")
def q_scan_songs(spark, sf_dir):
    return songs(spark, sf_dir)


@register("scan_songs_csv", f"WITH {S.SONGS_CTE} SELECT * FROM songs")
def q_scan_songs_csv(spark, sf_dir):
    """The songs through CSV files, the form the raw corpus comes in: texts with
    newlines, quotes and separators, missing fields."""
    from ..session import shared_path
    from ..sources.tables import scan_songs_csv, write_songs_csv
    path = shared_path(spark, "songs_csv")
    write_songs_csv(songs(spark, sf_dir), path)
    return scan_songs_csv(spark, path)


@register("scan_required_columns",
          f"WITH {S.SONGS_CTE} SELECT id, lyrics AS clean_lyrics, tag FROM songs")
def q_scan_required_columns(spark, sf_dir):
    from ..sources.tables import require_columns
    df = songs(spark, sf_dir).select("id", F.col("lyrics").alias("clean_lyrics"), "tag")
    return require_columns(df, ["clean_lyrics", "tag"])


# ---------------------------------------------------------------- filters
@register("filter_language", f"WITH {S.SONGS_CTE} SELECT id, language FROM songs WHERE language = 'en'")
def q_filter_language(spark, sf_dir):
    return C.filter_language(songs(spark, sf_dir)).select("id", "language")


@register("filter_notnull",
          f"WITH {S.SONGS_CTE} SELECT id, tag FROM songs WHERE lyrics IS NOT NULL AND tag IS NOT NULL")
def q_filter_notnull(spark, sf_dir):
    return C.filter_notnull(songs(spark, sf_dir), ["lyrics", "tag"]).select("id", "tag")


@register("filter_title_noise", f"""WITH {S.SONGS_CTE}
SELECT id, coalesce(title, '') AS title FROM songs
WHERE NOT regexp_matches(lower(coalesce(title, '')), '{S.noise_pattern()}')""")
def q_filter_title_noise(spark, sf_dir):
    return (C.filter_title_noise(songs(spark, sf_dir))
            .select("id", F.coalesce("title", F.lit("")).alias("title")))


@register("filter_blank", f"WITH {S.SONGS_CTE} SELECT id FROM songs WHERE {S.strip('lyrics')} <> ''")
def q_filter_blank(spark, sf_dir):
    return C.filter_blank(songs(spark, sf_dir), "lyrics").select("id")


@register("filter_min_length", f"""{WITH_CLEAN}
SELECT id, CAST(length(clean_lyrics) AS INTEGER) AS n_chars FROM cleaned_long""")
def q_filter_min_length(spark, sf_dir):
    return C.clean_stage(songs(spark, sf_dir)).select(
        "id", F.char_length("clean_lyrics").alias("n_chars"))


@register("filter_year_range", f"{WITH_CLEAN} SELECT id, year FROM cleaned WHERE year BETWEEN 1970 AND 2025")
def q_filter_year_range(spark, sf_dir):
    s = C.filter_title_noise(C.filter_language(songs(spark, sf_dir)).filter(F.col("lyrics").isNotNull()))
    return C.filter_year_range(C.cast_numeric_coerce(s)).select("id", "year")


@register("filter_in_genres",
          f"WITH {S.SONGS_CTE} SELECT id, tag FROM songs WHERE tag IN {S.in_list(fixed.GENRES)}")
def q_filter_in_genres(spark, sf_dir):
    return C.filter_in_genres(songs(spark, sf_dir)).select("id", "tag")


@register("filter_exclude_class",
          f"WITH {S.SONGS_CTE} SELECT id, tag FROM songs WHERE tag <> 'misc' AND tag IS NOT NULL")
def q_filter_exclude_class(spark, sf_dir):
    return C.filter_exclude_class(songs(spark, sf_dir)).select("id", "tag")


@register("filter_sentinel_title", f"""WITH {S.SONGS_CTE}
SELECT id, title FROM songs
WHERE coalesce(title, '') <> '' AND coalesce(title, '') <> {S.q(fixed.LYRICS_PLACEHOLDER_TITLE)}""")
def q_filter_sentinel_title(spark, sf_dir):
    return C.filter_sentinel_title(songs(spark, sf_dir), "title").select("id", "title")


# ---------------------------------------------------------------- casts, bins
_COERCED = f"""WITH {S.SONGS_CTE},
c AS (SELECT id, {S.coerce_numeric('year')} AS year, {S.coerce_numeric('views')} AS v FROM songs)"""


@register("cast_numeric_coerce", f"""{_COERCED}
SELECT id, year, CASE WHEN v IS NULL OR isnan(v) THEN 0.0 ELSE v END AS views
FROM c WHERE year IS NOT NULL AND NOT isnan(year)""")
def q_cast_numeric_coerce(spark, sf_dir):
    return C.cast_numeric_coerce(songs(spark, sf_dir)).select("id", "year", "views")


@register("cast_target_float", f"""{_COERCED}
SELECT id, CAST(year AS FLOAT) AS labels FROM c WHERE year IS NOT NULL AND NOT isnan(year)""")
def q_cast_target_float(spark, sf_dir):
    df = C.cast_numeric_coerce(songs(spark, sf_dir)).select("id", "year")
    return C.cast_target_float(df)


@register("era_bin", f"""{_COERCED}
SELECT id, year, {S.era_bin('year')} AS song_era FROM c WHERE year IS NOT NULL AND NOT isnan(year)""")
def q_era_bin(spark, sf_dir):
    df = C.cast_numeric_coerce(songs(spark, sf_dir))
    return df.select("id", "year", C.era_bin("year").alias("song_era"))


@register("project_training_cols", f"{WITH_CLEAN} SELECT id, clean_lyrics, year, song_era FROM era_docs")
def q_project_training_cols(spark, sf_dir):
    return C.project_training_cols(era_docs(spark, sf_dir))


@register("surrogate_id", f"""{WITH_CLEAN}
SELECT id, row_number() OVER (ORDER BY md5(clean_lyrics), id) AS surrogate_id FROM era_docs""")
def q_surrogate_id(spark, sf_dir):
    """1..n in a deterministic order (md5 of the text), without a
    single-partition sort."""
    d = era_docs(spark, sf_dir).withColumn("_h", F.md5("clean_lyrics"))
    r = exact_rank(d, [F.col("_h"), F.col("id")], hex_bucket("_h"), rank_col="surrogate_id",
                   n_groups_hint=1)
    return r.select("id", "surrogate_id")


# ---------------------------------------------------------------- labels
@register("label_encode", f"""{WITH_CLEAN}
SELECT id, song_era, CAST(dense_rank() OVER (ORDER BY song_era) - 1 AS INTEGER) AS label_id
FROM era_docs""")
def q_label_encode(spark, sf_dir):
    d = era_docs(spark, sf_dir)
    return label_encode(d, label_table(d, "song_era"), "song_era").select("id", "song_era", "label_id")


@register("label_binary", f"""{WITH_CLEAN}
SELECT id, song_era, {', '.join(f"CAST(song_era = '{e}' AS INTEGER) AS is_{e}" for e in ERAS)}
FROM era_docs""")
def q_label_binary(spark, sf_dir):
    d = era_docs(spark, sf_dir)
    return d.select("id", "song_era", *[label_binary("song_era", e).alias(f"is_{e}") for e in ERAS])


@register("label_decode", f"""{WITH_CLEAN},
enc AS (SELECT id, CAST(dense_rank() OVER (ORDER BY song_era) - 1 AS INTEGER) AS label_id FROM era_docs),
lab AS (SELECT song_era AS label, CAST(row_number() OVER (ORDER BY song_era) - 1 AS INTEGER) AS label_id
        FROM (SELECT DISTINCT song_era FROM era_docs))
SELECT id, label_id, label FROM enc JOIN lab USING (label_id)""")
def q_label_decode(spark, sf_dir):
    d = era_docs(spark, sf_dir)
    labels = label_table(d, "song_era")
    enc = label_encode(d, labels, "song_era").select("id", "label_id")
    return label_decode(enc, labels, "label_id", "label").select("id", "label_id", "label")


# ---------------------------------------------------------------- text functions
@register("clean_lyrics", f"""WITH {S.SONGS_CTE}
SELECT id, {S.clean_lyrics('lyrics')} AS clean_lyrics FROM songs WHERE lyrics IS NOT NULL""")
def q_clean_lyrics(spark, sf_dir):
    s = songs(spark, sf_dir).filter(F.col("lyrics").isNotNull())
    return s.select("id", TX.clean_lyrics("lyrics").alias("clean_lyrics"))


_AGG_WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_PUNCT = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def _sql_clean_aggressive(x: str) -> str:
    s = f"regexp_replace(lower({x}), {S.q(_PUNCT)}, ' ', 'g')"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]', ' ', 'g')"
    s = f"regexp_replace({s}, '{_AGG_WS}+', ' ', 'g')"
    s = S.strip(s)
    s = f"regexp_replace({s}, '[^\\x00-\\x7F]+', ' ', 'g')"
    return (f"array_to_string(list_filter(string_split({s}, ' '), "
            f"lambda t: t <> '' AND NOT list_contains({S.stop_list()}, t)), ' ')")


@register("clean_aggressive", f"""WITH {S.SONGS_CTE}
SELECT id, {_sql_clean_aggressive('lyrics')} AS clean_text FROM songs WHERE lyrics IS NOT NULL""")
def q_clean_aggressive(spark, sf_dir):
    s = songs(spark, sf_dir).filter(F.col("lyrics").isNotNull())
    return s.select("id", TX.clean_aggressive("lyrics").alias("clean_text"))


@register("tokenize_ws", f"""WITH {S.SONGS_CTE},
t AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(lyrics, '')), '{_AGG_WS}+'),
                             lambda x: x <> '') AS toks FROM songs)
SELECT id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, '|') AS tokens FROM t""")
def q_tokenize_ws(spark, sf_dir):
    t = songs(spark, sf_dir).select("id", TX.tokenize_ws("lyrics").alias("toks"))
    return t.select("id", F.size("toks").alias("n_tokens"), F.array_join("toks", "|").alias("tokens"))


@register("tokenize_word", f"""{WITH_CLEAN},
t AS (SELECT id, regexp_extract_all(lower(clean_lyrics), '({S.W}{{2,}})', 1) AS toks FROM era_docs)
SELECT id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, '|') AS tokens FROM t""")
def q_tokenize_word(spark, sf_dir):
    t = era_docs(spark, sf_dir).select("id", TX.tokenize_word("clean_lyrics").alias("toks"))
    return t.select("id", F.size("toks").alias("n_tokens"), F.array_join("toks", "|").alias("tokens"))


@register("remove_stopwords", f"""{WITH_CLEAN},
t AS (SELECT id, {S.tokens('clean_lyrics')} AS toks FROM era_docs)
SELECT id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, '|') AS tokens FROM t""")
def q_remove_stopwords(spark, sf_dir):
    t = era_docs(spark, sf_dir).select(
        "id", TX.remove_stopwords(TX.tokenize_word("clean_lyrics")).alias("toks"))
    return t.select("id", F.size("toks").alias("n_tokens"), F.array_join("toks", "|").alias("tokens"))


@register("ngrams_1_2", f"""{WITH_CLEAN},
t AS (SELECT id, {S.tokens('clean_lyrics')} AS toks FROM era_docs),
g AS (SELECT id, {S.grams('toks')} AS grams FROM t)
SELECT id, CAST(len(grams) AS INTEGER) AS n_grams, array_to_string(grams, '|') AS grams FROM g""")
def q_ngrams_1_2(spark, sf_dir):
    t = era_docs(spark, sf_dir).select(
        "id", TX.remove_stopwords(TX.tokenize_word("clean_lyrics")).alias("toks"))
    g = t.select("id", TX.ngrams_1_2("toks").alias("grams"))
    return g.select("id", F.size("grams").alias("n_grams"), F.array_join("grams", "|").alias("grams"))


# ---------------------------------------------------------------- dedup, funnel
@register("dedup_keep_first", f"{WITH_CLEAN} SELECT id, year, views FROM dedup")
def q_dedup_keep_first(spark, sf_dir):
    cl = C.clean_stage(songs(spark, sf_dir)).select("id", "clean_lyrics", "year", "views")
    return C.dedup_keep_first(cl).select("id", "year", "views")


_FUNNEL_SQL = f"""WITH {S.SONGS_CTE},
s AS (SELECT *, {S.coerce_numeric('year')} AS y FROM songs),
f AS (
  SELECT coalesce(language = 'en', false) AS s1, lyrics, title, y,
         CASE WHEN language = 'en' AND lyrics IS NOT NULL THEN {S.clean_lyrics('lyrics')} END AS clean
  FROM s),
g AS (
  SELECT s1, s1 AND lyrics IS NOT NULL AS s2,
         s1 AND lyrics IS NOT NULL AND NOT regexp_matches(lower(coalesce(title, '')), '{S.noise_pattern()}') AS s3,
         y, clean FROM f),
h AS (SELECT s1, s2, s3, s3 AND y IS NOT NULL AND NOT isnan(y) AS s4, y, clean FROM g),
k AS (SELECT s1, s2, s3, s4, s4 AND length(clean) > {fixed.MIN_CLEAN_CHARS} AS s5, y, clean FROM h),
grp AS (SELECT clean, min(y) AS y FROM k WHERE s5 GROUP BY clean),
counts AS (
  SELECT 0 AS stage_no, 'raw' AS stage, count(*) AS n FROM k
  UNION ALL SELECT 1, 'language', count(*) FILTER (WHERE s1) FROM k
  UNION ALL SELECT 2, 'lyrics_present', count(*) FILTER (WHERE s2) FROM k
  UNION ALL SELECT 3, 'title_noise', count(*) FILTER (WHERE s3) FROM k
  UNION ALL SELECT 4, 'year_valid', count(*) FILTER (WHERE s4) FROM k
  UNION ALL SELECT 5, 'min_length', count(*) FILTER (WHERE s5) FROM k
  UNION ALL SELECT 6, 'dedup', count(*) FROM grp
  UNION ALL SELECT 7, 'year_range', count(*) FILTER (WHERE y BETWEEN {fixed.YEAR_MIN} AND {fixed.YEAR_MAX}) FROM grp)
SELECT CAST(stage_no AS INTEGER) AS stage_no, stage, CAST(n AS BIGINT) AS n_rows FROM counts"""


@register("stage_funnel", _FUNNEL_SQL)
def q_stage_funnel(spark, sf_dir):
    return C.stage_funnel(songs(spark, sf_dir))


# ---------------------------------------------------------------- counts
@register("class_counts", f"""{WITH_CLEAN}
SELECT song_era, count(*) AS n_rows FROM era_docs WHERE song_era IS NOT NULL GROUP BY song_era""")
def q_class_counts(spark, sf_dir):
    return A.class_counts(era_docs(spark, sf_dir), "song_era")


@register("distinct_labels", f"""{WITH_CLEAN},
d AS (SELECT DISTINCT song_era FROM era_docs WHERE song_era IS NOT NULL)
SELECT song_era, CAST(row_number() OVER (ORDER BY song_era) - 1 AS INTEGER) AS label_id,
       CAST(count(*) OVER () AS BIGINT) AS n_labels FROM d""")
def q_distinct_labels(spark, sf_dir):
    return A.distinct_labels(era_docs(spark, sf_dir), "song_era")


@register("positive_ratio", """SELECT toxic, round(avg(CAST(quality AS DOUBLE)), 6) AS positive_ratio,
       count(*) AS n_rows FROM labels GROUP BY toxic""")
def q_positive_ratio(spark, sf_dir):
    return A.positive_ratio(table(spark, sf_dir, "labels"), "quality", by=("toxic",))


@register("genre_class_counts", f"""WITH {S.SONGS_CTE}
SELECT tag, count(*) AS n_rows FROM songs WHERE tag IN {S.in_list(fixed.GENRES)} GROUP BY tag""")
def q_genre_class_counts(spark, sf_dir):
    return A.class_counts(C.filter_in_genres(songs(spark, sf_dir)), "tag")


# ---------------------------------------------------------------- set operations
@register("union_all", f"""{WITH_CLEAN}
SELECT id, song_era, 1 AS part FROM era_docs WHERE song_era = '2010s'
UNION ALL SELECT id, song_era, 2 AS part FROM era_docs WHERE song_era <> '2010s'
UNION ALL SELECT id, song_era, 3 AS part FROM era_docs WHERE song_era = '1970s'""")
def q_union_all(spark, sf_dir):
    d = era_docs(spark, sf_dir).select("id", "song_era")
    pos = d.filter(F.col("song_era") == "2010s").withColumn("part", F.lit(1))
    neg = d.filter(F.col("song_era") != "2010s").withColumn("part", F.lit(2))
    dup = d.filter(F.col("song_era") == "1970s").withColumn("part", F.lit(3))
    return pos.unionByName(neg).unionByName(dup)


@register("distinct_urls", "SELECT DISTINCT url FROM pages")
def q_distinct_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url").distinct()


# ---------------------------------------------------------------- weights, maps
@register("class_weight_balanced", f"""{WITH_CLEAN},
c AS (SELECT song_era, count(*) AS nc FROM era_docs GROUP BY song_era),
w AS (SELECT song_era, sum(nc) OVER () / (count(*) OVER () * nc) AS weight FROM c)
SELECT id, song_era, round(weight, 9) AS weight FROM era_docs JOIN w USING (song_era)""")
def q_class_weight_balanced(spark, sf_dir):
    from ..operators.labels import class_weight_balanced
    d = era_docs(spark, sf_dir).select("id", "song_era")
    return class_weight_balanced(d, "song_era").select("id", "song_era", F.round("weight", 9).alias("weight"))


@register("inverse_freq_weight", f"""{WITH_CLEAN},
c AS (SELECT song_era, 1.0 / count(*) AS weight FROM era_docs GROUP BY song_era)
SELECT id, song_era, round(weight, 9) AS weight FROM era_docs JOIN c USING (song_era)""")
def q_inverse_freq_weight(spark, sf_dir):
    from ..operators.labels import inverse_freq_weight
    d = era_docs(spark, sf_dir).select("id", "song_era")
    return inverse_freq_weight(d, "song_era").select("id", "song_era", F.round("weight", 9).alias("weight"))


@register("join_class_weight", f"""{WITH_CLEAN},
c AS (SELECT song_era, 1.0 / count(*) AS weight FROM era_docs GROUP BY song_era)
SELECT e.id, CAST(e.year AS FLOAT) AS labels, round(c.weight, 9) AS weight
FROM era_docs e JOIN c USING (song_era)""")
def q_join_class_weight(spark, sf_dir):
    """Year-regression rows with their era's 1/count sampling weight."""
    from ..operators.labels import inverse_freq_weight
    d = era_docs(spark, sf_dir).select("id", "song_era", "year")
    w = inverse_freq_weight(d, "song_era")
    return w.select("id", F.col("year").cast("float").alias("labels"), F.round("weight", 9).alias("weight"))


@register("join_label_map", f"""{WITH_CLEAN},
lab AS (SELECT song_era, CAST(row_number() OVER (ORDER BY song_era) - 1 AS INTEGER) AS label_id
        FROM (SELECT DISTINCT song_era FROM era_docs WHERE song_era IS NOT NULL))
SELECT id, label_id FROM era_docs JOIN lab USING (song_era)""")
def q_join_label_map(spark, sf_dir):
    d = era_docs(spark, sf_dir)
    lab = label_table(d, "song_era")
    return d.join(F.broadcast(lab.withColumnRenamed("label", "song_era")), "song_era", "inner") \
        .select("id", "label_id")


@register("lemmatize_lookup", f"""{WITH_CLEAN},
t AS (SELECT id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM
        (SELECT id, regexp_extract_all(lower(clean_lyrics), '({S.W}{{2,}})', 1) AS toks FROM era_docs)),
vocab AS (SELECT DISTINCT tok FROM t),
lem AS (SELECT v.tok AS word, left(v.tok, length(v.tok) - 1) AS lemma FROM vocab v
        WHERE v.tok LIKE '%s' AND length(v.tok) > 3 AND left(v.tok, length(v.tok) - 1) IN (SELECT tok FROM vocab)),
m AS (SELECT t.id, t.pos, coalesce(lem.lemma, t.tok) AS lemma FROM t LEFT JOIN lem ON lem.word = t.tok)
SELECT id, CAST(count(*) AS INTEGER) AS n_tokens, string_agg(lemma, ' ' ORDER BY pos) AS lemmas FROM m GROUP BY id""")
def q_lemmatize_lookup(spark, sf_dir):
    """Plural-noun lemma table derived from the corpus vocabulary (word ending
    in 's' whose stem is also a word), applied with a join; unknown words
    stay unchanged."""
    from ..operators.encode import token_pairs
    from ..operators.lemma import lemmatize, plural_lemma_table
    d = era_docs(spark, sf_dir).select("id", "clean_lyrics")
    pairs = token_pairs(d, "id", TX.tokenize_word("clean_lyrics"))
    return lemmatize(pairs, plural_lemma_table(pairs.select("token").distinct(), "token"))
