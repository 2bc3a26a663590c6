"""SQL text shared by the oracle statements (DuckDB dialect, RE2 regexes).

Each helper mirrors one Column function of ``eraspark.functions`` so the
oracle and the Spark job state the same semantics in two engines.
"""

from __future__ import annotations

from ..functions import fixed
from ..sources.tables import SONGS_SQL

W = r"[\p{L}\p{N}_]"
# Python str.strip() whitespace in RE2 terms (RE2 \s is ASCII and lacks \v).
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
NUMERIC_RE = r"^\s*[+-]?[0-9.]+([eE][+-]?[0-9]+)?\s*$"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean_lyrics(x: str) -> str:
    s = f"replace({x}, chr(10), ' ')"
    s = f"regexp_replace({s}, '[,.!?]', '', 'g')"
    s = f"regexp_replace({s}, '(?s)\\[.*?\\]', ' ', 'g')"
    s = f"regexp_replace({s}, '{W}*\\p{{Nd}}{W}*', ' ', 'g')"
    s = f"regexp_replace({s}, '[()]', ' ', 'g')"
    return strip(f"lower({s})")


def coerce_numeric(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUMERIC_RE}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def stop_list(stop_words=None) -> str:
    words = fixed.ENGLISH_STOP_WORDS if stop_words is None else stop_words
    return "[" + ", ".join(q(w) for w in words) + "]"


def tokens(x: str, stop_words=None) -> str:
    """Word tokens with stop words removed (list)."""
    return (f"list_filter(regexp_extract_all(lower({x}), '({W}{{2,}})', 1), "
            f"lambda t: NOT list_contains({stop_list(stop_words)}, t))")


def grams(t: str) -> str:
    """Unigrams followed by bigrams of a token list expression ``t``."""
    return f"{t} || list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def era_bin(y: str) -> str:
    parts = " ".join(
        f"WHEN {y} >= {lo} AND {y} < {hi} THEN '{lab}'"
        for lo, hi, lab in zip(fixed.ERA_EDGES[:-1], fixed.ERA_EDGES[1:], fixed.ERA_LABELS))
    return f"CASE {parts} END"


def noise_pattern() -> str:
    return "|".join(fixed.NOISE_KEYWORDS)


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


SONGS_CTE = f"songs AS ({SONGS_SQL})"

# Cleaned rows before dedup: (id, clean_lyrics, year, views, tag, title).
CLEANED_CTE = f"""{SONGS_CTE},
coerced AS (
  SELECT id, title, tag, lyrics,
         {coerce_numeric('year')} AS year,
         {coerce_numeric('views')} AS views0
  FROM songs
  WHERE language = '{fixed.KEEP_LANGUAGE}' AND lyrics IS NOT NULL
    AND NOT regexp_matches(lower(coalesce(title, '')), '{noise_pattern()}')
),
cleaned AS (
  SELECT id, title, tag, year,
         CASE WHEN views0 IS NULL OR isnan(views0) THEN 0.0 ELSE views0 END AS views,
         {clean_lyrics('lyrics')} AS clean_lyrics
  FROM coerced
  WHERE year IS NOT NULL AND NOT isnan(year)
),
cleaned_long AS (
  SELECT * FROM cleaned WHERE length(clean_lyrics) > {fixed.MIN_CLEAN_CHARS}
),
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY clean_lyrics ORDER BY year, views DESC, id) AS rn
    FROM cleaned_long) WHERE rn = 1
),
era_docs AS (
  SELECT id, clean_lyrics, year, {era_bin('year')} AS song_era, views, tag, title
  FROM dedup WHERE year BETWEEN {fixed.YEAR_MIN} AND {fixed.YEAR_MAX}
)"""


def tfidf_ctes(docs: str, doc: str, text: str, V: int, min_df: int, extra: str = "",
               sublinear: bool = False, prefix: str = "") -> str:
    """CTEs {prefix}tf, {prefix}vocab, {prefix}w: long-form TF-IDF of ``docs``."""
    p = prefix
    extra_sel = f", {extra}" if extra else ""
    tfexpr = "(1 + ln(tf.tf))" if sublinear else "tf.tf"
    return f"""{p}toks AS (SELECT {doc} AS doc{extra_sel}, {tokens(text)} AS t FROM {docs}),
{p}grams AS (SELECT doc{extra_sel}, unnest({grams('t')}) AS term FROM {p}toks),
{p}tf AS (SELECT doc{extra_sel}, term, count(*) AS tf FROM {p}grams GROUP BY ALL),
{p}dfq AS (SELECT term, count(*) AS df, sum(tf) AS total FROM {p}tf GROUP BY term HAVING count(*) >= {min_df}),
{p}vocab AS (SELECT term, df, ln((1 + (SELECT count(*) FROM {docs})) / (1 + df)) + 1 AS idf
          FROM (SELECT * FROM {p}dfq ORDER BY total DESC, term LIMIT {V})),
{p}w0 AS (SELECT tf.doc{', tf.' + extra if extra else ''}, tf.term, {tfexpr} * v.idf AS w FROM {p}tf AS tf JOIN {p}vocab AS v USING (term)),
{p}w AS (SELECT doc{extra_sel}, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM {p}w0)"""
