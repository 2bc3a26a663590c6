"""Registered variants whose data or parameters make the operator's defining
step act: filters over songs with missing, blank, noisy and placeholder
values, caps and vocabularies small enough to bind, year rules over whole
document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as TX
from ..operators import corpus as C
from ..operators import features as FE
from ..operators import records as R
from ..operators import sampling as SM
from ..operators import scoring as SC
from ..session import materialize
from ..sources.tables import songs, table
from . import sqltext as S
from .q_features import MIN_DF, _stats, _TF
from .q_ingest import SEARCH_SQL, search_texts, year_sql
from .q_sampling import D, H, WITH_CLEAN, era_docs, targets_sql
from .q_scoring import ERAS, V, Ctx, MA, fit_tfidf, q_sql
from .registry import register

SMALL_CAP = 20
SMALL_V = 300

# Odd rows by id rule, the same in both engines.
DIRTY_SQL = f"""{S.SONGS_CTE},
dirty AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE tag END AS tag,
  CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN chr(9) || '  ' || chr(160) WHEN id % 17 = 0 THEN '' ELSE lyrics END AS lyrics,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 19 = 0 THEN '' WHEN id % 6 = 1 THEN {S.q(fixed.LYRICS_PLACEHOLDER_TITLE)}
       WHEN id % 23 = 0 THEN title || ' (Karaoke Version)' WHEN id % 29 = 0 THEN 'How To Translate' ELSE title END AS title
  FROM songs)"""


def dirty_songs(spark, sf_dir):
    i = F.col("id")
    return songs(spark, sf_dir).select(
        "id", F.when(i % 7 == 0, F.lit(None)).otherwise(F.col("tag")).alias("tag"),
        F.when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, F.lit("\t   ")).when(i % 17 == 0, F.lit("")).otherwise(F.col("lyrics")).alias("lyrics"),
        F.when(i % 5 == 0, F.lit(None)).when(i % 19 == 0, F.lit("")).when(i % 6 == 1, F.lit(fixed.LYRICS_PLACEHOLDER_TITLE))
        .when(i % 23 == 0, F.concat("title", F.lit(" (Karaoke Version)"))).when(i % 29 == 0, F.lit("How To Translate"))
        .otherwise(F.col("title")).alias("title"))


@register("filter_notnull_odd_rows", f"WITH {DIRTY_SQL} SELECT id, tag FROM dirty WHERE lyrics IS NOT NULL AND tag IS NOT NULL")
def q_filter_notnull_odd(spark, sf_dir):
    return C.filter_notnull(dirty_songs(spark, sf_dir), ["lyrics", "tag"]).select("id", "tag")


@register("filter_blank_odd_rows", f"WITH {DIRTY_SQL} SELECT id FROM dirty WHERE {S.strip('lyrics')} <> ''")
def q_filter_blank_odd(spark, sf_dir):
    return C.filter_blank(dirty_songs(spark, sf_dir), "lyrics").select("id")


@register("filter_title_noise_odd_rows", f"""WITH {DIRTY_SQL}
SELECT id, coalesce(title, '') AS title FROM dirty WHERE NOT regexp_matches(lower(coalesce(title, '')), '{S.noise_pattern()}')""")
def q_filter_title_noise_odd(spark, sf_dir):
    return C.filter_title_noise(dirty_songs(spark, sf_dir)).select("id", F.coalesce("title", F.lit("")).alias("title"))


@register("filter_sentinel_title_odd_rows", f"""WITH {DIRTY_SQL}
SELECT id, title FROM dirty WHERE coalesce(title, '') <> '' AND coalesce(title, '') <> {S.q(fixed.LYRICS_PLACEHOLDER_TITLE)}""")
def q_filter_sentinel_title_odd(spark, sf_dir):
    return C.filter_sentinel_title(dirty_songs(spark, sf_dir), "title").select("id", "title")


@register("undersample_cap_binding", f"""{WITH_CLEAN}, {D},
r AS (SELECT id, song_era, row_number() OVER (PARTITION BY song_era ORDER BY {H('CAST(id AS VARCHAR)')}, id) AS k FROM d)
SELECT id, song_era FROM r WHERE k <= {SMALL_CAP}""")
def q_undersample_cap_binding(spark, sf_dir):
    return SM.undersample_cap(era_docs(spark, sf_dir), "song_era", SMALL_CAP)


@register("ovr_balanced_binding", f"""{WITH_CLEAN}, {D},
cnt AS (SELECT song_era AS target, least(count(*), {SMALL_CAP}) AS q FROM d GROUP BY song_era),
pool AS (
  SELECT tg.target, d.id, d.song_era, cnt.q,
         row_number() OVER (PARTITION BY tg.target ORDER BY {H("tg.target || '|' || CAST(d.id AS VARCHAR)")}, d.id) AS k
  FROM d JOIN {targets_sql(ERAS)} ON d.song_era IS NULL OR d.song_era <> tg.target
  JOIN cnt ON cnt.target = tg.target)
SELECT target, count(*) AS negatives FROM pool WHERE k <= q GROUP BY target""")
def q_ovr_balanced_binding(spark, sf_dir):
    out = SM.ovr_balanced(era_docs(spark, sf_dir), "song_era", ERAS, cap=SMALL_CAP)
    return out.filter("is_target = 0").groupBy("target").agg(F.count(F.lit(1)).alias("negatives"))


@register("vocab_topk_binding", f"{_TF} SELECT term, df, CAST(total AS BIGINT) AS total FROM dfq ORDER BY total DESC, term LIMIT {SMALL_V}")
def q_vocab_topk_binding(spark, sf_dir):
    _, _, tdf = _stats(spark, sf_dir)
    kept = materialize(tdf.filter(F.col("df") >= MIN_DF), keep_partitioning=False)
    return FE.vocab_topk(kept, SMALL_V, MIN_DF).select("term", "df", "total")


@register("score_feature_align_smaller", q_sql(MA) + f""",
{S.tfidf_ctes('docs', 'id', 'clean_lyrics', SMALL_V, MIN_DF, prefix='f_')},
fd AS (SELECT w.doc AS id, c.class, sum(w.weight * c.coef) AS dot FROM f_w w JOIN a_coef c USING (term) GROUP BY ALL)
SELECT d.id, i.class, round(1 / (1 + exp(-(coalesce(fd.dot, 0) + i.intercept))), 9) AS score
FROM docs d CROSS JOIN a_icpt i LEFT JOIN fd ON fd.id = d.id AND fd.class = i.class""")
def q_score_feature_align_smaller(spark, sf_dir):
    """Features of a vocabulary of 300 terms under a model of all terms."""
    ctx = Ctx(spark, sf_dir)
    _, _, coef, icpt = ctx.model()
    w, _ = fit_tfidf(ctx.docs, "text_key", "clean_lyrics", SMALL_V, MIN_DF, keep=("id",), n_docs=ctx.n_docs, stats=ctx.stats())
    return SC.score_linear(w, coef, icpt, ctx.docs, "id", ERAS, max_features=V)


@register("coalesce_sources_none_found", f"""WITH {SEARCH_SQL},
y AS (SELECT page_id, source, {year_sql('text')} AS release_year FROM st WHERE source = 1 + page_id % 4)
SELECT page_id, arg_min(release_year, source) AS release_year, min(source) AS source
FROM y WHERE release_year IS NOT NULL GROUP BY page_id""")
def q_coalesce_sources_none_found(spark, sf_dir):
    """One source a page: pages whose source names no year drop out."""
    st = search_texts(spark, sf_dir).filter(F.col("source") == 1 + F.col("page_id") % 4)
    y = C.with_computed(st.select("page_id", "source", "text"), "release_year", TX.extract_year("text")).drop("text")
    return R.coalesce_sources(y, "page_id", "source", "release_year")


@register("extract_year_documents", f"SELECT doc_id, {year_sql('text')} AS release_year FROM documents")
def q_extract_year_documents(spark, sf_dir):
    """The year rules over whole document texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.with_computed(d, "release_year", TX.extract_year("text")).select("doc_id", "release_year")
