"""Registered queries: tokens, TF-IDF, era rankings (flagship), trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import analytics as A
from ..sources.tables import songs
from . import sqltext as S
from .registry import register

K, V, MIN_DF = fixed.TOP_TOKENS_K, fixed.TOP_TOKENS_V, fixed.TOP_TOKENS_MIN_DF

TOP_TOKENS_SQL = f"""WITH {S.CLEANED_CTE},
docs AS (SELECT * FROM era_docs WHERE song_era IS NOT NULL AND clean_lyrics IS NOT NULL),
{S.tfidf_ctes('docs', 'id', 'clean_lyrics', V, MIN_DF, extra='song_era')},
eras AS (SELECT song_era, count(*) AS n_docs FROM docs GROUP BY song_era),
m AS (SELECT w.song_era AS era, term, sum(weight) / any_value(n_docs) AS score
      FROM w JOIN eras USING (song_era) GROUP BY w.song_era, term),
r AS (SELECT era, term, score,
             row_number() OVER (PARTITION BY era ORDER BY round(score, {A.SCORE_TIE_DECIMALS}) DESC, term) AS rk
      FROM m)
SELECT era, CAST(rk AS INTEGER) AS rank, term AS token, round(score, 6) AS tfidf_score
FROM r WHERE rk <= {K}"""


@register("era_top_tokens", TOP_TOKENS_SQL)
def q_era_top_tokens(spark, sf_dir):
    return A.era_top_tokens(songs(spark, sf_dir))


# ---------------------------------------------------------------- term statistics
def era_docs_keyed(spark, sf_dir):
    from ..session import materialize_bucketed
    return materialize_bucketed(A.prepare_era_docs(songs(spark, sf_dir)), "text_key")


def _stats(spark, sf_dir):
    from ..operators import features as FE
    docs = era_docs_keyed(spark, sf_dir)
    tf = FE.term_frequencies(docs, "text_key", "clean_lyrics", keep=("id",))
    return docs, tf, FE.term_doc_freq(tf)


_TF = f"""WITH {S.CLEANED_CTE},
docs AS (SELECT * FROM era_docs WHERE song_era IS NOT NULL AND clean_lyrics IS NOT NULL),
{S.tfidf_ctes('docs', 'id', 'clean_lyrics', V, MIN_DF)}"""


@register("term_doc_freq", f"{_TF} SELECT term, df, CAST(total AS BIGINT) AS total FROM dfq")
def q_term_doc_freq(spark, sf_dir):
    _, _, tdf = _stats(spark, sf_dir)
    return tdf.filter(F.col("df") >= MIN_DF).select("term", "df", "total")


@register("vocab_topk", f"""{_TF}
SELECT term, df, CAST(total AS BIGINT) AS total FROM dfq ORDER BY total DESC, term LIMIT {fixed.OVR_ERA_V}""")
def q_vocab_topk(spark, sf_dir):
    from ..operators import features as FE
    from ..session import materialize
    _, _, tdf = _stats(spark, sf_dir)
    return FE.vocab_topk(materialize(tdf.filter(F.col("df") >= MIN_DF)), fixed.OVR_ERA_V, MIN_DF) \
        .select("term", "df", "total")


@register("join_vocab_idf", f"{_TF} SELECT term, round(idf, 6) AS idf FROM vocab")
def q_join_vocab_idf(spark, sf_dir):
    from ..operators import features as FE
    docs = era_docs_keyed(spark, sf_dir)
    _, vocab = FE.fit_tfidf(docs, "text_key", "clean_lyrics", V, MIN_DF)
    return vocab.select("term", F.round("idf", 6).alias("idf"))


@register("tfidf", f"{_TF} SELECT doc AS id, term, round(weight, 6) AS weight FROM w")
def q_tfidf(spark, sf_dir):
    from ..operators import features as FE
    docs = era_docs_keyed(spark, sf_dir)
    w, _ = FE.fit_tfidf(docs, "text_key", "clean_lyrics", V, MIN_DF, keep=("id",))
    return w.select("id", "term", F.round("weight", 6).alias("weight"))


@register("era_mean_tfidf", f"""WITH {S.CLEANED_CTE},
docs AS (SELECT * FROM era_docs WHERE song_era IS NOT NULL AND clean_lyrics IS NOT NULL),
{S.tfidf_ctes('docs', 'id', 'clean_lyrics', V, MIN_DF, extra='song_era')},
eras AS (SELECT song_era, count(*) AS n_docs FROM docs GROUP BY song_era)
SELECT w.song_era AS era, term AS token, round(sum(weight) / any_value(n_docs), 6) AS score
FROM w JOIN eras USING (song_era) GROUP BY w.song_era, term""")
def q_era_mean_tfidf(spark, sf_dir):
    from ..operators import features as FE
    docs = era_docs_keyed(spark, sf_dir)
    w, _ = FE.fit_tfidf(docs, "text_key", "clean_lyrics", V, MIN_DF, keep=("song_era",))
    m = A.era_mean_tfidf(w, docs)
    return m.select("era", "token", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- trends, overlaps
_TOP = f"top AS ({TOP_TOKENS_SQL})"


@register("token_overlap", f"""WITH {_TOP},
n AS (SELECT count(DISTINCT era) AS n FROM top)
SELECT token, CAST(count(DISTINCT era) AS BIGINT) AS n_eras, round(avg(tfidf_score), 9) AS mean_score
FROM top GROUP BY token HAVING count(DISTINCT era) = (SELECT n FROM n)""")
def q_token_overlap(spark, sf_dir):
    return A.token_overlap(A.era_top_tokens(songs(spark, sf_dir)))


@register("era_specific_tokens", f"""WITH {_TOP},
one AS (SELECT token FROM top GROUP BY token HAVING count(*) = 1)
SELECT era, token, rank, tfidf_score FROM top WHERE token IN (SELECT token FROM one)""")
def q_era_specific_tokens(spark, sf_dir):
    return A.era_specific_tokens(A.era_top_tokens(songs(spark, sf_dir)))


@register("era_trend", f"""WITH {_TOP},
n AS (SELECT count(DISTINCT era) AS n FROM top),
chosen AS (SELECT token FROM top GROUP BY token HAVING count(DISTINCT era) = (SELECT n FROM n))
SELECT token, era, rank, tfidf_score,
       round(tfidf_score - lag(tfidf_score) OVER (PARTITION BY token ORDER BY era), 6) AS delta
FROM top WHERE token IN (SELECT token FROM chosen)""")
def q_era_trend(spark, sf_dir):
    """Trend of the tokens listed in every era (the stable tokens)."""
    top = A.era_top_tokens(songs(spark, sf_dir))
    from ..session import materialize
    top = materialize(top)
    stable = [r["token"] for r in A.token_overlap(top).select("token").collect()]
    return A.era_trend(top, stable)


# ---------------------------------------------------------------- word vectors
_WS_RE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_W2V_MIN_COUNT = 5


_VEC_SQL = f"""WITH {S.CLEANED_CTE},
toks AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(clean_lyrics), '{_WS_RE}+'),
                                       lambda x: x <> '')) AS token FROM era_docs),
stats AS (SELECT token, count(*) AS total FROM toks GROUP BY token HAVING count(*) >= {_W2V_MIN_COUNT}),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS w FROM stats),
vecs AS (SELECT v.token, e.embedding FROM vocab v JOIN embeddings e ON e.vec_id = v.w % (SELECT count(*) FROM embeddings)),
known AS (SELECT t.id, v.embedding FROM toks t JOIN vecs v USING (token))"""


@register("join_word_vectors", f"""{_VEC_SQL},
n_all AS (SELECT id, count(*) AS n_tokens FROM toks GROUP BY id),
n_known AS (SELECT id, count(*) AS n_known FROM known GROUP BY id)
SELECT id, n_tokens, coalesce(n_known, 0) AS n_known FROM n_all LEFT JOIN n_known USING (id)""")
def q_join_word_vectors(spark, sf_dir):
    """Uses of each document's words, and of those that have a vector."""
    from ..operators import vectors as VX
    from ..operators.encode import look_up
    pairs = VX.doc_words(A.prepare_era_docs(songs(spark, sf_dir)))
    vecs = VX.word_vectors(spark, sf_dir, pairs)
    found = look_up(pairs.drop("positions"), vecs, "left", VX.HEAD_VECTORS)
    return found.groupBy("id").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("vector").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"))


@register("doc_embedding_mean", f"""{_VEC_SQL},
comps AS (SELECT id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM known),
means AS (SELECT id, i, avg(x) AS m FROM comps GROUP BY id, i),
per_doc AS (SELECT id, sqrt(sum(m * m)) AS l2, sum(m) AS s FROM means GROUP BY id),
dims AS (SELECT max(len(embedding)) AS dim FROM embeddings)
SELECT d.id, CAST((SELECT dim FROM dims) AS INTEGER) AS dim,
       round(coalesce(p.l2, 0), 6) AS l2, round(coalesce(p.s, 0), 6) AS total
FROM (SELECT DISTINCT id FROM toks) d LEFT JOIN per_doc p USING (id)""")
def q_doc_embedding_mean(spark, sf_dir):
    from ..operators import features as FE
    from ..operators import vectors as VX
    pairs = VX.doc_words(A.prepare_era_docs(songs(spark, sf_dir)))
    emb = FE.doc_embedding_mean(pairs, VX.word_vectors(spark, sf_dir, pairs), doc="id", dim=VX.vector_dim(spark, sf_dir),
                                head=VX.HEAD_VECTORS)
    return emb.select(
        "id", F.size("embedding").alias("dim"),
        F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("l2"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _top_tokens_sql(stop_words=None) -> str:
    tf = S.tfidf_ctes('docs', 'id', 'clean_lyrics', V, MIN_DF, extra='song_era')
    if stop_words is not None and not stop_words:
        tf = tf.replace(S.tokens("clean_lyrics"),
                        f"regexp_extract_all(lower(clean_lyrics), '({S.W}{{2,}})', 1)")
    return f"""WITH {S.CLEANED_CTE},
docs AS (SELECT * FROM era_docs WHERE song_era IS NOT NULL AND clean_lyrics IS NOT NULL),
{tf},
eras AS (SELECT song_era, count(*) AS n_docs FROM docs GROUP BY song_era),
m AS (SELECT w.song_era AS era, term, sum(weight) / any_value(n_docs) AS score
      FROM w JOIN eras USING (song_era) GROUP BY w.song_era, term),
r AS (SELECT era, term, score,
             row_number() OVER (PARTITION BY era ORDER BY round(score, {A.SCORE_TIE_DECIMALS}) DESC, term) AS rk
      FROM m)
SELECT era, CAST(rk AS INTEGER) AS rank, term AS token, round(score, 6) AS tfidf_score
FROM r WHERE rk <= {K}"""


@register("era_top_tokens_stopwords_kept", _top_tokens_sql(stop_words=()))
def q_era_top_tokens_stopwords_kept(spark, sf_dir):
    """The older top-token run that kept stop words (same pipeline, empty
    stop list)."""
    return A.era_top_tokens(songs(spark, sf_dir), stop_words=())
