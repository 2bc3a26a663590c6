"""Registered queries: page parsing, sinks, streams, user scorers
(SURVEY §2.1 sinks, 2.9, 2.11, 2.12). Rows-only checks: their pytest
counterparts compare against plain batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import analytics as A
from ..operators import corpus as C
from ..operators import records as R
from ..operators import scoring as SC
from ..operators import sinks as K
from ..operators.features import transform_tfidf
from ..operators.sampling import ovr_fair_negatives, split_random, split_stratified
from ..session import materialize, shared_path
from ..sources.tables import SONGS_SQL, songs, songs_from_documents, table
from ..streaming import ingest as ST
from . import sqltext as S
from .q_ingest import NORM, RAW_SQL, raw_records
from .q_links import page_records
from .q_sampling import WITH_CLEAN, split_by_target_sql
from .q_scoring import MA, q_sql
from .registry import QUERIES, register

ERAS = fixed.ERA_LABELS


# ---------------------------------------------------------------- sinks
def _era_docs(spark, sf_dir):
    return C.prepare_songs(songs(spark, sf_dir))


@register("sink_splits", f"WITH x AS ({QUERIES['split_random'].sql}), y AS ({WITH_CLEAN} SELECT id, song_era FROM era_docs) SELECT id, song_era, split FROM x JOIN y USING (id)")
def q_sink_splits(spark, sf_dir):
    path = shared_path(spark, "splits")
    K.write_splits(split_random(_era_docs(spark, sf_dir)), path)
    return spark.read.parquet(path).select("id", "song_era", "split")


@register("sink_era_binary", f"WITH f AS ({QUERIES['ovr_fair_negatives'].sql}), {split_by_target_sql('f')} SELECT target, split, id, is_target FROM bt")
def q_sink_era_binary(spark, sf_dir):
    path = shared_path(spark, "era_binary")
    sets = ovr_fair_negatives(_era_docs(spark, sf_dir).select("id", "song_era", "clean_lyrics"),
                              "song_era")
    K.write_era_binary(split_stratified(sets, "is_target", by=("target",)), path)
    return spark.read.parquet(path).select("target", "split", "id", "is_target")


@register("sink_dataset_columnar", f"""WITH x AS ({QUERIES['split_random'].sql}), p AS ({QUERIES['pad_truncate'].sql}),
y AS ({WITH_CLEAN} SELECT id, song_era FROM era_docs)
SELECT id, input_ids, mask_ones, song_era FROM x JOIN y USING (id) JOIN p USING (id) WHERE split = 'train'""")
def q_sink_dataset_columnar(spark, sf_dir):
    from .q_ingest import q_pad_truncate
    path = shared_path(spark, "tokenised")
    ids = q_pad_truncate(spark, sf_dir)
    d = split_random(_era_docs(spark, sf_dir).select("id", "clean_lyrics", "song_era")).join(ids, "id")
    K.write_dataset_columnar(d, path)
    return K.read_columns(spark, path, ["id", "input_ids", "mask_ones", "song_era"], split="train")


@register("sink_append_found", f"WITH {RAW_SQL}, {NORM} SELECT * FROM norm WHERE release_year IS NOT NULL")
def q_sink_append_found(spark, sf_dir):
    path = shared_path(spark, "found")
    recs = R.record_normalize(raw_records(spark, sf_dir))
    pid = F.trim(F.col("id")).cast("long")
    K.append_found(recs.filter(pid % 2 == 0), path)     # two appends: two crawl batches
    K.append_found(recs.filter(pid % 2 == 1), path)
    return spark.read.parquet(path)


@register("sink_model", q_sql(MA) + """ SELECT c.class, count(*) AS n_coef, (SELECT count(*) FROM a_vocab) AS n_vocab
FROM a_coef c JOIN a_icpt USING (class) GROUP BY c.class""")
def q_sink_model(spark, sf_dir):
    from .q_scoring import Ctx
    path = shared_path(spark, "model")
    ctx = Ctx(spark, sf_dir)
    _, vocab, coef, icpt = ctx.model()
    per_class_vocab = vocab.select("term", "idf").withColumn(
        "class", F.explode(F.array(*[F.lit(x) for x in ERAS])))
    K.write_model(coef, per_class_vocab.join(icpt.select("class"), "class", "left_semi"), path)
    c = spark.read.parquet(f"{path}/coef").groupBy("class").agg(F.count(F.lit(1)).alias("n_coef"))
    v = spark.read.parquet(f"{path}/vocab").groupBy("class").agg(F.count(F.lit(1)).alias("n_vocab"))
    return c.join(v, "class", "inner")


# ---------------------------------------------------------------- streams
def _schema(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").schema


@register("stream_ingest_records", f"WITH {RAW_SQL}, {NORM} SELECT DISTINCT * FROM norm")
def q_stream_ingest_records(spark, sf_dir):
    sink, ck = shared_path(spark, "stream_records"), shared_path(spark, "stream_records_ck")

    def to_records(pages):
        from .q_ingest import raw_records_from
        return R.record_normalize(raw_records_from(pages))

    ST.ingest_records(spark, f"{sf_dir}/pages.parquet", _schema(spark, sf_dir, "pages"),
                      to_records, sink, ck)
    return ST.read_sink(spark, sink)


@register("stream_ingest_pages", QUERIES["page_to_record"].sql)
def q_stream_ingest_pages(spark, sf_dir):
    """Arriving pages through the page parser: the crawl's records, each url once."""
    sink, ck = shared_path(spark, "stream_pages"), shared_path(spark, "stream_pages_ck")
    ST.ingest_records(spark, f"{sf_dir}/pages.parquet", _schema(spark, sf_dir, "pages"), page_records, sink, ck)
    return ST.read_sink(spark, sink)


@register("stream_score", q_sql(MA) + f""",
s_docs AS (SELECT item_id AS id, {S.clean_lyrics('text')} AS clean_lyrics FROM benchmark),
s_toks AS (SELECT id, {S.tokens('clean_lyrics')} AS t FROM s_docs),
s_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({S.grams('t')}) AS term FROM s_toks) GROUP BY ALL),
s_w0 AS (SELECT id, term, tf * idf AS w FROM s_tf JOIN a_vocab USING (term)),
s_w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM s_w0),
s_dots AS (SELECT id, class, sum(weight * coef) AS dot FROM s_w JOIN a_coef USING (term) GROUP BY ALL),
s_scores AS (SELECT d.id, i.class, round(1 / (1 + exp(-(coalesce(x.dot, 0) + i.intercept))), 9) AS score
             FROM s_docs d CROSS JOIN a_icpt i LEFT JOIN s_dots x ON x.id = d.id AND x.class = i.class)
SELECT id, class AS predicted, score AS top_score FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS rn FROM s_scores) WHERE rn = 1""")
def q_stream_score(spark, sf_dir):
    from ..functions.text import clean_lyrics
    from .q_scoring import Ctx
    ctx = Ctx(spark, sf_dir)
    _, vocab, coef, icpt = ctx.model()
    vocab, coef, icpt = materialize(vocab.select("term", "idf")), materialize(coef), materialize(icpt)
    sink, ck = shared_path(spark, "stream_scores"), shared_path(spark, "stream_scores_ck")

    def score_batch(batch):
        docs = batch.select(F.col("item_id").alias("id"), clean_lyrics("text").alias("clean_lyrics"))
        w = transform_tfidf(docs, vocab, "id", "clean_lyrics", max_features=fixed.TOP_TOKENS_V)
        sc = SC.score_linear(w, coef, icpt, docs, "id", ERAS)
        return SC.argmax_label(sc, "id").select("id", "predicted", "top_score")

    ST.score_stream(spark, f"{sf_dir}/benchmark.parquet", _schema(spark, sf_dir, "benchmark"),
                    score_batch, sink, ck)
    return ST.read_sink(spark, sink)


@register("stream_class_counts", f"WITH songs AS ({SONGS_SQL}) SELECT tag, count(*) AS n_rows FROM songs WHERE tag IN {S.in_list(fixed.GENRES)} GROUP BY tag")
def q_stream_class_counts(spark, sf_dir):
    sink, ck = shared_path(spark, "stream_counts"), shared_path(spark, "stream_counts_ck")

    def to_labels(docs):
        return C.filter_in_genres(songs_from_documents(docs))

    ST.class_counts_stream(spark, f"{sf_dir}/documents.parquet", _schema(spark, sf_dir, "documents"),
                           to_labels, "tag", sink, ck)
    return ST.read_latest(spark, sink)


# ---------------------------------------------------------------- user scorers
@register("user_scorer", r"""SELECT item_id,
       CASE WHEN length(coalesce(text, '')) = 0 THEN 0.0
            ELSE CAST(length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) AS DOUBLE) / length(text) END AS score
FROM benchmark""")
def q_user_scorer(spark, sf_dir):
    """A user-supplied vectorised scorer (pandas UDF) applied to the
    benchmark texts next to the built-in scores."""
    scorer = SC.register_scorer("text_len_share", SC.example_length_scorer)
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", scorer(F.col("text")).alias("score"))
