"""Registered queries: model fits and batch scoring.

Rows-only checks: fitted coefficients depend on the solver, so the returned
tables are evaluation reports / predictions; tests check the objective
mapping against a NumPy solver."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import clean_lyrics, tokenize_ws
from ..operators import analytics as A
from ..operators import metrics as M
from ..operators import mlp as MLP
from ..operators import models as ML
from ..operators import newton as N
from ..operators import scoring as SC
from ..operators.encode import token_pairs
from ..operators.features import distinct_term_stats, doc_embedding_mean, fit_tfidf, tfidf_arrays, transform_tfidf
from ..operators.sampling import ovr_fair_negatives, ovr_with_replacement, split_stratified
from ..operators.vectors import HEAD_VECTORS
from ..session import materialize, materialize_bucketed
from ..sources.tables import songs, table
from .registry import register

ERAS, GENRES = fixed.ERA_LABELS, fixed.GENRES
MIN_DF = 3


def _docs(spark, sf_dir):
    """Deduplicated era documents with a stratified train/val/test split."""
    d = A.prepare_era_docs(songs(spark, sf_dir), extra=("tag",))
    return materialize_bucketed(split_stratified(d, "song_era"), "text_key")


def _features(docs, V, sublinear=False, train_filter=None):
    """Fit TF-IDF on the training rows, transform every row, assemble
    sparse vectors; returns (vectors, size)."""
    train = docs.filter(train_filter if train_filter is not None else F.col("split") == "train")
    vocab = _vocab(train, V)
    size = vocab.count()
    rows, _ = tfidf_arrays(docs, vocab, "clean_lyrics", [c for c in docs.columns if c != "clean_lyrics"], sublinear=sublinear)
    return ML.as_vectors(rows, "terms", "weight", size), size


def _vocab(train, V):
    """The vocabulary of distinct documents (see :func:`_docs`), kept."""
    stats = distinct_term_stats(train, "clean_lyrics", MIN_DF)
    _, vocab = fit_tfidf(train, "text_key", "clean_lyrics", V, MIN_DF, stats=stats)
    return materialize(vocab, keep_partitioning=False)


def _train(vec):
    return vec.filter(F.col("split") == "train")


def _one_vs_rest(vec, size, docs, col, classes, C=1.0, penalise_intercept=True):
    """All classes fitted together, every row scored; report per split."""
    model = N.fit(_train(vec), col, classes, size, C, penalise_intercept=penalise_intercept)
    pred = SC.argmax_label(N.scores(vec, model, ["id"]), "id").join(docs.select("id", col, "split"), "id")
    return M.classification_report(pred, col, "predicted", classes, by=("split",))


def _present(docs, col, classes):
    """The classes that have training rows, in their own order."""
    there = {r[0] for r in _train(docs).select(col).distinct().collect()}
    return [c for c in classes if c in there]


@register("fit_ovr_logreg")
def q_fit_ovr_logreg(spark, sf_dir):
    """Shared TF-IDF (V 50k), one balanced binary LR per era, argmax;
    report per split."""
    docs = _docs(spark, sf_dir)
    vec, size = _features(docs, fixed.OVR_ERA_V)
    return _one_vs_rest(vec, size, docs, "song_era", _present(docs, "song_era", ERAS))


@register("fit_binary_per_era")
def q_fit_binary_per_era(spark, sf_dir):
    """Per era: fair one-vs-rest set, its own TF-IDF (V 80k) fitted on its
    train split, balanced LR; accuracy / F1 per split."""
    base = A.prepare_era_docs(songs(spark, sf_dir))
    sets = materialize_bucketed(split_stratified(ovr_fair_negatives(base, "song_era"), "is_target",
                                                 by=("target",)), "text_key")

    def per_era(era):
        d = sets.filter(F.col("target") == era)
        if _train(d).select("is_target").distinct().count() < 2:
            return None
        vec, size = _features(d, fixed.PER_ERA_V)
        model = N.fit(_train(vec), "is_target", [1], size)
        return _binary_report(N.decide(N.scores(vec, model, ["split", "is_target"]), ["split", "is_target"]), "is_target", by=("split",)) \
            .withColumn("target", F.lit(era))

    return _union([r for r in ML.fit_many(per_era, list(ERAS)) if r is not None])


def _binary_report(pred, truth, by=()):
    rows = pred.select(*by, F.col(truth).cast("int").cast("string").alias("t"), F.col("prediction").cast("string").alias("p"))
    return M.accuracy_f1(rows, "t", "p", ("0", "1"), positive="1", by=by)


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("fit_binary_per_genre")
def q_fit_binary_per_genre(spark, sf_dir):
    """Per genre: sublinear TF-IDF (V 150k) and balanced LR with C=2. The
    vectoriser is fitted once: every genre's model sees the same texts."""
    docs = materialize_bucketed(split_stratified(
        A.prepare_era_docs(songs(spark, sf_dir), extra=("tag",)).filter(F.col("tag").isin(*GENRES)),
        "tag"), "text_key")
    vec, size = _features(docs, fixed.GENRE_BINARY_V, sublinear=True)
    return _one_vs_rest(vec, size, docs, "tag", _present(docs, "tag", GENRES), C=2.0, penalise_intercept=False)


@register("fit_genre_balanced")
def q_fit_genre_balanced(spark, sf_dir):
    """Per genre: with-replacement balanced training draws (train split only),
    sublinear TF-IDF (V 500k) of the drawn texts, balanced LR C=1; evaluated on
    the untouched test split. A text drawn m times is one row of weight m, in
    the vocabulary's counts as in the fit."""
    docs = materialize_bucketed(split_stratified(
        A.prepare_era_docs(songs(spark, sf_dir), extra=("tag",)).filter(F.col("tag").isin(*GENRES)),
        "tag"), "text_key")
    genres = _present(docs, "tag", GENRES)
    draws = ovr_with_replacement(_train(docs).select("id", "tag"), "tag", genres, fixed.GENRE_DRAWS_PER_CLASS)
    times = materialize(draws.groupBy("target", "id").agg(F.count(F.lit(1)).alias("m")), keep_partitioning=False)

    def per_genre(g):
        drawn = docs.join(times.filter(F.col("target") == g).select("id", "m"), "id")
        return genre_fit(drawn, docs.filter("split = 'test'"), g).withColumn("genre", F.lit(g))

    return _union(ML.fit_many(per_genre, genres))


def genre_fit(drawn, test, genre, V=fixed.GENRE_BALANCED_V, min_df=MIN_DF):
    """Fit on ``drawn`` (with multiplicities ``m``), report on ``test``."""
    _, vocab = fit_tfidf(drawn, "text_key", "clean_lyrics", V, min_df, sublinear=True, weight="m")
    vocab = materialize(vocab, keep_partitioning=False)
    idx = materialize(ML.vocab_index(vocab), keep_partitioning=False)
    both = materialize_bucketed(drawn.select("text_key", "clean_lyrics", "tag", "split", "m")
                                .unionByName(test.select("text_key", "clean_lyrics", "tag", "split", F.lit(0).cast("long").alias("m"))), "text_key")
    w = transform_tfidf(both, vocab, "text_key", "clean_lyrics", sublinear=True, max_features=V)
    size = idx.count()
    vec = ML.to_vectors(w, idx, both, "text_key", size)
    model = N.fit(vec.filter("m > 0"), "tag", [genre], size, weight="m", penalise_intercept=False)
    pred = N.decide(N.scores(vec.filter("m = 0"), model, ["tag"]), ["tag"])
    return _binary_report(pred.withColumn("y", F.col("tag") == genre), "y")


@register("fit_multiclass_logreg")
def q_fit_multiclass_logreg(spark, sf_dir):
    """One-vs-rest LR over the era labels (V 120k), balanced weights."""
    docs = _docs(spark, sf_dir)
    vec, size = _features(docs, fixed.MULTICLASS_V)
    return _one_vs_rest(vec, size, docs, "song_era", _present(docs, "song_era", ERAS))


@register("fit_w2v_logreg")
def q_fit_w2v_logreg(spark, sf_dir):
    """Per era, on its balanced one-vs-rest set: Word2Vec (768-d, window 15,
    min count 5) on the train tokens, document = mean of its known word
    vectors (zeros if none), balanced LR; accuracy / F1 per split."""
    from pyspark.ml.functions import array_to_vector
    base = A.prepare_era_docs(songs(spark, sf_dir))
    sets = materialize_bucketed(split_stratified(ovr_fair_negatives(base, "song_era"), "is_target",
                                                 by=("target",)), "text_key")

    def per_era(era):
        d = sets.filter(F.col("target") == era).select("id", "split", "is_target", tokenize_ws("clean_lyrics").alias("toks"))
        train = d.filter(F.col("split") == "train")
        if train.select("is_target").distinct().count() < 2:
            return None
        # Written once: the model and its copies on the driver can go before the next era's fit.
        vectors = materialize(ML.fit_word2vec(train, "toks").getVectors().select(
            F.col("word").alias("token"), ML.vector_to_array("vector", "float32").alias("vector")), keep_partitioning=False)
        pairs = token_pairs(d, "id", F.col("toks"))
        uses = pairs.groupBy("token").agg(F.sum("n").alias("n"))
        emb = doc_embedding_mean(pairs, uses.join(vectors, "token"), doc="id", dim=768, head=HEAD_VECTORS)
        data = materialize(emb.join(d.drop("toks"), "id").select(
            "id", "split", F.col("is_target").cast("double").alias("y"), "embedding"), keep_partitioning=False)
        data = data.withColumn("features", array_to_vector("embedding"))
        model = N.fit(_train(data), "y", [1.0], 768)
        return _binary_report(N.decide(N.scores(data, model, ["split", "y"]), ["split", "y"]), "y", by=("split",)) \
            .withColumn("target", F.lit(era))

    return _union([r for r in ML.fit_many(per_era, list(ERAS), max_workers=1) if r is not None])


@register("fit_ridge_year")
def q_fit_ridge_year(spark, sf_dir):
    """Ridge (alpha 1) on TF-IDF (V 120k) -> release year; error report per split."""
    docs = _docs(spark, sf_dir)
    vec, _ = _features(docs, fixed.RIDGE_V)
    m = ML.fit_ridge(vec.filter(F.col("split") == "train").withColumn("y", F.col("year")), "y")
    pred = m.transform(vec).select("split", "year", F.col("prediction").alias("yhat"))
    return M.regression_metrics(pred, "year", "yhat", by=("split",))


@register("fit_mlp_tfidf")
def q_fit_mlp_tfidf(spark, sf_dir):
    """Feed-forward classifier (hidden 512, 256, ReLU, dropout 0.3) on TF-IDF
    (V 50k): mini-batch Adam, stopped early by the validation split."""
    from ..operators.labels import label_encode, label_table
    docs = _docs(spark, sf_dir)
    vec, size = _features(docs, fixed.MLP_V)
    labels = label_table(docs, "song_era")
    data = label_encode(vec, labels, "song_era")
    net = MLP.fit(_train(data), data.filter("split = 'val'"), "label_id", size, labels.count())
    pred = MLP.predict(data, net, ["split", "song_era"]).join(
        F.broadcast(labels.select(F.col("label_id").alias("prediction"), F.col("label").alias("predicted"))), "prediction", "left")
    return M.classification_report(pred, "song_era", "predicted", ERAS, by=("split",))


@register("score_binary_models")
def q_score_binary_models(spark, sf_dir):
    """Every benchmark text x every era model -> probability and argmax;
    an empty text yields an error row instead of failing the job."""
    docs = _docs(spark, sf_dir)
    train = docs.filter(F.col("split") == "train")
    vocab = _vocab(train, fixed.OVR_ERA_V)
    rows, idx = tfidf_arrays(train, vocab, "clean_lyrics", [c for c in train.columns if c != "clean_lyrics"])
    size = vocab.count()
    tv = ML.as_vectors(rows, "terms", "weight", size)
    b = table(spark, sf_dir, "benchmark").select(
        F.col("item_id"), F.col("item_id").cast("string").alias("doc"),
        clean_lyrics(F.coalesce("text", F.lit(""))).alias("clean_lyrics"), "text")
    bw = transform_tfidf(b, vocab, "doc", "clean_lyrics", max_features=fixed.OVR_ERA_V)
    bv = ML.to_vectors(bw, idx, b, "doc", size)
    model = N.fit(tv, "song_era", _present(docs, "song_era", ERAS), size)
    out = N.scores(bv, model, ["item_id"]).withColumn("score", F.round("score", 9))
    best = SC.argmax_label(out, "item_id").select("item_id", "predicted")
    empty = F.coalesce(F.trim(F.col("text")), F.lit("")) == ""
    return (out.join(best, "item_id").join(b.select("item_id", "text"), "item_id")
            .select("item_id", "class", F.when(empty, F.lit(None)).otherwise(F.col("score")).alias("score"),
                    F.when(empty, F.lit(None)).otherwise(F.col("predicted")).alias("predicted"),
                    F.when(empty, F.lit("Text is required for prediction.")).alias("error")))
