"""Corpus analytics: era mean TF-IDF, top tokens per era (flagship), token
trends, overlaps, class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .corpus import clean_stage, dedup_keep_first, era_bin, filter_year_range
from ..session import materialize_bucketed
from .features import fit_tfidf

# Scores equal to this many decimals count as ties (broken by token), so the
# ranking does not depend on the summation order of floating point sums.
SCORE_TIE_DECIMALS = 12


def prepare_era_docs(songs: DataFrame, extra=()) -> DataFrame:
    """Raw songs -> (text_key, id, clean_lyrics, year, song_era, *extra), one
    row per distinct cleaned text, hash-partitioned by ``text_key`` =
    md5(clean)."""
    cleaned = clean_stage(songs).select("id", "clean_lyrics", "year", *extra,
                                        *(["views"] if "views" in songs.columns else []))
    keyed = cleaned.withColumn("text_key", F.md5("clean_lyrics"))
    dedup = dedup_keep_first(keyed, text="text_key")
    return (filter_year_range(dedup)
            .withColumn("song_era", era_bin("year"))
            .filter(F.col("song_era").isNotNull() & F.col("clean_lyrics").isNotNull())
            .select("text_key", "id", "clean_lyrics", "year", "song_era", *extra))


def era_mean_tfidf(weights: DataFrame, docs: DataFrame, era: str = "song_era",
                   term: str = "term") -> DataFrame:
    """Mean weight per (era, term) over *all* documents of the era, zeros
    included: sum(weight) / n_docs(era). The era count table is bounded by
    the number of eras and is broadcast."""
    n_era = docs.groupBy(era).agg(F.count(F.lit(1)).alias("n_docs"))
    sums = weights.groupBy(era, term).agg(F.sum("weight").alias("_s"))
    return (sums.join(F.broadcast(n_era), era, "inner")
            .select(F.col(era).alias("era"), F.col(term).alias("token"),
                    (F.col("_s") / F.col("n_docs")).alias("score")))


def top_k_per_group(df: DataFrame, group: str, score: str, key: str, k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rank 1..k per group by score desc, key asc. Planned as a
    WindowGroupLimit, so each map task keeps only its local top k."""
    w = Window.partitionBy(group).orderBy(F.round(F.col(score), SCORE_TIE_DECIMALS).desc(),
                                          F.col(key).asc())
    return (df.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= k))


def era_top_tokens(songs: DataFrame, k: int = fixed.TOP_TOKENS_K,
                   max_features: int = fixed.TOP_TOKENS_V,
                   min_df: int = fixed.TOP_TOKENS_MIN_DF, stop_words=None) -> DataFrame:
    """Flagship: rank 1..k tokens per era by mean TF-IDF (1-2-grams, stop
    words removed, df >= min_df, vocabulary capped at max_features).
    Output (era string, rank int, token string, tfidf_score double)."""
    docs = materialize_bucketed(prepare_era_docs(songs), "text_key")
    weights, _ = fit_tfidf(docs, "text_key", "clean_lyrics", max_features, min_df,
                           stop_words, keep=("song_era",))
    means = era_mean_tfidf(weights, docs)
    top = top_k_per_group(means, "era", "score", "token", k)
    return top.select("era", F.col("rank").cast("int").alias("rank"), "token",
                      F.round("score", 6).alias("tfidf_score"))


def era_trend(top_tokens: DataFrame, tokens) -> DataFrame:
    """A chosen token list along the ordered eras, with the change from the
    previous era in which the token is listed."""
    w = Window.partitionBy("token").orderBy("era")
    return (top_tokens.filter(F.col("token").isin(*tokens))
            .select("token", "era", "rank", "tfidf_score",
                    F.round(F.col("tfidf_score") - F.lag("tfidf_score").over(w), 6).alias("delta")))


def token_overlap(top_tokens: DataFrame, n_groups: Column | int | None = None) -> DataFrame:
    """Tokens present in the list of every era (count(distinct era) = #eras)."""
    n = n_groups if n_groups is not None else top_tokens.select(F.countDistinct("era")).scalar()
    return (top_tokens.groupBy("token")
            .agg(F.countDistinct("era").alias("n_eras"),
                 # mean of 6-decimal scores: exact ties sit at 7 decimals
                 F.round(F.avg("tfidf_score"), 9).alias("mean_score"))
            .filter(F.col("n_eras") == n)
            .select("token", F.col("n_eras").cast("long"), "mean_score"))


def era_specific_tokens(top_tokens: DataFrame) -> DataFrame:
    """Tokens in exactly one era's list."""
    one = (top_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") == 1).select("token"))
    return top_tokens.join(one, "token", "left_semi").select("era", "token", "rank", "tfidf_score")


def class_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per class, descending (class ascending on ties); nulls excluded."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(F.desc("n_rows"), F.asc(col)))


def distinct_labels(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct labels with their 0-based position and the label count."""
    d = df.filter(F.col(col).isNotNull()).select(col).distinct()
    w = Window.orderBy(col)  # one row per distinct label: bounded by #classes
    return d.select(col, (F.row_number().over(w) - 1).cast("int").alias("label_id"),
                    F.count(F.lit(1)).over(Window.partitionBy()).cast("long").alias("n_labels"))


def positive_ratio(df: DataFrame, label: str, by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg(F.col(label).cast("double")), 6).alias("positive_ratio"),
                               F.count(F.lit(1)).alias("n_rows"))
