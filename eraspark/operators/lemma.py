"""Dictionary lemmatisation: (word, lemma) table, unknown words unchanged,
documents put together again in token order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import look_up, put_together


def plural_lemma_table(vocab: DataFrame, col: str = "tok") -> DataFrame:
    """(word, lemma) for words ending in 's' (longer than 3 chars) whose
    stem without the 's' is itself in the vocabulary."""
    stem = F.expr(f"left({col}, char_length({col}) - 1)")
    cand = vocab.filter(F.col(col).endswith("s") & (F.char_length(col) > 3)) \
        .select(F.col(col).alias("word"), stem.alias("lemma"))
    return cand.join(vocab.select(F.col(col).alias("lemma")), "lemma", "left_semi")


def lemmatize(pairs: DataFrame, lemmas: DataFrame, doc: str = "id") -> DataFrame:
    """(doc, n_tokens, lemmas joined by ' ') from the pairs of
    :func:`eraspark.operators.encode.token_pairs` and a (word, lemma) table;
    a word is looked up once for each document it stands in."""
    uses = pairs.groupBy("token").agg(F.sum("n").alias("n"))
    words = uses.join(lemmas, uses["token"] == lemmas["word"]).select("token", "n", "lemma")
    found = look_up(pairs, words, how="left").withColumn("lemma", F.coalesce("lemma", "token"))
    return (put_together(found, doc, "lemma", "_l")
            .select(doc, F.size("_l").alias("n_tokens"), F.array_join("_l", " ").alias("lemmas")))
