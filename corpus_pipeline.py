"""A training corpus from raw documents, in five stages.

1. ``language_id``: string-kernel language identification; documents without a
   letter, or whose n-grams are like none of the learnt languages, go.
2. ``line_dedup``: lines of recurring templates are taken out.
3. ``near_duplicates``: n-gram Jaccard join; of each group of near and exact
   copies the document with the smallest id stays.
4. ``repeated_strings``: bytes covered by a 100-byte string that starts
   earlier in the corpus are cut out.
5. ``packing``: what is left, in windows of 4096 tokens.

A stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each
as Parquet in the shared folder and gives it, read again, to the next. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eraspark.llm import jaccard, langid, line_templates, packing, suffix_dedup
from eraspark.llm.common import documents, held_out
from eraspark.session import configure, materialize

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are accepted as one of the languages learnt from the
    documents' own ``lang`` values (rows not held out). A language with few
    labelled rows accepts every text it is predicted for; without any labelled
    rows nothing is known and only texts without a letter go. Null and empty
    texts go, equal texts fare alike, an empty table gives no rows."""
    configure(spark)
    columns = docs.columns
    model = langid.fit(docs.filter(~held_out()))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = langid.identify(docs.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(columns) if c != "text"}), model)
    return (named.filter("accepted").drop("lang_pred", "score", "accepted")
            .withColumnsRenamed({f"_{i}": c for i, c in enumerate(columns)}).select(*columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; a document that
    consisted of nothing else goes."""
    configure(spark)
    left = line_templates.drop_recurring_lines(docs)
    left = left.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return _same_columns(left, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of
    0.8, the one with the smallest id. Documents without a word stay."""
    configure(spark)
    return jaccard.first_of_each(docs, words=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier 100-byte string covers. A
    character of which a byte is cut goes whole; a document that loses
    everything goes, one that was empty stays. Null text stays null,
    repeated rows fare alike, an empty table gives no rows."""
    configure(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "kept")]
    cut = suffix_dedup.repeated_spans(docs, carry=others, as_text=True)
    left = cut.filter((F.size("spans") == 0) | (F.col("kept") != "")).withColumn("text", F.col("kept"))
    return _same_columns(left, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 tokens, with their ids. Null
    and empty texts are their end token alone, repeated rows are packed each,
    texts longer than a window lie in several, an empty table gives no rows."""
    configure(spark)
    return packing.pack(docs, TOKENIZER, end_id=2)


def _same_columns(left: DataFrame, docs: DataFrame) -> DataFrame:
    """``left`` with the columns of documents, n_chars counted anew."""
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("repeated_strings", repeated_strings), ("packing", pack)]

#: Suffix order, packing and the learnt stage are beyond SQL; the stages are
#: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), keep_partitioning=False)
    return docs
