"""Partitioned Parquet sinks. Every write goes to a caller-given path; the
query layer uses folders under the cluster's shared checkpoint directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str) -> None:
    """train/val/test in one write, partitioned by ``split`` (no index column)."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_era_binary(df: DataFrame, path: str) -> None:
    """One folder per target era with its train/val/test."""
    df.write.mode("overwrite").partitionBy("target", "split").parquet(path)


def write_dataset_columnar(df: DataFrame, path: str, drop=("clean_lyrics",)) -> None:
    """Tokenised splits saved without the raw text."""
    df.drop(*drop).write.mode("overwrite").partitionBy("split").parquet(path)


def read_columns(spark, path: str, columns, split: str | None = None) -> DataFrame:
    """Load back only the selected columns (pruned at the scan) and,
    optionally, one split (partition pruning)."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df.select(*columns)


def append_found(records: DataFrame, path: str) -> None:
    """Append only records for which a release year was found."""
    records.filter(F.col("release_year").isNotNull()).write.mode("append").parquet(path)


def write_model(coef: DataFrame, vocab: DataFrame, path: str) -> None:
    """Coefficient and vocabulary tables, partitioned by class: what the
    relational scorer reads back."""
    coef.write.mode("overwrite").partitionBy("class").parquet(f"{path}/coef")
    vocab.write.mode("overwrite").partitionBy("class").parquet(f"{path}/vocab")
