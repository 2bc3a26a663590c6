"""Label encoding: sorted distinct labels -> 0..k-1, binary indicators,
decoding, class weights. Label tables hold one row per class, so they are
broadcast (their size is bounded by the number of classes, not the data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_table(df: DataFrame, col: str) -> DataFrame:
    """(label, label_id): distinct non-null labels in ascending order
    (alphabetical, not by frequency)."""
    d = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("label")).distinct()
    return d.select("label", (F.row_number().over(Window.orderBy("label")) - 1)
                    .cast("int").alias("label_id"))


def label_encode(df: DataFrame, labels: DataFrame, col: str, out: str = "label_id",
                 on_unseen: str = "error") -> DataFrame:
    """Map labels to ids with a fitted label table. An unseen label raises
    (``on_unseen='error'``) or becomes null (``'null'``)."""
    j = df.join(F.broadcast(labels.select(F.col("label").alias("_lab"),
                                          F.col("label_id").alias("_lid"))),
                F.col(col) == F.col("_lab"), "left")
    lid = F.col("_lid")
    if on_unseen == "error":
        lid = F.when(F.col(col).isNotNull() & lid.isNull(),
                     F.raise_error(F.concat(F.lit("unseen label: "), F.col(col).cast("string")))
                     .cast("int")).otherwise(lid)
    return j.withColumn(out, lid).drop("_lab", "_lid")


def label_decode(df: DataFrame, labels: DataFrame, id_col: str = "label_id",
                 out: str = "label") -> DataFrame:
    lab = F.broadcast(labels.select(F.col("label").alias(out), F.col("label_id").alias("_lid")))
    return df.join(lab, F.col(id_col) == F.col("_lid"), "left").drop("_lid")


def label_binary(col, positive) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return (c == F.lit(positive)).cast("int")


def class_weight_balanced(df: DataFrame, col: str, out: str = "weight") -> DataFrame:
    """n / (k * n_c) per row. The per-class count table has k rows; its
    totals come from a window over those k rows, then it is broadcast."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_nc"))
    whole = Window.partitionBy()
    w = counts.select(col, (F.sum("_nc").over(whole)
                            / (F.count(F.lit(1)).over(whole) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), col, "left")


def inverse_freq_weight(df: DataFrame, col: str, out: str = "weight") -> DataFrame:
    """1 / n_class per row."""
    counts = df.groupBy(col).agg((1.0 / F.count(F.lit(1))).alias(out))
    return df.join(F.broadcast(counts), col, "left")
