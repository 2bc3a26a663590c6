"""Table sources: explicit schemas, Parquet/CSV scans, the ``songs`` view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import data_path

# Raw songs as the analysed project reads them: year/views stay strings until
# coerced; id and views are optional.
SONGS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("lyrics", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("views", T.StringType()),
    T.StructField("tag", T.StringType()),
])

# Tables whose rows carry long text: per-row work on them is regex-heavy.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id",
               "conversations": "conv_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(data_path(sf_dir, name))
    key = TEXT_TABLES.get(name)
    return spread(df, key) if key else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a text table over at least one partition per core when
    its scan yields fewer splits (a file with one large row group is a single
    task). Cluster-sized inputs already split into more scan tasks than cores
    and are left as they are. Filters and column pruning are pushed below the
    repartition by the optimizer, so only surviving rows and columns move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


# The songs view over ``documents``: title, year, views and tag are derived
# from doc_id so Spark and DuckDB build identical rows (years 1960-2029,
# 'unknown' every 41st id, missing views every 29th id).
SONGS_SQL = """SELECT doc_id AS id,
       split_part(text, chr(10), 1) AS title,
       text AS lyrics,
       lang AS language,
       CASE WHEN doc_id % 41 = 0 THEN 'unknown'
            ELSE CAST(1960 + (doc_id * 37) % 70 AS VARCHAR(8)) END AS year,
       CASE WHEN doc_id % 29 = 0 THEN NULL
            ELSE CAST((doc_id * 7919) % 100003 AS VARCHAR(12)) END AS views,
       CASE doc_id % 6 WHEN 0 THEN 'pop' WHEN 1 THEN 'rock' WHEN 2 THEN 'rap'
                       WHEN 3 THEN 'rb' WHEN 4 THEN 'country' ELSE 'misc' END AS tag
FROM documents"""


def songs_from_documents(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    tag = (F.when(d % 6 == 0, "pop").when(d % 6 == 1, "rock").when(d % 6 == 2, "rap")
           .when(d % 6 == 3, "rb").when(d % 6 == 4, "country").otherwise("misc"))
    return documents.select(
        d.alias("id"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("lyrics"),
        F.col("lang").alias("language"),
        F.when(d % 41 == 0, F.lit("unknown"))
         .otherwise((F.lit(1960) + (d * 37) % 70).cast("string")).alias("year"),
        F.when(d % 29 == 0, F.lit(None).cast("string"))
         .otherwise(((d * 7919) % 100003).cast("string")).alias("views"),
        tag.alias("tag"),
    )


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return songs_from_documents(table(spark, sf_dir, "documents"))


def scan_songs_csv(spark: SparkSession, path: str, schema: T.StructType = SONGS_SCHEMA) -> DataFrame:
    """CSV with header; lyrics hold newlines and quotes, so multiLine is on.
    Only an empty field is missing (a literal 'NA' title is kept)."""
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", True)
            .option("escape", '"').option("quote", '"')
            .option("mode", "PERMISSIVE")
            .csv(path))


def require_columns(df: DataFrame, required) -> DataFrame:
    """Stop before any job starts when a required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def write_songs_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True)
     .option("escape", '"').option("quote", '"').csv(path))
