import time

from pyspark.sql import functions as F

from eraspark.session import discard, freeing, materialize


def _shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def _left(spark, before):
    for _ in range(50):
        if not (left := _shuffles(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffles(spark)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    written = materialize(sums, keep_partitioning=False)
    assert not _left(spark, before)
    with freeing(spark), freeing(spark):
        rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")).toArrow().num_rows
    assert rows == written.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
    # What is not written may run again.
    assert sorted(sums.collect()) == sorted(written.collect()) == sorted(sums.collect())


def test_discarded_tables_go(spark):
    import os
    written = materialize(spark.range(5), keep_partitioning=False)
    at = written._shared_path.removeprefix("file://")
    assert os.path.isdir(at)
    discard(written)
    assert not os.path.exists(at)
