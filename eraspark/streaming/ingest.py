"""Structured Streaming jobs: incremental page ingest, scoring of arriving
texts against static model tables, running class counts.

All use ``trigger(availableNow=True)`` so a run processes what has arrived
and stops; checkpoints make them restartable. A micro-batch writes its own
folder of the sink (``batch_id=N``) in overwrite mode, so a batch that is run
again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .url_index import UrlIndex

BATCH = "batch_id"


def _stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Stream a folder of Parquet files. ``path`` may also name a single file
    (``dir/name.parquet``): its folder is watched and only it is taken."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def write_batch(rows: DataFrame, batch_id: int, sink: str) -> None:
    rows.write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch_id}")


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    """All rows that the batches have written."""
    return spark.read.parquet(sink).drop(BATCH)


def read_latest(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of the last batch (complete-mode sinks)."""
    df = spark.read.parquet(sink)
    last = df.select(F.max(BATCH)).first()[0]
    return df.filter(F.col(BATCH) == last).drop(BATCH)


def ingest_records(spark: SparkSession, source: str, schema, to_records, sink: str,
                   checkpoint: str, files_per_batch: int = 1000, index: UrlIndex | None = None) -> None:
    """New pages -> records -> keep each url once -> append to ``sink``.

    Each micro-batch keeps the least record of a url and drops urls that other
    batches have stored, by an index of their keys next to the sink of which it
    reads only the parts that its urls fall into. No streaming state is kept, and
    a restart from the checkpoint gives the same table as one batch run. A sink
    without an index (or one that lacks a batch) is indexed first."""
    index = index or UrlIndex(spark, f"{sink}-urls")
    empty = to_records(spark.createDataFrame([], schema))
    empty.write.mode("ignore").parquet(f"{sink}/{BATCH}=-1")       # so that the sink can always be read

    def one(batch: DataFrame, batch_id: int) -> None:
        if not index.is_complete(batch_id):
            index.rebuild(spark.read.parquet(sink).filter(F.col(BATCH) != batch_id), batch_id)
        recs = to_records(batch)
        recs = recs.groupBy("url").agg(F.min(F.struct(*recs.columns)).alias("_r")).select("_r.*")
        recs = materialize(recs, keep_partitioning=False)          # pages are parsed once
        write_batch(index.unseen(recs, batch_id).select(*empty.columns), batch_id, sink)
        index.add(spark.read.parquet(f"{sink}/{BATCH}={batch_id}").select("url"), batch_id)

    _run(_stream(spark, source, schema, files_per_batch).writeStream, one, checkpoint)


def _run(writer, one, checkpoint: str) -> None:
    (writer.foreachBatch(one).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def score_stream(spark: SparkSession, source: str, schema, score_batch, sink: str,
                 checkpoint: str) -> None:
    """Score arriving texts with static model tables (stream-static join
    inside ``score_batch``) and append the scores."""
    _run(_stream(spark, source, schema).writeStream,
         lambda batch, batch_id: write_batch(score_batch(batch), batch_id, sink), checkpoint)


def class_counts_stream(spark: SparkSession, source: str, schema, to_labels, label: str,
                        sink: str, checkpoint: str) -> None:
    """Running counts per class (complete mode; one row per class), one table
    per trigger; :func:`read_latest` gives the current one."""
    counts = to_labels(_stream(spark, source, schema)).groupBy(label).agg(
        F.count(F.lit(1)).alias("n_rows"))
    _run(counts.writeStream.outputMode("complete"),
         lambda batch, batch_id: write_batch(batch, batch_id, sink), checkpoint)
