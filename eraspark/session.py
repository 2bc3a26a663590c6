"""Session construction and cluster-shared paths."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: UTC for the epoch/date formatting operators,
# ANSI on so bad casts surface (we always use try_cast where coercion is the
# intent), AQE for runtime coalescing and skew-join splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of text are a few KB each: keep a batch to a few MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
# Session-start settings for the sessions we build ourselves.
LOCAL_ONLY_CONF = {
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "eraspark", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster use the cluster's own session and
    call :func:`configure` on it instead."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf.update(LOCAL_ONLY_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")   # local mode: the only heap
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators assume to an existing session
    and ship this package to the executors' Python workers."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """``addPyFile`` a zip of the ``eraspark`` sources (what ``--py-files``
    does at submit time), once per SparkContext, so Python workers can
    import the functions that ``mapInPandas`` / pandas UDFs refer to."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="eraspark-pyfiles-"), "eraspark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the platform to a shared file system and is
    used as is. Only when it is unset (tests, local runs) do we pick a scratch
    folder ourselves; away from a local master that would scatter files over
    the machines' own disks, so there it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        d = tempfile.mkdtemp(prefix="eraspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (for written tables
    that cut lineage and survive executor loss)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING: dict[str, list] = {}
_LOCK = threading.Lock()


@contextmanager
def freeing(spark: SparkSession):
    """Shuffle files of what is written, or planned and collected, in here go
    when that ends, else when the driver's garbage happens to be collected. For
    plans that do not run again."""
    key = spark.sparkContext.applicationId
    with _LOCK:
        held = _FREEING.setdefault(key, [0, None])
        if not held[0]:
            held[1] = spark.conf.get(_FREE, None)
            spark.conf.set(_FREE, "true")
        held[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.unset(_FREE) if held[1] is None else spark.conf.set(_FREE, held[1])


def discard(*tables) -> None:
    """Delete the files of tables from ``materialize(keep_partitioning=False)``
    that nothing reads again."""
    for df in tables:
        spark, path = df.sparkSession, df._shared_path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df, keep_partitioning: bool = True):
    """Compute ``df`` once and cut its lineage in the shared checkpoint
    folder (survives executor loss; never a local checkpoint).

    ``keep_partitioning=True``: reliable ``checkpoint()``; the output
    partitioning is kept, so a table checkpointed right after a shuffle on
    ``k`` can be grouped by ``k`` without another shuffle.
    ``keep_partitioning=False``: a Parquet table written under the shared
    folder and read back -- columnar, compressed, much cheaper to write for
    large intermediate tables whose consumers re-shuffle anyway."""
    from pyspark import StorageLevel
    if not keep_partitioning:
        path = shared_path(df.sparkSession, "table")
        with freeing(df.sparkSession):
            df.write.mode("overwrite").parquet(path)
        out = df.sparkSession.read.parquet(path)
        out._shared_path = path
        return out
    ensure_checkpoint_dir(df.sparkSession)
    # Writing a reliable checkpoint re-runs the plan unless it is cached, so
    # compute once into the cache, write the files from it, then release it.
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist(blocking=False)
    return out


def materialize_bucketed(df, key: str, buckets: int | None = None):
    """Write ``df`` as a table bucketed by ``key`` under the shared
    checkpoint folder and read it back through the session catalog.

    Later aggregations, windows and joins keyed on ``key`` (or on ``key`` plus
    more columns) then read co-partitioned buckets and need no shuffle --
    the layout survives, unlike an RDD checkpoint's. Bucket count defaults to
    ``spark.sql.shuffle.partitions``."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"eraspark_{uuid.uuid4().hex[:12]}"
    (df.write.mode("overwrite").bucketBy(n, key)
     .option("path", shared_path(spark, name)).saveAsTable(name))
    return spark.table(name)


def data_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
