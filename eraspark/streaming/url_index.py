"""Index of the urls that a stream has stored, for batches that must not read
the whole sink.

A url's key is its md5 (16 bytes); keys are dealt into ``PARTS`` parts by their
hash. Each batch adds one segment a part that it brought new urls to; a part of
``MERGE`` segments is written anew as one. So a batch reads, of the parts that
its urls fall into, at most ``MERGE`` segments each, however long the stream has
run. What belongs to the index after batch N is listed in manifest N, a row a
part. A batch reads manifest N - 1 and overwrites what N wrote, so a batch that
is run again gives the same index; segments that batch N - 1 merged away are
removed in batch N, when nothing can ask for them again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS, MERGE = 256, 8

_MANIFEST = "part int, segments array<long>, dropped array<long>"


@dataclass
class UrlIndex:
    spark: SparkSession
    path: str
    parts: int = PARTS
    merge: int = MERGE
    #: Folders that the last batch read, for tests and logs.
    last_read: list[str] = field(default_factory=list)

    def keyed(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``_key`` and ``_part``; a null url has the key of the empty one."""
        u = F.coalesce(F.col("url"), F.lit(""))
        return urls.withColumns({"_key": F.unhex(F.md5(u)), "_part": F.pmod(F.xxhash64(u), F.lit(self.parts)).cast("int")})

    def unseen(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The ``rows`` whose url no batch before ``batch_id`` has stored."""
        keyed = self.keyed(rows)
        touched = [r["_part"] for r in keyed.select("_part").distinct().collect()]
        held = self._manifest(batch_id - 1)
        self.last_read = [self._folder(s, p) for p in touched for s in held.get(p, ([], []))[0]]
        old = self._keys(self.last_read)
        return keyed.join(old, "_key", "left_anti").drop("_key", "_part")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store the urls of ``rows``, all of them unseen, as those of ``batch_id``."""
        held = self._manifest(batch_id - 1)
        keys = self.keyed(rows).select("_key", "_part")
        fresh = {r["_part"] for r in keys.select("_part").distinct().collect()}
        full = [p for p in fresh if len(held.get(p, ([], []))[0]) + 1 >= self.merge]
        for p in full:
            old = self._keys([self._folder(s, p) for s in held[p][0]])
            keys = keys.unionByName(old.withColumn("_part", F.lit(p)))
        (keys.withColumnRenamed("_part", "part").repartition("part").sortWithinPartitions("part")
         .write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/keys/segment={batch_id}"))
        now = {p: (segments, []) for p, (segments, _) in held.items()}
        for p in fresh:
            before = held.get(p, ([], []))[0]
            now[p] = ([batch_id], before) if p in full else ([*before, batch_id], [])
        rows_ = [(p, s, d) for p, (s, d) in sorted(now.items())]
        self.spark.createDataFrame(rows_, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(self._manifest_path(batch_id))
        for p, (_, dropped) in held.items():
            for s in dropped:
                self._remove(self._folder(s, p))
        self._remove(self._manifest_path(batch_id - 2))

    def rebuild(self, urls: DataFrame, batch_id: int) -> None:
        """Index ``urls`` anew as all that came before ``batch_id``."""
        self.add(urls.select("url").distinct(), batch_id - 1)

    def is_complete(self, batch_id: int) -> bool:
        """Whether all batches before ``batch_id`` are in the index."""
        return self._exists(f"{self._manifest_path(batch_id - 1)}/_SUCCESS")

    # ------------------------------------------------------------ files
    def _folder(self, segment: int, part: int) -> str:
        return f"{self.path}/keys/segment={segment}/part={part}"

    def _manifest_path(self, batch_id: int) -> str:
        return f"{self.path}/manifest/batch={batch_id}"

    def _manifest(self, batch_id: int) -> dict[int, tuple[list[int], list[int]]]:
        """part -> (its segments, those merged away by this batch); PARTS rows at most."""
        if not self._exists(f"{self._manifest_path(batch_id)}/_SUCCESS"):
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(self._manifest_path(batch_id)).collect()
        return {r["part"]: (list(r["segments"]), list(r["dropped"])) for r in rows}

    def _keys(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], "_key binary")
        return self.spark.read.schema("_key binary").parquet(*folders)

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _exists(self, path: str) -> bool:
        fs, place = self._fs(path)
        return fs.exists(place)

    def _remove(self, path: str) -> None:
        fs, place = self._fs(path)
        if fs.exists(place):
            fs.delete(place, True)
