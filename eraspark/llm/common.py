"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Output rows of one Arrow batch built in Python hold at most this much text.
BATCH_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch, column: str):
    """Cut an Arrow record batch so that ``column`` holds about
    ``BATCH_BYTES`` per slice (a single longer text stays whole)."""
    import pyarrow.compute as pc
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > BATCH_BYTES:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def returning(run, column: str):
    """``run`` over a task's Arrow batches, cut by :func:`slices` of ``column``; what
    it freed goes back to the machine at the end, since a Python worker that
    waits for its next task would keep it."""
    def task(batches):
        import ctypes

        import pyarrow as pa
        yield from run(part for batch in batches for part in slices(batch, column))
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    return task


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as the empty text."""
    import pyarrow as pa
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id: str = "doc_id"):
    """True for rows whose labels must not be learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
