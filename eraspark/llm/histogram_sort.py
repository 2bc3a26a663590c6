"""Sharding by histogram sort.

Rows are ordered by (key, tie) and cut into shards of nearly equal size. The
cuts (splitters) are found without sorting: every round lays candidate
boundaries over the key ranges that are still open, all partitions sum the
bytes between neighbouring candidates, and the sums, added up, give the exact
bytes below each candidate. A splitter is settled when a candidate lies within
``tolerance`` of its target; otherwise its range shrinks to the two candidates
around the target, taken in to the keys that are really there. Rows of one key
are a group, and a group is cut, by its ties, only where none of its ends is
near enough to the target. So a group that holds a third of all rows is spread
over the shards it fills, and others stay whole.

Then the rows are exchanged once, in the order of (shard, key, tie), each shard
over as many tasks as it needs, and written; a row's slot in its shard follows
from its place in the file and the rows of the files before.

All steps are DataFrame functions. The rounds read a table of key, tie and size
alone, and bring at most ``PROBES`` sums a splitter to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_path

TOLERANCE = 0.001
#: Candidates laid over an open range in one round.
PROBES = 512
#: Bytes of rows that one task of the exchange sorts, and most tasks.
TASK_BYTES, MOST_TASKS = 256 << 20, 1 << 16

_LEAST = -(1 << 63)
_LONG = 1 << 62


@dataclass(frozen=True)
class Cut:
    """Between two neighbours of the order: rows at or after (key, tie) lie above,
    or only rows after it if ``after``. Without a tie it falls between two keys."""
    key: int
    tie: int | None = None
    after: bool = False

    def above(self) -> Column:
        k, t = F.col("_key"), F.col("_tie")
        if self.tie is None:
            return k > self.key if self.after else k >= self.key
        return (k > self.key) | ((k == self.key) & (t > self.tie if self.after else t >= self.tie))


@dataclass(frozen=True)
class Range:
    """An open range of keys, or of one key's ties, with the bytes below it."""
    low: int
    high: int
    below: int
    key: int | None = None                     # the key whose ties these are
    targets: tuple[float, ...] = field(default=(), compare=False)

    @property
    def step(self) -> int:
        return -(-(self.high - self.low + 1) // PROBES)

    def holds(self) -> Column:
        at = F.col("_key" if self.key is None else "_tie").between(self.low, self.high)
        return at if self.key is None else (F.col("_key") == self.key) & at

    def bin(self) -> Column:
        at = "_key" if self.key is None else "_tie"
        if self.high - self.low < _LONG:
            return F.expr(f"({at} - ({self.low}L)) div {self.step}L")
        return F.expr(f"(cast({at} as decimal(20, 0)) - ({self.low}BD)) div {self.step}BD")


def histogram_sort(df: DataFrame, shards: int, key: str, tie: str, size: str, tolerance: float = TOLERANCE) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in
    each shard), read from files in which the shards lie in the order of
    (key, tie), columns of whole numbers. The shards' sums of ``size`` differ
    from an equal share by ``tolerance`` of it at each end, or where no two
    neighbours of the order meet there, by as much as the nearest ones need.

    A null key or tie comes first, a null or negative size counts as 0. Rows
    equal in key and tie cannot be told apart and stay in one shard, in any
    order; with unique ties there are none. With fewer rows than shards some
    shards are empty, an empty table stays empty. Other columns are carried;
    those named ``shard`` or ``slot`` are replaced."""
    folder = shared_path(df.sparkSession, "shards")
    write_shards(df, folder, shards, key, tie, size, tolerance)
    return read_shards(df.sparkSession, folder, df)


def write_shards(df: DataFrame, folder: str, shards: int, key: str, tie: str, size: str, tolerance: float = TOLERANCE) -> list[Cut]:
    """Write ``df`` as ``folder``/shard=N/*.parquet, sorted; the cuts between
    the shards. Rows as in :func:`histogram_sort`."""
    if shards < 1 or not 0 <= tolerance < 1:
        raise ValueError("at least one shard, and a tolerance from 0 to under 1")
    ordered = df.drop("shard", "slot", "_row").withColumns({
        "_key": F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)), "_tie": F.coalesce(F.col(tie).cast("long"), F.lit(_LEAST)),
        "_size": F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))})
    keys = materialize(ordered.select("_key", "_tie", "_size"), keep_partitioning=False)
    total, cuts = splitters(keys, shards, tolerance)
    shard = sum((cut.above().cast("int") for cut in cuts), F.lit(0))
    tasks = min(MOST_TASKS, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES))
    placed = ordered.withColumn("shard", shard)
    (placed.repartitionByRange(tasks, "shard", "_key", "_tie").sortWithinPartitions("shard", "_key", "_tie")
     .withColumn("_row", F.monotonically_increasing_id())
     .drop("_key", "_tie", "_size").write.partitionBy("shard").parquet(folder))
    return cuts


def read_shards(spark, folder: str, like: DataFrame) -> DataFrame:
    """The rows that :func:`write_shards` wrote, with shard and slot; ``like``
    has the columns."""
    columns = [c for c in like.columns if c not in ("shard", "slot", "_row")]
    schema = like.select(*columns).withColumns({"_row": F.lit(0).cast("long"), "shard": F.lit(0)}).schema
    rows = spark.read.schema(schema).parquet(folder).withColumn("_task", F.shiftright("_row", 33))
    # One row for each task of the exchange and shard in it: at most MOST_TASKS and as many as there are shards.
    runs = rows.groupBy("shard", "_task").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.expr("coalesce(sum(_n) over (partition by shard order by _task rows between unbounded preceding and 1 preceding), 0)")
    runs = runs.select("shard", "_task", (before - F.col("_first")).alias("_shift"))
    return (rows.join(F.broadcast(runs), ["shard", "_task"])
            .select(*columns, "shard", (F.col("_row") + F.col("_shift")).alias("slot")))


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[int, list[Cut]]:
    """(bytes of all rows, the cuts between the shards), from (_key, _tie, _size)."""
    total, low, high = keys.agg(F.sum("_size"), F.min("_key"), F.max("_key")).first()
    if low is None:
        return 0, []
    targets = tuple(total * i / shards for i in range(1, shards))
    near = tolerance * total / shards
    settled: dict[float, Cut] = {}
    open_ = [Range(low, high, 0, targets=targets)] if targets else []
    while open_:
        open_ = _round(keys, open_, near, settled)
    return int(total), [settled[t] for t in targets]


def _round(keys: DataFrame, ranges: list[Range], near: float, settled: dict[float, Cut]) -> list[Range]:
    """Count the bytes between the candidates of all ranges; settle what is
    near enough or cannot be cut finer; the ranges that stay open."""
    which, bin_ = F.lit(None), F.lit(None)
    for i, r in enumerate(ranges):
        which = F.when(r.holds(), i).otherwise(which)
        bin_ = F.when(r.holds(), r.bin()).otherwise(bin_)
    sums = (keys.select(which.cast("int").alias("which"), bin_.cast("long").alias("bin"), "_key", "_tie", "_size").filter("which is not null")
            .groupBy("which", "bin").agg(F.sum("_size").alias("n"), F.min("_key").alias("k0"), F.max("_key").alias("k1"),
                                         F.min("_tie").alias("t0"), F.max("_tie").alias("t1")).collect())
    still: dict[Range, tuple[float, ...]] = {}
    for i, r in enumerate(ranges):
        bins = sorted((x for x in sums if x["which"] == i), key=lambda x: x["bin"])
        tops = list(accumulate((x["n"] for x in bins), initial=r.below))
        for target in r.targets:
            j = next((j for j in range(len(bins)) if tops[j + 1] >= target), len(bins) - 1)
            x, under, over = bins[j], target - tops[j], tops[j + 1] - target
            whole = r.key is None                                # the bin holds whole groups
            if min(under, over) <= near or (x["t0"] == x["t1"] and (not whole or x["k0"] == x["k1"])):
                at = ("k0", "t0") if under <= over else ("k1", "t1")
                settled[target] = Cut(x[at[0]], None if whole else x[at[1]], after=under > over)
                continue
            if not whole or x["k0"] == x["k1"]:
                finer = Range(x["t0"], x["t1"], tops[j], key=x["k0"])
            else:
                finer = Range(x["k0"], x["k1"], tops[j])
            still[finer] = (*still.get(finer, ()), target)
    return [replace(r, targets=t) for r, t in still.items()]
