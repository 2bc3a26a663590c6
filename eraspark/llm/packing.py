"""Mixture-controlled packing by deficit round-robin over source queues.

Each source's documents, end to end, form a queue of tokens. Every window
(one training sequence) is filled from all queues: a source gets its target
share of the window's tokens, and what rounding withheld is carried as its
deficit into the next window. Documents are cut where a share ends.

The carried deficits have a closed form, so no task waits for another. The
sources are the leaves of a binary tree; of the first x slots of a node, its
left side gets floor(x * left / node) and its right side the rest. Both grow
with x and add up exactly, hence every window is full, and a source is never
more than one token per tree level away from its target share. The place of
a token follows from its position in its queue alone: a position's window is
found from the share function, whichever partition it is computed in.

When targets differ from what the queues hold, a queue runs dry; from there
on a new phase shares the windows out among the remaining sources.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from . import bpe
from .common import slices

WINDOW = 4096


class Phase:
    """Allotments of one phase: ``slots[s]`` tokens of source s, served from
    queue position ``queue[s]`` on, in slots ``first`` to ``first + length``."""

    def __init__(self, first: int, queue: list[int], slots: list[int]):
        self.first, self.queue, self.slots = first, queue, slots
        self.sums = [0]
        self.queued = [0]
        for a, q in zip(slots, queue):
            self.sums.append(self.sums[-1] + a)
            self.queued.append(self.queued[-1] + q)
        self.length = self.sums[-1]

    def served(self, s: int, slot: int) -> tuple[int, int]:
        """Tokens of the sources before s, and of s, in all slots before ``slot``."""
        x, lo, hi, before, sums = slot - self.first, 0, len(self.slots), 0, self.sums
        while hi - lo > 1:
            mid = (lo + hi) // 2
            whole = sums[hi] - sums[lo]
            left = x * (sums[mid] - sums[lo]) // whole if whole else 0
            if s < mid:
                x, hi = left, mid
            else:
                before, x, lo = before + left, x - left, mid
        return self.queued[s] + before, self.queue[s] + x


class Mixture:
    """Where each queue position goes. ``totals``: tokens by source;
    ``targets``: relative shares (by default the totals, so that all queues
    end together); a source without a target is served when the others are dry."""

    def __init__(self, totals: dict, targets: dict | None = None, window: int = WINDOW):
        self.sources = sorted(totals)
        self.index = {s: i for i, s in enumerate(self.sources)}
        self.window = window
        left = [totals[s] for s in self.sources]
        wanted = left if targets is None else [targets.get(s, 0) for s in self.sources]
        queue, first, self.phases = [0] * len(left), 0, []
        while any(left):
            open_ = [i for i, n in enumerate(left) if n]
            share = {i: wanted[i] for i in open_ if wanted[i] > 0} or {i: left[i] for i in open_}
            dry = min(share, key=lambda i: (left[i] / share[i], i))
            slots = [0] * len(left)
            for i in share:
                slots[i] = left[i] if i == dry else min(left[i], int(left[dry] * share[i] // share[dry]))
            self.phases.append(Phase(first, list(queue), slots))
            first += sum(slots)
            queue = [q + a for q, a in zip(queue, slots)]
            left = [n - a for n, a in zip(left, slots)]
        self.total = first
        self.firsts = [p.first for p in self.phases]
        # Window ends: full windows, then the rest in powers of two.
        self.full, rest = divmod(first, window)
        self.tail = []
        at = self.full * window
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                self.tail.append(at)
                at += 1 << bit
        self.tail.append(at)
        self.windows = self.full + len(self.tail) - 1

    def start(self, w: int) -> int:
        """First slot of window w (w = number of windows: the end)."""
        return w * self.window if w < self.full else self.tail[w - self.full]

    def window_of(self, slot: int) -> int:
        return slot // self.window if slot < self.full * self.window else self.full + bisect_right(self.tail, slot) - 1

    def served(self, s: int, slot: int) -> tuple[int, int]:
        return self.phases[max(0, bisect_right(self.firsts, slot) - 1)].served(s, slot)

    def pieces(self, source, start: int, n: int):
        """Cut queue positions [start, start + n) of a source into
        (position, length, window, offset in the window)."""
        s, at, end = self.index[source], start, start + n
        p = next(p for p in reversed(self.phases) if p.queue[s] <= at and p.slots[s])
        w = min(self.window_of(min(p.first + (at - p.queue[s]) * p.length // p.slots[s], self.total - 1)), self.windows - 1)
        while w and self.served(s, self.start(w))[1] > at:
            w -= 1
        low = self.served(s, self.start(w))
        while at < end:
            high = self.served(s, self.start(w + 1))
            if high[1] > at:
                size = min(end, high[1]) - at
                yield at, size, w, high[0] - low[0] + at - low[1]
                at += size
            w, low = w + 1, high


def queues(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Encode all documents and write them in queue order (source, id, text
    hash): id, source, ids, the task that wrote the row, and the tokens of the
    same source before it in that task. Range partitioning on all three keys
    splits a source that holds most rows."""
    keys = [F.col("source"), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                       F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spec = bpe.spec_of(docs.sparkSession, tokenizer)
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        enc, part, seen = bpe.load(bpe.Bpe, spec.value, True), TaskContext.get().partitionId(), {}
        for batch in batches:
            for b in slices(batch, "text"):
                ids = [enc.encode(t or "") + end for t in b.column("text").to_pylist()]
                starts = []
                for source, x in zip(b.column("source").to_pylist(), ids):
                    starts.append(seen.get(source, 0))
                    seen[source] = starts[-1] + len(x) // 4
                k = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("source"), pa.array(ids, pa.binary()), pa.array([part] * k, pa.int32()), pa.array(starts, pa.int64())],
                    names=["doc_id", "source", "ids", "part", "queue_start"])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, source string, ids binary, part int, queue_start long"
    path = shared_path(docs.sparkSession, "queues")
    rows.mapInArrow(run, schema).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, targets: dict | None = None, window: int = WINDOW,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack all documents into windows of ``window`` tokens.

    Returns one row per piece: doc_id, source, start (the document's tokens
    before it), length, doc_tokens, sequence_id, offset, ids (packed). Every
    token, the end id of each document included, lies in exactly one piece.
    All windows are full; the rest (fewer than ``window`` tokens in all) makes
    windows of powers of two, so there is no padding. Null text is the empty
    document (its end id alone), null source is the source ''. Repeated rows
    are documents of their own. An empty table gives no rows. Other columns,
    whatever their names, are ignored.

    The driver reads one row per source and one per (task, source): the
    mixture's totals and where each task's part of a queue begins. A task
    holds a range of the queue order, so these are at most tasks + sources rows.
    """
    table = queues(docs, tokenizer, end_id, id_col, text_col, source_col)
    sums = table.groupBy("source", "part").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("n")).collect()
    totals, base = {}, {}
    for r in sorted(sums, key=lambda r: (r.source, r.part)):
        base[r.source, r.part] = totals.get(r.source, 0)
        totals[r.source] = totals.get(r.source, 0) + r.n
    plan = docs.sparkSession.sparkContext.broadcast((Mixture(totals, targets, window), base))

    def run(batches):
        import pyarrow as pa
        mixture, base = plan.value
        for batch in batches:
            for b in slices(batch, "ids"):
                out = {k: [] for k in ("row", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
                for row, (source, part, at, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in ("source", "part", "queue_start", "ids")))):
                    n, first = len(ids) // 4, base[source, part] + at
                    for position, size, w, offset in mixture.pieces(source, first, n):
                        lo = position - first
                        for k, v in zip(out, (row, lo, size, n, w, offset, ids[4 * lo:4 * (lo + size)])):
                            out[k].append(v)
                rows = pa.array(out.pop("row"), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(rows), b.column("source").take(rows),
                     *(pa.array(out[k], pa.binary() if k == "ids" else pa.int64()) for k in out)],
                    names=["doc_id", "source", *out])

    schema = f"doc_id {dict(table.dtypes)['doc_id']}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return table.mapInArrow(run, schema)
