"""Token-id shards as wavelet matrices.

A shard file holds the ids of consecutive documents as a wavelet matrix: for
each bit of the ids, from the highest, a plane of n bits; zeros of a plane go
before its ones in the next plane, in stable order. With the count of ones
before each block of a plane (rank), the file answers from a few small reads:

* ``access(i)``              the id at position i
* ``rank(id, i)``            occurrences of id before position i
* ``count(id, lo, hi)``      occurrences within a range
* ``select(id, k)``          position of the k-th occurrence
* ``occurrences(id)``        all positions of an id
* ``decode()`` / ``document(j)``  all ids, or those of one document

File layout (little-endian): the 8 magic bytes, the length of the header as
unsigned 64-bit, the header (JSON: number of ids and levels, block size, and
for each section its offset and length), then zstd-compressed sections:
document ids, document ends, and for each level its zero count, the ones
before each block, the byte offsets of its blocks, and the blocks themselves,
compressed one by one so that a query unpacks only the blocks it touches.
"""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAGIC = b"WAVEMTX1"
BLOCK_BITS = 1 << 16
# A shard is closed at the first document end after this many ids.
SHARD_TOKENS = 1 << 22


def _kind(levels: int):
    return np.uint16 if levels <= 16 else np.uint32


def pack(ids: np.ndarray, doc_ids: list, doc_ends: list) -> bytes:
    """The shard file of ``ids``; ``doc_ends[j]`` ids precede document j+1."""
    import zstandard
    squeeze = zstandard.ZstdCompressor(level=1).compress
    n = len(ids)
    levels = max(1, int(ids.max()).bit_length()) if n else 1
    sections: dict[str, list[int]] = {}
    body: list[bytes] = []
    at = 0

    def put(name, data, compress=True):
        nonlocal at
        data = squeeze(data) if compress else data
        sections[name] = [at, len(data)]
        body.append(data)
        at += len(data)

    known = [d is not None for d in doc_ids]
    put("doc_known", np.asarray(known, np.uint8).tobytes())
    put("doc_ids", np.asarray([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    put("doc_ends", np.asarray(doc_ends, "<i8").tobytes())
    rest = ids.astype(_kind(levels))
    for level in range(levels):
        bits = (rest & rest.dtype.type(1 << (levels - 1 - level))).astype(bool)
        ones = [np.count_nonzero(bits[k:k + BLOCK_BITS]) for k in range(0, n, BLOCK_BITS)]
        before = np.cumsum([0, *ones]).astype("<i8")
        plane = np.packbits(bits).tobytes()
        blocks = [squeeze(plane[k:k + BLOCK_BITS // 8]) for k in range(0, len(plane), BLOCK_BITS // 8)]
        put(f"ones{level}", before.tobytes())
        put(f"offsets{level}", np.cumsum([0, *map(len, blocks)]).astype("<i8").tobytes())
        put(f"plane{level}", b"".join(blocks), compress=False)
        rest = np.concatenate([np.compress(~bits, rest), np.compress(bits, rest)])
    header = json.dumps({"n": n, "levels": levels, "block_bits": BLOCK_BITS, "sections": sections}).encode()
    return MAGIC + struct.pack("<Q", len(header)) + header + b"".join(body)


class Shard:
    """Reader of one shard file (a seekable binary file object)."""

    def __init__(self, file):
        import zstandard
        self.expand = zstandard.ZstdDecompressor().decompress
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack("<Q", file.read(8))[0]
        self.head = json.loads(file.read(size))
        self.base = 16 + size
        self.n, self.levels, self.block = self.head["n"], self.head["levels"], self.head["block_bits"]
        known = np.frombuffer(self._section("doc_known"), np.uint8)
        self.doc_ids = [int(d) if k else None for k, d in zip(known, np.frombuffer(self._section("doc_ids"), "<i8"))]
        self.doc_ends = np.frombuffer(self._section("doc_ends"), "<i8")
        self.ones = [np.frombuffer(self._section(f"ones{i}"), "<i8") for i in range(self.levels)]
        self.offsets = [np.frombuffer(self._section(f"offsets{i}"), "<i8") for i in range(self.levels)]
        self.zeros = [self.n - int(o[-1]) for o in self.ones]
        self.seen: dict = {}

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(self.base + at)
        return self.file.read(size)

    def _section(self, name: str) -> bytes:
        return self.expand(self._read(*self.head["sections"][name]))

    def _block(self, level: int, k: int) -> np.ndarray:
        """Bits of block ``k`` and the ones before each of its bits."""
        if (level, k) not in self.seen:
            if len(self.seen) > 64:
                self.seen.clear()
            lo, hi = self.offsets[level][k:k + 2]
            raw = self.expand(self._read(self.head["sections"][f"plane{level}"][0] + int(lo), int(hi - lo)))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8))
            self.seen[level, k] = bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        return self.seen[level, k]

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        k, r = divmod(i, self.block)
        return int(self.ones[level][k]) + (int(self._block(level, k)[1][r]) if r else 0)

    def _bit(self, level: int, i: int) -> int:
        k, r = divmod(i, self.block)
        return int(self._block(level, k)[0][r])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            value = value << 1 | bit
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` in [lo, hi) stand below the last plane."""
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        if value < 0 or value >> self.levels:
            return 0
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, value: int, i: int) -> int:
        return self.count(value, 0, i)

    def _nth(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) set or clear bit of a plane."""
        ones = self.ones[level]
        starts = ones if bit else np.minimum(np.arange(len(ones), dtype=np.int64) * self.block, self.n) - ones
        block = int(np.searchsorted(starts, k, side="right")) - 1
        bits = self._block(level, block)[0]
        return block * self.block + int(np.flatnonzero(bits == bit)[k - int(starts[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence, counted from 0."""
        if k < 0 or k >= self.count(value):
            raise IndexError(k)
        at = self._range(value, 0, self.n)[0] + k
        for level in reversed(range(self.levels)):
            bit = value >> (self.levels - 1 - level) & 1
            at = self._nth(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def document(self, j: int) -> list[int]:
        lo = int(self.doc_ends[j - 1]) if j else 0
        return [self.access(i) for i in range(lo, int(self.doc_ends[j]))]

    def decode(self) -> np.ndarray:
        """All ids, undoing the planes' stable partitions from the last one."""
        out = np.zeros(self.n, _kind(self.levels))
        for level in reversed(range(self.levels)):
            at, size = self.head["sections"][f"plane{level}"]
            data, offsets = self._read(at, size), self.offsets[level]
            raw = b"".join(self.expand(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:]))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).astype(bool)
            up = np.empty(self.n, out.dtype)
            up[~bits] = out[:self.zeros[level]]
            up[bits] = out[self.zeros[level]:] | out.dtype.type(1 << (self.levels - 1 - level))
            out = up
        return out.astype(np.uint32)


def ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Range-partitioned and sorted by id (null first); rows of one id go by
    their text's hash, so repeated rows have a defined order too."""
    keys = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)]
    return docs.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_shards(rows: DataFrame, folder: str, id_col: str = "doc_id", ids_col: str = "ids",
                 shard_tokens: int = SHARD_TOKENS, encoder=None) -> DataFrame:
    """Write range-partitioned, sorted rows (see :func:`ordered`) as shard
    files below ``folder``, a path that every executor reaches, and return the
    manifest (part, seq, path, n_docs, n_ids), itself written there.

    A task writes its documents in order and closes a shard after
    ``shard_tokens`` ids, so memory is bounded by that and the longest
    document. Files are written under another name and then moved: a lost or
    repeated task leaves whole files only, equal for equal input.

    ``encoder``, if given, is called once in a task and returns the function
    that turns a value of ``ids_col`` (a text, say) into packed ids.
    """
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        convert = encoder() if encoder else lambda ids: ids or b""
        task = TaskContext.get()
        part, seq, docs, ends, held, total = task.partitionId(), 0, [], [], [], 0

        def close():
            nonlocal seq, docs, ends, held, total
            path = f"{root}/part-{part:06d}-{seq:05d}.wavelet"
            own = f"{root}/.{part:06d}-{seq:05d}-{task.taskAttemptId()}"
            with store.open_output_stream(own) as out:
                out.write(pack(np.frombuffer(b"".join(held), "<u4"), docs, ends))
            store.move(own, path)
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path.removeprefix(root)], "n_docs": [len(docs)], "n_ids": [total]},
                                             schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            seq, docs, ends, held, total = seq + 1, [], [], [], 0
            return row

        for batch in batches:
            for doc, ids in zip(batch.column(id_col).to_pylist(), batch.column(ids_col).to_pylist()):
                ids = convert(ids)
                docs.append(doc)
                total += len(ids) // 4
                ends.append(total)
                held.append(ids)
                if total >= shard_tokens:
                    yield close()
        if docs:
            yield close()

    written = rows.select(id_col, ids_col).mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long")
    written.write.mode("overwrite").parquet(f"{folder}/manifest")
    return rows.sparkSession.read.parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the shard files: id, ``start`` (ids of all
    documents before it) and its ``ids`` (packed, unsigned 32-bit)."""
    # Ids before each part: a running sum over one row per part; then within it.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = (manifest.join(parts, "part")
              .select("path", (F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("base")))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_file(root + path) as file:
                    shard = Shard(file)
                    ids = shard.decode().astype("<u4")
                starts = np.concatenate([[0], shard.doc_ends]).tolist()
                for lo in range(0, len(shard.doc_ids), 1000):
                    js = range(lo, min(lo + 1000, len(shard.doc_ids)))
                    yield pa.RecordBatch.from_pydict(
                        {id_col: [shard.doc_ids[j] for j in js], "start": [base + starts[j] for j in js],
                         "ids": [ids[starts[j]:starts[j + 1]].tobytes() for j in js]},
                        schema=pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("ids", pa.binary())]))

    return shards.repartition(tasks, "path").mapInArrow(run, f"`{id_col}` long, start long, ids binary")
