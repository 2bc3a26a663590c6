"""Set-similarity join on word shingles: prefix filtering, rarest first.

A document is the set of its distinct word shingles. Sets are put into one
global order, rare shingles first; if two sets are similar enough, their
prefixes in that order (the first n - ceil(t n) + 1 shingles) share one. So
only prefix shingles are joined, and a candidate pair must pass

* the length filter: sizes within the threshold of each other;
* the positional filter: what can still be common from the shared prefix
  shingle on reaches the needed overlap;
* the signature filter: each shingle flips one bit of its set's signature, so
  two signatures differ in no more bits than their sets in shingles, and that
  is no more than two sets with the needed overlap can;

before the sets themselves are compared, once for each pair. A signature has a
bit or two a shingle, where the set has 64: few pairs that do not link pass.

The rarity of a shingle is the count of its hash bucket over all documents
(2**16 buckets, a fixed 512 KB). Any fixed order gives the same result; the
counts only keep frequent shingles out of the prefixes. Of the prefix rows,
only those are moved whose shingle another class has in its prefix too, as far
as a bit table of fixed size (``TABLE_BITS``) tells; a chance hit there is a
row more.

Equal sets are one class from the start. Within a large group that shares a
prefix shingle, members are first compared with a few leaders, those with the
fewest rare shingles; what these links join needs no further comparison, and
only pairs of members from different components are then taken up. No link
between components can be missed, and copies never expand into pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, freeing, materialize
from .common import returning, slices, utf8
from .components import components
from .suffix_dedup import SYMBOLS, bit_table, in_table, mix, powers

BUCKETS = 1 << 16
TABLE_BITS = 27
# Bits of a signature at least and at most.
LEAST_BITS, MOST_BITS = 64, 1 << 20
LEADERS = 4
MEMORY_ENTRIES = 1_000_000
# Bytes of text hashed at a time.
CHUNK = 1 << 18


class _WordHashes(dict):
    def __missing__(self, word):
        import xxhash
        if len(self) >= MEMORY_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the text's words (runs of bytes other than ASCII white space)."""
    found = text.split()
    return np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = SYMBOLS.copy()
_LOWER[ord("A"):ord("Z") + 1] = SYMBOLS[ord("a"):ord("z") + 1]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash (A-Z lower-cased) and start of each word, by prefix sums."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_LOWER[raw] * down[:n])])
    return mix((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def _pieces(text: bytes):
    """A long text in pieces that end behind white space (a longer word stays whole)."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and not _SPACE[text[end - 1]]:
            end += 1
        yield text[at:end]
        at = end


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles. Words are
    runs of bytes other than ASCII white space, A-Z lower-cased; a text of
    fewer words than ``words`` has its whole sequence as the one shingle."""
    out, i = [], 0
    while i < len(texts):
        if len(texts[i]) > CHUNK:
            w = np.concatenate([_words(p)[0] for p in _pieces(texts[i])])
            j, cuts = i + 1, np.asarray([0, len(w)])
        else:
            j, size = i, 0
            while j < len(texts) and size + len(texts[j]) <= CHUNK:
                size += len(texts[j]) + 1
                j += 1
            w, start = _words(b"\n".join(texts[i:j]))
            cuts = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[i:j]])]))
        long = _rolled(w, words)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(long[a:b - words + 1]))
            else:
                out.append(_rolled(w[a:b], b - a) if b > a else np.zeros(0, np.int64))
        i = j
    return out


def _rolled(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    h = np.full(max(len(w) - k + 1, 0), k, np.uint64)
    for j in range(k):
        h = (h ^ w[j:len(w) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def needed_prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sets(batches, words, *extra):
    """For each batch: the texts' shingle sets, the nodes (128-bit set
    hashes), and the columns named in ``extra``."""
    import xxhash
    for batch in batches:
        for b in slices(batch, "text"):
            sets = shingle_sets(utf8(b.column("text")), words)
            yield sets, [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [b.column(c) for c in extra]


def signature(s: np.ndarray) -> np.ndarray:
    """64-bit words of a set's signature: for each of a power of two of places,
    as many as shingles at least, whether an odd number of shingles falls on it."""
    bits = min(max(LEAST_BITS, 1 << max(len(s) - 1, 0).bit_length()), MOST_BITS)
    odd = np.bincount((s >> 40) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _apart(column_a, column_b) -> np.ndarray:
    """In how many bits two columns of signatures differ; the longer of two is
    folded to the length of the shorter."""
    sides = []
    for column in (column_a, column_b):
        ends = column.offsets.to_numpy()
        sides.append((ends[:-1], np.diff(ends), column.values.to_numpy().view(np.uint64)))
    (at_a, n_a, a), (at_b, n_b, b) = sides
    out = np.zeros(len(n_a), np.int64)
    for i, j in np.unique(np.stack([n_a, n_b]), axis=1).T.tolist():
        rows, n = np.flatnonzero((n_a == i) & (n_b == j)), min(i, j)
        step = max(1, (1 << 17) // max(i, j))
        for lo in range(0, len(rows), step):
            some = rows[lo:lo + step]
            x, y = (np.bitwise_xor.reduce(values[at[some][:, None] + np.arange(k)].reshape(len(some), k // n, n), axis=1)
                    for at, k, values in ((at_a, i, a), (at_b, j, b)))
            out[some] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def members(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, node, n_shingles, signature), each row's class of equal sets and
    the set's signature, and the shingles of all documents by hash bucket; all
    from one pass."""
    def run(batches):
        import pyarrow as pa
        count = np.zeros(BUCKETS, np.int64)
        names = ["doc_id", "node", "n_shingles", "signature", "bucket"]
        kept = pa.list_(pa.int64())
        for sets, nodes, (ids,) in _sets(batches, words, "doc_id"):
            if sets:
                count += np.bincount(np.concatenate(sets) & (BUCKETS - 1), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([signature(s) for s in sets], kept),
                                              pa.nulls(len(sets), pa.int32())], names=names)
            kind = ids.type
        if (used := np.flatnonzero(count)).size:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), kind), pa.nulls(len(used), pa.binary()), pa.array(count[used]), pa.nulls(len(used), kept),
                                              pa.array(used, pa.int32())], names=names)
    both = materialize(docs.mapInArrow(returning(run, "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, node binary, n_shingles long, signature array<long>, bucket int"), keep_partitioning=False)
    with freeing(docs.sparkSession):
        rows = both.filter("bucket is not null").groupBy("bucket").agg(F.sum("n_shingles").alias("n")).toArrow()
    count = np.zeros(BUCKETS, np.int64)
    count[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    # As ranks: few enough bits to sort together with the hash.
    return both.filter("bucket is null").drop("bucket"), np.unique(count, return_inverse=True)[1].astype(np.uint64)


def _prefix(s: np.ndarray, percent: int, order: np.ndarray) -> np.ndarray:
    """The prefix of a sorted set: rarest first, then by hash."""
    key = order[s & (BUCKETS - 1)] << np.uint64(32) | s.view(np.uint64) >> np.uint64(32)
    return s[np.argsort(key, kind="stable")[:needed_prefix(len(s), percent)]]


def prefixes(docs: DataFrame, words: int, percent: int, count) -> DataFrame:
    """(token, node, n, pos): those prefix shingles of each class that may be
    in another prefix too. A task emits a class once; the same class from
    several tasks is merged."""
    def new(batches):
        done = set()
        for sets, nodes, _ in _sets(batches, words):
            for s, node in zip(sets, nodes):
                if len(s) and node not in done:
                    done.add(node)
                    yield node, len(s), _prefix(s, percent, count.value)
            yield None, 0, None

    def tokens(batches):
        import pyarrow as pa
        held = []
        for node, _, first in new(batches):
            if node is not None:
                held.append(first)
            elif held:
                found, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["token", "n"])
                held = []
    several = (docs.select("text").mapInArrow(returning(tokens, "text"), "token long, n long")
               .groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1"))
    table = docs.sparkSession.sparkContext.broadcast(bit_table(several, "token", TABLE_BITS))

    def run(batches):
        import pyarrow as pa
        rows = [[], [], [], []]
        for node, n, first in new(batches):
            if node is not None:
                pos = np.flatnonzero(in_table(table.value, first))
                for column, values in zip(rows, (first[pos], [node] * len(pos), np.full(len(pos), n, np.int32), pos.astype(np.int32))):
                    column.append(values)
            elif rows[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(rows[0])), pa.array([x for r in rows[1] for x in r], pa.binary()),
                     pa.array(np.concatenate(rows[2])), pa.array(np.concatenate(rows[3]))], names=["token", "node", "n", "pos"])
                rows = [[], [], [], []]
    found = (docs.select("text").mapInArrow(returning(run, "text"), "token long, node binary, n int, pos int")
             .groupBy("token", "node").agg(F.min("n").alias("n"), F.min("pos").alias("pos")))
    out = materialize(found, keep_partitioning=False)
    table.destroy()
    return out


def _fits(percent: int, a: str, b: str):
    """Length and positional filter for two prefix rows of one token."""
    c = lambda side, name: F.col(f"{side}.{name}").cast("long")
    length = ((100 * c(a, "n") >= percent * c(b, "n")) & (100 * c(b, "n") >= percent * c(a, "n")))
    still = F.least(c(a, "n") - c(a, "pos"), c(b, "n") - c(b, "pos"))
    return length & ((100 + percent) * still >= percent * (c(a, "n") + c(b, "n")))


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _sets_of(docs: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the classes that ``named`` (doc_id) stands for, and
    a few more: the rows are found by a bit table over their ids, so no text
    is moved."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(named.select(F.xxhash64("doc_id").alias("h")).distinct(), "h", TABLE_BITS))

    def run(batches):
        import pyarrow as pa
        done = set()
        for batch in batches:
            some = batch.filter(pa.array(in_table(table.value, batch.column("h").to_numpy())))
            for sets, nodes, _ in _sets([some], words):
                new = [i for i, node in enumerate(nodes) if node not in done and not done.add(node)]
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in new], pa.binary()),
                                                  pa.array([sets[i] for i in new], pa.list_(pa.int64()))], names=["node", "shingles"])
    out = materialize(docs.select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(returning(run, "text"), "node binary, shingles array<long>"),
                      keep_partitioning=False)
    table.destroy()
    return out


def _verified(pairs: DataFrame, member: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, written: signature filter, then the sets
    themselves."""
    pairs = materialize(pairs, keep_partitioning=False)
    if pairs.isEmpty():
        return pairs
    asked = member.join(_nodes(pairs), "node", "left_semi")
    marks = asked.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("signature").alias("s"))
    both = (pairs.join(marks.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
            .join(marks.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b"))

    def close(batches):
        import pyarrow as pa
        for batch in batches:
            a, b, total, sa, sb = batch.columns
            total = total.to_numpy()
            # overlap >= percent * total / (100 + percent)  =>  difference <= total - 2 * overlap
            some = pa.array((100 + percent) * (total - _apart(sa, sb)) >= 2 * percent * total)
            yield pa.RecordBatch.from_arrays([a.filter(some), b.filter(some)], names=["a", "b"])
    near = materialize(both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "sa", "sb").mapInArrow(returning(close, "a"), "a binary, b binary"), keep_partitioning=False)
    discard(pairs)
    if near.isEmpty():
        return near
    named = member.join(_nodes(near), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = _sets_of(docs, named, words)
    both = (near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    total = (F.size("sa") + F.size("sb")).cast("long")
    out = materialize(both.filter((100 + percent) * common >= percent * total).select("a", "b"), keep_partitioning=False)
    discard(near, sets)
    return out


def linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, node, n_shingles, component) for each row of (doc_id, text);
    the component is the least node its class of equal sets reaches."""
    spark = docs.sparkSession
    member, order = members(docs, words)
    order = spark.sparkContext.broadcast(order)
    every = prefixes(docs, words, percent, order)
    order.destroy()
    several = every.groupBy("token").agg(F.count(F.lit(1)).alias("nodes")).filter("nodes > 1").select("token")
    rows = materialize(every.join(several, "token"), keep_partitioning=False)
    discard(every)

    # 1. Every member of a token's group against its leaders.
    rank = F.row_number().over(Window.partitionBy("token").orderBy("pos", "node"))
    leaders = rows.withColumn("rank", rank).filter(F.col("rank") <= LEADERS).drop("rank")
    near = (leaders.alias("x").join(rows.alias("y"), F.col("x.token") == F.col("y.token"))
            .filter((F.col("x.node") != F.col("y.node")) & _fits(percent, "x", "y"))
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    near = materialize(near, keep_partitioning=False)
    links = _verified(near, member, docs, words, percent)

    # 2. Pairs of a group that these links leave in different components.
    joined = materialize(components(links, "a", "b"), keep_partitioning=False)
    marked = rows.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (marked.groupBy("token").agg(F.min(F.xxhash64("component")).alias("lo"), F.max(F.xxhash64("component")).alias("hi"))
             .filter("lo != hi").select("token"))
    marked = materialize(marked.join(mixed, "token"), keep_partitioning=False)
    rest = (marked.alias("x").join(marked.alias("y"), (F.col("x.token") == F.col("y.token"))
                                   & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
                                   & _fits(percent, "x", "y"))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
            .join(near, ["a", "b"], "left_anti"))
    links = links.union(_verified(rest, member, docs, words, percent))
    discard(rows, marked, near)

    joined = materialize(components(links, "a", "b"), keep_partitioning=False)
    return member.drop("signature").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the
    smallest id reachable over links (100 * common >= percent * union).

    Null or blank texts have an empty set and link with nothing: their
    component is their own id. Rows without an id belong to the component of
    their set but never name it. Repeated rows are equal sets, so one
    component. Other columns are ignored. An empty table gives no rows.
    """
    placed = linked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words, percent)
    names = placed.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (placed.join(names, "component", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id (a row without
    an id only if no other has one; among rows of one id, the one whose set
    has the least hash). Rows with null or blank text all stay."""
    import pyarrow as pa
    columns = docs.columns
    names = {c: f"_c{i}" for i, c in enumerate(columns)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    key, text = names[id_col], names[text_col]
    placed = materialize(linked(rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), words, percent), keep_partitioning=False)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node"))
    stay = placed.filter("n_shingles > 0").groupBy("component").agg(first.alias("f")).select(
        F.col("f.doc_id").alias("_id"), F.col("f.node").alias("_node"))

    def run(batches):
        import xxhash
        for batch in batches:
            for b in slices(batch, text):
                sets = shingle_sets(utf8(b.column(text)), words)
                nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.binary())], names=[*b.schema.names, "node"])
    tagged = rows.mapInArrow(returning(run, text), rows.withColumn("node", F.lit(None).cast("binary")).schema)
    # Classes that several rows share in the chosen id keep one row only.
    several = placed.filter("n_shingles > 0").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    kept = tagged.join(stay.hint("shuffle_hash"), tagged[key].eqNullSafe(F.col("_id")) & (F.col("node") == F.col("_node")), "left_semi")
    if several:
        kept = kept.dropDuplicates([key, "node"])
    blank = rows.filter(F.col(text).isNull() | ~F.col(text).rlike(r"[^ \t-\r]"))
    return kept.select(*names.values()).unionByName(blank).withColumnsRenamed({n: c for c, n in names.items()})
