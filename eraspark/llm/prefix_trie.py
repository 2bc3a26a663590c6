"""Trie of conversation prefixes, screened by a count-min sketch.

A node is a distinct sequence of the first d turns (role, text) of some
conversation; its members are the conversations that start with it.

1. Each turn is digested where it lies (128 bits and its number of words); texts
   do not move. A prefix digest is the exclusive-or of its turns' digests, each
   mixed with its place, so a running aggregate over a conversation's turns
   gives all its prefixes.
2. Every task counts its prefix digests in a count-min sketch whose counters stop
   at two (two bit planes); the sketches are added up by blocks. Estimates never
   fall short, so an estimate of one proves that a single conversation has the
   prefix, and with it all longer ones: such a tail is a chain of nodes of that
   conversation alone and is emitted from its own rows.
3. Only possibly shared prefixes are shuffled, and grouped exactly, counts being
   summed up before the shuffle.
4. What a node sums over its subtree comes from its members: every node is owned
   by its smallest member, which then owns all nodes below on its own path. So a
   running sum from the end of each conversation over what it owns, added up
   over the members of a node, is the sum over the node's subtree. A node's
   children find their parent by its digest, in a join of the kind that skew
   handling splits.

No step runs once a level, so depth costs nothing but rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, materialize_bucketed

#: Counters of a row of the sketch for each prefix, rows, and the most counters
#: of a row: the table is at most MOST_CELLS * ROWS bits = 64 MB, and broadcast. A
#: larger input fills it, so that more prefixes are shuffled; the nodes stay the same.
CELLS_EACH, ROWS, MOST_CELLS = 4, 4, 1 << 27
_LEAST_CELLS = 1 << 16
_BLOCK = 1 << 13                       # bytes of a bit plane that are added up together
#: Bytes of joined ids that one row carries to the digest of a node's ends.
_PIECE = 1 << 16

_KEY = ["depth", "p1", "p2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digests(role: str = "role", text: str = "text") -> list[Column]:
    """Columns t1, t2 (digest) and words (runs of characters other than ASCII
    white space) of a turn; a null role or text is the empty one."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.lit(1), r, t).alias("t1"), F.xxhash64(F.lit(2), r, t).alias("t2"),
            F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, i, t1, t2, words): the turns of each conversation numbered from
    1 in the order of ``turn`` (null first); turns of one number follow by role,
    then digest. Rows without a conv_id belong to no conversation and are left
    out; equal rows are turns of their own. Other columns are dropped."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "t1", "t2")
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), *turn_digests())
    return rows.withColumn("i", F.row_number().over(order).cast("long")).select("conv_id", "i", "t1", "t2", "words")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The nodes of all conversations in ``turns`` (conv_id, turn, role, text),
    as :func:`prefix_trie` gives them."""
    rows = materialize(numbered_turns(turns), keep_partitioning=False)
    return prefix_trie(rows.withColumnRenamed("i", "depth"), rows.select("conv_id").distinct())


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row a node, from ``turns`` (conv_id, depth, t1, t2, words; depth
    counts from 1 without gaps) and ``members``, every conv_id once, also of
    conversations without a turn:

    conv_id, the smallest member; depth; parent_conv_id, the parent's smallest
    member (root: null); n_convs, members; n_children; n_leaves, childless nodes
    of its subtree, itself included; saved_tokens, over its subtree, what each
    node's other members need not hold again: (n_convs - 1) * words of its last
    turn; ends_sha256, of the ids of members with no further turn, ascending,
    joined by commas. (conv_id, depth) names the turn that ends the node.

    Turns are told apart by 128-bit digests. No member, no node: an empty table
    gives an empty one. Equal conversations are members of the same nodes."""
    spark = turns.sparkSession
    # In buckets of conversations: the running steps along one need no further shuffle.
    rows = materialize_bucketed(_prefixes(turns), "conv_id")
    rows = materialize(_screened(rows), keep_partitioning=False)
    shared = rows.filter("shared")
    nodes = materialize(_grouped(shared), keep_partitioning=False)
    kids = nodes.groupBy(F.expr("depth - 1").alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("kids"))

    # What each conversation owns, and its tail: summed from its end, then over a node's members.
    parents = materialize(nodes.join(kids, _KEY, "left").withColumn("n_children", F.col("tails") + F.coalesce("kids", F.lit(0))), keep_partitioning=False)
    owned = parents.select("conv_id", "depth", *(F.lit(0).cast("long").alias(c) for c in ("p1", "p2")), F.lit(True).alias("own"),
                           F.expr("(n_convs - 1) * words").alias("saved"), F.expr("if(n_children = 0, 1, 0)").cast("long").alias("leaves"))
    held = shared.select("conv_id", *_KEY, F.lit(False).alias("own"), F.lit(0).cast("long").alias("saved"), F.col("tail").cast("long").alias("leaves"))
    on = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = (held.select(owned.columns).union(owned).withColumns({c: F.sum(c).over(on) for c in ("saved", "leaves")})
            .filter("not own").groupBy(*_KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")))
    full = parents.join(sums, _KEY).join(_ends(shared), _KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    inner = full.select("conv_id", "depth", "q1", "q2", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    single = rows.filter("not shared").select(
        "conv_id", "depth", "q1", "q2", one.alias("n_convs"), F.expr("if(last, 0, 1)").cast("long").alias("n_children"), one.alias("n_leaves"), no.alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"), "first")
    # Within a tail the parent is of the same conversation; its first node, like a shared one, asks for its parent.
    within = single.filter("not first").withColumn("parent_conv_id", F.col("conv_id"))
    asking = inner.unionByName(single.filter("first").drop("first"))
    least, n = members.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    top = asking.filter("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    above = nodes.select(F.expr("depth + 1").alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    deep = asking.filter("depth > 1").join(above, ["depth", "q1", "q2"])
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = materialize(within.select(out).union(top.select(out)).union(deep.select(out)), keep_partitioning=False)
    return nodes.union(_root(spark, members.join(turns.filter("depth = 1").select("conv_id"), "conv_id", "left_anti"), nodes, least, n).select(out))


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, words, p1, p2, q1, q2, last): digests of the prefix that
    ends here and of the one before."""
    mixed = turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "words", F.xxhash64("t1", "depth").alias("m1"), F.xxhash64("t2", "depth").alias("m2"))
    along = Window.partitionBy("conv_id").orderBy("depth")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = mixed.withColumns({"p1": F.bit_xor("m1").over(so_far), "p2": F.bit_xor("m2").over(so_far),
                              "last": F.lead("depth").over(along).isNull()})
    return rows.select("conv_id", "depth", "words", "p1", "p2", F.col("p1").bitwiseXOR(F.col("m1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("m2")).alias("q2"), "last")


def _cell(row: int, cells: int) -> Column:
    """The counter of a prefix in one row of the sketch."""
    return F.xxhash64("p1", F.lit(row)).bitwiseAND(F.lit(cells - 1).cast("long"))


def _sketch(rows: DataFrame, cells: int) -> DataFrame:
    """(row, block, once, twice): bit planes of the counters that reached one and two."""
    def count(batches):
        sums: dict = {}
        for seen in _gathered(batches):
            for row, at in enumerate(seen):
                at, n = np.unique(at, return_counts=True)
                for block in np.unique(at // (8 * _BLOCK)).tolist():
                    lo, hi = np.searchsorted(at, (block * 8 * _BLOCK, (block + 1) * 8 * _BLOCK))
                    here = at[lo:hi] - block * 8 * _BLOCK
                    _add(sums, (row, block), _plane(here), _plane(here[n[lo:hi] > 1]))
        yield from _frames(sums)

    def add(batches):
        sums: dict = {}
        for b in batches:
            for row, block, once, twice in zip(*(c.to_pylist() for c in b.columns)):
                _add(sums, (row, block), np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8))
        yield from _frames(sums)

    schema = "row int, block int, once binary, twice binary"
    return rows.select(*(_cell(row, cells) for row in range(ROWS))).mapInArrow(count, schema).repartition("row", "block").mapInArrow(add, schema)


def _gathered(batches, least: int = 1 << 20):
    """The columns of the batches, some batches at a time."""
    held, size = [], 0
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        size += b.num_rows
        if size >= least:
            yield [np.concatenate(c) for c in zip(*held)]
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _plane(at):
    bits = np.zeros(8 * _BLOCK, bool)
    bits[at] = True
    return np.packbits(bits, bitorder="little")


def _add(sums: dict, key, once, twice) -> None:
    a, b = sums.get(key, (0, 0))
    sums[key] = a | once, b | twice | (a & once)


def _frames(sums: dict):
    import pyarrow as pa
    names = ["row", "block", "once", "twice"]
    for (row, block), (once, twice) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()),
                                          pa.array([once.tobytes()]), pa.array([twice.tobytes()])], names)


def _screened(rows: DataFrame) -> DataFrame:
    """``rows`` with ``shared`` (false: the estimate proves one conversation),
    ``first`` (the first of its tail) and ``tail`` (a tail begins after it)."""
    cells, wanted = _LEAST_CELLS, min(MOST_CELLS, CELLS_EACH * rows.count())
    while cells < wanted:
        cells *= 2
    planes = materialize(_sketch(rows, cells).select("row", "block", "twice"), keep_partitioning=False)
    columns, often = rows.columns, F.lit(True)
    for row in range(ROWS):
        # At most MOST_CELLS / 8 bytes. A broadcast join leaves the buckets of conversations as they are.
        plane = planes.filter(F.col("row") == row).select(F.col("block").cast("long").alias(f"_b{row}"), F.col("twice").alias(f"_w{row}"))
        rows = (rows.withColumns({f"_c{row}": _cell(row, cells)}).withColumn(f"_b{row}", F.expr(f"_c{row} div {8 * _BLOCK}"))
                .join(F.broadcast(plane), f"_b{row}", "left"))
        byte = F.expr(f"cast(conv(hex(substring(_w{row}, cast(_c{row} % {8 * _BLOCK} div 8 as int) + 1, 1)), 16, 10) as int)")
        often = often & (F.getbit(byte, F.expr(f"cast(_c{row} % 8 as int)")) == 1)
    rows = rows.select(*columns, often.alias("often"))

    along = Window.partitionBy("conv_id").orderBy("depth")
    # A prefix of a tail may look shared by chance: the tail begins at the first that does not.
    alone = F.max(~F.col("often")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("shared", ~alone)
    rows = rows.withColumns({"first": ~F.col("shared") & F.coalesce(F.lag("shared").over(along), F.lit(True)),
                             "tail": F.col("shared") & ~F.coalesce(F.lead("shared").over(along), F.lit(True))})
    return rows.drop("often")


def _grouped(shared: DataFrame) -> DataFrame:
    """(depth, p1, p2, q1, q2, words, conv_id, n_convs, tails) of each possibly shared prefix."""
    return shared.groupBy(*_KEY).agg(F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("words").alias("words"), F.min("conv_id").alias("conv_id"),
                                     F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("tail").cast("long")).alias("tails"))


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the prefixes at which a conversation ends.

    The ids are sorted over all tasks and joined in pieces, so a prefix at which
    very many conversations end is one digest over few rows, in order."""
    import pyarrow as pa
    ends = (rows.filter("last").select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id"))

    def join(batches):
        def piece():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, first, ",".join(ids)), kinds)], [*_KEY, "first", "ids"])
        kinds = [pa.int64()] * 4 + [pa.string()]
        key, first, ids, size = None, None, [], 0
        for b in batches:
            for *k, conv in zip(*(c.to_pylist() for c in b.columns)):
                if k != key or size > _PIECE:
                    if ids:
                        yield piece()
                    key, first, ids, size = k, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1])
        if ids:
            yield piece()

    def digest(batches):
        def done():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, sha.hexdigest()), kinds)], [*_KEY, "ends_sha256"])
        kinds = [pa.int64()] * 3 + [pa.string()]
        key, sha = None, None
        for b in batches:
            for *k, _, ids in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if sha:
                        yield done()
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha:
            yield done()

    key = "depth long, p1 long, p2 long"
    pieces = ends.mapInArrow(join, f"{key}, first long, ids string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, f"{key}, ends_sha256 string")


def _root(spark, turnless: DataFrame, nodes: DataFrame, least, n: int) -> DataFrame:
    """The node of depth 0, if there is a conversation: sums over the nodes of depth 1."""
    no = F.lit(0).cast("long")
    top = nodes.filter("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = _ends(turnless.select(no.alias("depth"), no.alias("p1"), no.alias("p2"), "conv_id", F.lit(True).alias("last"))).select("ends_sha256")
    ends = ends.agg(F.coalesce(F.max("ends_sha256"), F.lit(_EMPTY)).alias("ends_sha256")).first()[0]
    return top.filter(F.lit(n > 0)).select(
        F.lit(least).cast("long").alias("conv_id"), no.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"),
        "n_children", F.greatest(F.coalesce("n_leaves", no), F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", no).alias("saved_tokens"), F.lit(ends).alias("ends_sha256"))
