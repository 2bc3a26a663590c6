"""Repeated byte strings by prefix-free parsing and suffix arrays.

Which ``LENGTH``-byte strings start earlier in the corpus is read off the
corpus order of its suffixes, as far as their first ``LENGTH`` bytes go. The
order is never built over the corpus itself:

1. *Parse.* A rolling hash runs over every ``CORE`` bytes. A position triggers
   when its hash is the least (leftmost among equals) of all that fit in some
   ``LENGTH``-byte string, so each such string has exactly one trigger inside,
   found from its own bytes. The strings with the same trigger make a phrase;
   the phrases cover a document, overlapping by LENGTH - 1 bytes. A phrase has
   at most LENGTH - CORE + 1 strings.
2. *Dictionary.* Equal phrases collapse to one entry with its first
   occurrence in the corpus; all other occurrences hold repeated strings only.
   Phrases whose trigger hash is found once in the corpus need no entry: none
   of their strings occurs elsewhere. Which hashes are found twice or more is
   kept in a bit table of fixed size (``TABLE_BITS``); a chance hit there only
   means an entry more.
3. *Suffix arrays.* Strings of different phrases can be equal only if the
   phrases share their trigger. Entries that do are brought together by
   trigger, a slice's suffixes are ranked by doubling (8, 16, 32, 64, then
   LENGTH bytes), and strings of one rank are put in the order of the parse:
   the first stays, the others are repeated. A trigger with more than
   ``SLICE`` entries is dealt to several slices; what stays in each is merged
   by trigger and string hash with a grouped minimum.

A last pass parses each document again, takes out the strings of all phrases
that are not first occurrences, and those found in step 3.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import freeing, materialize
from .common import returning, utf8

LENGTH = 100
CORE = 40
TABLE_BITS = 27
SLICE = 1024
# Bytes parsed, and dictionary bytes sorted, at a time.
CHUNK = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
SYMBOLS = np.random.default_rng(20).integers(0, 2**64, 256, dtype=_U)
_POWERS: dict = {}


def powers(n: int):
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            run = np.full(n, base, _U)
            run[0] = 1
            _POWERS[name] = np.cumprod(run)
    return _POWERS["up"], _POWERS["down"]


def mix(z):
    z = (z ^ (z >> _U(32))) * _U(0xBF58476D1CE4E5B9)
    return (z ^ (z >> _U(29))) * _U(0x94D049BB133111EB)


def _parse(data: bytes, ends: np.ndarray, length: int, core: int):
    """Phrases of concatenated texts (``ends``: where each ends): text index,
    first string, number of strings, trigger hash, phrase hash. No phrase
    crosses an end."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    up, down = powers(n + 1)
    sums = np.concatenate([[_U(0)], np.cumsum(SYMBOLS[np.frombuffer(data, np.uint8)] * down[:n])])
    rolling = mix((sums[core:] - sums[:-core]) * up[:n - core + 1])
    # The hash's upper bits, then the position: the least is the leftmost least.
    least = (rolling >> _U(31) << _U(31)) | np.arange(len(rolling), dtype=_U)
    span, width = length - core + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    trigger = (least & _U(2**31 - 1)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(trigger)), side="right")
    start = np.flatnonzero(np.arange(len(trigger)) + length <= ends[np.minimum(text, len(ends) - 1)])
    if not len(start):
        return none, none, none, none, none
    trigger, text = trigger[start], text[start]
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])]))
    lo, last = start[new], start[np.concatenate([new[1:] - 1, [len(start) - 1]])]
    whole = mix((sums[last + length] - sums[lo]) * up[lo] + (last - lo).astype(_U) * _U(0xD6E8FEB86659FD93))
    return text[new], lo, last - lo + 1, rolling[trigger[new]].view(np.int64), whole.view(np.int64)


def phrases(texts: list[bytes], length: int = LENGTH, core: int = CORE):
    """Phrases of all texts, at most about ``CHUNK`` bytes at a time: yields
    (text index, first string, number of strings, trigger hash, phrase hash)
    arrays. A long text is taken in pieces that begin at a phrase."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > CHUNK:
            at, whole = 0, texts[i]
            while True:
                piece = whole[at:at + CHUNK]
                t, lo, n, trigger, phrase = _parse(piece, np.asarray([len(piece)]), length, core)
                done = at + len(piece) == len(whole)
                keep = slice(None) if done else slice(-1)
                yield t[keep] + i, lo[keep] + at, n[keep], trigger[keep], phrase[keep]
                if done:
                    break
                at += int(lo[-1])
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= CHUNK:
            size += len(texts[j])
            j += 1
        ends = np.cumsum([len(t) for t in texts[i:j]])
        t, lo, n, trigger, phrase = _parse(b"".join(texts[i:j]), ends, length, core)
        yield t + i, lo - np.concatenate([[0], ends])[t], n, trigger, phrase
        i = j


def ranks(entries: list[bytes], length: int = LENGTH):
    """Suffix order of dictionary entries to ``length`` bytes: for each string
    its entry, its start there, and its rank (equal strings, equal rank)."""
    sizes = np.asarray([len(e) for e in entries])
    data = np.frombuffer(b"".join(entries), np.uint8).astype(_U)
    n, width = len(data), 1
    word = data
    while width < 8:                                   # 8 bytes as one number
        word = (word << _U(8 * width)) | np.concatenate([word[width:], np.zeros(min(width, n), _U)])
        width *= 2
    rank = np.unique(word, return_inverse=True)[1].astype(_U)
    while 2 * width <= length:
        rank = np.unique((rank << _U(32)) | np.concatenate([rank[width:], np.zeros(min(width, n), _U)]), return_inverse=True)[1].astype(_U)
        width *= 2
    counts = sizes - length + 1
    entry = np.repeat(np.arange(len(entries)), counts)
    start = np.arange(len(entry)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(sizes) - sizes, counts) + start
    rank = np.unique((rank[at] << _U(32)) | rank[at + length - width], return_inverse=True)[1]
    return entry, start, rank


def bit_table(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits bits, in 64-bit words, with a bit set for each hash (long)."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, 58) as int))")
    with freeing(hashes.sparkSession):
        words = (hashes.select(F.expr(f"{column} & {2 ** (bits - 6) - 1}").alias("word"), bit.alias("bit"))
                 .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the table: never false for one that is."""
    word = table[hashes & (len(table) - 1)].view(_U)
    return (word >> (hashes.view(_U) >> _U(58))) & _U(1) == 1


def _listed(values, kind):
    import pyarrow as pa
    return pa.array(values, kind)


def _runs(flags: np.ndarray, cut: np.ndarray):
    """[first, last] of each run of true flags; runs also end where ``cut`` changes."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on
    brk = np.flatnonzero((on[1:] != on[:-1] + 1) | (cut[on[1:]] != cut[on[:-1]]))
    return on[np.concatenate([[0], brk + 1])], on[np.concatenate([brk, [len(on) - 1]])]


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (id, text): doc_id, n_bytes, ``spans`` (array of
    (start, end): the maximal runs of bytes covered by a ``length``-byte string
    that starts earlier in the corpus) and ``kept`` (binary, all other bytes).

    Texts are UTF-8 bytes; null counts as empty. Earlier means a smaller id
    (null before all), or the same row further left; strings do not cross
    rows. Different texts under one id go by their hash; rows equal in id and
    text are one document, each with the same result. An empty table gives no
    rows; other columns are ignored, but for those named in ``carry``, which
    come after the result's. ``as_text``: ``kept`` is a string, without the
    characters of which a byte is cut; null texts stay null.
    """
    import pyarrow as pa
    if length < 64:
        raise ValueError("length below 64")
    spark, core = docs.sparkSession, min(CORE, length - 1)
    carry = carry or []
    carried = {c: f"_c{i}" for i, c in enumerate(carry)}
    full = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in carried.items()))
    docs = full.select("doc_id", "text")
    # A hash tells rows of one id apart; where ids are unique it is left at 0.
    unique = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").limit(1).count() == 0
    twin = F.lit(0).cast("long") if unique else F.xxhash64("text")
    docs = docs.withColumn("twin", twin)

    # 1. Trigger hashes found more than once, as a bit table.
    def triggers(batches):
        for batch in batches:
            for _, _, _, trigger, _ in phrases(utf8(batch.column("text")), length, core):
                found, n = np.unique(trigger, return_counts=True)
                yield pa.RecordBatch.from_arrays([_listed(found, pa.int64()), _listed(n, pa.int64())], names=["trigger", "n"])
    once = docs.select("text") if unique else docs.select("doc_id", "text").distinct().select("text")
    several = (once.mapInArrow(returning(triggers, "text"), "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n")).filter("n > 1"))
    table = spark.sparkContext.broadcast(bit_table(several, "trigger", TABLE_BITS))

    def shared(trigger):
        return in_table(table.value, trigger)

    # 2. Dictionary entries: the first occurrence of each phrase.
    def parse(batches):
        for batch in batches:
            for t, lo, n, trigger, phrase in phrases(utf8(batch.column("text")), length, core):
                on = shared(trigger)
                if on.any():
                    rows = pa.array(t[on])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(trigger[on]), pa.array(phrase[on]), batch.column("doc_id").take(rows), batch.column("twin").take(rows),
                         pa.array(lo[on] << 8 | n[on])], names=["trigger", "phrase", "doc_id", "twin", "place"])
    occurrences = docs.mapInArrow(returning(parse, "text"), "trigger long, phrase long, doc_id long, twin long, place long")
    entries = (occurrences.groupBy("trigger", "phrase").agg(F.min(F.struct("doc_id", "twin", "place")).alias("first"))
               .select("trigger", "first.*"))
    entries = materialize(entries, keep_partitioning=False)
    rivals = entries.groupBy("trigger").agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1")
    rivals = entries.join(rivals, "trigger").select(
        "trigger", "doc_id", "twin", "place", F.ceil(F.col("entries") / SLICE).cast("int").alias("deals"))
    rivals = rivals.withColumn("deal", F.expr("cast(pmod(xxhash64(doc_id, twin, place), deals) as int)"))

    # Their bytes, from the documents.
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["twin"] == b["twin"])
    places = rivals.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("trigger", "place", "deals", "deal")).alias("entries"))
    texts = docs if unique else docs.distinct()
    held = texts.join(places.hint("shuffle_hash").withColumnsRenamed({"doc_id": "d", "twin": "t"}),
                      F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t"))).drop("d", "t")
    bytes_of = held.select("doc_id", "twin", F.encode("text", "UTF-8").alias("data"), F.explode("entries").alias("e")).select(
        "doc_id", "twin", "e.*", F.expr(f"substring(data, cast(shiftright(e.place, 8) + 1 as int), cast((e.place & 255) + {length - 1} as int))").alias("bytes"))

    # 3. Suffix order of each slice; ``code`` is null for settled strings.
    def settle(rows):
        trigger, doc, twin, place, deals, data = rows
        entry, start, rank = ranks(data, length)
        lo = place[entry] >> 8
        order = np.lexsort((lo + start, twin[entry], doc[entry], rank))
        later = np.zeros(len(rank), bool)
        later[order[1:]] = rank[order[1:]] == rank[order[:-1]]
        a, b = _runs(later, entry)
        open_ = np.flatnonzero(~later & (deals[entry] > 1))
        code = _codes(data, entry[open_], start[open_], length)
        e = np.concatenate([entry[a], entry[open_]])
        return pa.RecordBatch.from_arrays(
            [pa.array(trigger[e]), pa.array(np.concatenate([np.zeros(len(a), np.int64), code]), mask=np.arange(len(e)) < len(a)),
             pa.array(doc[e], mask=doc[e] == _NULL), pa.array(twin[e]),
             pa.array(np.concatenate([(lo + start)[a], (lo + start)[open_]])),
             pa.array(np.concatenate([(lo + start)[b], (lo + start)[open_]]))],
            names=["trigger", "code", "doc_id", "twin", "first", "last"])

    def order(batches):
        held, size, mark = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("trigger", "doc_id", "twin", "place", "deals", "bytes", "deal"))):
                if size >= CHUNK and (row[0], row[6]) != mark:
                    yield settle(_columns(held))
                    held, size = [], 0
                mark = row[0], row[6]
                held.append(row)
                size += len(row[5])
        if held:
            yield settle(_columns(held))
    slices_ = bytes_of.repartition("trigger", "deal").sortWithinPartitions("trigger", "deal")
    found = materialize(slices_.mapInArrow(returning(order, "bytes"), "trigger long, code long, doc_id long, twin long, first long, last long"), keep_partitioning=False)
    open_ = found.filter("code is not null")
    least = (open_.groupBy("trigger", "code").agg(F.min(F.struct("doc_id", "twin", "first")).alias("least"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").drop("n"))
    merged = (open_.join(least, ["trigger", "code"])
              .filter(~F.struct("doc_id", "twin", "first").eqNullSafe(F.col("least"))))
    strings = found.filter("code is null").select("doc_id", "twin", "first", "last").union(merged.select("doc_id", "twin", "first", "last"))

    # Per document: its first occurrences and its repeated strings.
    firsts = entries.groupBy("doc_id", "twin").agg(F.collect_list("place").alias("places"))
    strings = strings.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("first", "last")).alias("strings"))
    known = firsts.join(strings.withColumnsRenamed({"doc_id": "d", "twin": "t"}),
                        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")), "left").select(
        F.col("doc_id").alias("kd"), F.col("twin").alias("kt"), "places", F.col("strings.first").alias("first"), F.col("strings.last").alias("last"))
    whole = full.withColumn("twin", twin).join(known.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("twin") == F.col("kt")), "left")

    def cut(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            known, first, last = (batch.column(c).to_pylist() for c in ("places", "first", "last"))
            gone = [[] for _ in texts]
            for t, lo, n, trigger, _ in phrases(texts, length, core):
                on = np.flatnonzero(shared(trigger))
                for i in np.split(on, np.flatnonzero(t[on][1:] != t[on][:-1]) + 1):
                    if len(i):
                        k = int(t[i[0]])
                        out = i[~np.isin(lo[i] << 8 | n[i], np.asarray(known[k] or [], np.int64))]
                        gone[k] += zip(lo[out].tolist(), (lo[out] + n[out] - 1).tolist())
            spans, kept = [], []
            for k, text in enumerate(texts):
                got = _union([*gone[k], *zip(first[k] or [], last[k] or [])], length)
                spans.append([{"start": a, "end": b} for a, b in got])
                at, parts = 0, []
                for a, b in got:
                    parts.append(text[at:a])
                    at = b
                kept.append(b"".join([*parts, text[at:]]))
            if as_text:
                null = batch.column("text").is_null().to_pylist()
                kept = [None if x else k.decode("utf-8", "ignore") for x, k in zip(null, kept)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.string() if as_text else pa.binary()), *(batch.column(n) for n in carried.values())],
                names=["doc_id", "n_bytes", "spans", "kept", *carried.values()])
    kinds = dict(full.dtypes)
    schema = ", ".join(["doc_id long, n_bytes long, spans array<struct<start: long, end: long>>", "kept " + ("string" if as_text else "binary"),
                        *(f"{n} {kinds[n]}" for n in carried.values())])
    return whole.select("doc_id", "text", "places", "first", "last", *carried.values()).mapInArrow(returning(cut, "text"), schema).withColumnsRenamed(
        {n: c for c, n in carried.items()})


_NULL = np.iinfo(np.int64).min


def _columns(rows):
    trigger, doc, twin, place, deals, data, _ = zip(*rows)
    doc = np.asarray([_NULL if d is None else d for d in doc], np.int64)
    return np.asarray(trigger, np.int64), doc, np.asarray(twin, np.int64), np.asarray(place, np.int64), np.asarray(deals, np.int64), list(data)


def _codes(data, entry, start, length):
    import xxhash
    return np.asarray([xxhash.xxh3_64_intdigest(data[e][s:s + length]) for e, s in zip(entry.tolist(), start.tolist())], np.uint64).view(np.int64)


def _union(strings, length):
    """Byte ranges covered by the strings that start in the given ranges."""
    out: list[list[int]] = []
    for a, b in sorted(strings):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return out
