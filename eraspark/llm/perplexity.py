"""Quality rules: base text rules and an n-gram perplexity band.

The language model is a modified Kneser-Ney model of order 5 over the UTF-8
bytes of the text (case kept; all digits one symbol; runs of one blank or one
punctuation mark as one). Spark gathers the distinct 5-grams of all documents
with the number of documents that hold them; no order, count or size is cut,
so the model grows with the corpus and is never in one place:

* Documents are read once, in blocks of about ``BLOCK_BYTES``. A block is kept
  compressed, beside sorted arrays of its distinct 5-grams, one for each pair
  of symbols before the last (``pair``).
* All 5-grams of a pair meet in one task, which merges the arrays as they
  stream by. Every context of two to four symbols lies within its pair, so the
  orders 3 to 5 follow there. Orders 1 and 2 (at most 256**2 numbers) and the
  discounts are summed over the pairs.
* The pair's task answers the blocks that asked for its 5-grams, and a block's
  answers meet the block again for scoring.

A document is scored without its own counts: a 5-gram that n documents hold
has the probability of n - 1, so one that no other document holds falls back
to the shorter context. Lower orders count distinct left neighbours, the
document's own included.

The verdict on a document is its language's band: within each language (the
``lang`` value, null being its own class) the median of the documents' bits
per symbol, and ``WIDTH`` robust standard deviations (1.4826 times the median
absolute deviation, which of a normal distribution is the standard deviation)
to both sides, those of the language or of all languages, whichever is wider, so
that a language of a few documents has a band too. Documents outside are
rejected, too regular ones below and too irregular ones above.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, materialize_bucketed
from .common import returning, utf8
from .jaccard import word_hashes

ORDER = 5
WIDTH = 4.0
#: Bytes of text in a block (a longer text is a block of its own).
BLOCK_BYTES = 8 << 20
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BLOCKS = "block long, pair int, grams binary, n binary, payload binary"


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Byte to symbol (0 only starts a text), and whether a run of it is one symbol."""
    to = np.arange(256, dtype=np.uint8)
    to[0] = 1
    to[ord("0"):ord("9") + 1] = ord("0")
    to[[9, 11, 12, 13]] = ord(" ")
    once = np.asarray([b < 128 and not chr(b).isalnum() for b in range(256)])
    return to, once


TO_SYMBOL, ONCE = _symbols()


def codes(text: bytes) -> np.ndarray:
    """The 5-gram that ends in each symbol of a text (start symbols go before
    it): symbols 3 and 4 in the high bits, then 1, 2 and 5, eight bits each."""
    s = TO_SYMBOL[np.frombuffer(text, np.uint8)]
    if len(s):
        s = s[np.concatenate([[True], (s[1:] != s[:-1]) | ~ONCE[s[1:]]])]
    s = np.concatenate([np.zeros(ORDER - 1, np.uint8), s]).astype(np.int64)
    n = len(s) - ORDER + 1
    code = np.zeros(n, np.int64)
    for j in (2, 3, 0, 1, 4):
        code = code << 8 | s[j:n + j]
    return code


def merge(codes_: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of several arrays, and the sums of their counts."""
    if not codes_:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, at = np.unique(np.concatenate(codes_), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)


def document_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of the texts, and how many texts hold each."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(codes(t)) for t in texts)]), return_counts=True)


def lower_orders(grams: np.ndarray) -> tuple:
    """From a pair's 5-grams (symbols 1, 2, 5): its 4-grams (2, 5) and its
    3-grams (5), each with the number of distinct left neighbours."""
    four, n4 = np.unique(grams & 0xFFFF, return_counts=True)
    three, n3 = np.unique(four & 0xFF, return_counts=True)
    return four, n4, three, n3


def discounts(kinds) -> np.ndarray:
    """0, D1, D2, D3+ of modified Kneser-Ney from the numbers of n-grams that
    occur once, twice, three and four times."""
    c = [int(x) for x in kinds]
    y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
    d = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return np.asarray([0.0, *(min(max(x, 0.0), k) for k, x in zip((1, 2, 3), d))])


def kinds_of(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in range(1, 5)]


def _interpolated(context: np.ndarray, n: np.ndarray, d: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """P of n-grams sorted by context, ``rest`` being P in the shorter context."""
    _, at = np.unique(context, return_inverse=True)
    total = np.bincount(at, weights=n)[at]
    held = np.bincount(at, weights=d[np.minimum(n, 3)])[at]
    return (n - d[np.minimum(n, 3)]) / total + held / total * rest


class Shared:
    """What all pairs share: P of orders 1 and 2 as tables, discounts of the
    orders 3 to 5. ``pairs[a, b]`` is the number of distinct left neighbours
    of the symbols a, b; ``kinds`` the numbers of 3-, 4- and 5-grams that
    occur one to four times."""

    def __init__(self, pairs: np.ndarray, kinds: dict[int, list[int]]):
        self.discounts = {k: discounts(v) for k, v in kinds.items()}
        a, b = np.nonzero(pairs)
        n1 = np.count_nonzero(pairs, axis=0)
        last = np.flatnonzero(n1)
        one = np.zeros(256)
        if len(last):
            one[last] = _interpolated(np.zeros(len(last)), n1[last], discounts(kinds_of(n1[last])), np.full(len(last), 1 / 256))
        self.two = np.zeros((256, 256))
        if len(a):
            self.two[a, b] = _interpolated(a, pairs[a, b], discounts(kinds_of(pairs[a, b])), one[b])

    def log2(self, pair: int, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log2 P of the last symbol for all 5-grams of a pair, each as one
        of the n documents that hold it sees it: without its own."""
        four, n4, three, n3 = lower_orders(grams)
        p3 = _interpolated(np.zeros(len(three)), n3, self.discounts[3], self.two[pair & 0xFF, three])
        p4 = _interpolated(four >> 8, n4, self.discounts[4], p3[np.searchsorted(three, four & 0xFF)])
        rest = p4[np.searchsorted(four, grams & 0xFFFF)]
        _, at = np.unique(grams >> 8, return_inverse=True)
        d = self.discounts[5]
        kept, cut = d[np.minimum(n, 3)], d[np.minimum(n - 1, 3)]
        total = np.bincount(at, weights=n)[at] - 1
        held = np.bincount(at, weights=kept)[at] - kept + cut
        return np.log2(np.where(total > 0, (n - 1 - cut + held * rest) / np.maximum(total, 1), rest))


def base_rules(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = word_hashes(text)
    chars = len(text) - sum(text.count(b) for b in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    if not text.isascii():
        chars -= int((np.frombuffer(text, np.uint8) & 0xC0 == 0x80).sum())
    symbols = sum(text.count(c.encode()) for c in SYMBOLS[1:-1])
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(b" \t\v\f\r"):
            seen.add(line)
    repeat = 0
    if (n := len(words) - WINDOW + 1) > 1:
        h = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            h = (h ^ words[j:n + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if same.any():
            again = np.zeros(n, bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            steps = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(steps, at, 1)
            np.add.at(steps, at + WINDOW, -1)
            repeat = int((np.cumsum(steps) > 0).sum())
    return len(words), chars, symbols, dup, repeat


def blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of two kinds: a block (pair -1) with its documents and their base
    figures as a compressed Arrow stream, and one row for each pair in it, with
    the sorted 5-grams (symbols 1, 2, 5) and the documents that hold each."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        for seq, part in enumerate(_gathered(batches)):
            texts = utf8(part.column(text_col))
            rules = [base_rules(t) for t in texts]
            for k, c in enumerate(FIGURES):
                part = part.append_column(c, pa.array([r[k] for r in rules], pa.int64()))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_table(part)
            code, n = document_counts(texts)
            pair, lo = np.unique(code >> 24, return_index=True)
            hi = np.append(lo[1:], len(code))
            grams, n = (code & 0xFFFFFF).astype("<u4"), n.astype("<u4")
            columns = [[first + seq] * (len(pair) + 1), [-1, *pair.tolist()],
                       [None, *(grams[i:j].tobytes() for i, j in zip(lo, hi))],
                       [None, *(n[i:j].tobytes() for i, j in zip(lo, hi))],
                       [sink.getvalue().to_pybytes(), *[None] * len(pair)]]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             names=["block", "pair", "grams", "n", "payload"])

    def _gathered(batches):
        """Tables of about BLOCK_BYTES of text."""
        import pyarrow.compute as pc
        held, size = [], 0
        for part in batches:
            now = pc.sum(pc.binary_length(part.column(text_col))).as_py() or 0
            if held and size + now > BLOCK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += now
        if held:
            yield pa.Table.from_batches(held)
    return docs.mapInArrow(returning(run, text_col), _BLOCKS)


def _ints(b) -> np.ndarray:
    return np.frombuffer(b, "<u4").astype(np.int64)


def model(asked: DataFrame) -> DataFrame:
    """(pair, grams, n, last, kinds) of all blocks' rows: the sorted 5-grams of
    a pair with the documents that hold them, its distinct last symbols, and
    how many of its 3-, 4- and 5-grams occur one to four times. A task holds
    the distinct 5-grams of one pair."""
    import pyarrow as pa

    def run(batches):
        names = ["pair", "grams", "n", "last", "kinds"]

        def row(pair, grams, n):
            four, n4, three, n3 = lower_orders(grams)
            return pa.RecordBatch.from_arrays(
                [pa.array([pair], pa.int32()), pa.array([grams.astype("<u4").tobytes()]), pa.array([n.astype("<i8").tobytes()]),
                 pa.array([three.tolist()], pa.list_(pa.int32())), pa.array([kinds_of(n3) + kinds_of(n4) + kinds_of(n)], pa.list_(pa.int64()))],
                names=names)
        now, grams, n, size = None, [], [], 0
        for batch in batches:
            for pair, g, c in zip(*(batch.column(x).to_pylist() for x in ("pair", "grams", "n"))):
                if pair != now:
                    if now is not None:
                        yield row(now, *merge(grams, n))
                    now, grams, n, size = pair, [], [], 0
                grams.append(_ints(g))
                n.append(_ints(c))
                size += len(grams[-1])
                if len(grams) > 1 and size > 2 * len(grams[0]) + (1 << 16):
                    grams, n = ([x] for x in merge(grams, n))
                    size = len(grams[0])
        if now is not None:
            yield row(now, *merge(grams, n))
    return (asked.select("pair", "grams", "n").repartition("pair").sortWithinPartitions("pair")
            .mapInArrow(run, "pair int, grams binary, n binary, last array<int>, kinds array<long>"))


def shared(pairs: DataFrame) -> Shared:
    """The tables that all pairs need, from the rows of :func:`model`: at most
    256 * 256 numbers and twelve sums reach the driver."""
    table = np.zeros((256, 256), np.int64)
    for r in (pairs.select((F.col("pair") % 256).alias("a"), F.explode("last").alias("b"))
              .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()):
        table[r.a, r.b] = r.n
    sums = pairs.agg(*(F.sum(F.col("kinds")[i]) for i in range(12))).first()
    return Shared(table, {k: [x or 0 for x in sums[4 * i:4 * i + 4]] for i, k in enumerate((3, 4, 5))})


def answers(pairs: DataFrame, asked: DataFrame, common: Shared) -> DataFrame:
    """(block, pair, logp): the log2 probabilities of the 5-grams that a block
    asked for, in its order."""
    import pyarrow as pa
    held = asked.sparkSession.sparkContext.broadcast(common)      # 256 * 256 numbers
    rows = (pairs.select(F.lit(-1).cast("long").alias("block"), "pair", "grams", "n")
            .unionByName(asked.select("block", "pair", "grams", F.lit(None).cast("binary").alias("n")))
            .repartition("pair").sortWithinPartitions("pair", "block"))

    def run(batches):
        known = logp = None
        for batch in batches:
            out = []
            for block, pair, g, c in zip(*(batch.column(x).to_pylist() for x in ("block", "pair", "grams", "n"))):
                g = _ints(g)
                if block < 0:
                    known, logp = g, held.value.log2(pair, g, np.frombuffer(c, "<i8")).astype("<f4")
                else:
                    out.append((block, pair, logp[np.searchsorted(known, g)].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))],
                                                 names=["block", "pair", "logp"])
    return rows.mapInArrow(run, "block long, pair int, logp binary")


def score(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the base figures, base_failed, and bits
    (mean negative log2 probability of a symbol; null for texts without one)."""
    import pyarrow as pa
    docs = docs.drop(*FIGURES, "bits", "base_failed", "kept")
    # Bucketed by block, so that the documents stay where they are and only
    # the answers are shuffled to them.
    table = materialize_bucketed(blocks(docs, text_col), "block")
    asked = table.filter("pair >= 0").select("block", "pair", "grams", "n")
    pairs = materialize(model(asked), keep_partitioning=False)
    replies = (answers(pairs, asked, shared(pairs)).groupBy("block")
               .agg(F.sort_array(F.collect_list(F.struct("pair", "logp"))).getField("logp").alias("logp")))
    rows = table.filter("pair < 0").select("block", "payload").join(replies.hint("merge"), "block", "left").select("payload", "logp")
    schema = T.StructType([f for f in docs.schema if f.name != text_col]
                          + [T.StructField(c, T.LongType()) for c in FIGURES] + [T.StructField("bits", T.DoubleType())])

    def scored(payload, logp):
        part = pa.ipc.open_stream(payload).read_all().combine_chunks()
        found = [np.unique(codes(t), return_counts=True) for t in utf8(part.column(text_col))]
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *(c for c, _ in found)]))
        logp = np.frombuffer(b"".join(logp), "<f4").astype(np.float64)
        bits = [-(logp[np.searchsorted(known, c)] * n).sum() / n.sum() if len(c) else None for c, n in found]
        yield from part.drop_columns([text_col]).append_column("bits", pa.array(bits, pa.float64())).to_batches()

    def run(batches):
        for batch in batches:
            for payload, logp in zip(batch.column("payload"), batch.column("logp")):
                yield from scored(payload.as_py(), logp.as_py() or [])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(returning(run, "payload"), schema).withColumn("base_failed", failed)


def bands(scored: DataFrame, lang_col: str = "lang", width: float = WIDTH) -> DataFrame:
    """(lang, lower, upper): each language's band of bits per symbol, from all
    its documents that pass the base rules."""
    rows = scored.filter("not base_failed and bits is not null").select(F.col(lang_col).alias("_l"), "bits")
    middle = rows.groupBy("_l").agg(F.percentile_approx("bits", 0.5, 10_000).alias("middle"))
    apart = F.abs(F.col("bits") - F.col("middle"))
    # One row for each language value.
    near = (rows.join(middle.withColumnRenamed("_l", "_m"), F.col("_l").eqNullSafe(F.col("_m")))
            .select("_l", "middle", apart.alias("apart")))
    own = near.groupBy("_l", "middle").agg(F.percentile_approx("apart", 0.5, 10_000).alias("own"))
    every = near.agg(F.percentile_approx("apart", 0.5, 10_000).alias("every")).first().every or 0.0
    half = F.lit(width * 1.4826) * F.greatest(F.col("own"), F.lit(every))
    return own.select(F.col("_l").alias(lang_col), (F.col("middle") - half).alias("lower"), (F.col("middle") + half).alias("upper"))


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without its text: base figures, base_failed, bits, and kept
    (base rules passed and bits within the language's band). Null text counts
    as empty, and fails. A null language has a band of its own. Repeated rows
    get equal results; each is evidence for the others. An empty table gives no
    rows."""
    scored = materialize(score(docs, text_col), keep_partitioning=False)
    limits = bands(scored, lang_col).withColumnRenamed(lang_col, "_l")
    inside = F.coalesce(F.col("bits").between(F.col("lower"), F.col("upper")), F.lit(False))
    return (scored.join(limits, F.col(lang_col).eqNullSafe(F.col("_l")), "left")
            .withColumn("kept", ~F.col("base_failed") & inside).drop("_l", "lower", "upper"))
