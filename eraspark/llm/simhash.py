"""Document fingerprints: SimHash over word shingles, and Hamming search.

Every 5-word shingle of a text (each occurrence counts, so a shingle's weight
is its frequency) votes on 128 bits: for each set bit of its hash +1, for each
clear bit -1; the sign of the sum is the fingerprint's bit.

The votes are counted in Spark's own aggregation. A hash is cut into 16 longs
by a shift and a mask that leaves every 16th bit, so one long sums four bits'
votes in 16-bit lanes; a text is counted in runs of 65,535 shingles, which
keeps the lanes from overflowing, and the runs of a text are added up after.

The search follows the pigeonhole rule: of n blocks of two fingerprints within
the radius, one differs in at most radius div n bits. There is one table for
each block, in which that block leads; a query looks up its own leading block
and those that differ from it in so few bits, which is an equi-join on (table,
leading block), checked in full within the join.

The radius follows from a similarity of 0.8: two texts of equal length whose
shingle sets have the Jaccard similarity J differ in 128 acos(2J / (1 + J)) / pi
bits in the mean, 19.4 at 0.8 with a standard deviation of 4.1. 26 is the least
radius that finds 95 of 100 such pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SHINGLE = 5
BITS = 128
LANES = 16
RUN = (1 << 16) - 1
MASK = 0x0001000100010001
RADIUS = 26
# Up to this radius blocks are equal; beyond, they would be too short to tell
# fingerprints apart, so longer ones may differ in FLIPS bits.
EQUAL_RADIUS, FLIPS = 7, 2


def terms(text: str, words: int = SHINGLE) -> Column:
    """Hash of each shingle of a column of word hashes, in order; a text of fewer words
    has its whole sequence as the one shingle, a blank one none."""
    return F.expr(f"""
        case when size({text}) = 0 then array()
             when size({text}) < {words} then array(xxhash64({text}))
             else transform(sequence(0, size({text}) - {words}), i -> xxhash64({', '.join(f'{text}[i + {j}]' for j in range(words))}))
        end""")


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """``keys``, n_terms and the fingerprint as two longs (hi, lo), one row
    for each distinct value of ``keys`` (rows that share it must share the
    text). Null or blank texts have no terms and the fingerprint 0. Words are
    runs of characters other than ASCII white space. If ``df`` is already
    partitioned by some of ``keys``, nothing is shuffled."""
    hashed = (df.select(*keys, F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t-\r]+"), "").alias("_w"))
              .select(*keys, F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
              .select(*keys, terms("_h", words).alias("_t")))
    rows = (hashed.select(*keys, F.posexplode_outer("_t").alias("_pos", "_term"))
            .select(*keys, F.expr(f"_pos div {RUN}").alias("_run"), F.col("_term").isNotNull().cast("long").alias("_one"),
                    F.coalesce("_term", F.lit(0).cast("long")).alias("_a")))
    rows = rows.withColumn("_b", F.when(F.col("_one") == 1, F.xxhash64("_a", F.lit(1))).otherwise(F.lit(0).cast("long")))
    votes = [F.expr(f"sum(shiftrightunsigned({h}, {i}) & {MASK}L)").alias(f"_{h}{i}") for h in ("_a", "_b") for i in range(LANES)]
    runs = rows.groupBy(*keys, "_run").agg(F.sum("_one").alias("_n"), *votes)
    lanes = lambda h: F.array(*(F.col(f"_{h}{i}") for i in range(LANES))).alias(h)
    runs = runs.select(*keys, "_n", lanes("_a"), lanes("_b"))
    texts = runs.groupBy(*keys).agg(F.collect_list(F.struct("_n", "_a", "_b")).alias("_r"))
    texts = texts.withColumn("n_terms", F.expr("aggregate(_r, 0L, (s, r) -> s + r._n)"))
    # Bit j of a hash sits in lane j div 16 of the long for shift j mod 16.
    ones = f"aggregate(_r, 0L, (s, r) -> s + (shiftrightunsigned(r.%s[j % {LANES}], 16 * cast(j div {LANES} as int)) & {RUN}L))".replace("% 16", "%% 16")
    bits = lambda h: F.expr(f"aggregate(sequence(0, 63), 0L, (f, j) -> f | shiftleft(if(2 * {ones % h} > n_terms, 1L, 0L), j))")
    return texts.select(*keys, "n_terms", bits("_a").alias("hi"), bits("_b").alias("lo"))


def as_hex(hi: str = "hi", lo: str = "lo") -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(F.col(c))), 16, "0") for c in (hi, lo)))


def differing(a_hi, a_lo, b_hi, b_lo) -> Column:
    """Bits in which two fingerprints differ."""
    return (F.bit_count(F.col(a_hi).bitwiseXOR(F.col(b_hi))) + F.bit_count(F.col(a_lo).bitwiseXOR(F.col(b_lo)))).cast("int")


def likeness(a_hi, a_lo, b_hi, b_lo) -> Column:
    return F.lit(1.0) - differing(a_hi, a_lo, b_hi, b_lo) / F.lit(float(BITS))


def _cuts(n: int) -> list[tuple[int, int]]:
    """Start and end bit (from the highest) of n blocks of nearly equal width."""
    cuts = [BITS * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def _blocks(hi: str, lo: str, n: int) -> list[Column]:
    """Each of the fingerprint's n blocks as a long: its bits, or a hash if it has more than 63."""
    text = F.concat(*(F.lpad(F.conv(F.hex(F.col(c)), 16, 2), 64, "0") for c in (hi, lo)))
    bits = [(F.substring(text, a + 1, b - a), b - a) for a, b in _cuts(n)]
    return [F.conv(x, 2, 10).cast("long") if width < 64 else F.xxhash64(x) for x, width in bits]


def _masks(a: int, b: int) -> tuple[int, int]:
    """The two signed longs whose set bits are the bits a to b - 1 of a fingerprint."""
    mask = ((1 << (b - a)) - 1) << (BITS - b)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (mask >> 64, mask & ((1 << 64) - 1)))


def within(fingerprints_: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All (q_hi, q_lo, hi, lo, distance) with a distance of at most
    ``radius``, from the distinct fingerprints (hi, lo) of both tables; each
    pair comes once, from the first block on which it nearly agrees. Repeated
    rows count once, other columns are ignored, and where either table is empty
    there are no pairs."""
    flips = 0 if radius <= EQUAL_RADIUS else FLIPS
    n = radius // (flips + 1) + 1
    cuts = _cuts(n)

    def tables(df):
        d = df.select("hi", "lo").distinct()
        return d.select("hi", "lo", F.array(*_blocks("hi", "lo", n)).alias("blocks"))

    def near(i):
        """The blocks that differ from block i in at most ``flips`` bits."""
        width = cuts[i][1] - cuts[i][0]
        changes = [sum(1 << j for j in bits) for k in range(flips + 1) for bits in combinations(range(width), k)]
        return f"transform(array({', '.join(f'{c}L' for c in changes)}), c -> struct({i} as table, blocks[{i}] ^ c as lead))"
    a = (tables(queries).select("hi", "lo", F.explode(F.expr(f"flatten(array({', '.join(map(near, range(n)))}))")).alias("at"))
         .select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), F.col("at.table").alias("q_table"), F.col("at.lead").alias("q_lead")))
    b = tables(fingerprints_).select("hi", "lo", F.posexplode("blocks").alias("table", "lead"))
    distance = differing("q_hi", "q_lo", "hi", "lo")
    agree = [f"bit_count((q_hi ^ hi) & {h}L) + bit_count((q_lo ^ lo) & {x}L) <= {flips}".replace("-9223372036854775808L", "shiftleft(1L, 63)")
             for h, x in (_masks(*c) for c in cuts)]
    first = F.expr(f"array_position(array({', '.join(agree)}), true) - 1")
    # The lookups are many more than their source's size tells: never broadcast.
    return (a.hint("merge").join(b, (F.col("q_table") == F.col("table")) & (F.col("q_lead") == F.col("lead"))
                   & (distance <= radius) & (first == F.col("table")))
            .select("q_hi", "q_lo", "hi", "lo", distance.alias("distance")))


def ranked(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, n_chars, r): 0-based place of each row by ascending id
    (null first; rows of one id by their text's hash), from a range-partitioned
    sort: places within a partition plus the rows of the partitions before."""
    keys = [F.col("doc_id").asc_nulls_first(), F.col("twin")]
    placed = (docs.select("doc_id", "twin", F.length("text").cast("long").alias("n_chars"))
              .repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    placed = materialize(placed, keep_partitioning=False)
    part = F.shiftrightunsigned("at", 33)
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not total:
        return placed.select("doc_id", "twin", "n_chars", F.lit(0).cast("long").alias("r"), F.lit(1).cast("long").alias("total"))
    base = F.element_at(F.create_map(*(F.lit(x).cast("long") for p in before.items() for x in p)), part)
    return placed.select("doc_id", "twin", "n_chars", (base + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("r"),
                         F.lit(total).cast("long").alias("total"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, twin, r (its place by id), n_chars, text, and the text
    with its last floor(n/4) code points replaced by the first as many (or
    all) of the next row's, after the last the first row's. Null text counts
    as empty."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    unique = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").limit(1).count() == 0
    docs = docs.withColumn("twin", F.lit(0).cast("long") if unique else F.xxhash64("text"))
    place = ranked(docs)
    texts = docs if unique else docs.dropDuplicates(["doc_id", "twin"])
    # What each row lends: for the row before it, that row's cut.
    lender = place.select(F.col("r").alias("to"), F.col("doc_id").alias("s_doc"), F.col("twin").alias("s_twin"))
    loans = (place.select(F.expr("(r + 1) % total").alias("to"), "doc_id", "twin", "r", F.expr("n_chars div 4").alias("cut")).join(lender, "to")
             .groupBy("s_doc", "s_twin").agg(F.collect_list(F.struct("doc_id", "twin", "r", "cut")).alias("loans")))
    lent = texts.join(loans.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("twin") == F.col("s_twin")))
    heads = (lent.select("text", F.explode("loans").alias("loan"))
             .select(F.col("loan.doc_id").alias("h_doc"), F.col("loan.twin").alias("h_twin"),
                     F.struct("loan.r", F.expr("left(text, cast(loan.cut as int))").alias("head")).alias("head"))
             .groupBy("h_doc", "h_twin").agg(F.collect_list("head").alias("heads")))
    joined = texts.join(heads.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("twin") == F.col("h_twin")))
    n = F.length("text").cast("long")
    return (joined.select("doc_id", "twin", "text", n.alias("n_chars"), F.explode("heads").alias("h"))
            .select("doc_id", "twin", F.col("h.r").alias("r"), "n_chars", "text",
                    F.concat(F.expr("left(text, cast(n_chars - n_chars div 4 as int))"), F.col("h.head")).alias("edited")))
