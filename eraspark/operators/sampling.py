"""Sampling and splitting with exact sizes.

Row picks use the order "smallest md5('seed|id') first", which is
independent of partitioning (``rand(seed)`` is not) and can be computed by
any engine. Sizes and class balance follow the reference's rules exactly;
which rows are picked cannot match a seeded NumPy generator and does not
try to. All ranks come from :func:`exact_rank` (no single-partition sort);
quota tables hold one row per class and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import sha_order
from .ranking import exact_rank, hex_bucket


def hash_key(df: DataFrame, key: str = "id", seed: int = fixed.SEED, out: str = "_h") -> DataFrame:
    return df.withColumn(out, sha_order(seed, F.col(key)))


def rank_in_class(df: DataFrame, cls: str | None, key: str = "id", seed: int = fixed.SEED,
                  rank_col: str = "k", limit=None, n_classes_hint: int | None = 64,
                  digits: int = 4) -> DataFrame:
    """k = 1.. within each class in md5 order (ties by key)."""
    h = hash_key(df, key, seed)
    parts = [cls] if cls else []
    r = exact_rank(h, [F.col("_h"), F.col(key)], hex_bucket("_h", digits), parts,
                   rank_col, n_groups_hint=n_classes_hint, n_buckets_hint=16 ** digits,
                   limit=limit)
    return r.drop("_h")


# ---------------------------------------------------------------- caps
def undersample_cap(df: DataFrame, cls: str, cap: int = fixed.CLASS_CAP,
                    key: str = "id", seed: int = fixed.SEED) -> DataFrame:
    """At most ``cap`` rows per class, without replacement."""
    return rank_in_class(df, cls, key, seed, "_k", limit=cap).drop("_k")


def sample_n(df: DataFrame, n: int, key: str = "id", seed: int = fixed.SEED) -> DataFrame:
    """n rows without replacement (the n smallest hash keys). 4 hex digits
    of bucket keep the boundary bucket small at any scale."""
    return rank_in_class(df, None, key, seed, "sample_rank", limit=n, digits=4)


def shuffle_rows(df: DataFrame, key: str = "id", seed: int = fixed.SEED) -> DataFrame:
    """A permutation: position 1..n in hash order."""
    return rank_in_class(df, None, key, seed, "position")


# ---------------------------------------------------------------- splits
def split_sizes(n: Column, test_fraction: float = fixed.SPLIT_TEST_FRACTION):
    """(n_test, n_val): test = ceil(f * n), val = ceil(f * (n - test)), as
    the reference's two chained 10 % splits (float arithmetic kept)."""
    n_test = F.ceil(F.lit(test_fraction) * n)
    n_val = F.ceil(F.lit(test_fraction) * (n - n_test))
    return n_test, n_val


def split_random(df: DataFrame, key: str = "id", seed: int = fixed.SEED) -> DataFrame:
    """Adds ``split`` in {train, val, test}: first ranks are test, then val.
    The row count enters as a scalar subquery (no join)."""
    r = rank_in_class(df, None, key, seed, "_r")
    n_test, n_val = split_sizes(df.select(F.count(F.lit(1))).scalar())
    return _assign(r.withColumn("_nt", n_test).withColumn("_nv", n_val)).drop("_r", "_nt", "_nv")


def _assign(j: DataFrame) -> DataFrame:
    return j.withColumn("split", F.when(F.col("_r") <= F.col("_nt"), "test")
                        .when(F.col("_r") <= F.col("_nt") + F.col("_nv"), "val")
                        .otherwise("train"))


def approximate_mode(counts: DataFrame, cls: str, count_col: str, draws: Column,
                     out: str, by=()) -> DataFrame:
    """Allot ``draws`` over classes in proportion to ``count_col``:
    floor(c / n * draws) each, then one more to the classes with the largest
    remainders (ties: class ascending). ``counts`` has one row per class
    (per ``by`` group), so the windows run over class-sized groups."""
    whole = Window.partitionBy(*by)
    n = F.sum(count_col).over(whole)
    cont = F.col(count_col) / n * draws
    c = counts.withColumn("_cont", cont).withColumn("_fl", F.floor("_cont"))
    c = c.withColumn("_need", draws - F.sum("_fl").over(whole))
    rk = F.row_number().over(Window.partitionBy(*by).orderBy(
        F.desc(F.col("_cont") - F.col("_fl")), F.asc(cls)))
    return (c.withColumn(out, (F.col("_fl") + F.when(rk <= F.col("_need"), 1).otherwise(0)).cast("long"))
            .drop("_cont", "_fl", "_need"))


def split_stratified(df: DataFrame, cls: str, key: str = "id", seed: int = fixed.SEED,
                     by=()) -> DataFrame:
    """Two chained stratified 10 % splits (per ``by`` group): class shares
    kept per split, per-class allotments by largest remainder."""
    by = list(by)
    counts = df.groupBy(*by, cls).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*by)
    counts = counts.withColumn("_ntest_all", F.ceil(F.lit(fixed.SPLIT_TEST_FRACTION)
                                                    * F.sum("_c").over(whole)))
    t = approximate_mode(counts, cls, "_c", F.col("_ntest_all"), "_nt", by)
    t = t.withColumn("_rest", F.col("_c") - F.col("_nt"))
    t = t.withColumn("_nval_all", F.ceil(F.lit(fixed.SPLIT_TEST_FRACTION) * F.sum("_rest").over(whole)))
    t = approximate_mode(t, cls, "_rest", F.col("_nval_all"), "_nv", by)
    quotas = t.select(*by, cls, "_nt", "_nv")
    h = df.withColumn("_h", sha_order(seed, F.concat_ws("|", *[F.col(b).cast("string") for b in by],
                                                         F.col(key).cast("string"))))
    r = exact_rank(h, [F.col("_h"), F.col(key)], hex_bucket("_h"), [*by, cls], "_r",
                   n_groups_hint=64).drop("_h")
    j = r.join(F.broadcast(quotas), [*by, cls], "inner")
    return _assign(j).drop("_r", "_nt", "_nv")


# ---------------------------------------------------------------- one-vs-rest
def explode_targets(df: DataFrame, classes, out: str = "target") -> DataFrame:
    """One copy of each row per target class (a fan-out bounded by the
    number of classes, produced by a Generate rather than a join)."""
    return df.withColumn(out, F.explode(F.array(*[F.lit(c) for c in classes])))


def ovr_balanced(df: DataFrame, cls: str, classes, cap: int = fixed.OVR_NEGATIVE_CAP,
                 key: str = "id", seed: int = fixed.SEED) -> DataFrame:
    """Per target class: every positive plus min(n_pos, cap) negatives drawn
    from all other classes pooled (capped at the pool size, where the
    reference would fail). Returns (*df columns, target, is_target)."""
    counts = df.groupBy(F.col(cls).alias("target")).agg(F.count(F.lit(1)).alias("_np"))
    quota = counts.select("target", F.least("_np", F.lit(cap)).alias("_q"))
    pos = (df.filter(F.col(cls).isin(*classes)).withColumn("target", F.col(cls))
           .withColumn("is_target", F.lit(1)))
    pool = explode_targets(df, classes).filter(
        F.col(cls).isNull() | (F.col(cls) != F.col("target")))
    pool = pool.join(F.broadcast(quota), "target", "inner")
    h = pool.withColumn("_h", sha_order(seed, F.concat_ws("|", "target", F.col(key).cast("string"))))
    neg = exact_rank(h, [F.col("_h"), F.col(key)], hex_bucket("_h"), ["target"], "_k",
                     n_groups_hint=len(classes), limit=F.col("_q"))
    neg = neg.drop("_h", "_k", "_q").withColumn("is_target", F.lit(0))
    return pos.unionByName(neg)


def fair_negative_quotas(sizes: dict[str, int], cap: int = fixed.OVR_NEGATIVE_CAP):
    """Per target: (T, {other: quota}).

    T = min(n_pos, int(mean size of the other classes), their total, cap).
    Negatives are taken by water-filling: rows of the other classes are
    visited in rounds (round k takes the k-th row of every class that still
    has one, classes in ascending order) until T are taken. So every class
    gets min(size, L) for the highest full level L, and the r leftovers go to
    the first r classes (in order) that have more than L rows.
    ``sizes`` has one entry per class (read from a k-row count table)."""
    out = {}
    classes = sorted(sizes)
    for t in classes:
        others = [c for c in classes if c != t]
        if not others:
            continue
        tot = sum(sizes[c] for c in others)
        T = min(sizes[t], int(tot / len(others)), tot, cap)
        if T <= 0:
            continue
        level = 0
        for cand in sorted({sizes[c] for c in others} | {T // len(others)}):
            if sum(min(sizes[c], cand) for c in others) <= T:
                level = max(level, cand)
        # the level may sit between two class sizes: raise it while it fits
        deep = [c for c in others if sizes[c] > level]
        if deep:
            level += (T - sum(min(sizes[c], level) for c in others)) // len(deep)
        q = {c: min(sizes[c], level) for c in others}
        r = T - sum(q.values())
        for c in others:
            if r > 0 and sizes[c] > level:
                q[c] += 1
                r -= 1
        out[t] = (sum(q.values()), q)
    return out


def ovr_fair_negatives(df: DataFrame, cls: str, cap: int = fixed.OVR_NEGATIVE_CAP,
                       key: str = "id", seed: int = fixed.SEED) -> DataFrame:
    """Per target class: T positives and T negatives spread fairly over the
    other classes. Rows are ranked once within their own class (k = 1..); a
    broadcast quota table (target, class, quota), computed from the k class
    counts, keeps rows with k <= quota. Returns (target, *df columns, is_target)."""
    sizes = {r[cls]: r["n"] for r in df.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).collect()
             if r[cls] is not None}
    plan = fair_negative_quotas(sizes, cap)
    rows = []
    for t, (T, q) in plan.items():
        rows.append((t, t, int(T), 1))
        rows.extend((t, c, int(n), 0) for c, n in q.items() if n > 0)
    quotas = df.sparkSession.createDataFrame(
        rows, f"target string, {cls} string, quota long, is_target int")
    max_q = max([r[2] for r in rows], default=0)
    ranked = rank_in_class(df.filter(F.col(cls).isNotNull()), cls, key, seed, "_k", limit=max_q)
    return (ranked.join(F.broadcast(quotas), cls, "inner")
            .filter(F.col("_k") <= F.col("quota")).drop("_k", "quota"))


def ovr_with_replacement(df: DataFrame, cls: str, classes, n: int, key: str = "id",
                         seed: int = fixed.SEED) -> DataFrame:
    """Per class: n positives and n negatives drawn *with* replacement. Returns
    (target, is_target, draw, *df columns); a side without rows has no draws.

    Draws by the inverse of the cumulative class sizes: every row is ranked
    once, within its own class (md5 order). The negatives of a class are the
    other classes one after the other in ascending order, those without a class
    first. Draw j of a side takes place h(seed|class|side|j) modulo the side's
    size, h being the first 15 hex digits of md5; where that lies among the
    cumulative sizes gives the class and the rank in it, on which the draw is
    joined. The sizes are one row a class and collected."""
    spark = df.sparkSession
    labelled = df.withColumn("_cls", F.coalesce(F.col(cls), F.lit(NO_CLASS)))
    sizes = {r["_cls"]: r["n"] for r in labelled.groupBy("_cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    sides = []
    for target in classes:
        for side, members in ((1, [target]), (0, sorted(c for c in sizes if c != target))):
            segments, total = [], 0
            for c in members:
                if sizes.get(c):
                    segments.append((c, total))
                    total += sizes[c]
            if total:
                sides.append((target, side, total, segments))
    schema = "target string, is_target int, _size long, _segments array<struct<c: string, below: long>>"
    draws = (spark.range(1, n + 1).withColumnRenamed("id", "draw")
             .select("draw", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(s).alias("is_target")) for t, s, _, _ in sides])).alias("_s"))
             .select("draw", "_s.*") if sides else spark.createDataFrame([], "draw long, target string, is_target int"))
    draws = draws.join(F.broadcast(spark.createDataFrame(sides, schema)), ["target", "is_target"])       # two rows a class
    at = F.pmod(_hash15(F.lit(str(seed)), F.col("target"), F.col("is_target").cast("string"), F.col("draw").cast("string")), F.col("_size"))
    draws = draws.withColumn("_u", at).withColumn("_seg", F.element_at(F.filter("_segments", lambda s: s["below"] <= F.col("_u")), -1))
    draws = draws.select("target", "is_target", "draw", F.col("_seg.c").alias("_cls"), (F.col("_u") - F.col("_seg.below") + 1).alias("_pos"))
    ranked = rank_in_class(labelled, "_cls", key, seed, "_pos")
    return draws.join(ranked, ["_cls", "_pos"]).drop("_cls", "_pos")


#: Stands for a missing class, before all others.
NO_CLASS = "\0"


def _hash15(*parts) -> Column:
    """The first 15 hex digits of md5('part|part|...') as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def weighted_sample_replace(df: DataFrame, cls: str, n: int | None = None, key: str = "id",
                            seed: int = fixed.SEED) -> DataFrame:
    """n draws (default: as many as rows) with replacement, row weight
    1 / class size (so every class is equally likely): draw j takes the class
    whose number is h(seed|c|j) modulo the classes, in ascending order, and in
    it the rank h(seed|r|j) modulo its size, h as above. Rows without a class
    are never drawn. Every row is ranked once."""
    spark = df.sparkSession
    rows = df.filter(F.col(cls).isNotNull())
    sizes = sorted((r[cls], r["n"]) for r in rows.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(s for _, s in sizes) if n is None else n
    numbered = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(sizes)], f"_ci long, {cls} {df.schema[cls].dataType.simpleString()}, _size long")
    j = F.col("draw").cast("string")
    draws = spark.range(1, n + 1).withColumnRenamed("id", "draw")
    draws = draws.withColumn("_ci", F.pmod(_hash15(F.lit(f"{seed}|c"), j), F.lit(max(1, len(sizes)))))
    draws = draws.join(F.broadcast(numbered), "_ci").withColumn("_pos", F.pmod(_hash15(F.lit(f"{seed}|r"), j), F.col("_size")) + 1)
    return draws.join(rank_in_class(rows, cls, key, seed, "_pos"), [cls, "_pos"]).drop("_pos", "_size", "_ci")
