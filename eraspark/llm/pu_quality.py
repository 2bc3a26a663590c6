"""Quality classifier from positive and unlabelled texts.

Trusted positives are texts labelled good; everything else, whatever it is,
is unlabelled. With p the share of good texts among all (the class prior), the
risk of a scorer z is estimated without negatives,

    R = p E_pos[loss(z, +)] + max(0, E_all[loss(z, -)] - p E_pos[loss(z, -)]),

where the second term, the risk on the unseen negatives, may not go below
zero: when an estimate does, the step goes the other way for that term
(non-negative PU learning). The loss is logistic, the scorer additive: each
text statistic is cut at its corpus quantiles, and a bin has a weight.

The prior is estimated first: a scorer that tells positives from all texts
ranks good texts high, and the share of all texts above a threshold over the
share of positives above it is p plus what negatives are left there; its least
value over the thresholds that keep ``KEEP`` of the positives is the estimate.
That scorer learns from one half of the rows (by the hash of their statistics)
and is read on the other, where it has not seen the positives.

The weights are the mean of the later steps, whose rate falls to zero.
Nothing is sampled: statistics, quantiles, prior and every gradient are sums
over all rows that Spark computes and adds up; the driver sees one number for
each weight. Sums are added as integers, whatever the order in which tasks end;
the quantiles are Spark's approximate ones, which may differ a little with that
order once a statistic has more distinct values than their accuracy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices, utf8
from .jaccard import word_hashes
from .perplexity import base_rules

BINS = 16
WARM_STEPS = 20
STEPS = 60
RATE = 0.25
SHRINK = 1e-2
KEEP = 0.7
SCALE = 1 << 20

_KINDS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n",
                             b".,;:'\"-()?", b"!", b"|", b"#*$%&<>", b"@/\\=_+~^`[]{}"), start=1):
    _KINDS[list(_chars)] = _k
_KINDS[128:] = 11
_N_KINDS = 12


def statistics(text: bytes) -> list[float]:
    """The text's statistics; all 0 for the empty text."""
    data = np.frombuffer(text, np.uint8)
    n = max(len(data), 1)
    kinds = np.bincount(_KINDS[data], minlength=_N_KINDS)
    letters = max(int(kinds[1] + kinds[2] + kinds[11]), 1)
    n_words, chars, symbols, dup, repeat = base_rules(text)
    w = word_hashes(text)
    m = max(n_words, 1)
    _, counts = np.unique(w, return_counts=True)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ((data != 32) & ((data < 9) | (data > 13))).view(np.int8), [0]])))
    sizes = edges[1::2] - edges[::2]
    lines = text.count(b"\n") + 1
    return [float(x) for x in (
        np.log1p(n_words), kinds[2] / letters, kinds[3] / n, kinds[6] / n, kinds[7] / m, kinds[8] / m, symbols / m, kinds[10] / n, kinds[11] / n,
        chars / m, sizes.std() if n_words else 0, (sizes <= 3).sum() / m, (sizes >= 10).sum() / m,
        len(counts) / m, counts.max() / m if n_words else 0, (w[1:] == w[:-1]).sum() / m, repeat / m, dup / lines, np.log1p(n_words / lines),
        (counts == 1).sum() / m, kinds[0] / n, kinds[9] / n)]


N_STATISTICS = len(statistics(b""))


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with its text replaced by ``stats`` (array of double)."""
    import pyarrow as pa
    others = [c for c in docs.columns if c not in (text_col, "stats")]
    schema = docs.select(*others).withColumn("stats", F.array(F.lit(0.0))).schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                stats = [statistics(t) for t in utf8(part.column(text_col))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(stats, pa.list_(pa.float64()))], names=[*others, "stats"])
    return docs.mapInArrow(run, schema)


def binned(rows: DataFrame) -> DataFrame:
    """``stats`` cut at the quantiles of all rows: ``bins``, one byte each."""
    import pyarrow as pa
    share = [k / BINS for k in range(1, BINS)]
    cuts = rows.agg(*(F.percentile_approx(F.col("stats")[i], share, 10_000).alias(f"c{i}") for i in range(N_STATISTICS))).first()
    cuts = [np.unique(np.asarray(c if c is not None else [], float)) for c in cuts]
    others = [c for c in rows.columns if c not in ("stats", "bins")]
    schema = rows.select(*others).withColumn("bins", F.lit(b"")).schema

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("stats").flatten()).reshape(-1, N_STATISTICS)
            cut = np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([r.tobytes() for r in cut], pa.binary())], names=[*others, "bins"])
    return rows.mapInArrow(run, schema)


def _z(weights: np.ndarray, batch) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a batch's rows, and their flat weight indices."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, N_STATISTICS)
    at = bins.astype(np.int64) + np.arange(N_STATISTICS) * BINS
    return weights[-1] + weights[at].sum(1), at


def _summed(rows: DataFrame, weights: np.ndarray, of) -> np.ndarray:
    """Sum of ``of(z, indices, positive)`` (an array) over all rows."""
    import pyarrow as pa
    size = len(of(np.zeros(0), np.zeros((0, N_STATISTICS), np.int64), np.zeros(0, bool)))

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z, at = _z(weights, batch)
                total += of(z, at, batch.column("positive").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(np.rint(total * SCALE).astype(np.int64))], names=["k", "v"])
    out = np.zeros(size)
    for r in rows.select("bins", "positive").mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v / SCALE
    return out


def _gradients(z, at, positive):
    """For all rows and for positives: count, losses and gradients of both signs."""
    def sums(some, slope):
        g = np.bincount(at[some].ravel(), weights=np.repeat(slope[some], N_STATISTICS), minlength=BINS * N_STATISTICS)
        return [g, [slope[some].sum()]]
    up = 1 / (1 + np.exp(-np.clip(z, -30, 30)))              # slope of loss(z, -); of loss(z, +) it is up - 1
    everyone = np.ones(len(z), bool)
    minus, plus = np.logaddexp(0, z), np.logaddexp(0, -z)
    head = [len(z), minus.sum(), positive.sum(), minus[positive].sum(), plus[positive].sum()]
    return np.concatenate([head, *sums(everyone, up), *sums(positive, up), *sums(positive, up - 1)])


class _Adam:
    def __init__(self, size):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0

    def step(self, weights, gradient, rate=RATE):
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.99 * self.v + 0.01 * gradient ** 2
        return weights - rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.99 ** self.t)) + 1e-8)


def risk_gradient(sums: np.ndarray, weights: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Non-negative risk and its step direction from the sums of a pass."""
    size = len(weights)
    n, minus_all, n_pos, minus_pos, plus_pos = sums[:5]
    g_all, g_minus, g_plus = (sums[5 + k * size:5 + (k + 1) * size] for k in range(3))
    negative = minus_all / n - prior * minus_pos / n_pos
    down = g_all / n - prior * g_minus / n_pos
    if negative < 0:
        return prior * plus_pos / n_pos, -down
    return prior * plus_pos / n_pos + negative, prior * g_plus / n_pos + down


def estimate_prior(rows: DataFrame, weights: np.ndarray) -> float:
    """Least ratio of all texts to positives above a score threshold (0.5 if
    there are no positives)."""
    def histogram(z, at, positive):
        place = np.clip((1 / (1 + np.exp(-np.clip(z, -30, 30))) * 400).astype(int), 0, 399)
        return np.concatenate([np.bincount(place, minlength=400), np.bincount(place[positive], minlength=400)]).astype(float)
    both = _summed(rows, weights, histogram)
    if not both[400:].sum():
        return 0.5
    every, good = (np.cumsum(both[k:k + 400][::-1]) / both[k:k + 400].sum() for k in (0, 400))
    use = good >= KEEP
    return float(np.clip((every[use] / good[use]).min(), 0.05, 0.99))


def fit(rows: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights and class prior from rows (bins, positive); None without positives."""
    size = BINS * N_STATISTICS + 1
    half = F.pmod(F.xxhash64("bins"), F.lit(2))
    weights, adam = np.zeros(size), _Adam(size)
    for _ in range(WARM_STEPS):                          # positives against all
        sums = _summed(rows.filter(half == 0), weights, _gradients)
        if not sums[2]:
            break
        g_all, g_plus = sums[5:5 + size], sums[5 + 2 * size:]
        weights = adam.step(weights, g_all / sums[0] + g_plus / sums[2] + SHRINK * weights)
    prior = estimate_prior(rows.filter(half == 1), weights)
    weights, mean, adam = np.zeros(size), np.zeros(size), _Adam(size)
    for t in range(STEPS):
        sums = _summed(rows, weights, _gradients)
        if not sums[2]:
            return None
        step = risk_gradient(sums, weights, prior)[1] + SHRINK * weights
        weights = adam.step(weights, step, RATE * (1 - t / STEPS))
        mean += weights * (t >= STEPS // 2) / (STEPS - STEPS // 2)
    return mean, prior


def classify(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without its text: score (0 to 1, higher for good texts) and
    predicted (1 from ``threshold`` on). ``positives``: ids of trusted good
    texts; ids that ``docs`` lacks, and nulls, are ignored. Null text counts as
    empty and is scored like any other. Without a positive every score is 0.5.
    Repeated rows get equal scores. An empty table gives no rows."""
    import pyarrow as pa
    docs = docs.drop("stats", "bins", "positive", "score", "predicted")
    rows = materialize(measured(docs, text_col), keep_partitioning=False)
    good = positives.select(F.col(id_col).alias("_good")).filter("_good is not null").distinct()
    rows = (rows.join(good, F.col(id_col) == F.col("_good"), "left")
            .withColumn("positive", F.col("_good").isNotNull()).drop("_good"))
    rows = materialize(binned(rows), keep_partitioning=False)
    found = fit(rows)
    if found is None:
        return rows.drop("bins", "positive").withColumns({"score": F.lit(0.5), "predicted": (F.lit(0.5) >= threshold).cast("int")})
    weights = found[0]
    others = [c for c in rows.columns if c not in ("bins", "positive")]
    schema = rows.select(*others).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            z, _ = _z(weights, batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*others, "score"])
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
