"""Feed-forward classifier on sparse rows: mini-batch Adam, ReLU, dropout and
early stopping.

An epoch is one Spark job. Every task starts from the broadcast weights, goes
through its rows in mini-batches with Adam, and hands on how its weights changed,
times its rows; the changes are added up by weight row in Spark and their mean is
applied. Of the first layer, which has a row for each feature, a task holds and
changes only the rows of the features in its documents, and a mini-batch touches
only those of its own. After an epoch the loss on the validation rows decides:
without improvement for ``patience`` epochs the fit stops, and the best weights
count. The driver holds the weights twice (``MOST_NUMBERS`` at most).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .newton import rows_of

#: Weights on the driver: 400 MB in single precision.
MOST_NUMBERS = 100_000_000
# Adam's decay rates and guard.
_BETA1, _BETA2, _GUARD = 0.9, 0.999, 1e-7
# Weight rows that a step of Adam handles at once.
_ROWS = 64


def start(sizes, seed: int) -> list[np.ndarray]:
    """[W1, b1, W2, b2, ...] drawn evenly from +-sqrt(6 / (in + out)), biases 0."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(sizes, sizes[1:]):
        edge = np.sqrt(6.0 / (a + b))
        out += [rng.uniform(-edge, edge, (a, b)).astype(np.float32), np.zeros(b, np.float32)]
    return out


def forward(net, docs, masks=None):
    """Activations of all layers for ``docs`` = [(places, values), ...]: the inner
    ones after ReLU and ``masks`` (dropout), the last as log-probabilities."""
    x = np.stack([v @ net[0][p] for p, v in docs]) if docs else np.zeros((0, net[0].shape[1]), np.float32)
    layers, z = [], x + net[1]
    for j in range(2, len(net), 2):
        h = np.maximum(z, 0)
        h = h * masks[j // 2 - 1] if masks is not None else h
        layers.append(h)
        z = h @ net[j] + net[j + 1]
    z = z - z.max(axis=1, keepdims=True) if len(z) else z
    return [*layers, z - np.log(np.exp(z).sum(axis=1, keepdims=True))]


def gradients(net, docs, y, masks=None):
    """(loss, [(touched rows, gradient) of W1, gradient of b1, of W2, ...]) of
    the mean negative log-likelihood; loss is summed."""
    layers = forward(net, docs, masks)
    logp, n = layers[-1], len(docs)
    d = np.exp(logp)
    d[np.arange(n), y] -= 1
    d /= n
    out = []
    for j in range(len(net) - 2, 0, -2):
        h = layers[j // 2 - 1]
        out = [h.T @ d, d.sum(axis=0), *out]
        d = (d @ net[j].T) * (h > 0)
        if masks is not None:
            d = d * masks[j // 2 - 1]
    touched = np.unique(np.concatenate([p for p, _ in docs])) if docs else np.zeros(0, np.int64)
    first = np.zeros((len(touched), net[0].shape[1]), net[0].dtype)
    for i, (p, v) in enumerate(docs):
        first[np.searchsorted(touched, p)] += np.outer(v, d[i])         # a document names a place once
    return -float(logp[np.arange(n), y].sum()), [(touched, first), d.sum(axis=0), *out]


class Adam:
    """Moments of each weight; rows of the first layer move only when touched."""

    def __init__(self, net, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net]

    def step(self, net, grads) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - _BETA2 ** self.t) / (1 - _BETA1 ** self.t)
        for j, g in enumerate(grads):
            touched, g = g if j == 0 else (None, g)
            for lo in range(0, len(g), _ROWS):        # a few rows at a time stay in the processor's cache
                some = slice(lo, lo + _ROWS)
                at, d = some if touched is None else touched[some], g[some]
                m = _BETA1 * self.m[j][at] + (1 - _BETA1) * d
                v = _BETA2 * self.v[j][at] + (1 - _BETA2) * d * d
                self.m[j][at], self.v[j][at] = m, v
                net[j][at] -= (rate * m / (np.sqrt(v) + _GUARD)).astype(np.float32)


def _documents(batches):
    """([(places, values), ...], labels) of a task's rows."""
    docs, labels = [], []
    for b in batches:
        places, values = b.column(0), b.column(1)
        at = places.offsets.to_numpy()
        p, v = places.flatten().to_numpy(), values.flatten().to_numpy().astype(np.float32)
        docs += [(p[i - at[0]:j - at[0]], v[i - at[0]:j - at[0]]) for i, j in zip(at, at[1:])]
        labels.append(b.column(2).to_numpy())
    return docs, np.concatenate(labels) if labels else np.zeros(0, np.int32)


def _epoch(net, docs, y, rate, dropout, batch, rng):
    """(touched rows, their change), [changes of the other weights] of one epoch of Adam."""
    own = np.unique(np.concatenate([p for p, _ in docs]))
    docs = [(np.searchsorted(own, p), v) for p, v in docs]
    local = [net[0][own].copy(), *(w.copy() for w in net[1:])]
    adam, order = Adam(local, rate), rng.permutation(len(docs))
    for lo in range(0, len(order), batch):
        some = order[lo:lo + batch]
        masks = [(rng.random((len(some), local[j].shape[0])) >= dropout).astype(np.float32) / np.float32(1 - dropout) for j in range(2, len(local), 2)]
        adam.step(local, gradients(local, [docs[i] for i in some], y[some], masks)[1])
    return (own, local[0] - net[0][own]), [a - b for a, b in zip(local[1:], net[1:])]


def fit(train: DataFrame, val: DataFrame, label: str, n_features: int, n_classes: int, hidden=(512, 256), dropout: float = 0.3,
        rate: float = 1e-3, batch: int = 128, epochs: int = 10, patience: int = 3, seed: int = 42, features: str = "features"):
    """The weights [W1, b1, ...] after training on ``train``; ``label`` is a class
    number from 0. ``val`` decides when to stop; if empty, all epochs run. Rows
    without a feature count by their biases; an empty ``train`` is an error."""
    sizes = (n_features, *hidden, n_classes)
    if sum(a * b for a, b in zip(sizes, sizes[1:])) > MOST_NUMBERS:
        raise ValueError(f"layers of {sizes} exceed {MOST_NUMBERS} weights")
    spark, net = train.sparkSession, start(sizes, seed)
    columns = [*rows_of(features), F.col(label).cast("int").alias("_y")]
    rows, held_out = (d.select(*columns).persist() for d in (train, val))
    best, best_loss, waited = [w.copy() for w in net], np.inf, 0
    try:
        for epoch in range(epochs):
            held = spark.sparkContext.broadcast(net)
            change = _changes(rows, held, epoch, seed, rate, dropout, batch)
            if not change:
                raise ValueError("no training rows")
            total = change.pop(None)
            for (layer, row), d in change.items():
                net[layer].reshape(-1, net[layer].shape[-1])[row] += (d / total).astype(np.float32)
            held.unpersist()
            loss = _loss(held_out, spark.sparkContext.broadcast(net))
            if loss is None or loss < best_loss:
                best, best_loss, waited = [w.copy() for w in net], loss if loss is not None else np.inf, 0
            else:
                waited += 1
                if waited >= patience:
                    break
    finally:
        rows.unpersist()
        held_out.unpersist()
    return best


def _changes(rows: DataFrame, held, epoch: int, seed: int, rate: float, dropout: float, batch: int) -> dict:
    """{(layer, row): change times rows, None: rows}, added up over the tasks."""
    def train(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        docs, y = _documents(batches)
        if not docs:
            return
        rng = np.random.default_rng((seed, epoch, TaskContext.get().partitionId()))
        (own, first), others = _epoch(held.value, docs, y, rate, dropout, batch, rng)
        n = len(docs)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([[float(n)]], pa.list_(pa.float64()))], ["layer", "row", "d"])
        for layer, at, d in [(0, own, first), *((j + 1, None, w.reshape(-1, w.shape[-1])) for j, w in enumerate(others))]:
            at = np.arange(len(d)) if at is None else at
            for lo in range(0, len(d), 1000):
                part = d[lo:lo + 1000].astype(np.float64) * n
                lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), part.ravel())
                yield pa.RecordBatch.from_arrays([pa.array([layer] * len(part), pa.int32()), pa.array(at[lo:lo + 1000], pa.int32()), lists], ["layer", "row", "d"])

    parts = rows.mapInArrow(train, "layer int, row int, d array<double>")
    added = parts.groupBy("layer", "row").agg(Summarizer.sum(array_to_vector("d")).alias("d")).select("layer", "row", vector_to_array("d").alias("d")).toArrow()
    out = {}
    for layer, row, d in zip(added.column(0).to_pylist(), added.column(1).to_pylist(), added.column(2)):
        out[(layer, row) if layer >= 0 else None] = d.values.to_numpy() if layer >= 0 else d.values[0].as_py()
    return out


def _loss(rows: DataFrame, held) -> float | None:
    """Mean negative log-likelihood of ``rows``; None without any."""
    def losses(batches):
        import pyarrow as pa
        for b in batches:
            docs, y = _documents([b])
            logp = _in_parts(held.value, docs)
            yield pa.RecordBatch.from_arrays([pa.array([-float(logp[np.arange(len(y)), y].sum())]), pa.array([len(y)], pa.int64())], ["loss", "n"])
    loss, n = rows.mapInArrow(losses, "loss double, n long").agg(F.sum("loss"), F.sum("n")).first()
    return loss / n if n else None


def _in_parts(net, docs, size: int = 128):
    """Log-probabilities of the documents, some at a time."""
    return np.concatenate([forward(net, docs[lo:lo + size])[-1] for lo in range(0, len(docs), size)] or [np.zeros((0, len(net[-1])))])


def predict(data: DataFrame, net, keep, features: str = "features") -> DataFrame:
    """``keep``, prediction (class number) and p, its probability."""
    held = data.sparkSession.sparkContext.broadcast(net)
    keep = list(keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.select(*keep).schema.fields)

    def score(batches):
        import pyarrow as pa
        for b in batches:
            docs, _ = _documents([b])
            logp = _in_parts(held.value, docs)
            yield pa.RecordBatch.from_arrays([*b.columns[3:], pa.array(logp.argmax(axis=1).astype(np.int32)), pa.array(np.exp(logp.max(axis=1)).astype(np.float64))],
                                             [*keep, "prediction", "p"])
    return data.select(*rows_of(features), F.lit(0).alias("_y"), *keep).mapInArrow(score, f"{kinds}, prediction int, p double")
