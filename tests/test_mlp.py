"""The network: numeric gradient, lazy Adam, learning, stopping."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from eraspark.operators import mlp as M


def _docs(rng, n, d):
    docs = []
    for _ in range(n):
        p = np.sort(rng.choice(d, rng.integers(0, d), replace=False))
        docs.append((p, rng.normal(size=len(p))))
    return docs


def test_gradient_is_numeric():
    rng = np.random.default_rng(1)
    net = [w.astype(np.float64) for w in M.start((7, 5, 4, 3), 2)]
    for j in (1, 3, 5):
        net[j] += rng.normal(size=net[j].shape) * 0.1
    docs, y = _docs(rng, 6, 7), rng.integers(0, 3, 6)
    masks = [(rng.random((6, k)) < 0.7) / 0.7 for k in (5, 4)]
    for m in (None, masks):
        loss, grads = M.gradients(net, docs, y, m)
        touched, first = grads[0]
        whole = [np.zeros_like(net[0]), *grads[1:]]
        whole[0][touched] = first
        for j, w in enumerate(net):
            for at in np.ndindex(*w.shape):
                old = w[at]
                w[at] = old + 1e-6
                up = M.gradients(net, docs, y, m)[0]
                w[at] = old - 1e-6
                down = M.gradients(net, docs, y, m)[0]
                w[at] = old
                assert abs((up - down) / 2e-6 / 6 - whole[j][at]) < 1e-6


def test_only_touched_rows_move():
    net = M.start((6, 4, 2), 0)
    before = net[0].copy()
    docs = [(np.array([1, 4]), np.array([1.0, 2.0], np.float32)), (np.array([], np.int64), np.array([], np.float32))]
    adam = M.Adam(net, 0.01)
    adam.step(net, M.gradients(net, docs, np.array([0, 1]))[1])
    moved = (net[0] != before).any(axis=1)
    assert not moved[[0, 2, 3, 5]].any() and moved[[1, 4]].any()


def _rows(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = np.zeros(20)
        x[rng.choice(20, 5, replace=False)] = 1.0
        y = int((x[:5].sum() > x[5:10].sum()) + 2 * (x[10] > 0))
        rows.append((i, Vectors.sparse(20, np.flatnonzero(x).tolist(), x[x != 0].tolist()), y))
    return spark.createDataFrame(rows, ["id", "features", "y"]).repartition(3)


def test_learns_what_no_linear_model_of_the_majority_does(spark):
    train, val, test = _rows(spark, 900, 1), _rows(spark, 150, 2), _rows(spark, 200, 3)
    net = M.fit(train, val, "y", 20, 4, hidden=(32, 16), epochs=25, rate=0.01, batch=32)
    got = M.predict(test, net, ["id", "y"])
    right, most = got.filter("prediction = y").count(), max(r["count"] for r in test.groupBy("y").count().collect())
    assert right > 150 and right > 1.2 * most
    assert got.filter("p <= 0 or p > 1").count() == 0


def test_stops_early_and_keeps_the_best(spark, monkeypatch):
    losses = iter([3.0, 2.0, 2.5, 2.4, 2.2, 1.0])
    nets = []
    monkeypatch.setattr(M, "_loss", lambda rows, held: (nets.append([w.copy() for w in held.value]), next(losses))[1])
    net = M.fit(_rows(spark, 60), _rows(spark, 5), "y", 20, 4, hidden=(4,), epochs=10, patience=3)
    assert len(nets) == 5 and all((a == b).all() for a, b in zip(net, nets[1]))


def test_errors(spark, monkeypatch):
    empty = _rows(spark, 3).filter("id > 5")
    with pytest.raises(ValueError):
        M.fit(empty, empty, "y", 20, 4, hidden=(4,), epochs=1)
    monkeypatch.setattr(M, "MOST_NUMBERS", 10)
    with pytest.raises(ValueError):
        M.fit(empty, empty, "y", 20, 4)


def test_adam_steps_a_few_rows_at_a_time(monkeypatch):
    """Every row moves as in one go, whatever the number handled at once (F8)."""
    def moved(rows):
        monkeypatch.setattr(M, "_ROWS", rows)
        rng, net = np.random.default_rng(4), M.start((30, 12, 5, 3), 2)
        adam = M.Adam(net, 1e-2)
        for _ in range(3):
            adam.step(net, M.gradients(net, [(p, v.astype(np.float32)) for p, v in _docs(rng, 9, 30)], rng.integers(0, 3, 9))[1])
        return net
    whole = moved(1000)
    for rows in (1, 7, 64):
        assert all((a == b).all() for a, b in zip(whole, moved(rows)))
