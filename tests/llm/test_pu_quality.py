"""PU learning: risk by definition, prior, held-out accuracy."""
import numpy as np

from conftest import SF001, SF01
from eraspark.llm import pu_quality as P


def test_statistics_are_finite():
    for t in (b"", b" ", b"a", b"a b c\n\n", "é ß 中".encode(), b"x" * 100000, b"!! ## \x00"):
        s = P.statistics(t)
        assert len(s) == P.N_STATISTICS and np.isfinite(s).all()
    assert not any(P.statistics(b""))


def test_risk_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    at = rng.integers(0, P.BINS, (200, P.N_STATISTICS)) + np.arange(P.N_STATISTICS) * P.BINS
    positive = rng.random(200) < 0.3
    w = rng.normal(0, 0.1, P.BINS * P.N_STATISTICS + 1)

    def risk(w):
        z = w[-1] + w[at].sum(1)
        minus, plus = np.logaddexp(0, z), np.logaddexp(0, -z)
        negative = minus.mean() - 0.4 * minus[positive].mean()
        return 0.4 * plus[positive].mean() + max(0.0, negative), negative
    value, g = P.risk_gradient(P._gradients(w[-1] + w[at].sum(1), at, positive), w, 0.4)
    want, negative = risk(w)
    assert negative > 0 and abs(value - want) < 1e-9
    for k in rng.integers(0, len(w), 12):
        e = np.zeros(len(w))
        e[k] = 1e-5
        assert abs((risk(w + e)[0] - risk(w - e)[0]) / 2e-5 - g[k]) < 1e-6


def test_held_out_quality(spark):
    from eraspark.llm.queries import op6_quality
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = op6_quality(spark, SF01).collect()
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, _, q in held if q == v] for v in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.95 and np.mean([p == q for _, p, q in held]) > 0.9


def test_without_positives_nulls_clashing_and_empty(spark, monkeypatch):
    monkeypatch.setattr(P, "WARM_STEPS", 2)
    monkeypatch.setattr(P, "STEPS", 4)
    df = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, "some words " * 50, 0.1), (3, "some words " * 50, 0.1), (None, "a", 0.1)],
                               "doc_id long, text string, score double")
    none = spark.createDataFrame([(None,), (99,)], "doc_id long")
    out = P.classify(df, none)
    assert sorted(out.columns) == ["doc_id", "predicted", "score"] and {r.score for r in out.collect()} == {0.5}
    some = {(r.doc_id, r.score) for r in P.classify(df, spark.createDataFrame([(3,), (3,)], "doc_id long")).collect()}
    assert len(some) == 4
    assert P.classify(df.limit(0), none).count() == 0
