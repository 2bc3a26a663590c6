from pyspark.sql import functions as F

from eraspark.operators import metrics as M
from eraspark.operators import scoring as SC


def test_argmax_ties_and_nan(spark):
    df = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "x", float("nan")), (2, "y", 0.1),
                                (3, "only", 0.2)], "id long, class string, score double")
    got = {r.id: r.predicted for r in SC.argmax_label(df, "id").collect()}
    assert got == {1: "a", 2: "y", 3: "only"}


def test_classification_report_undefined_is_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    rep = {r.label: r for r in M.classification_report(df, "t", "p", ["a", "b", "c", "d"]).collect()}
    assert rep["a"].precision == 1.0 and rep["a"].recall == 0.5
    assert rep["c"].precision == 0.0 and rep["c"].f1 == 0.0          # never predicted
    assert rep["d"].support == 0 and rep["d"].recall == 0.0            # never true
    assert rep["accuracy"].f1 == 0.5 and rep["accuracy"].support == 4


def test_confusion_grid_full(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "t string, p string")
    cm = M.confusion_matrix(df, "t", "p", ["a", "b"])
    assert cm.count() == 4 and cm.agg(F.sum("n")).first()[0] == 2


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "y double, yhat double")
    r = M.regression_metrics(df, "y", "yhat").first()
    assert abs(r.mae - 1 / 3) < 1e-6 and abs(r.mse - 1 / 6) < 1e-6 and abs(r.r2 - 0.75) < 1e-6


def test_methods_side_by_side(spark):
    from eraspark.operators import scoring as SC
    a = spark.createDataFrame([(1, "x", 0.2), (1, "y", 0.2), (2, "x", float("nan")), (2, "y", 0.1)], "id long, class string, score double")
    b = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.95), (3, "y", 0.5)], "id long, class string, score double")
    got = {r.id: r for r in SC.compare_scores({"bin": a, "multi": b}, "id", ["x", "y"]).collect()}
    assert (got[1].pred_bin, got[1].pred_multi, got[1].conf_bin_x, got[1].conf_multi_y) == ("x", "y", 0.2, 0.95)
    assert (got[2].pred_bin, got[2].pred_multi, got[2].conf_multi_x) == ("y", None, None)
    assert (got[3].pred_bin, got[3].pred_multi, got[3].conf_bin_y) == (None, "y", None)


def test_ensemble_labels(spark):
    from eraspark.operators import scoring as SC
    kinds = "id long, class string, score double"
    a = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.1)], kinds)
    b = spark.createDataFrame([(1, "x", 0.1), (1, "y", 0.8)], kinds)
    for wa, wb, mix in ((0.6, 0.4, "x"), (0.3, 0.7, "y")):
        rows = SC.ensemble_labels(SC.score_ensemble(a, b, "id", wa, wb), "id").collect()
        assert [(r.pred_a, r.pred_b, r.pred_mix) for r in rows] == [("x", "y", mix)] * 2


def test_registry_skips_incomplete_classes(spark, tmp_path):
    import pytest

    from eraspark.operators import scoring as SC
    from eraspark.operators import sinks as K
    coef = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 2.0)], "class string, term string, coef double")
    vocab = spark.createDataFrame([("b", "t", 1.0), ("c", "t", 1.0)], "class string, term string, idf double")
    assert [r["class"] for r in SC.scan_models(coef, vocab).collect()] == ["b"]
    K.write_model(coef, vocab, str(tmp_path / "m"))
    c, v = SC.load_models(spark, str(tmp_path / "m"))
    assert [r.coef for r in c.collect()] == [2.0] and [r["class"] for r in v.collect()] == ["b"]
    with pytest.raises(ValueError):
        SC.scan_models(coef, vocab.filter("class = 'c'"))


def test_both_feature_kinds_from_one_pass(spark):
    """Equal to two fits; the terms are counted once for any number of fits."""
    from eraspark.operators import features as FE
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"word{chr(97 + (i * j) % 7)}" for j in range(1, 9))) for i in range(12)], "doc string, text string")
    stats = FE.term_stats(docs, "doc", "text", 2)
    both, vocab = FE.fit_tfidf(docs, "doc", "text", 20, 2, stats=stats, also="other")
    got = {(r.doc, r.term): (r.weight, r.other) for r in both.collect()}
    for i, sublinear in enumerate((False, True)):
        w, v = FE.fit_tfidf(docs, "doc", "text", 20, 2, sublinear=sublinear)
        want = {(r.doc, r.term): r.weight for r in w.collect()}
        assert want.keys() == got.keys() and all(abs(want[k] - got[k][i]) < 1e-12 for k in want)
        assert sorted(v.collect()) == sorted(vocab.collect())


def test_weights_stay_where_they_are_under_a_bounded_model(spark):
    """Only a document's sums are shuffled, and a model too large to broadcast gives the same scores."""
    from eraspark.operators import scoring as SC
    w = spark.createDataFrame([(i, f"t{j}", (i + j) / 10) for i in range(5) for j in range(4)], "id long, term string, weight double")
    coef = spark.createDataFrame([(c, f"t{j}", j * k / 7) for k, c in ((1, "a"), (-1, "b")) for j in range(3)], "class string, term string, coef double")
    icpt = spark.createDataFrame([("a", -0.5), ("b", -0.9)], "class string, intercept double")
    docs = spark.range(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, bounded = (SC.score_linear(w, coef, icpt, docs, "id", ["a", "b"], max_features=m) for m in (None, 10))
        shuffles = [d._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(term") for d in (plain, bounded)]
        assert shuffles[0] == 2 and shuffles[1] == 1            # the coefficients' own grouping
        assert sorted(plain.collect()) == sorted(bounded.collect()) and bounded.count() == 12
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
