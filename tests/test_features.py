import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eraspark.operators import features as FE
from eraspark.operators.features import vocab_topk


def py_tfidf(docs, min_df=1, V=None, sublinear=False):
    from collections import Counter
    tfs = {d: Counter(toks) for d, toks in docs.items()}
    df = Counter(t for c in tfs.values() for t in c)
    total = Counter()
    for c in tfs.values():
        total.update(c)
    cand = [t for t in df if df[t] >= min_df]
    cand.sort(key=lambda t: (-total[t], t))
    vocab = set(cand[:V] if V else cand)
    n = len(docs)
    out = {}
    for d, c in tfs.items():
        w = {t: ((1 + math.log(k)) if sublinear else k) * (math.log((1 + n) / (1 + df[t])) + 1)
             for t, k in c.items() if t in vocab}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        out.update({(d, t): x / norm for t, x in w.items()})
    return out


def test_tfidf_matches_python(spark):
    texts = {1: "love love night", 2: "night sky blue", 3: "love sky", 4: "zzz qqq", 5: "love night sky"}
    df = spark.createDataFrame(list(texts.items()), "doc long, text string")
    for sub in (False, True):
        w, _ = FE.fit_tfidf(df, "doc", "text", max_features=None, min_df=2, stop_words=(), sublinear=sub)
        got = {(r.doc, r.term): r.weight for r in w.collect()}
        grams = {}
        for d, t in texts.items():
            toks = t.split()
            grams[d] = toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
        want = py_tfidf(grams, min_df=2, sublinear=sub)
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    # document without vocabulary tokens gets no rows
    assert not any(k[0] == 4 for k in got)


def test_vocab_cap_ties(spark):
    rows = [("a", 5, 9), ("b", 5, 7), ("c", 5, 7), ("d", 5, 7), ("e", 5, 3), ("f", 2, 50)]
    tdf = spark.createDataFrame(rows, "term string, df long, total long")
    got = sorted(r.term for r in vocab_topk(tdf, 3, min_df=3).collect())
    assert got == ["a", "b", "c"]
    assert sorted(r.term for r in vocab_topk(tdf, 10, min_df=3).collect()) == ["a", "b", "c", "d", "e"]


def test_doc_embedding_mean(spark):
    pairs = spark.createDataFrame([(1, "a", 1), (1, "zzz", 1), (2, "zzz", 1), (3, "a", 2), (3, "b", 1)], "doc long, token string, n long")
    vecs = spark.createDataFrame([("a", 3, [1.0, 2.0]), ("b", 1, [4.0, 5.0])], "token string, n long, vector array<double>")
    for head in (1, 2, 100):
        got = {r.doc: r.embedding for r in FE.doc_embedding_mean(pairs, vecs, dim=2, head=head).collect()}
        assert got == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [2.0, 3.0]}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(totals=st.lists(st.one_of(st.integers(1, 40), st.integers(1, 2**62)), min_size=1, max_size=30), radix=st.sampled_from([2, 5, 1 << 16]))
def test_cutoff_total_equals_a_sort(spark, monkeypatch, totals, radix):
    monkeypatch.setattr(FE, "RADIX", radix if max(totals) < 1000 else 1 << 16)
    df = spark.createDataFrame([(t,) for t in totals], "total long").coalesce(1)
    k = 1 + len(totals) // 2
    want = sorted(totals, reverse=True)[k - 1]
    assert FE.cutoff_total(df, "total", k) == (want, sum(t > want for t in totals))


def test_doc_embedding_mean_sends_no_vector_per_pair(spark, monkeypatch):
    """Documents of rare words, null ids and words without a vector, in tasks of
    a few documents: the means by definition, and no vector column summed by document."""
    rng = np.random.default_rng(3)
    words = {f"w{i}": rng.normal(size=5).tolist() for i in range(300)}
    docs = {d: {f"w{i}": int(c) for i, c in zip(rng.choice(330, 40, replace=False), rng.integers(1, 4, 40))} for d in [None, *range(60)]}
    docs[60] = {"x": 2}
    pairs = spark.createDataFrame([(d, w, c) for d, ws in docs.items() for w, c in ws.items()], "doc long, token string, n long")
    vecs = spark.createDataFrame([(w, 50 if w == "w7" else 1, v) for w, v in words.items()]
                                 + [("w8", 1, [9.0] * 5), ("w9", 1, [7.0] * 5), ("w9", 1, [-1.0] * 5), ("x", 1, None)], "token string, n long, vector array<float>")
    monkeypatch.setattr(FE, "SUM_BYTES", 8 * 5 * 4)
    single = {w: [np.asarray(v, np.float32).astype(float)] for w, v in words.items()}
    single["w8"].append(np.full(5, 9.0))
    single["w9"] += [np.full(5, 7.0), np.full(5, -1.0)]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for head, size in ((1, 3), (20, 7), (1000, 2000)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = FE.doc_embedding_mean(pairs, vecs, dim=5, head=head)
        assert "aggregate_metrics" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.doc: r.embedding for r in out.collect()}
        assert set(got) == set(docs) and got[60] == got[None] == [0.0] * 5
        for d, ws in docs.items():
            mine = [(c, v) for w, c in ws.items() for v in single.get(w, [])]
            if mine and d is not None:
                want = sum(c * v for c, v in mine) / sum(c for c, _ in mine)
                assert np.allclose(got[d], want, atol=1e-12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_counting_by_task_equals_counting_by_document(spark, monkeypatch):
    """Stats and weights made where documents are read are those of the grouped
    rows, and need no shuffle or sort by document."""
    monkeypatch.setattr(FE, "COUNT_TOKENS", 7)
    texts = ["love love night sky", "", None, "night sky blue love love", "sky", "a b", "zzz qqq zzz qqq", "été night été night"] * 2
    docs = spark.createDataFrame([(f"k{i}", i, t) for i, t in enumerate(texts)], "doc string, id long, text string")
    for min_df, ngram_max in ((1, 2), (3, 2)):
        stats = FE.distinct_term_stats(docs, "text", min_df)
        assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, FE.term_stats(docs, "doc", "text", min_df).collect()))
        long, vocab = FE.fit_tfidf(docs, "doc", "text", 6, min_df, stats=stats, also="other", keep=("id",))
        rows, index = FE.tfidf_arrays(docs, vocab, "text", ("id",), also="other")
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        terms = [r.term for r in index.orderBy("idx").collect()]
        assert terms == sorted(r.term for r in vocab.collect())
        got = {(r.id, terms[t]): (w, o) for r in rows.collect() for t, w, o in zip(r.terms, r.weight, r.other)}
        want = {(r.id, r.term): (r.weight, r.other) for r in long.collect()}
        assert rows.count() == len(texts) and all(r.terms == sorted(r.terms) for r in rows.collect())
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    empty, index = FE.tfidf_arrays(docs, vocab.filter("term = 'none'"), "text", ("id",))
    assert index.count() == 0 and all(r.terms == [] and r.weight == [] for r in empty.collect())


def test_counts_without_bigrams():
    import pyarrow as pa
    row, term, tf, terms = FE.count_terms(pa.array([["b", "a", "b"], None, [], ["a"]]), 1)
    assert sorted(zip(row.tolist(), [terms[t].as_py() for t in term], tf.tolist())) == [(0, "a", 1), (0, "b", 2), (3, "a", 1)]
