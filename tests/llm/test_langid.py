"""Language identification: kernel identities and held-out accuracy."""
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001, SF01
from eraspark.llm import langid as L
from eraspark.llm.common import held_out


def test_places_and_kernel():
    a, b = L.places("The cat"), L.places("the CAT 12 !")
    assert a.tolist() == b.tolist() and len(a)
    assert a.tolist() != L.places("the dog").tolist()
    rows = [L.places(t) for t in ("the cat sat", "le chat noir", "der hund", "the dog sat")]
    m = L.Model(rows, ["en", "fr", "de", "en"])
    k = m.kernel(rows)
    order = [2, 0, 3, 1]                                    # landmarks by class: de, en, en, fr
    for i in range(4):
        for j, x in enumerate(order):
            want = len(set(rows[i]) & set(rows[x])) / np.sqrt(len(rows[i]) * len(rows[x]))
            assert abs(k[i, j] - want) < 1e-9
    z = m.features(rows)
    assert np.allclose(z @ z.T, m.kernel(rows)[:, [1, 3, 0, 2]], atol=1e-6)   # all rows are landmarks
    assert [m.classes[c] for c in m.score(rows)[0]] == ["en", "fr", "de", "en"]


def test_kernel_in_blocks(monkeypatch):
    rows = [L.places(t * 9) for t in ("the cat sat", "le chat noir", "der hund", "a", "the dog sat on it", "x")]
    m = L.Model(rows[:3], ["en", "fr", "de"])
    want = m.kernel(rows)
    for block in (1, 20, 60):
        monkeypatch.setattr(L, "BLOCK", block)
        assert np.array_equal(m.kernel(rows), want)


def test_kernel_holds_little_at_a_time():
    import tracemalloc
    rng = np.random.default_rng(3)
    m = L.Model.__new__(L.Model)
    m.landmarks, m.sizes = rng.integers(0, 2, (1 << L.HASH_BITS, 96), np.uint8), np.ones(96)
    rows = [np.flatnonzero(rng.random(1 << L.HASH_BITS) < 0.03) for _ in range(60)] + [np.arange(1 << L.HASH_BITS)]
    tracemalloc.start()
    got = m.kernel(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got[-1], m.landmarks.sum(0, dtype=np.int64) / 2 ** (L.HASH_BITS / 2))
    assert np.allclose(got[5], m.landmarks[rows[5]].sum(0, dtype=np.int64) / np.sqrt(len(rows[5])))
    assert peak < 16 << 20


def test_scores_of_plain_kernel_ridge():
    """Every training text a landmark: kernel ridge on the sets themselves, by the dual solution."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(w) for _ in range(12)) for w in (["the", "cat", "on", "house"], ["le", "chat", "sur", "maison"], ["der", "hund", "auf"]) for _ in range(7)]
    labels = [x for x in ("en", "fr", "de") for _ in range(7)]
    sets = [{s[i:i + n] for n in L.ORDERS for i in range(len(s) - n + 1)} for s in (f" {t} " for t in texts)]
    k = np.asarray([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    y = np.where(np.asarray(labels)[:, None] == np.asarray(["de", "en", "fr"]), 1.0, -1.0)
    # Weights 1/7 a row and a penalised intercept: (K + 1 + 7 RIDGE I) a = y, output (K + 1) a.
    out = (k + 1) @ np.linalg.solve(k + 1 + 7 * L.RIDGE * np.eye(21), y)
    odds = np.exp(4 * out)
    best, score = L.Model([L.places(t) for t in texts], labels).score([L.places(t) for t in texts])
    assert best.tolist() == out.argmax(1).tolist()
    assert np.allclose(score, (odds / odds.sum(1, keepdims=True)).max(1), atol=0.01)


def test_letters():
    assert [L.has_letter(t) for t in ("½²", "Ⅷ", "12 _!", "٣", "é", "ß", "Ж", "語")] == [False] * 4 + [True] * 4


def test_unlearnt_languages_are_not_accepted(spark):
    rng = random.Random(5)
    russian = "Быстрая коричневая лиса прыгает через ленивую собаку, а потом долго спит под старым деревом у реки и видит сны. "
    japanese = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所で泣いていた事だけは記憶している。"
    junk = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(4, 9))) for _ in range(90))
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = L.fit(docs.filter(~held_out()))
    odd = spark.createDataFrame([(1, russian), (2, russian * 40), (3, japanese), (4, junk), (5, "½²")], "doc_id long, text string")
    assert [(r.accepted, r.lang_pred == "und") for r in L.identify(odd, model).orderBy("doc_id").collect()] == [(False, False)] * 4 + [(False, True)]
    own = L.identify(docs.filter(held_out()), model).filter("lang_pred != 'und'")
    assert own.filter("accepted").count() >= 0.995 * own.count() > 100
    # Beginnings of clean texts, down to a few words, are not taken for another language.
    short = docs.filter(held_out() & F.col("text").rlike(r"\p{L}")).select("doc_id", F.explode(F.array(*(F.substring("text", 1, n) for n in (20, 60, 200)))).alias("text"))
    short = L.identify(short, model).filter("lang_pred != 'und'")
    assert short.filter("accepted").count() >= 0.99 * short.count()


def test_held_out_accuracy(spark):
    from eraspark.llm.queries import op10_langid
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = op10_langid(spark, SF01).collect()
    assert len(rows) == len(docs)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].text]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_unknown_nulls_clashing_and_empty(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "123", "xx"), (4, None, "yy"), (5, "text", None)],
                                  "doc_id long, text string, lang string")
    model = L.fit(train)
    assert model.classes == ["en", "fr"]
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "12 !?", 1.0), (4, "le chat", 1.0), (4, "le chat", 1.0), (None, "The Dog " * 9000, 1.0)],
                               "doc_id long, text string, score double")
    out = L.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "accepted"]
    assert [r.lang_pred for r in out.collect()] == ["und", "und", "und", "fr", "fr", "en"]
    assert L.identify(df.limit(0), model).count() == 0
    assert L.fit(train.limit(0)) is None
    assert {r.lang_pred for r in L.identify(df, None).collect()} == {"und"}


def test_same_result_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").filter("doc_id % 4 != 2")
    a, b = L.fit(docs), L.fit(docs.repartition(7))
    assert a.classes == b.classes and np.allclose(a.weights, b.weights)
