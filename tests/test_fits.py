"""Every fit on songs whose words tell era, genre and year: better than the
majority class (or the mean year) on rows that the fit has not seen."""
import random

import pytest
from pyspark.sql import functions as F

from eraspark.functions import fixed
from eraspark.operators import features as FE
from eraspark.plans import q_models as Q


def planted(spark):
    rng = random.Random(6)
    rows = []
    for i in range(420):
        year = 1970 + (i * 37) % 56
        tag = fixed.GENRES[(i * 7) % 5]
        era = year // 10 * 10
        words = [f"common{chr(97 + rng.randint(0, 25))}" for _ in range(20)] + [f"era{chr(97 + (era - 1970) // 10)}{rng.choice('xyz')}" for _ in range(5)]
        words += [f"{tag}{rng.choice('xyz')}" for _ in range(5)] + ["id" + "".join(chr(97 + int(c)) for c in str(i))]
        rng.shuffle(words)
        rows.append((i, f"title {chr(97 + i % 26)}", " ".join(words), "en", str(year), "1", tag))
    return spark.createDataFrame(rows, "id long, title string, lyrics string, language string, year string, views string, tag string").repartition(4)


@pytest.fixture
def corpus(spark, monkeypatch):
    df = planted(spark)
    monkeypatch.setattr(Q, "songs", lambda *a: df)
    monkeypatch.setattr(Q.fixed, "GENRE_DRAWS_PER_CLASS", 300)
    return df


@pytest.mark.parametrize("name, classes", [("fit_ovr_logreg", 6), ("fit_multiclass_logreg", 6), ("fit_binary_per_genre", 5), ("fit_mlp_tfidf", 6)])
def test_reports_beat_the_majority(spark, corpus, name, classes):
    rows = {(r.split, r.label): r for r in getattr(Q, f"q_{name}")(spark, "").collect()}
    for split in ("val", "test"):
        n = rows[split, "accuracy"].support
        most = max(r.support for (s, label), r in rows.items() if s == split and label not in ("accuracy", "macro avg", "weighted avg"))
        assert rows[split, "accuracy"].f1 > max(0.8 if "logreg" in name else 0.6, most / n)
        assert sum(r.support for (s, label), r in rows.items() if s == split and label not in ("accuracy", "macro avg", "weighted avg")) == n
    assert len(rows) == 3 * (classes + 3)


def test_binary_models_beat_a_coin(spark, corpus):
    rows = Q.q_fit_binary_per_era(spark, "").collect()
    assert {r.target for r in rows} == set(fixed.ERA_LABELS)
    tests = [r.accuracy for r in rows if r.split == "test"]
    assert sum(tests) / len(tests) > 0.8


def test_genre_models_on_drawn_rows(spark, corpus):
    rows = Q.q_fit_genre_balanced(spark, "").collect()
    assert {r.genre for r in rows} == set(fixed.GENRES)
    assert min(r.accuracy for r in rows) > 0.85              # the majority, "not this genre", has 0.8


def test_multiplicities_equal_copies(spark):
    docs = planted(spark).select(F.col("id").cast("string").alias("text_key"), F.col("lyrics").alias("clean_lyrics"), "tag").withColumn("m", F.col("text_key").cast("long") % 4)
    drawn = docs.filter("m > 0").withColumn("split", F.lit("train"))
    copies = drawn.select(F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("k"), "*").withColumn("text_key", F.concat_ws("-", "text_key", "k")).drop("k").withColumn("m", F.lit(1).cast("long"))
    a, b = (FE.fit_tfidf(d, "text_key", "clean_lyrics", 200, 3, weight="m")[1] for d in (drawn, copies))
    plain = FE.fit_tfidf(copies, "text_key", "clean_lyrics", 200, 3)[1]
    key = lambda v: sorted((r.term, r.df, r.total, round(r.idf, 12)) for r in v.collect())
    assert key(a) == key(b) == key(plain)
    test = docs.filter("m = 0").withColumn("split", F.lit("test"))
    a, b = (Q.genre_fit(d, test, "pop", V=200).collect() for d in (drawn, copies))
    assert a == b


def test_ridge_follows_the_year(spark, corpus):
    rows = {r.split: r for r in Q.q_fit_ridge_year(spark, "").collect()}
    assert rows["test"].r2 > 0.5 and rows["test"].mae < 12
