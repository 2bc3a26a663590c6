import pytest
from pyspark.sql import functions as F

from eraspark.operators import labels as L
from eraspark.operators import records as R
from eraspark.operators import sampling as SM
from eraspark.operators.ranking import exact_rank, hex_bucket


def test_coalesce_sources_priority(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "1999"), (1, 3, "2001"),
                                (2, 1, None), (2, 4, None),
                                (3, 4, "1980"), (3, 3, None)], "k long, source int, year string")
    got = {r.k: (r.year, r.source) for r in R.coalesce_sources(df, "k", "source", "year").collect()}
    assert got == {1: ("1999", 2), 3: ("1980", 4)}          # key 2 has no year anywhere: dropped


def test_first_hit_source(spark):
    df = spark.createDataFrame([(1, 1, "  "), (1, 2, "lyrics b"), (1, 3, "lyrics c"), (2, 1, None)],
                               "k long, source int, text string")
    got = {r.k: (r.source, r.text) for r in R.first_hit_source(df, "k", "source", "text").collect()}
    assert got == {1: (2, "lyrics b")}


def test_exact_rank_with_limit_per_group(spark):
    df = SM.hash_key(spark.createDataFrame([(i, i % 3) for i in range(900)], "id long, g int"))
    r = exact_rank(df, [F.col("_h"), F.col("id")], hex_bucket("_h"), ["g"], "r", limit=7)
    counts = {x.g: x["count"] for x in r.groupBy("g").count().collect()}
    assert counts == {0: 7, 1: 7, 2: 7}
    assert sorted(x.r for x in r.filter("g = 1").collect()) == list(range(1, 8))


def test_sample_n_size_and_determinism(spark):
    df = spark.createDataFrame([(i,) for i in range(5000)], "id long")
    a = sorted(r.id for r in SM.sample_n(df, 50).collect())
    b = sorted(r.id for r in SM.sample_n(df.repartition(7), 50).collect())
    assert len(a) == 50 and a == b                           # independent of partitioning


def test_schema_align_keeps_lyric(spark):
    crawl = spark.createDataFrame([("u1", "the lyric", 1999)], "url string, lyric_text string, release_year int")
    recs = R.record_normalize(spark.createDataFrame([("u2", "other")], "url string, text string"))
    out = {r.url: r for r in R.schema_align(crawl, recs).collect()}
    assert out["u1"].text == "the lyric" and out["u1"].release_year == "1999"
    assert out["u1"].album == "" and out["u2"].text == "other"


def test_label_encode_unseen_raises(spark):
    train = spark.createDataFrame([("1990s",), ("1970s",)], "e string")
    labels = L.label_table(train, "e")
    assert {r.label: r.label_id for r in labels.collect()} == {"1970s": 0, "1990s": 1}
    new = spark.createDataFrame([("2020s",)], "e string")
    with pytest.raises(Exception):
        L.label_encode(new, labels, "e").collect()
    assert L.label_encode(new, labels, "e", on_unseen="null").first().label_id is None
