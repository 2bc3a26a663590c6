from pyspark.sql import functions as F

from eraspark.operators import corpus as C


def test_title_noise(spark):
    df = spark.createDataFrame([(1, "Discover"), (2, None), (3, "KARAOKE night"), (4, "Love song")],
                               "id long, title string")
    kept = sorted(r.id for r in C.filter_title_noise(df).collect())
    assert kept == [2, 4]


def test_cast_numeric_coerce(spark):
    vals = ["1990", " 1990 ", "", "19x", "NaN", "1990d"]
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(vals)], "id long, year string, views string")
    got = {r.id: r.year for r in C.cast_numeric_coerce(df).collect()}
    assert got == {0: 1990.0, 1: 1990.0}
    v = spark.createDataFrame([(0, "1990", None), (1, "1991", "12")], "id long, year string, views string")
    assert {r.id: r.views for r in C.cast_numeric_coerce(v).collect()} == {0: 0.0, 1: 12.0}


def test_era_bin(spark):
    ys = [1969.9, 1970.0, 1979.9, 1980.0, 2025.0, 2025.5, 2026.0]
    df = spark.createDataFrame([(y,) for y in ys], "year double")
    got = [r.e for r in df.select(C.era_bin("year").alias("e")).collect()]
    assert got == [None, "1970s", "1970s", "1980s", "2020s", "2020s", None]


def test_dedup_keep_first(spark):
    df = spark.createDataFrame([
        (1, "same text", 1990.0, 5.0), (2, "same text", 1985.0, 1.0),      # oldest year wins
        (3, "other", 1990.0, 1.0), (4, "other", 1990.0, 9.0),              # then most views
        (6, "tie", 2000.0, 3.0), (5, "tie", 2000.0, 3.0),                  # then smallest id
        (7, "missing views", 2001.0, 0.0),
    ], "id long, clean_lyrics string, year double, views double")
    got = sorted(r.id for r in C.dedup_keep_first(df).collect())
    assert got == [2, 4, 5, 7]
    again = sorted(r.id for r in C.dedup_keep_first(C.dedup_keep_first(df)).collect())
    assert again == got


def test_stage_funnel_monotone(spark):
    from conftest import SF01
    from eraspark.sources.tables import songs
    f = C.stage_funnel(songs(spark, SF01)).orderBy("stage_no").collect()
    n = [r.n_rows for r in f]
    assert n == sorted(n, reverse=True) and n[0] == 1000
    assert n[-1] == C.prepare_songs(songs(spark, SF01)).count()
