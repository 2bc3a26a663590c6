from pyspark.sql import functions as F

from eraspark.operators import pages as P
from eraspark.operators import records as R


def test_record_normalize(spark):
    rows = [(" a ", 0, None, " 1999 "), ("b", 1600000000, None, "99"), ("c", None, "2024-01-01", "19999"),
            ("d", None, None, None)]
    df = spark.createDataFrame(rows, "id string, ts_epoch long, ts_text string, release_year string") \
        .withColumn("text", F.lit(None).cast("string"))
    got = {r.id: r for r in R.record_normalize(df).collect()}
    assert got["a"].timestamp == "" and got["a"].release_year == "1999"
    assert got["b"].timestamp == "2020-09-13 12:26:40" and got["b"].release_year is None
    assert got["c"].timestamp == "2024-01-01" and got["d"].timestamp == ""
    assert got["d"].text == "" and got["d"].platform == "musicatm" and got["d"].language_variant == "Thai"
    assert list(R.record_normalize(df).columns) == list(R.fixed.RECORD_FIELDS)


def test_anti_seen_urls(spark):
    batch = spark.createDataFrame([("u1",), ("u1",), ("u2",), ("u3",)], "url string")
    seen = spark.createDataFrame([("u3",)], "url string")
    assert sorted(r.url for r in R.anti_seen_urls(batch, seen).collect()) == ["u1", "u2"]


def test_parse_page():
    html = ("<html><head><title>T</title><script>var x='<p>';</script></head><body>"
            "<h1>Song A</h1><div id='lyric-lyric'><p>Line &amp; one<br><p>Song A two</p></div>"
            "<strong>หมวดเพลง : ลูกทุ่ง</strong></body></html>")
    page, block, raw, heading, label = P.parse_page(html, "div", "lyric-lyric", None)
    assert block == "Line & one\nSong A two"
    assert raw.startswith("<div id='lyric-lyric'>") and raw.endswith("</div>")
    assert heading == "Song A" and label == "หมวดเพลง : ลูกทุ่ง"
    assert "var x" not in page and page.startswith("T Song A")


def test_pick_first_key(spark):
    df = spark.createDataFrame([('{"era": 5, "predicted_era": " 1990s "}',), ('{"era": "  "}',),
                                ('{"era_confidence": "87.6x", "era": "a"}',)], "j string")
    out = R.pick_first_number(R.pick_first_key(df, "j", ["era", "predicted_era"], "Unknown", "era"),
                              "j", ["era_confidence"], 0, "c").collect()
    assert [r.era for r in out] == [" 1990s ", "Unknown", "a"]
    assert [r.c for r in out] == [0, 0, 88]
