"""Broken inputs and repeated batches give rows, not failed jobs."""
import pytest
from pyspark.sql import functions as F

from eraspark import session
from eraspark.functions.text import tokenize_ws
from eraspark.operators import pages as P
from eraspark.operators import records as R
from eraspark.operators import scoring as SC
from eraspark.streaming import ingest as ST


def test_bad_json_payload_takes_the_default(spark):
    df = spark.createDataFrame([("{bad",), ('{"a": "x"}',), (None,), ("",)], "j string")
    rows = R.pick_first_number(R.pick_first_key(df, "j", ["a"], "none", "k"), "j", ["n"], 7, "v").collect()
    assert [(r.k, r.v) for r in rows] == [("none", 7), ("x", 7), ("none", 7), ("none", 7)]


def test_malformed_page_gives_an_error_row(spark):
    df = spark.createDataFrame([(1, "u", "<![foo["), (2, "u", "<article>ok</article>"), (3, "u", None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in P.parse_pages(df).collect()}
    assert rows[1].page_text is None and rows[1].parse_error
    assert rows[2].block_text == "ok" and rows[2].parse_error is None and rows[3].parse_error is None


def test_tokens_split_like_str_split(spark):
    text = "A\x1cb\x1d\x1e c\x85d\xa0e f\x1f"
    got = spark.createDataFrame([(text,)], "t string").select(tokenize_ws("t")).first()[0]
    assert got == text.lower().split()


def test_nan_scores_keep_the_document(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (1, "b", float("nan")), (2, "a", 0.2), (2, "b", float("nan"))], "d long, class string, score double")
    assert {r.d: r.predicted for r in SC.argmax_label(df, "d").collect()} == {1: None, 2: "a"}


def test_repeated_batch_replaces_its_rows(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x long")
    sink = str(tmp_path / "sink")
    for _ in range(2):
        ST.write_batch(df, 0, sink)
    ST.write_batch(df, 1, sink)
    assert ST.read_sink(spark, sink).count() == 4 and ST.read_latest(spark, sink).count() == 2


def test_ingest_restarts_to_the_same_table(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("u1", "b"), ("u1", "a"), ("u2", "c")], "url string, t string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    ST.ingest_records(spark, src, schema, lambda d: d, sink, str(tmp_path / "ck1"))
    spark.createDataFrame([("u2", "z"), ("u3", "d")], "url string, t string").write.mode("append").parquet(src)
    ST.ingest_records(spark, src, schema, lambda d: d, sink, str(tmp_path / "ck1"))
    want = [("u1", "a"), ("u2", "c"), ("u3", "d")]
    assert sorted(map(tuple, ST.read_sink(spark, sink).collect())) == want
    ST.ingest_records(spark, src, schema, lambda d: d, str(tmp_path / "out2"), str(tmp_path / "ck2"))
    assert ST.read_sink(spark, str(tmp_path / "out2")).select("url").distinct().count() == 3


def test_sink_that_cannot_be_read_fails(spark, tmp_path):
    src, sink = str(tmp_path / "in"), tmp_path / "out"
    spark.createDataFrame([("u1", "b")], "url string, t string").write.parquet(src)
    (sink / "batch_id=5").mkdir(parents=True)
    (sink / "batch_id=5" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        ST.ingest_records(spark, src, spark.read.parquet(src).schema, lambda d: d, str(sink), str(tmp_path / "ck"))


def test_no_private_folder_off_a_local_master(monkeypatch):
    class Conf:
        def get(self, *a): return None

    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self): return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
