"""Streaming ingest: many batches, urls that come again, restarts, repeated
batches, and what a batch reads of the url index."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001, SF01
from eraspark.plans.q_links import page_records
from eraspark.session import shared_path
from eraspark.streaming import ingest as ST
from eraspark.streaming.url_index import UrlIndex

SCHEMA = "page_id long, url string, html string"


def _pages(batch, urls):
    return [(batch, f"http://s.example/{u}", f"<html><article><h1>t{u}</h1>batch {batch} 199{u % 10}</article></html>") for u in urls]


def test_pages_in_a_stream_equal_a_batch(spark):
    got = E.queries()["stream_ingest_pages"](spark, SF01)
    want = page_records(spark.read.parquet(f"{SF01}/pages.parquet"))
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_many_batches_each_url_once(spark):
    source, sink, ck = (shared_path(spark, n) for n in ("src", "sink", "ck"))
    batches = [_pages(b, {b, b + 1, 2 * b, 7, 100 + b}) for b in range(7)]
    index = UrlIndex(spark, f"{sink}-urls", parts=4, merge=3)
    reads = []
    unseen = index.unseen
    index.unseen = lambda rows, n: (unseen(rows, n), reads.append(len(index.last_read)))[0]
    schema = spark.createDataFrame([], SCHEMA).schema
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ST.ingest_records(spark, source, schema, page_records, sink, ck, files_per_batch=1, index=index)
    got = ST.read_sink(spark, sink)
    first = {}
    for b, rows in enumerate(batches):
        for _, url, _ in rows:
            first.setdefault(url, b)
    assert {(r.url, r.lyric_text.split()[1]) for r in got.collect()} == {(u, str(b)) for u, b in first.items()}
    assert got.count() == len(first)
    # However many batches came before: at most merge - 1 segments of each part touched.
    assert len(reads) == 7 and max(reads) <= 4 * (3 - 1) and len(set(reads[3:])) <= 4
    assert not index._exists(index._manifest_path(3)) and index._exists(index._manifest_path(6))


def test_a_batch_run_again_changes_nothing(spark):
    path = shared_path(spark, "index")
    index = UrlIndex(spark, path, parts=3, merge=2)
    rows = [spark.createDataFrame([(f"u{u}",) for u in urls], "url string") for urls in ((1, 2, 3), (3, 4), (5, 1, 6), (6, 7))]
    for n, urls in enumerate(rows):
        for _ in range(3):
            seen = sorted(r.url for r in index.unseen(urls, n).collect())
            index.add(spark.createDataFrame([(u,) for u in seen], "url string"), n)
        assert seen == [["u1", "u2", "u3"], ["u4"], ["u5", "u6"], ["u7"]][n]


def test_a_sink_without_an_index_is_indexed_first(spark):
    source, sink, ck = (shared_path(spark, n) for n in ("src", "sink", "ck"))
    schema = spark.createDataFrame([], SCHEMA).schema
    old = page_records(spark.createDataFrame(_pages(9, {1, 2}), SCHEMA))
    ST.write_batch(old, 1_000_000, sink)                                # stored by an earlier job
    spark.createDataFrame(_pages(0, {2, 3}), SCHEMA).write.parquet(source)
    ST.ingest_records(spark, source, schema, page_records, sink, ck)
    got = {(r.url, r.lyric_text.split()[1]) for r in ST.read_sink(spark, sink).collect()}
    assert got == {("http://s.example/1", "9"), ("http://s.example/2", "9"), ("http://s.example/3", "0")}


@pytest.mark.parametrize("name", ["stream_ingest_records", "stream_ingest_pages"])
def test_registered_streams_have_each_url_once(spark, name):
    got = E.queries()[name](spark, SF001)
    assert got.count() == got.select("url").distinct().count() == spark.read.parquet(f"{SF001}/pages.parquet").select(F.countDistinct("url")).first()[0]
