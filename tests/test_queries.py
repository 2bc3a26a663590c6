"""Every registered query builds and runs on the smallest tables; the
flagship keeps its golden shape; streams equal their batch form."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001, SF01
from eraspark.plans.registry import load_all

# The queries of the optional parts have tests of their own.
NAMES = set(load_all())


def test_registry_and_oracle_keys():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 100


def test_entry_flagship_shape(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["era", "rank", "token", "tfidf_score"]
    by_era = {}
    for r in rows:
        by_era.setdefault(r.era, []).append(r)
    for era, rs in by_era.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1))
        scores = [r.tfidf_score for r in rs]
        assert scores == sorted(scores, reverse=True)


@pytest.mark.parametrize("name", sorted(NAMES))
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF001)
    df.limit(5).collect()


def test_stream_ingest_equals_batch(spark):
    from eraspark.operators import records as R
    from eraspark.plans.q_ingest import raw_records
    s = E.queries()["stream_ingest_records"](spark, SF01)
    b = R.record_normalize(raw_records(spark, SF01)).dropDuplicates(["url"])
    assert s.count() == b.count()
    assert s.select("url").subtract(b.select("url")).count() == 0


@pytest.mark.parametrize("name", sorted(NAMES - {
    "stream_ingest_records", "stream_score", "stream_class_counts", "sink_splits", "sink_era_binary",
    "sink_dataset_columnar", "sink_append_found", "sink_model"}))
def test_plan_has_no_cross_join_or_row_udf(spark, name):
    plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, (name, bad)


def test_stream_class_counts_equal_batch(spark):
    from eraspark.operators.corpus import filter_in_genres
    from eraspark.sources.tables import songs
    s = {r.tag: r.n_rows for r in E.queries()["stream_class_counts"](spark, SF01).collect()}
    b = {r.tag: r["count"] for r in filter_in_genres(songs(spark, SF01)).groupBy("tag").count().collect()}
    assert s == b
