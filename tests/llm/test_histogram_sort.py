"""Histogram sort: the whole order, the cuts and the slots against a plain sort."""
import random
import zlib

import pytest
import xxhash

from conftest import SF001
from eraspark.llm import histogram_sort as H
from eraspark.llm import queries


def place(spark, rows, shards, tolerance=H.TOLERANCE, parts=5):
    df = spark.createDataFrame(rows, "k long, t long, n long, shard string").repartition(parts)
    got = H.histogram_sort(df, shards, "k", "t", "n", tolerance)
    assert got.columns == ["k", "t", "n", "shard", "slot"]
    return got.collect()


def check(rows, got, shards, tolerance, key):
    """Same rows; sorted by (shard, slot); slots gapless; each cut near its
    target or the nearest that the order has. Returns shard sizes."""
    assert sorted(map(repr, ((r.k, r.t, r.n) for r in got))) == sorted(map(repr, (x[:3] for x in rows)))
    got = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [key(r) for r in got] == sorted(key(r) for r in got)
    for s in range(shards):
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got)))
    assert all(0 <= r.shard < shards for r in got)
    weigh = lambda n: max(n or 0, 0)
    total = sum(weigh(r.n) for r in got)
    edges, at = [0], 0
    for r, after in zip(got, [*got[1:], None]):
        at += weigh(r.n)
        if after is None or key(after) != key(r):
            edges.append(at)
    for i in range(1, shards):
        cut = sum(weigh(r.n) for r in got if r.shard < i)
        off, target = abs(cut - total * i / shards), total * i / shards
        assert off <= max(tolerance * total / shards, min(abs(e - target) for e in edges)) + 1e-6
    return [sum(weigh(r.n) for r in got if r.shard == s) for s in range(shards)]


def low(x):
    return -(1 << 63) if x is None else x


def by_key(r):
    return low(r.k), low(r.t)


@pytest.mark.parametrize("tolerance", [0, 0.001, 0.2])
def test_equals_a_plain_sort(spark, tolerance):
    rng = random.Random(3)
    rows = [(rng.randint(-(1 << 63), (1 << 63) - 1), i, rng.randint(1, 200), "x") for i in range(900)]
    rows += [(77, 1000 + i, 50, "hot") for i in range(500)]              # a third of all, one group
    rows += [(rng.randint(0, 40), 2000 + i, rng.randint(1, 9), None) for i in range(300)]
    sizes = check(rows, place(spark, rows, 8, tolerance), 8, tolerance, by_key)
    if tolerance < 0.1:
        assert max(sizes) - min(sizes) <= 2 * 200 + 2 * tolerance * sum(sizes) / 8


def test_groups_stay_whole_within_the_tolerance(spark):
    rows = [(g, i, 10, "") for g in range(400) for i in range(2)]
    got = place(spark, rows, 8, 0.02)
    homes = {}
    for r in got:
        homes.setdefault(r.k, set()).add(r.shard)
    assert all(len(s) == 1 for s in homes.values())


def test_odd_rows(spark):
    rows = [(None, None, 5, "a"), (None, 3, None, None), (1, 1, 7, "c"), (1, 1, 7, "c"), (2, -9, -4, "d"), ((1 << 63) - 1, 1, 6, "e"), (-(1 << 63), 4, 6, "e")]
    check(rows, place(spark, rows, 3), 3, 0.001, by_key)
    check(rows[:2], place(spark, rows[:2], 8), 8, 0.001, by_key)
    assert place(spark, [], 8) == []
    assert {r.shard for r in place(spark, rows, 1)} == {0}
    with pytest.raises(ValueError):
        place(spark, rows, 0)


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries.QUERIES["op11_histogram_sort"](spark, SF001).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    order = lambda r: (xxhash.xxh64_intdigest(docs[r.doc_id].encode(), seed=42) >> 1, r.doc_id)
    rows = sorted(got, key=lambda r: (r.shard, r.slot))
    assert rows == sorted(got, key=order)
    total, most = sum(r.size for r in got), max(r.size for r in got)
    for s in range(8):
        mine = [r for r in rows if r.shard == s]
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 8) <= most + 0.002 * total / 8


def test_no_python_workers(spark):
    plan = queries.QUERIES["op11_histogram_sort"](spark, SF001)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
