import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from eraspark.operators import sampling as SM
from eraspark.operators.ranking import exact_rank, hex_bucket


def _df(spark, n, k=3):
    return spark.createDataFrame([(i, f"c{i % k}") for i in range(n)], "id long, cls string")


def test_exact_rank_equals_global_row_number(spark):
    df = SM.hash_key(_df(spark, 3000), "id", 42)
    r = exact_rank(df, [F.col("_h"), F.col("id")], hex_bucket("_h"), rank_col="r")
    ref = df.withColumn("g", F.row_number().over(Window.orderBy("_h", "id")))
    bad = r.join(ref, "id").filter(F.col("r") != F.col("g")).count()
    assert bad == 0 and r.count() == 3000


def test_split_sizes(spark):
    for n in (1, 9, 10, 11, 100, 1001):
        got = {r.split: r["count"] for r in SM.split_random(_df(spark, n)).groupBy("split").count().collect()}
        nt = math.ceil(0.1 * n)
        nv = math.ceil(0.1 * (n - nt))
        assert got.get("test", 0) == nt and got.get("val", 0) == nv
        assert sum(got.values()) == n


def test_split_stratified_keeps_shares(spark):
    df = spark.createDataFrame([(i, "a" if i < 700 else ("b" if i < 990 else "c")) for i in range(1000)],
                               "id long, cls string")
    s = SM.split_stratified(df, "cls")
    got = {(r.cls, r.split): r["count"] for r in s.groupBy("cls", "split").count().collect()}
    assert got[("a", "test")] == 70 and got[("b", "test")] == 29 and got.get(("c", "test"), 0) == 1
    assert s.count() == 1000 and s.select("id").distinct().count() == 1000


def test_fair_negative_quotas_brute_force():
    rnd = random.Random(7)
    for _ in range(500):
        sizes = {f"e{i}": rnd.choice([0, 1, 2, 5, 9, rnd.randint(0, 60)]) for i in range(rnd.randint(2, 6))}
        cap = rnd.choice([3, 50, 200000])
        plan = SM.fair_negative_quotas(sizes, cap)
        for t, (T, q) in plan.items():
            others = sorted(c for c in sizes if c != t)
            tot = sum(sizes[c] for c in others)
            want_T = min(sizes[t], int(tot / len(others)), tot, cap)
            order = sorted((k, c) for c in others for k in range(1, sizes[c] + 1))[:want_T]
            want = {c: sum(1 for _, x in order if x == c) for c in others}
            assert T == want_T and q == want


def test_ovr_fair_negatives_balanced(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else ("b" if i < 60 else "c")) for i in range(100)],
                               "id long, song_era string")
    out = SM.ovr_fair_negatives(df, "song_era")
    c = {(r.target, r.is_target): r["count"] for r in out.groupBy("target", "is_target").count().collect()}
    for t in ("a", "b", "c"):
        assert c[(t, 1)] == c[(t, 0)]


def test_undersample_cap(spark):
    out = SM.undersample_cap(_df(spark, 100, 2), "cls", cap=7)
    assert sorted(r["count"] for r in out.groupBy("cls").count().collect()) == [7, 7]


def test_weighted_sample_replace_classes_even(spark):
    df = spark.createDataFrame([(i, "big" if i < 900 else "small") for i in range(1000)], "id long, song_era string")
    out = SM.weighted_sample_replace(df, "song_era", n=4000)
    c = {r.song_era: r["count"] for r in out.groupBy("song_era").count().collect()}
    assert out.count() == 4000 and abs(c["big"] - c["small"]) < 400


def test_draws_with_replacement_by_cumulative_sizes(spark):
    import hashlib
    rows = [(i, "abc"[0 if i < 400 else 1 + i % 2]) for i in range(500)] + [(500 + i, None) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, cls string")
    got = SM.ovr_with_replacement(df, "cls", ["a", "b", "none"], 200)
    place = sorted(rows, key=lambda r: (r[1] or "\0", hashlib.md5(f"42|{r[0]}".encode()).hexdigest()))
    want = set()
    for target in ("a", "b"):
        for side in (1, 0):
            pool = [r[0] for r in place if (r[1] == target) == bool(side)]
            for j in range(1, 201):
                h = int(hashlib.md5(f"42|{target}|{side}|{j}".encode()).hexdigest()[:15], 16)
                want.add((target, side, j, pool[h % len(pool)]))
    mine = {(r.target, r.is_target, r.draw, r.id) for r in got.filter("target != 'none'").collect()}
    assert mine == want
    assert got.filter("target = 'none'").select("is_target").distinct().collect() == [(0,)]
    # Every row is ranked once: no copies of the table by class.
    assert "Generate explode" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[-1]


def test_weighted_draws_are_even_over_classes(spark):
    df = spark.createDataFrame([(i, "big" if i < 900 else "small") for i in range(1000)] + [(2000, None)], "id long, cls string")
    got = SM.weighted_sample_replace(df, "cls")
    counts = {r.cls: r["count"] for r in got.groupBy("cls").count().collect()}
    assert sum(counts.values()) == 1000 and abs(counts["big"] - 500) < 80
    assert SM.weighted_sample_replace(df, "cls", n=5).select("draw").distinct().count() == 5
