"""SimHash: edits, votes against a direct count, Hamming search against all pairs."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from eraspark.llm import simhash


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        k = len(t) // 4
        out.append(t[:len(t) - k] + texts[(i + 1) % len(texts)][:k])
    return out


def test_query_edits_and_likeness(spark):
    from eraspark.llm.queries import op2_simhash
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF001}/documents.parquet").collect())
    want = dict(zip([d for d, _ in docs], edited([t for _, t in docs])))
    rows = {r.doc_id: r for r in op2_simhash(spark, SF001).collect()}
    assert set(rows) == set(want)
    same = {}
    for d, t in docs:
        r = rows[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(want[d].encode()).hexdigest()
        assert same.setdefault(t, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 32
        bits = bin(int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).count("1")
        assert r.near_edited == 1 - bits / 128
    ids = [d for d, _ in docs]
    for a, b in zip(ids, ids[1:] + ids[:1]):
        bits = bin(int(rows[a].fingerprint, 16) ^ int(rows[b].fingerprint, 16)).count("1")
        assert rows[a].near_next == 1 - bits / 128
        near = sum(bin(int(rows[a].fingerprint, 16) ^ int(rows[x].fingerprint, 16)).count("1") <= simhash.RADIUS for x in ids)
        assert rows[a].n_near == (near if a % 50 == 0 else None)
    long = [d for d, t in docs if len(t.split()) > 60]
    assert sum(rows[d].near_edited > rows[d].near_next for d in long) >= 0.95 * len(long)


def test_votes_against_direct_count(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 7)
    texts = {1: "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3, 2: "one", 3: "", 4: None, 5: " x  y\tz ", 6: "a b c d e"}
    df = spark.createDataFrame(list(texts.items()), "k long, text string")
    got = {r.k: r for r in simhash.fingerprints(df, ["k"]).collect()}
    for k, text in texts.items():
        words = (text or "").split()
        if not words:
            assert (got[k].hi, got[k].lo, got[k].n_terms) == (0, 0, 0)
            continue
        n = max(1, len(words) - 4)
        w = spark.createDataFrame([(words,)], "w array<string>").select(F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
        hashes = w.select(simhash.terms("h").alias("t")).select(F.explode("t").alias("a")).select("a", F.xxhash64("a", F.lit(1)).alias("b")).collect()
        assert len(hashes) == n == got[k].n_terms
        for name, col in (("hi", "a"), ("lo", "b")):
            want = sum(1 << j for j in range(64) if 2 * sum((h[col] >> j) & 1 for h in hashes) > n)
            assert got[k][name] % 2**64 == want


@pytest.mark.parametrize("radius", [0, 1, 3, 7])
def test_search_against_all_pairs(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(6)] + [0]
    prints = set(base)
    for _ in range(150):
        x = rng.choice(base)
        for j in rng.sample(range(128), rng.randint(0, 9)):
            x ^= 1 << j
        prints.add(x)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    rows = [(signed(x >> 64), signed(x % 2**64)) for x in prints]
    df = spark.createDataFrame(rows + rows[:5], "hi long, lo long")
    got = sorted((r.q_hi % 2**64 << 64 | r.q_lo % 2**64, r.hi % 2**64 << 64 | r.lo % 2**64, r.distance)
                 for r in simhash.within(df, df, radius).collect())
    assert got == sorted((a, b, (a ^ b).bit_count()) for a in prints for b in prints if (a ^ b).bit_count() <= radius)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "abcd"), (1, "efghijkl"), (1, "efghijkl"), (1, None), (2, ""), (3, "ééééé")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, r string")
    got = simhash.edited(df).collect()
    assert len(got) == 6 and sorted(r.r for r in got) == list(range(6))
    byplace = {r.r: r for r in got}
    assert byplace[0].doc_id is None
    texts = [byplace[i].text for i in range(6)]
    assert [byplace[i].edited for i in range(6)] == edited(texts)
    assert simhash.edited(df.limit(0)).count() == 0
    one = simhash.edited(df.limit(1)).collect()
    assert len(one) == 1


@pytest.mark.parametrize("radius", [8, 20, 26])
def test_wide_search_against_all_pairs(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(5)] + [0, 2**128 - 1]
    prints = set(base)
    for _ in range(200):
        x = rng.choice(base)
        for j in rng.sample(range(128), rng.randint(0, radius + 3)):
            x ^= 1 << j
        prints.add(x)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    df = spark.createDataFrame([(signed(x >> 64), signed(x % 2**64)) for x in prints], "hi long, lo long")
    got = sorted((r.q_hi % 2**64 << 64 | r.q_lo % 2**64, r.hi % 2**64 << 64 | r.lo % 2**64, r.distance)
                 for r in simhash.within(df, df, radius).collect())
    assert got == sorted((a, b, (a ^ b).bit_count()) for a in prints for b in prints if (a ^ b).bit_count() <= radius)


def test_planted_near_copies_are_found(spark):
    # 500 words, 11 of them changed: 441 of 551 different shingles in common.
    rng = random.Random(3)
    rows = []
    for k in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(500)]
        rows.append((k, 0, " ".join(words)))
        for place in range(20, 500, 45):
            words[place] = f"x{rng.randrange(10**9)}"
        rows.append((k, 1, " ".join(words)))
    df = spark.createDataFrame(rows, "k long, form int, text string")
    prints = simhash.fingerprints(df, ["k", "form"]).cache()
    found = simhash.within(prints.filter("form = 1"), prints.filter("form = 0"))
    pairs = (found.join(prints.filter("form = 0").select("k", F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")), ["q_hi", "q_lo"])
             .join(prints.filter("form = 1").select(F.col("k").alias("other"), "hi", "lo"), ["hi", "lo"]).collect())
    assert all(r.k == r.other for r in pairs) and len(pairs) >= 0.9 * 400, len(pairs)


def test_search_in_empty_repeated_and_wider_tables(spark):
    df = spark.createDataFrame([(1, 2, "x", 7), (1, 2, "x", 8), (-1, 5, None, 9)], "hi long, lo long, blocks string, distance int")
    got = [(r.q_hi, r.q_lo, r.hi, r.lo, r.distance) for r in simhash.within(df, df).collect()]
    assert sorted(got) == [(-1, 5, -1, 5, 0), (1, 2, 1, 2, 0)]
    assert simhash.within(df.limit(0), df).count() == 0 and simhash.within(df, df.limit(0)).count() == 0
