"""The pipeline: each stage judged on its own input, against plain versions."""
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from conftest import SF001, SF01
from eraspark.session import materialize


def copy(df):
    return materialize(df, keep_partitioning=False)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF001}/documents.parquet"), []
    for _, f in C.STAGES:
        out.append((docs, copy(f(spark, docs, SF001))))
        docs = out[-1][1]
    return out


def test_stages_and_columns(spark, stages):
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "near_duplicates", "repeated_strings", "packing"]
    for docs, out in stages[:-1]:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_language_stage_keeps_all_with_letters(stages):
    docs, out = stages[0]
    want = {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    assert {r.doc_id for r in out.collect()} == want


def test_language_stage_drops_unlearnt_languages(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    odd = ["Быстрая коричневая лиса прыгает через ленивую собаку и потом долго спит под деревом. " * 5,
           "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗い所で泣いていた事だけは記憶している。" * 3]
    # Their lang is null, or (held out by its id) one that nothing was learnt of.
    held = next(i for i in range(10**6, 10**6 + 99) if zlib.crc32(str(i).encode()) % 4 == 2)
    extra = spark.createDataFrame([(10**7, odd[0], None, "web", 1), (held, odd[1], "ja", "web", 1)], docs.schema)
    out = C.language_id(spark, docs.unionByName(extra), SF01)
    want = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    got = {r.doc_id for r in out.collect()}
    assert got <= want and len(want - got) <= 0.005 * len(want)


def test_line_stage(stages):
    docs, out = stages[1]
    before = {r.doc_id: r for r in docs.collect()}
    for r in out.collect():
        lines = iter(before[r.doc_id].text.split("\n"))
        assert all(line in lines for line in r.text.split("\n"))         # a subsequence of its lines
        assert r.n_chars == len(r.text) and r.lang == before[r.doc_id].lang
    assert out.count() >= 0.95 * docs.count()


def test_near_duplicate_stage(stages):
    from test_jaccard import brute
    docs, out = stages[2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, n, c in brute(rows, 5, 80) if n == 0 or c == d)


def test_repeated_string_stage(stages):
    from test_suffix_dedup import brute
    docs, out = stages[3]
    want = {d: k.decode("utf-8", "ignore") for d, n, s, k in brute([(r.doc_id, r.text) for r in docs.collect()]) if not s or k.decode("utf-8", "ignore")}
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_packing_stage(stages):
    docs, out = stages[4]
    rows = out.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_odd_rows_pass_every_stage(spark):
    rng = random.Random(0)
    say = lambda: " ".join(rng.choice(["the", "and", "of", "cat", "sat", "long", "words"]) + str(rng.randrange(50)) for _ in range(80))
    a = say()
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, "12 34", "en", "a", 0), (4, a, "en", "a", 9), (4, a, "en", "a", 9), (5, a, "en", None, 9),
            (None, a + " x", "en", "b", 9), (6, say(), "fr", "b", 1), (6, say(), "fr", "b", 1), (7, "x" * 100000, "en", "a", 2)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, f in C.STAGES[:-1]:
        docs = copy(f(spark, docs, ""))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [4, 6, 6, 7]
    assert C.pack(spark, docs, "").count() >= 4
    empty = docs.limit(0)
    for _, f in C.STAGES:
        assert f(spark, empty, "").count() == 0
