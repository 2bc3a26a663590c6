"""Periodic runs against the plain definition: every period, every stretch."""
import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF001
from eraspark.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, min_length=24, min_repeats=3):
    out = []
    n = len(words)
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(min_length, min_repeats * q):
                stretch = words[start:start + length]
                if not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                    out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def runs_of(words, **kw):
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([names[w] for w in words], np.int32)
    return list(zip(*(x.tolist() for x in periodic.runs_of(ids, np.zeros(len(ids), int), **kw))))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12)), max_size=8))
def test_any_text_equals_the_definition(pieces):
    words = [w for block, times in pieces for w in block * times]
    assert runs_of(words) == plain_runs(words)
    small = dict(min_length=4, min_repeats=2)
    assert runs_of(words, **small) == plain_runs(words, **small)


def test_long_periods_many_documents():
    rng = random.Random(5)
    texts = []
    for k in range(40):
        body = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 300))]
        block = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 150))]
        texts.append(body + block * rng.randint(2, 6) + block[:rng.randint(0, len(block))] + body[:30])
    names = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    ids = np.array([names[w] for t in texts for w in t], np.int32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    want, at = [], 0
    for t in texts:
        want += [(at + s, n, q) for s, n, q in plain_runs(t)]
        at += len(t)
    assert list(zip(*(x.tolist() for x in periodic.runs_of(ids, doc)))) == want


def test_one_word_a_hundred_thousand_times():
    assert runs_of(["a"] * 100_000) == [(0, 100_000, 1)]
    assert runs_of((["a"] * 50 + ["b"]) * 2000)[0] == (0, 50, 1)


def test_splitting_leaves_only_repeated_words():
    ids = np.array([*range(50), *([1, 2, 3] * 10), *range(50, 80)])
    place, segment = periodic.split_by_frequency(ids, np.zeros(len(ids), int), 24, 3)
    assert place.tolist() == list(range(50, 80)) and set(segment.tolist()) == {0}


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "x"), (2, " \n\t ", "y"), (3, "na " * 40 + "\x1cbatman ", "z"), (4, "long " * 70_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(df).collect()), key=repr)
    assert got == sorted([(1, [], ""), (1, [], ""), (None, [], ""), (2, [], ""), (3, [(0, 40, 1)], "na \x1cbatman "), (4, [(0, 70_000, 1)], "long")], key=repr)
    assert periodic.find_runs(df.filter("doc_id > 9")).count() == 0
    assert periodic.find_runs(df.repartition(3)).columns == ["doc_id", "text", "runs", "collapsed"]


def test_query_equals_the_definition(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic"](spark, SF001).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:        # the definition takes the square of the length
            continue
        runs, r = plain_runs(words), got[doc_id]
        planted += h % 10 == 0 and bool(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        milli = best[1] * 1000 // best[2] if runs else None
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert planted
