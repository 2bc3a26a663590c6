"""Repeated strings against a direct scan of all 100-byte strings."""
import random

import pytest

from conftest import SF001
from eraspark.llm import suffix_dedup as S


def brute(rows, length=100):
    """rows: (id, text) -> for each row (id, n_bytes, spans, kept)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        t = (rows[i][1] or "").encode()
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            w = t[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            at = len(t) if at < 0 else at
            spans.append((a, at))
        out[i] = (rows[i][0], len(t), spans, bytes(b for b, g in zip(t, gone) if not g))
    return sorted((out[i] for i in range(len(rows))), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=repr)


def corpus(rng, n):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(rng.choice([14, 20, 40])) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [say(rng.randint(0, 40)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        if rng.random() < 0.2:
            parts.append("ab " * rng.randint(1, 200))
        text = rng.choice(["", " "]).join(parts)
        rows.append((rng.choice(rows)[1] if rows and rng.random() < 0.15 else text))
        rows[-1] = (i * 7 % n if n % 7 else i, rows[-1])
    return rows


@pytest.mark.parametrize("seed", [1])
def test_random_corpus(spark, seed):
    rows = corpus(random.Random(seed), 60)
    rows += [(1000, None), (1001, ""), (1002, "x" * 99), (1003, "x" * 100), (1004, "x" * 5000), (None, rows[0][1]), (1005, "é" * 400)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, kept string").repartition(5)
    assert got(S.repeated_spans(df)) == brute(rows)


def test_hot_trigger_and_long_texts_in_pieces(spark, monkeypatch):
    """A passage in many contexts, dealt to many slices; texts longer than a chunk."""
    monkeypatch.setattr(S, "SLICE", 4)
    rng = random.Random(5)
    say = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    line = say(110)
    rows = [(i, say(rng.randint(0, 120)) + line + say(rng.randint(0, 120))) for i in range(60)]
    rows.append((70, say(9000) + rows[3][1] + say(4000) + line))
    assert got(S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)
    monkeypatch.setattr(S, "CHUNK", 700)
    texts = [t.encode() for _, t in rows]
    cut = [tuple(x) for p in S.phrases(texts) for x in zip(*(c.tolist() for c in p))]
    monkeypatch.setattr(S, "CHUNK", 1 << 20)
    assert cut == [tuple(x) for p in S.phrases(texts) for x in zip(*(c.tolist() for c in p))]


def test_repeated_rows_are_one_document(spark):
    t = "some words " * 30
    rows = [(1, t), (1, t), (2, t)]
    out = got(S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    single = brute([(1, t), (2, t)])
    assert out == sorted([single[0], single[0], single[1]], key=repr)


def test_ranks_are_the_suffix_order():
    rng = random.Random(3)
    entries = [bytes(rng.choice(b"ab") for _ in range(rng.randint(100, 140))) for _ in range(30)]
    entries.append(entries[0])
    e, s, r = S.ranks(entries)
    strings = [entries[i][j:j + 100] for i, j in zip(e, s)]
    want = {w: k for k, w in enumerate(sorted(set(strings)))}
    assert r.tolist() == [want[w] for w in strings]


def test_query(spark):
    import hashlib
    from eraspark.llm.queries import op4_suffix_dedup
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = {(d, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for d, n, s, k in brute(rows)}
    assert {tuple(r) for r in op4_suffix_dedup(spark, SF001).collect()} == want


def test_empty(spark):
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
