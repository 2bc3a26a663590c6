"""Packing: every token once, windows full, targets met, brute-force mixture."""
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF001
from eraspark.llm import packing

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("totals,targets,window", [
    ({"a": 10, "b": 1, "c": 1000}, None, 16), ({"a": 1}, None, 4), ({}, None, 4),
    ({"a": 500, "b": 40, "c": 3}, {"a": 1, "b": 1}, 32), ({"a": 64, "b": 64}, {"a": 3, "b": 1}, 16),
    ({f"s{i}": 7 * i + 1 for i in range(23)}, {f"s{i}": (i % 5) for i in range(23)}, 64)])
def test_mixture_places_every_token_once(totals, targets, window):
    m = packing.Mixture(totals, targets, window)
    total = sum(totals.values())
    taken = {}
    for s, n in totals.items():
        for at in range(0, n, 13):                     # documents of 13 tokens
            size = min(13, n - at)
            pieces = list(m.pieces(s, at, size))
            assert sum(p[1] for p in pieces) == size and pieces[0][0] == at
            for position, k, w, offset in pieces:
                for i in range(k):
                    assert (w, offset + i) not in taken
                    taken[w, offset + i] = s
    assert len(taken) == total
    by_window = defaultdict(list)
    for w, offset in taken:
        by_window[w].append(offset)
    for w, offsets in by_window.items():
        assert sorted(offsets) == list(range(len(offsets)))
        assert len(offsets) == window or len(offsets) & (len(offsets) - 1) == 0
    if targets is None and total:                      # shares hold in every prefix of windows
        for w in range(1, m.full + 1):
            for s, n in totals.items():
                got = sum(v == s for (x, _), v in taken.items() if x < w)
                assert abs(got - w * window * n / total) <= 1 + len(totals).bit_length()


def test_query_rows(spark):
    from eraspark.llm.queries import op7_packing
    lib = Tokenizer.from_file(WORD)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in op7_packing(spark, SF001).collect():
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(docs) == set(texts)
    for d, rows in docs.items():
        ids = np.asarray(lib.encode(texts[d], add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    short = 0
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096
        short += at < 4096
        assert at == 4096 or at & (at - 1) == 0
    assert short <= 12


def test_null_repeated_clashing_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "a b", "x", 2)],
                               "doc_id long, text string, source string, offset int")
    rows = packing.pack(df, WORD, window=4).collect()
    assert sum(r.length for r in rows) == 1 + 1 + 3
    assert sorted(r.source for r in rows if r.doc_id == 1) == ["", ""]
    assert packing.pack(df.limit(0), WORD).count() == 0
    assert packing.pack(df, WORD, targets={"x": 1}, window=4).agg({"length": "sum"}).first()[0] == 5
