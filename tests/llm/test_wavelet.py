"""Wavelet shards against plain arrays, and the query's round trip."""
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF001
from eraspark.llm import wavelet


@pytest.mark.parametrize("n,top,block", [(0, 1, 64), (1, 1, 64), (500, 7, 64), (3000, 50257, 256), (700, 1, 64)])
def test_shard_answers(n, top, block, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", block)
    rng = np.random.default_rng(n + top)
    ids = (rng.zipf(1.3, n) % top).astype(np.uint32) if n else np.zeros(0, np.uint32)
    ends = sorted({0, n // 3, n})
    shard = wavelet.Shard(io.BytesIO(wavelet.pack(ids, [None] + [7] * (len(ends) - 1), ends)))
    assert shard.decode().tolist() == ids.tolist()
    assert shard.doc_ids[0] is None and shard.doc_ends.tolist() == ends
    for i in rng.integers(0, n, min(n, 60)).tolist():
        assert shard.access(i) == ids[i]
        assert shard.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
    for v in list(dict.fromkeys(ids.tolist()))[:10]:
        where = np.flatnonzero(ids == v).tolist()
        assert shard.occurrences(v)[:20] == where[:20] and shard.count(v) == len(where)
        assert shard.count(v, n // 4, n // 2) == int((ids[n // 4:n // 2] == v).sum())
    assert shard.count(1 << 20) == 0
    for j, e in enumerate(ends[:2]):
        assert shard.document(j) == ids[(ends[j - 1] if j else 0):e].tolist()


def test_query_round_trip(spark):
    from eraspark.llm.queries import op3_wavelet
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op3_wavelet(spark, SF001).collect()}
    at = 0
    assert set(rows) == set(texts)
    for d in sorted(texts):
        ids = np.asarray(lib.encode(texts[d], add_special_tokens=False).ids + [0], "<u4")
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_small_shards_nulls_and_repeats(spark, tmp_path):
    df = spark.createDataFrame([(None, b"\x01\0\0\0", "x"), (3, None, "y"), (3, None, "y"), (5, b"\x02\0\0\0" * 9, "z")],
                               "doc_id long, ids binary, path string")
    ordered = wavelet.ordered(df, text_col="ids")
    folder = f"file://{tmp_path}/w"
    manifest = wavelet.write_shards(ordered, folder, shard_tokens=2)
    rows = sorted(wavelet.read_shards(manifest, folder).collect(), key=lambda r: (r.doc_id or 0, r.start))
    assert [(r.doc_id, r.start, len(r.ids) // 4) for r in rows] == [(None, 0, 1), (3, 1, 0), (3, 1, 0), (5, 1, 9)]
    empty = wavelet.write_shards(ordered.limit(0), f"file://{tmp_path}/e")
    assert wavelet.read_shards(empty, f"file://{tmp_path}/e").count() == 0
