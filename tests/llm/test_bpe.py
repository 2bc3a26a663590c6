"""BPE against the tokenizers library on whole texts."""
import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF001
from eraspark.llm import bpe

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PAIRS = {}


def pair(name):
    if name not in PAIRS:
        spec = open(public_tokenizers.path(name), encoding="utf-8").read()
        PAIRS[name] = (Tokenizer.from_str(spec), bpe.Bpe(spec), bpe.Bpe(spec, library_merges=True), bpe.Decoder(spec))
    return PAIRS[name]


def same(name, text):
    lib, own, mixed, back = pair(name)
    want = lib.encode(text, add_special_tokens=False).ids
    for enc in (own, mixed):
        got = np.frombuffer(enc.encode(text), "<u4").tolist()
        assert got == want, (name, text)
    assert back.decode(want) == lib.decode(want, skip_special_tokens=False)


CASES = ["", " ", "  ", "a  b", "a   b ", " a", "  a", "\n a\n\n b \n", "a \nb", "x\t y", "tail   ",
         "Hello <|endoftext|> World's café café 123  x İ ẞ  ", "<|endoftext|><|startoftext|>",
         "<|EndOfText|>x", "ΑΣ Σ", "a‍b \U0001F642\t\n'S 'll'LL don't ½²",
         " \x1c\x85\x00a ﬁ ǅ", "  　 x", "́ ́a", "word" * 3000, "!!! ### $$%%", "\r\n \r\n", "Ã© é Ÿÿ İı ŉ ſ ĳ ª º µ × ÷ ² Straße ÀÉÎ d'Été", "naïve <|endoftext|>Ünï  x"]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("text", CASES)
def test_cases(name, text):
    same(name, text)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(" \n\t'sSaAtTé1.# "), st.characters(codec="utf-8", max_codepoint=0x2fff)), max_size=60))
def test_any_text(name, text):
    same(name, text)


def test_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_ENTRIES", 3)
    lib, own, _, _ = pair(FILES[0])
    own.units.clear(), own.words.clear()
    text = " ".join(f"w{i % 9} the x{i}" for i in range(60))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(own.words) <= 3 and len(own.words.older) <= 3


def test_query_equals_library(spark):
    from eraspark.llm.queries import op1_bpe
    lib = pair(FILES[0])[0]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = op1_bpe(spark, SF001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_clashing_columns_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x", 5), (1, None, "x", 5), (None, "a b", "y", 6)],
                               "doc_id long, text string, ids string, extra int")
    out = bpe.decode(bpe.encode(df, public_tokenizers.path(FILES[0])), public_tokenizers.path(FILES[0]))
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "extra", "ids", "decoded"] and len(rows) == 3
    both = bpe.encode(df, public_tokenizers.path(FILES[0]), decoded_col="decoded").collect()
    assert [(r.ids, r.decoded) for r in both] == [(r.ids, r.decoded) for r in rows]
    assert [r.decoded for r in rows] == ["", "", "a</w> b</w>"]
    assert bpe.encode(df.limit(0), public_tokenizers.path(FILES[0])).count() == 0
