"""Byte-pair encoding and decoding with a published vocabulary.

Merging follows the queue form of the algorithm. The symbols of one word are
a doubly linked list; a priority queue holds (merge rank, position) of every
adjacent pair that has a merge. The lowest entry is taken, skipped when a
neighbour has changed meanwhile (a stale entry), else applied, and the two
new neighbour pairs are queued. Decoding concatenates vocabulary strings as
the tokenizer file's decoder says.

Around the merges, the tokenizer file's own rules hold: added tokens are cut
out first, then normalisation, splitting and the byte alphabet. The ids of a
word are kept in a bounded memory, so frequent words are merged once per
worker. Texts of characters outside ``PLAIN`` go through the library's own
normaliser and splitter, unit by unit (cut at blanks that no token crosses).
"""

from __future__ import annotations

import json
import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words whose ids a worker remembers: two generations of so many.
MEMORY_ENTRIES = 300_000
# ASCII and the letters of Latin-1 and Latin Extended-A: unchanged by NFC,
# lower-cased one by one, and letters to the files' patterns. (Without the
# dotted capital I, whose lower case is two characters.)
PLAIN = "\\n\\r\\t -~À-ÖØ-öø-įı-ſ"
LETTERS = "À-ÖØ-öø-ſ"


def byte_alphabet() -> dict[int, str]:
    """Each byte's printable stand-in: itself where Latin-1 prints it, else
    the next free code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def merge_symbols(symbols: list[int], rules: dict[int, int], merged: list[int]) -> list[int]:
    """Apply the merges lowest rank first, leftmost first within a rank.
    ``rules`` maps left << 32 | right to the rank, ``merged`` the rank to the
    new symbol. Queue entries are rank << 40 | position."""
    n = len(symbols)
    if n < 2:
        return symbols
    find = rules.get
    queue = []
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        if (rank := find(left << 32 | right)) is not None:
            queue.append(rank << 40 | i - 1)
        left = right
    if not queue:
        return symbols
    heapify(queue)
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    while queue:
        entry = heappop(queue)
        i = entry & 0xFFFFFFFFFF
        j = after[i]
        if j < 0 or symbols[i] < 0:
            continue                                   # stale: a side is gone
        new = merged[entry >> 40]
        rank = find(symbols[i] << 32 | symbols[j])
        if rank is None or merged[rank] != new:
            continue                                   # stale: a side has grown
        symbols[i], symbols[j] = new, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (rank := find(new << 32 | symbols[k])) is not None:
                heappush(queue, rank << 40 | i)
        p = before[i]
        if p >= 0 and (rank := find(symbols[p] << 32 | new)) is not None:
            heappush(queue, rank << 40 | p)
    return [s for s in symbols if s >= 0]


# The first so many words a worker meets, most of them frequent, are looked up
# in a table of their own that stays in the processor's cache.
FIRST_WORDS = 6_000


class _Memory(dict):
    """Remembers ``make(key)``. When full, the entries become the older
    generation, from which those still in use come back one by one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        if len(self) >= MEMORY_ENTRIES:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Decoder:
    """Ids back to text: vocabulary strings, put together as the tokenizer
    file's decoder says (without one, joined by blanks)."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        named = [*parsed["model"]["vocab"].items(), *((t["content"], t["id"]) for t in parsed["added_tokens"])]
        self.strings = [""] * (1 + max(i for _, i in named))
        for text, i in named:
            self.strings[i] = text
        bytewise = (parsed["decoder"] or {}).get("type") == "ByteLevel"
        self.bytes_of = {c: b for b, c in byte_alphabet().items()} if bytewise else None

    def decode(self, ids: list[int]) -> str:
        found = map(self.strings.__getitem__, ids)
        if (back := self.bytes_of) is None:
            return " ".join(found)
        out = b"".join(bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s in found)
        return out.decode("utf-8", "replace")

    def unpack(self, ids: bytes) -> str:
        return self.decode(np.frombuffer(ids, "<u4").tolist())


class Bpe:
    """Encoder for one tokenizer file (its JSON text).

    ``library_merges`` hands the merges of a word to the tokenizers library
    instead of :func:`merge_symbols`; ids are the same. All ids travel as
    little-endian unsigned 32-bit integers in ``bytes``.
    """

    def __init__(self, spec: str, library_merges: bool = False):
        from tokenizers import Tokenizer
        parsed = json.loads(spec)
        model = parsed["model"]
        self.library = Tokenizer.from_str(spec)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.rules, self.merged = {}, []
        for rank, (a, b) in enumerate([] if library_merges else model["merges"]):
            self.rules[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.merged.append(self.vocab[a + b])
        self.added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.added_re = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.alphabet = byte_alphabet()
        self.blank_joins = parsed["normalizer"] is None     # a blank belongs to the word after it
        self.back = {c: b for b, c in self.alphabet.items()}
        self.plain = re.compile(f"[{PLAIN}]*")
        # The files' splitting patterns, spelt out for plain characters.
        if self.blank_joins:
            self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{LETTERS}]+| ?[0-9]+| ?[^\sA-Za-z0-9{LETTERS}]+|\s+(?!\S)|\s+")
        else:
            self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^\sa-z0-9{LETTERS}]+")
        self.first: dict[str, bytes] = {}
        self.shown = {b: c for b, c in self.alphabet.items() if chr(b) != c}
        self.words = _Memory(self._library_word if library_merges else self._queue_word)
        self.units = _Memory(self._unit)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _queue_word(self, word: str) -> bytes:
        shown = [*self._letters(word)]
        shown[-1] += self.suffix
        symbols = [s for s in map(self.vocab.get, shown) if s is not None]
        return self._pack(merge_symbols(symbols, self.rules, self.merged))

    def _library_word(self, word: str) -> bytes:
        return self._pack([t.id for t in self.library.model.tokenize(self._letters(word))])

    def _letters(self, word: str) -> str:
        """The word's bytes in the byte alphabet."""
        return (word if word.isascii() else word.encode().decode("latin-1")).translate(self.shown)

    def _joined(self, words: list[str]) -> bytes:
        first, rest = self.first.get, self.words
        out = [first(w) or rest[w] for w in words]
        if len(self.first) < FIRST_WORDS:
            self.first.update(zip(words, out))
        return b"".join(out)

    def _unit(self, unit: str) -> bytes:
        """Ids of a piece of text that no token crosses the ends of, split by the library."""
        if self.library.normalizer is not None:
            unit = self.library.normalizer.normalize_str(unit)
        words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(unit)] if unit else []
        return b"".join([self.words[bytes(map(self.back.__getitem__, w)).decode()] for w in words])

    def _stretch(self, text: str) -> bytes:
        if self.plain.fullmatch(text):
            return self._joined(self.split.findall(text if self.blank_joins else text.lower()))
        units = text.split(" ")
        if self.blank_joins:
            if _BLANK_RUN.search(text):
                units = _rejoin(units)
            units = units[:1] + [" " + u for u in units[1:]]
        return b"".join(map(self.units.__getitem__, units))

    def encode(self, text: str) -> bytes:
        if self.added_re and self.added_re.search(text):
            return b"".join(self._pack([self.added[p]]) if p in self.added else self._stretch(p)
                            for p in self.added_re.split(text) if p)
        return self._stretch(text)


_BLANK_RUN = re.compile(r"\s ")


def _rejoin(units: list[str]) -> list[str]:
    """Put back together what was cut at a blank that follows white space:
    such a blank may share a token with the white space before it."""
    out = [units[0]]
    for u in units[1:]:
        if out[-1] == "" and len(out) == 1 or (out[-1] and not out[-1][-1].isspace()):
            out.append(u)
        else:
            out[-1] += " " + u
    return out


_LOADED: dict = {}


def load(kind, spec: str, *args):
    """The worker's encoder or decoder for a tokenizer file, built once per process."""
    key = (kind, hash(spec), len(spec), *args)
    if key not in _LOADED:
        _LOADED[key] = kind(spec, *args)
    return _LOADED[key]


def spec_of(spark, path: str):
    """Broadcast the tokenizer file's text: a few MB, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids",
           library_merges: bool = False, decoded_col: str | None = None) -> DataFrame:
    """``df`` with ``ids_col`` (binary, little-endian unsigned 32-bit) next to
    its own columns; with ``decoded_col``, also what those ids decode to. Null
    text encodes as the empty text; columns already named so are replaced. Every
    row is encoded by itself and whole, however long, so repeated rows and any
    order give the same ids. An empty table gives no rows."""
    import pyarrow as pa
    from .common import slices
    more = [ids_col] + [decoded_col] * bool(decoded_col)
    df = df.drop(*more)
    spec = spec_of(df.sparkSession, tokenizer)
    schema = df.withColumn(ids_col, F.lit(b"")).schema
    schema = schema.add(decoded_col, "string") if decoded_col else schema

    def run(batches):
        bpe = load(Bpe, spec.value, library_merges)
        back = load(Decoder, spec.value) if decoded_col else None
        for batch in batches:
            for part in slices(batch, text_col):
                ids = [bpe.encode(t or "") for t in part.column(text_col).to_pylist()]
                new = [pa.array(ids, pa.binary())]
                if decoded_col:
                    new.append(pa.array([back.unpack(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *more])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its packed ids; null ids decode as empty. A column
    already named ``out_col`` is replaced. Every row is decoded by itself and
    whole. An empty table gives no rows."""
    import pyarrow as pa
    from .common import slices
    df = df.drop(out_col)
    spec = spec_of(df.sparkSession, tokenizer)
    schema = df.withColumn(out_col, F.lit("")).schema

    def run(batches):
        back = load(Decoder, spec.value)
        for batch in batches:
            for part in slices(batch, ids_col):
                texts = [back.unpack(x or b"") for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 names=[*part.schema.names, out_col])
    return df.mapInArrow(run, schema)
