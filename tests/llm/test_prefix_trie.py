"""The trie against one built node by node, and the sketch's promise."""
import hashlib
import random
import zlib

import pytest

from conftest import SF001, SF01
from eraspark.llm import prefix_trie as P
from eraspark.llm import queries

def n_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return sum(w != "" for w in text.split(" "))


def plain_trie(convs):
    """{conv: [(role, text)]} -> rows, by going down every conversation."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)]
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                 sum(len(q) == len(path) + 1 for q in below), len(leaves),
                 sum((len(nodes[p]) - 1) * n_words(p[-1][1]) for p in below if p),
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def fast_trie(convs):
    """The same for many nodes: children linked to parents, sums from the deepest up."""
    members, kids = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = sum(saved[q] for q in below) + ((len(members[p]) - 1) * n_words(p[-1][1]) if p else 0)
        ends = sorted(c for c in members[p] if len(convs[c]) == len(p))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p],
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.collect()]
    assert len(set(got)) == len(got)
    return set(got)


def trie(spark, convs, **kw):
    rows = [(c, i, r, t, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return rows_of(P.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string").repartition(3)))


def test_plain_tries_agree():
    convs = {c: [("u", "ab"[c % 2]), *[("a", f"t {c % (d + 2)}") for d in range(c % 4)]] for c in range(12)}
    assert plain_trie(convs) == fast_trie(convs)


@pytest.mark.parametrize("cells", [None, 8])
def test_random_conversations(spark, monkeypatch, cells):
    if cells:                                              # a full sketch: nothing is proven single, all is grouped
        monkeypatch.setattr(P, "_LEAST_CELLS", cells)
        monkeypatch.setattr(P, "MOST_CELLS", cells)
    rng = random.Random(8)
    convs = {c: [(rng.choice("ua"), rng.choice(["", "x y", "x\ty z", "w" * 3000])) for _ in range(rng.randint(1, 6))] for c in rng.sample(range(-50, 900), 120)}
    convs |= {1000 + c: [("u", "hot"), ("a", "start"), *[("u", str(c))] * (c % 3)] for c in range(90)}
    convs |= {2000 + c: [("u", "hot"), ("a", "the same")] for c in range(100)}
    assert trie(spark, convs) == fast_trie(convs)


def test_many_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "_PIECE", 20)
    convs = {c: [("u", "one")] for c in range(300)}
    assert trie(spark, convs) == fast_trie(convs)


def test_a_long_conversation(spark):
    convs = {1: [("u", str(i)) for i in range(3000)], 2: [("u", str(i)) for i in range(2999)]}
    got = trie(spark, convs)
    assert len(got) == 3001 and max(r[1] for r in got) == 3000
    assert next(r for r in got if r[1] == 0)[3:7] == (2, 1, 1, 2999)


def test_screening_proves_only_single_prefixes(spark, monkeypatch):
    monkeypatch.setattr(P, "_LEAST_CELLS", 1 << 10)
    monkeypatch.setattr(P, "CELLS_EACH", 1)
    rng = random.Random(3)
    turns = [(c, d, rng.randint(0, 2) if d < 3 else rng.getrandbits(40), 0, 1) for c in range(500) for d in range(1, 6)]
    rows = P.materialize_bucketed(P._prefixes(spark.createDataFrame(turns, "conv_id long, depth long, t1 long, t2 long, words long")), "conv_id")
    screened = P._screened(rows)
    plan = screened._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan               # tails are told apart where their rows lie
    got = screened.collect()
    counts = {}
    for r in got:
        counts[r.depth, r.p1, r.p2] = counts.get((r.depth, r.p1, r.p2), 0) + 1
    single = [r for r in got if not r.shared]
    assert all(counts[r.depth, r.p1, r.p2] == 1 for r in single) and len(single) > 500
    assert sum(r.first for r in got) == len({r.conv_id for r in single}) and all(not r.shared for r in got if r.first)
    assert all(r.shared for r in got if r.tail) and all(r.depth > 1 for r in single if not r.first)


def test_odd_rows(spark):
    kinds = "conv_id long, turn long, role string, text string"
    rows = [(None, 1, "u", "lost"), (1, 2, "u", "b"), (1, None, None, None), (2, 0, "", ""), (2, 5, "u", "b"), (2, 5, "u", "b"), (3, 1, "a", "q"), (3, 1, "a", "q")]
    convs = {1: [("", ""), ("u", "b")], 2: [("", ""), ("u", "b"), ("u", "b")], 3: [("a", "q"), ("a", "q")]}
    assert rows_of(P.conversation_trie(spark.createDataFrame(rows, kinds))) == fast_trie(convs)
    assert P.conversation_trie(spark.createDataFrame([], kinds)).count() == 0


def rebuilt(table):
    own = {}
    for r in table:
        own.setdefault(r.conv_id, []).append(r)
    own = {c: [(r.role or "", r.text or "") for r in sorted(rs, key=lambda r: (r.turn is not None, r.turn or 0))] for c, rs in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_query(spark, folder):
    want = fast_trie(rebuilt(spark.read.parquet(f"{folder}/conversations.parquet").collect()))
    df = queries.QUERIES["op13_prefix_trie"](spark, folder)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(df) == want
    assert any(r[1] == 0 for r in want)
