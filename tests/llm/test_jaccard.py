"""Jaccard join against all pairs on small tables."""
import random
import re

import pytest

from conftest import SF001
from eraspark.llm.components import components
from eraspark.llm.jaccard import jaccard_components


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("words,percent", [(4, 85), (2, 50)])
def test_near_copies_against_all_pairs(spark, words, percent):
    rng = random.Random(words)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.choice([3, 40, 120]))] for _ in range(8)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i * 3 % 161, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one two"), (504, "ONE  two"), (None, "one two"),
             (505, "é\x85b \xa0 c d e"), (505, "é\x85b \xa0 c d e"), (None, "lonely words of no other row"), (506, "x" * 100000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component string")
    assert got(jaccard_components(df, words, percent)) == brute(rows, words, percent)


def test_chain_of_links_and_one_large_group(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([f"n{j}" for j in range(i)] + base[i:])) for i in range(40)]
    rows += [(1000 + i, " ".join(base + [f"t{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_components(df, 4, 85)) == brute(rows, 4, 85)


def test_query_against_all_pairs(spark):
    from eraspark.llm.queries import op8_jaccard
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert got(op8_jaccard(spark, SF001)) == brute(rows, 4, 85)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (3, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 10), (None, 1)], "p long, q long")
    assert sorted(map(tuple, components(df, "p", "q").collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 6), (9, 6), (10, 6)]
    assert components(df.filter("p = 3 and q = 3"), "p", "q").count() == 0


def test_signatures_differ_in_no_more_bits_than_their_sets():
    import numpy as np
    import pyarrow as pa

    from eraspark.llm.jaccard import _apart, signature
    rng = np.random.default_rng(3)
    pairs = []
    for n in (0, 1, 5, 64, 65, 130, 700):
        for change in (0, 1, 7, n):
            s = np.unique(rng.integers(-2**63, 2**63, n))
            pairs.append((s, np.unique(np.concatenate([s[min(change, n):], rng.integers(-2**63, 2**63, change)]))))
    column = lambda side: pa.array([signature(p[side]) for p in pairs], pa.list_(pa.int64()))
    apart = _apart(column(0), column(1))
    true = [len(np.setxor1d(*p)) for p in pairs]
    assert all(x <= t and (x - t) % 2 == 0 for x, t in zip(apart.tolist(), true))
    # Sets that share nothing are told apart.
    assert apart[-1] > 700 * 2 // 9 and apart.tolist() == _apart(column(1), column(0)).tolist()
    assert _apart(column(0).slice(3, 9), column(1).slice(3, 9)).tolist() == apart[3:12].tolist()


def test_sets_and_prefixes_do_not_stay_on_disk(spark):
    import glob

    from eraspark.session import ensure_checkpoint_dir
    at = ensure_checkpoint_dir(spark).removeprefix("file://")
    there = set(glob.glob(f"{at}/table-*"))
    base = [[f"b{k}w{i}" for i in range(60)] for k in range(3)]
    rows = [(i, " ".join([*base[i % 3][:i], f"x{i}", *base[i % 3][i + 1:]])) for i in range(30)]
    df = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    left = {c for t in set(glob.glob(f"{at}/table-*")) - there for c in spark.read.parquet(t).columns}
    assert not left & {"shingles", "token", "pos"}
    assert got(df) == brute(rows, 2, 80)
