"""Line templates: hand-made cases, and the DuckDB statement on other rows."""
import hashlib
import random

import duckdb
import pandas as pd

from eraspark.llm import line_templates as T


def rows_of(spark, rows):
    df = spark.createDataFrame([(*r, "c", 7) for r in rows], "doc_id long, text string, leaf string, n_dropped int")
    return T.drop_recurring_lines(df)


def prose(rng, k):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") * rng.randint(1, 4) for _ in range(k))


def test_boilerplate_goes_copies_stay(spark):
    rng = random.Random(1)
    story = "\n".join(prose(rng, 30) for _ in range(4))
    rows = [(i, f"{prose(rng, 20)}\nPrinted on page {i} of {i + 9}\n\nAll rights reserved by {'Ann' if i % 2 else 'Bob'} and the heirs of the house\n{prose(rng, 20)}")
            for i in range(30)]
    rows += [(100 + i, story) for i in range(50)]                       # exact copies
    rows += [(200 + i, story + f"\n{prose(rng, 9)}") for i in range(40)]  # near copies
    got = {r.doc_id: r for r in rows_of(spark, rows).collect()}
    for d, text in rows:
        if d < 100:
            first, *_, last = text.split("\n")
            assert got[d].text == f"{first}\n\n{last}" and (got[d].n_lines, got[d].n_dropped) == (5, 2)
        else:
            assert got[d].text == text and got[d].n_dropped == 0
    assert got[5].leaf == "c"


def test_nulls_blank_long_and_empty(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "\n \n"), (3, "x" * 200000)]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows_of(spark, rows).collect()), key=repr)
    assert got == sorted([(1, None, 0, 0), (1, None, 0, 0), (None, "", 1, 0), (2, "\n \n", 3, 0), (3, "x" * 200000, 1, 0)], key=repr)
    assert rows_of(spark, rows).limit(0).count() == 0
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.drop_recurring_lines(df).count() == 0


def test_same_rows_as_sql(spark):
    rng = random.Random(4)
    lines = [prose(rng, k) for k in (3, 5, 8, 12)] + ["a b c {0} e f g h", "a b c d {0} {1} g h", "Total {0} of {1} items"]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randint(1, 6)) for _ in range(rng.randint(0, 4))]
        parts += [rng.choice(lines).format(rng.randint(0, 99), rng.choice("xyz")) for _ in range(rng.randint(0, 3))]
        rng.shuffle(parts)
        rows.append((i, rng.choice(rows)[1] if i and rng.random() < 0.2 else rng.choice(["\n", "\n\n"]).join(parts)))
    rows.append((500, None))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = sorted(duckdb.sql(T.SQL).fetchall())
    got = rows_of(spark, rows).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got) == want
    assert sum(r[2] for r in want) > 20


def test_variable_field_without_digits_after_three_tokens(spark):
    rng = random.Random(7)
    rows = [(i, f"{prose(rng, 20)}\n{prose(rng, 20)}\nFiled under topic {prose(rng, 1)}{'q' * i} in the archive of the house\n{prose(rng, 20)}") for i in range(30)]
    got = {r.doc_id: r for r in rows_of(spark, rows).collect()}
    for d, text in rows:
        first, second, _, last = text.split("\n")
        assert got[d].text == f"{first}\n{second}\n{last}" and got[d].n_dropped == 1


def test_two_templates_in_one_leaf(spark):
    rng = random.Random(8)
    word = lambda i: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(4)) + "q" * i
    rows = []
    for i in range(30):
        rows.append((i, f"{prose(rng, 40)}\nFiled under the heading of {word(i)} in our old archive room"))
        rows.append((100 + i, f"{prose(rng, 40)}\nFiled under the name {word(i)} by some clerk long gone now"))
    got = {r.doc_id: r for r in rows_of(spark, rows).collect()}
    assert [(got[d].text, got[d].n_dropped) for d, _ in rows] == [(t.split("\n")[0], 1) for _, t in rows]


def test_pages_that_are_mostly_boilerplate(spark):
    rng = random.Random(9)
    shared = [prose(rng, 8) for _ in range(6)]
    rows = [(i, "\n".join(shared[:3] + [prose(rng, 9) for _ in range(4)] + shared[3:])) for i in range(40)]
    got = {r.doc_id: r for r in rows_of(spark, rows).collect()}
    assert [(got[d].text.split("\n"), got[d].n_dropped) for d, _ in rows] == [(t.split("\n")[3:7], 6) for _, t in rows]


def test_same_rows_as_sql_with_many_templates_a_leaf(spark):
    rng = random.Random(10)
    rows = [(i, "\n".join([prose(rng, 12) for _ in range(3)] + [" ".join(["a", "b", "c", *(rng.choice("xy") for _ in range(rng.choice([4, 6])))]) for _ in range(4)]))
            for i in range(150)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = sorted(duckdb.sql(T.SQL).fetchall())
    got = rows_of(spark, rows).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got) == want
    assert sum(r[2] for r in want) > 20
