"""Dictionary-encoded documents and ranks over ranges, against plain lists."""
import random

from pyspark.sql import functions as F

from eraspark.operators import encode as EN
from eraspark.operators.lemma import lemmatize
from eraspark.operators.ranking import range_rank


def _docs(spark):
    rng = random.Random(4)
    texts = {i: [rng.choice(["the", "the", "the", "a", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 40))] for i in range(60)}
    texts[60] = ["the"] * 5000
    texts[61], texts[62] = [], None
    return texts, spark.createDataFrame(list(texts.items()), "id long, toks array<string>").withColumn("toks", F.coalesce("toks", F.array().cast("array<string>")))


def test_range_rank_equals_a_sort(spark):
    rng = random.Random(2)
    words = sorted({"prefix" + "".join(rng.choice("ab") for _ in range(12)) for _ in range(2000)})
    rows = list(words)
    rng.shuffle(rows)
    ranked = range_rank(spark.createDataFrame([(w,) for w in rows], "w string").repartition(5), ["w"], "r")
    assert sorted((r.r, r.w) for r in ranked.collect()) == list(enumerate(words, 1))
    assert range_rank(ranked.filter("r < 0").drop("r"), ["w"]).count() == 0


def test_encode_equals_a_lookup_of_each_token(spark):
    texts, docs = _docs(spark)
    words = EN.dictionary(docs.select(F.explode("toks").alias("token"), F.lit(1).alias("n")), min_count=2)
    ids = {r.token: r.token_id for r in words.collect()}
    uses = [t for ts in texts.values() for t in ts or []]
    assert sorted(ids, key=ids.get) == sorted({t for t in uses if uses.count(t) >= 2}) and sorted(ids.values()) == list(range(len(ids)))
    for first in (None, 7):
        got = {r.id: (r.n_tokens, r.ids) for r in EN.encode(docs, "id", F.col("toks"), words, "token_id", first=first).collect()}
        assert got == {i: (len(ts or []), [ids[t] for t in (ts or [])[:first] if t in ids]) for i, ts in texts.items()}


def test_lookup_joins_pairs_not_occurrences(spark):
    _, docs = _docs(spark)
    pairs = EN.token_pairs(docs, "id", F.col("toks"))
    assert pairs.filter("id = 60").select("token", "n").collect() == [("the", 5000)]
    words = EN.dictionary(pairs)
    for head in (1, 2, 10_000):                # no, some or all tokens broadcast
        found = EN.look_up(pairs, words, head=head)
        assert found.count() == pairs.count() and found.filter("token_id is null").count() == 0
    some = words.filter("token != 'the'")
    assert EN.look_up(pairs, some, "inner").count() == pairs.filter("token != 'the'").count()
    assert EN.look_up(pairs, some, "left").count() == pairs.count()
    assert EN.look_up(pairs, words.limit(0), "left").count() == pairs.count()


def test_lemmas_keep_the_order(spark):
    docs = spark.createDataFrame([(1, ["cats", "like", "dogs", "cats"]), (2, ["no"])], "id long, toks array<string>")
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("unused", "x")], "word string, lemma string")
    got = {r.id: (r.n_tokens, r.lemmas) for r in lemmatize(EN.token_pairs(docs, "id", F.col("toks")), lemmas).collect()}
    assert got == {1: (4, "cat like dog cat"), 2: (1, "no")}
