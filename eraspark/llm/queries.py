"""Registered queries of the training-data operators: ``QUERIES`` maps each
name to a builder ``(spark, sf_dir) -> DataFrame``, ``SQL`` holds the DuckDB
statement where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_path
from . import bpe, histogram_sort, jaccard, langid, line_templates, packing, periodic, perplexity, prefix_trie, pu_quality, simhash, suffix_dedup, wavelet
from .common import documents, held_out

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of both."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    both = bpe.encode(docs, WORD_BPE, decoded_col="decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form; likenesses; for
    every id divisible by 50 also ``n_near``, the documents whose fingerprint
    lies within the search radius of its own (itself included)."""
    pairs = simhash.edited(documents(spark, sf_dir))
    keys = ["doc_id", "twin", "r", "n_chars", "edited_sha256"]
    rows = pairs.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("t")),
                                                F.struct(F.lit(1).alias("form"), F.col("edited").alias("t")))).alias("x"))
    prints = simhash.fingerprints(both.select(*keys, "x.form", "x.t"), [*keys, "form"], "t")
    own = F.struct("form", "hi", "lo")
    prints = prints.groupBy(*keys).agg(F.min(own).alias("a"), F.max(own).alias("b"))
    prints = materialize(prints.select(*keys, F.col("a.hi").alias("hi"), F.col("a.lo").alias("lo"),
                                       F.col("b.hi").alias("e_hi"), F.col("b.lo").alias("e_lo")), keep_partitioning=False)
    total = prints.count()
    following = prints.select(F.expr(f"(r - 1 + {total}) % {max(1, total)}").alias("r"), F.col("hi").alias("x_hi"), F.col("lo").alias("x_lo"))
    asked = prints.filter("doc_id % 50 = 0")
    copies = prints.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("copies"))
    near = (simhash.within(prints, asked).join(copies, ["hi", "lo"])
            .groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("copies").alias("n_near")))
    return (prints.join(following, "r").join(near, ["hi", "lo"], "left")
            .select("doc_id", "n_chars", "edited_sha256", simhash.as_hex().alias("fingerprint"),
                    simhash.as_hex("e_hi", "e_lo").alias("edited_fingerprint"),
                    simhash.likeness("hi", "lo", "e_hi", "e_lo").alias("near_edited"),
                    simhash.likeness("hi", "lo", "x_hi", "x_lo").alias("near_next"),
                    F.when(F.col("doc_id") % 50 == 0, F.col("n_near")).alias("n_near")))


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ids, each document closed by id 0, as wavelet shards; read them back."""
    docs = wavelet.ordered(documents(spark, sf_dir).select("doc_id", "text"))
    spec = bpe.spec_of(spark, BYTE_BPE)

    def encoder():
        encode = bpe.load(bpe.Bpe, spec.value, True).encode
        return lambda text: encode(text or "") + bytes(4)
    folder = shared_path(spark, "wavelet")
    manifest = wavelet.write_shards(docs, folder, ids_col="text", encoder=encoder)
    back = wavelet.read_shards(manifest, folder)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that no earlier 100-byte string covers."""
    cut = suffix_dedup.repeated_spans(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity bands over every document."""
    judged = perplexity.quality_rules(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, from the positives not held out."""
    docs = documents(spark, sf_dir).select("doc_id", held_out().alias("held_out"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    positives = labels.filter((F.col("quality") == 1) & ~held_out()).select("doc_id")
    return pu_quality.classify(docs, positives).select("doc_id", "held_out", "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into windows of 4096 tokens at the corpus's own mixture."""
    pieces = packing.pack(documents(spark, sf_dir), WORD_BPE, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset", "source")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets overlap by 85 %."""
    return jaccard.jaccard_components(documents(spark, sf_dir), words=4, percent=85)


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recurring templates taken out of every document."""
    left = line_templates.drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return left.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out()))
    named = langid.identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return named.select("doc_id", "held_out", "lang_pred", "score")


def op11_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes, ordered by the hash
    of their text, then id, so that equal texts lie together."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1,
                             "text_hash": F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)})
    placed = histogram_sort.histogram_sort(docs, 8, key="text_hash", tie="doc_id", size="size")
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                         F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document; in those whose number says so, the
    words from one on are first replaced by a repeated stretch of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = documents(spark, sf_dir).select("doc_id", "text", F.floor(h / 10).alias("g"),
                                           F.when(h % 10 == 0, words).alias("w"))
    docs = docs.withColumn("a", F.expr("if(size(w) > 0, cast(g % size(w) as int), null)"))
    docs = docs.withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast((size(w) - a) div p + 1 as int))), 1, size(w) - a)")
    changed = F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " ")
    found = periodic.find_runs(docs.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text")))
    best = F.aggregate("runs", F.expr("runs[0]"), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumns({"best": F.when(F.size("runs") > 0, best),
                               "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")})
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, each rebuilt on the first turns of the one
    whose id is the next lower multiple of 20."""
    turns = prefix_trie.numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turns = materialize(turns.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4,
                                           "base": F.expr("conv_id - conv_id % 20")}), keep_partitioning=False)
    convs = materialize(turns.select("conv_id", "h", "base").distinct(), keep_partitioning=False)
    heads = turns.filter("conv_id = base and i <= 3").select("base", "i", "t1", "t2", "words")
    taken = convs.join(heads, "base").filter("i <= h").select("conv_id", F.col("i").alias("depth"), "t1", "t2", "words")
    found = heads.groupBy("base").agg(F.count(F.lit(1)).alias("k"))
    own = (turns.filter("i > h").join(found, "base", "left")
           .select("conv_id", F.expr("i - h + least(h, coalesce(k, 0))").alias("depth"), "t1", "t2", "words"))
    return prefix_trie.prefix_trie(taken.union(own), convs.select("conv_id"))


QUERIES = {"op1_bpe": op1_bpe, "op2_simhash": op2_simhash, "op3_wavelet": op3_wavelet, "op4_suffix_dedup": op4_suffix_dedup, "op5_perplexity": op5_perplexity, "op6_quality": op6_quality, "op7_packing": op7_packing,
           "op8_jaccard": op8_jaccard, "op9_line_templates": op9_line_templates,
           "op10_langid": op10_langid, "op11_histogram_sort": op11_histogram_sort, "op12_periodic": op12_periodic,
           "op13_prefix_trie": op13_prefix_trie}
SQL: dict[str, str] = {"op9_line_templates": line_templates.SQL}
