"""Relational text features: terms, document frequency, vocabulary cap,
TF-IDF (long form), document vectors.

Weights follow the vectoriser the reference fits:
``idf = ln((1 + n) / (1 + df)) + 1``; ``w = tf * idf`` (or ``(1 + ln tf) * idf``
when sublinear); each document's weights are divided by their L2 norm over
the kept vocabulary. Spark ML's ``IDF`` uses another formula, so it is not used.

Physical layout: documents are keyed by ``doc`` and every per-document step
(term counts, norms) groups by ``doc`` first, so once the documents are
hash-partitioned by ``doc`` those steps need no further shuffle. Token skew
("the" in every document) is absorbed by map-side partial aggregation of the
per-term statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams_1_2, remove_stopwords, tokenize_word
from ..session import materialize
from .encode import HEAD
from .ranking import range_rank

# Vocabulary tables up to this many rows are broadcast to the term-weight
# join; V (max features) bounds the vocabulary, so the check is on V.
VOCAB_BROADCAST_MAX = 2_000_000
# Counts that one step of the search for the vocabulary's cut-off brings to the driver.
RADIX = 1 << 16


def doc_terms(docs: DataFrame, doc: str, text: str, stop_words=None,
              ngram_max: int = 2, keep=()) -> DataFrame:
    """One row per term occurrence: (doc, *keep, term)."""
    toks = remove_stopwords(tokenize_word(F.col(text)), stop_words)
    grams = ngrams_1_2(F.col("_t")) if ngram_max >= 2 else F.col("_t")
    return (docs.select(doc, *keep, toks.alias("_t"))
            .select(doc, *keep, F.explode(grams).alias("term")))


def term_frequencies(docs: DataFrame, doc: str = "doc", text: str = "text",
                     stop_words=None, ngram_max: int = 2, keep=()) -> DataFrame:
    """(doc, *keep, term, tf)."""
    return (doc_terms(docs, doc, text, stop_words, ngram_max, keep)
            .groupBy(doc, *keep, "term").agg(F.count(F.lit(1)).alias("tf")))


def term_doc_freq(tf: DataFrame, weight: str | None = None) -> DataFrame:
    """(term, df, total): documents containing the term and its total count.
    With ``weight`` (a whole number) a document counts that many times."""
    m = F.col(weight) if weight else F.lit(1)
    return tf.groupBy("term").agg(F.sum(m).cast("long").alias("df"), F.sum(F.col("tf") * m).cast("long").alias("total"))


#: Tokens counted at a time (a longer document stays whole).
COUNT_TOKENS = 1 << 20


def count_terms(tokens, ngram_max: int = 2):
    """(row, term, tf, terms) of an Arrow array of token lists: that ``row`` has
    ``terms[term]`` ``tf`` times; sorted by row, unigrams before bigrams."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    lengths = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False)
    coded = tokens.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    row = np.repeat(np.arange(len(tokens)), lengths)
    key, tf = np.unique(row * max(len(words), 1) + code, return_counts=True)
    found = [np.divmod(key, max(len(words), 1))]
    if ngram_max < 2:
        return *found[0], tf, words
    inside = np.flatnonzero(row[1:] == row[:-1])
    pairs, code = np.unique(code[inside] * len(words) + code[inside + 1], return_inverse=True)
    key, n = np.unique(row[inside] * max(len(pairs), 1) + code, return_counts=True)
    found.append(np.divmod(key, max(len(pairs), 1)))
    first, second = np.divmod(pairs, max(len(words), 1))
    grams = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), pa.scalar(" ", words.type))
    return (np.concatenate([r for r, _ in found]), np.concatenate([found[0][1], found[1][1] + len(words)]),
            np.concatenate([tf, n]), pa.concat_arrays([words, grams]))


def _parts(batch, column: str):
    """A batch cut to about ``COUNT_TOKENS`` tokens a part."""
    import pyarrow.compute as pc
    lo = total = 0
    for i, n in enumerate(pc.list_value_length(batch.column(column)).fill_null(0).to_pylist()):
        if total and total + n > COUNT_TOKENS:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def distinct_term_stats(docs: DataFrame, text: str, min_df: int = 1, stop_words=None, ngram_max: int = 2) -> DataFrame:
    """:func:`term_stats` of ``docs`` in which no document comes twice: every
    row is a document. Its terms are counted where it is read, some documents
    at a time, so what is grouped by term is a row for each term of those, not
    for each (document, term)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for part in _parts(batch, "_t"):
                _, term, tf, terms = count_terms(part.column("_t"), ngram_max)
                sums = np.bincount(term, tf, len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(term, minlength=len(terms))), pa.array(sums)], names=["term", "df", "total"])
    counts = docs.select(remove_stopwords(tokenize_word(F.col(text)), stop_words).alias("_t")).mapInArrow(run, "term string, df long, total long")
    sums = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    return materialize(sums.filter(F.col("df") >= min_df), keep_partitioning=False)


def tfidf_arrays(docs: DataFrame, vocab: DataFrame, text: str, keep, stop_words=None, sublinear: bool = False,
                 also: str | None = None, ngram_max: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows, index): for each row of ``docs``, taken as a document of its own,
    the columns of ``keep`` and arrays ``terms`` (numbers of its vocabulary
    terms, ascending) and ``weight``, the weights :func:`tfidf` gives (``also``:
    as there); ``index`` = (term, idx), terms numbered from 0 in term order.

    For a bounded ``vocab`` (term, idf): it is broadcast, so a document is
    weighed where it is read, and nothing is shuffled or sorted."""
    import pyarrow as pa
    spark = docs.sparkSession
    known = vocab.select("term", "idf").toArrow().combine_chunks().sort_by("term")
    # Not chunked, so that a worker gets two plain arrays.
    words = pa.concat_arrays(known.column("term").chunks) if known.num_rows else pa.array([], pa.string())
    held = spark.sparkContext.broadcast((words, known.column("idf").to_numpy()))
    index = spark.createDataFrame(pa.table({"term": words, "idx": pa.array(range(len(words)), pa.int32())}))
    kinds = {"weight": sublinear} | ({also: not sublinear} if also else {})

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc
        words, idf = held.value
        for batch in batches:
            for part in _parts(batch, "_t"):
                row, term, tf, terms = count_terms(part.column("_t"), ngram_max)
                place = pc.index_in(terms, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)[term]
                use = np.flatnonzero(place >= 0)
                use = use[np.argsort(row[use] * max(len(words), 1) + place[use])]
                row, place, tf = row[use], place[use], tf[use]
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]), pa.int32())
                new = [pa.ListArray.from_arrays(ends, pa.array(place, pa.int32()))]
                for sub in kinds.values():
                    w = ((1 + np.log(tf)) if sub else tf) * idf[place]
                    w = w / np.sqrt(np.bincount(row, w * w, part.num_rows))[row]
                    new.append(pa.ListArray.from_arrays(ends, pa.array(w)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*part.schema.names[:-1], "terms", *kinds])
    tokens = remove_stopwords(tokenize_word(F.col(text)), stop_words)
    schema = docs.select(*keep).withColumn("terms", F.array().cast("array<int>")).withColumns({k: F.array().cast("array<double>") for k in kinds}).schema
    return docs.select(*keep, tokens.alias("_t")).mapInArrow(run, schema), index


def vocab_topk(tdf: DataFrame, max_features: int | None, min_df: int = 1) -> DataFrame:
    """Terms with df >= min_df, then the ``max_features`` with the largest
    total count (ties: term ascending).

    No global sort: when there are more candidates than ``max_features``, the
    cut-off total is found by :func:`cutoff_total`; terms above it are kept,
    and only the tie group at it is ranked. ``tdf`` should be materialised (it
    is read several times)."""
    cand = tdf.filter(F.col("df") >= min_df)
    if max_features is None:
        return cand
    n_cand = cand.count()
    if n_cand <= max_features:
        return cand
    least, n_above = cutoff_total(cand, "total", max_features)
    above = cand.filter(F.col("total") > least)
    tie = range_rank(cand.filter(F.col("total") == least), ["term"], "_tr")
    tie = tie.filter(F.col("_tr") <= max_features - n_above).drop("_tr")
    return above.unionByName(tie)


def cutoff_total(rows: DataFrame, total: str, k: int) -> tuple[int, int]:
    """(the k-th largest value of ``total``, a whole number from 1, of which
    there are k at least; how many are larger).

    Radix selection: a count by binary order of magnitude (64 classes at most)
    finds the class of the k-th value, counts over ``RADIX`` equal parts of it
    find its part, and so on until a part is one value: the second count does
    it up to values of 2 * RADIX, each further one a factor of RADIX more."""
    def counts(key: Column, where=None):
        d = rows if where is None else rows.filter(where)
        return sorted(((r["_b"], r["n"]) for r in d.groupBy(key.alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)

    def at(bins, larger):
        for b, n in bins:
            if larger + n >= k:
                return b, larger
            larger += n
        raise ValueError("fewer values than asked for")

    digits, larger = at(counts(F.length(F.bin(total))), 0)
    low, width = 1 << (digits - 1), 1 << (digits - 1)
    while width > 1:
        step = -(-width // RADIX)
        inside = F.col(total).between(low, low + width - 1)
        part, larger = at(counts(F.expr(f"({total} - {low}L) div {step}L"), inside), larger)
        low, width = low + part * step, step
    return low, larger


def tfidf(tf: DataFrame, idf: DataFrame, doc: str = "doc", sublinear: bool = False,
          max_features: int | None = None, also: str | None = None) -> DataFrame:
    """Long-form TF-IDF rows (doc, ..., term, weight), L2-normalised per doc.

    ``idf`` is broadcast when its size is bounded (by ``max_features``). With
    ``also``, a column of that name has the weights of the other kind (sublinear
    or not), from the same pass."""
    small = max_features is not None and max_features <= VOCAB_BROADCAST_MAX
    v = F.broadcast(idf) if small else idf
    kinds = {"weight": sublinear} | ({also: not sublinear} if also else {})
    raw = tf.join(v, "term", "inner").withColumns(
        {f"_{out}": ((1 + F.log(F.col("tf"))) if sub else F.col("tf")) * F.col("idf") for out, sub in kinds.items()})
    norm = {out: F.sqrt(F.sum(F.col(f"_{out}") * F.col(f"_{out}")).over(Window.partitionBy(doc))) for out in kinds}
    return raw.withColumns({out: F.col(f"_{out}") / n for out, n in norm.items()}).drop(*(f"_{out}" for out in kinds))


def term_stats(docs: DataFrame, doc: str, text: str, min_df: int = 1, stop_words=None, keep=(), weight: str | None = None) -> DataFrame:
    """(term, df, total) of the terms in ``min_df`` documents or more, kept in the shared folder."""
    tf = term_frequencies(docs, doc, text, stop_words, 2, keep if weight is None or weight in keep else (*keep, weight))
    return materialize(term_doc_freq(tf, weight).filter(F.col("df") >= min_df), keep_partitioning=False)


def fit_tfidf(docs: DataFrame, doc: str, text: str, max_features: int | None,
              min_df: int = 1, stop_words=None, sublinear: bool = False,
              keep=(), n_docs: int | None = None, weight: str | None = None,
              stats: DataFrame | None = None, also: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit on ``docs`` and transform them: returns (weights, vocab) where
    vocab = (term, df, total, idf).

    ``docs`` should be a table bucketed by ``doc`` (see
    :func:`eraspark.session.materialize_bucketed`): term counts and norms
    per document then read co-partitioned buckets and need no shuffle. They
    are computed twice (statistics, weights): storing the term-count table
    (about 3x the text) measured no faster. Several fits on the same documents
    share their ``stats`` (:func:`term_stats`); ``also`` is that of :func:`tfidf`.

    With ``weight``, a column of whole numbers, the vocabulary and its idf are
    those of a corpus in which each document stands that many times."""
    keep = keep if weight is None or weight in keep else (*keep, weight)
    tf = term_frequencies(docs, doc, text, stop_words, 2, keep)
    stats = stats if stats is not None else term_stats(docs, doc, text, min_df, stop_words, keep, weight)
    vocab = vocab_topk(stats, max_features, min_df)
    n = n_docs if n_docs is not None else docs.agg(F.sum(weight)).first()[0] or 0 if weight else docs.count()
    vocab = vocab.withColumn("idf", F.log(F.lit(float(1 + n)) / (1 + F.col("df"))) + 1)
    weights = tfidf(tf, vocab.select("term", "idf"), doc, sublinear, max_features, also)
    return weights, vocab


def transform_tfidf(docs: DataFrame, vocab: DataFrame, doc: str, text: str,
                    stop_words=None, sublinear: bool = False,
                    max_features: int | None = None, keep=()) -> DataFrame:
    """Apply a fitted vocabulary (term, idf) to new documents; terms outside
    it are dropped (that is also how shorter models are padded with zeros)."""
    tf = term_frequencies(docs, doc, text, stop_words, 2, keep)
    return tfidf(tf, vocab.select("term", "idf"), doc, sublinear, max_features)


#: Sums of one task's documents, at most: 32 MB.
SUM_BYTES = 32 << 20


def doc_embedding_mean(pairs: DataFrame, vectors: DataFrame, doc: str = "doc", dim: int | None = None,
                       head: int = HEAD) -> DataFrame:
    """Mean of the in-vocabulary word vectors of each document, zeros when
    none is known or the document is null; a word given twice counts with both
    its vectors, one without a vector is unknown. ``pairs`` = (doc, token, n), one row a distinct token of a
    document; ``vectors`` = (token, n, vector array<float|double>).

    A document's pairs all go to one task, and to every task goes the vector of
    each word its documents hold, once. Sorted by word, vectors stream past the
    pairs that use them, so a task holds the sums of its documents
    (``SUM_BYTES`` at most) and no vocabulary. What is shuffled is the narrow
    pairs and tasks x words vectors, never a vector for a (document, word) pair.
    Vectors of frequent words (``head`` of them at most) are broadcast."""
    import numpy as np
    spark = pairs.sparkSession
    vectors = vectors.filter(F.col("vector").isNotNull())
    total = vectors.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * head >= total
    top = vectors.filter(frequent).select("token", "vector").toArrow()
    flat = top.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    known = spark.sparkContext.broadcast(flat.reshape(top.num_rows, -1) if top.num_rows else np.zeros((0, dim or 0)))
    numbers = spark.createDataFrame(list(zip(top.column("token").to_pylist(), range(top.num_rows))), "token string, _head int")

    n_docs = pairs.select(F.approx_count_distinct(F.struct(doc))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_docs * 8 * (dim or 1024) // SUM_BYTES))
    kind = vectors.schema["vector"].dataType.simpleString()
    uses = (pairs.select(F.pmod(F.xxhash64(doc), F.lit(tasks)).cast("int").alias("_task"), doc, "token", F.col("n").cast("double").alias("_c"))
            .join(F.broadcast(numbers), "token", "left"))
    rare = vectors.filter(~frequent).select("token", "vector")
    needed = uses.filter(F.col("_head").isNull()).select("_task", "token").distinct().join(rare, "token")
    rows = (uses.select("_task", F.when(F.col("_head").isNull(), F.col("token")).alias("_w"), F.lit(None).cast(kind).alias("_v"), doc, "_c", "_head")
            .unionByName(needed.select("_task", F.col("token").alias("_w"), F.col("vector").alias("_v")), allowMissingColumns=True))
    # A word's vector stands before the pairs that use it: they have no count.
    rows = rows.repartitionById(tasks, F.col("_task")).sortWithinPartitions("_w", F.col("_c").asc_nulls_first()).drop("_task")
    out = f"`{doc}` {pairs.schema[doc].dataType.simpleString()}, embedding array<double>"
    return rows.select("_w", "_v", doc, "_c", "_head").mapInArrow(lambda batches: _mean_vectors(batches, known.value, doc, dim or 0), out)


def _mean_vectors(batches, top, doc: str, dim: int):
    """Batches of (word, vector, document, count, place in ``top``) sorted by word,
    a word's vector before its pairs -> (document, mean) of the task's documents."""
    import numpy as np
    import pyarrow as pa
    places: dict = {}
    sums, counts = np.zeros((0, top.shape[1] if len(top) else dim)), np.zeros(0)
    word, vector, number = None, None, 0
    for b in (b for b in batches if b.num_rows):
        is_vector = b.column(3).is_null().to_numpy(zero_copy_only=False)
        lists = b.column(1).filter(pa.array(is_vector))
        found = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, sums.shape[1]))
        width = found.shape[1] or sums.shape[1] or (0 if vector is None else len(vector))
        if sums.shape[1] != width:                    # the first vector tells the width
            sums = np.zeros((len(sums), width))
        words = b.column(0).dictionary_encode("encode")
        code, names = words.indices.to_numpy(), words.dictionary
        # Sum and number of each word's vectors, and the place of that: -1 when it has none.
        own, first = np.unique(code[is_vector], return_index=True)
        held = np.add.reduceat(found, first) if len(own) else np.zeros((0, width))
        many = np.diff([*first, len(found)])
        at = np.full(len(names), -1)
        at[own] = np.arange(len(own))
        if vector is not None and names[code[0]].as_py() == word:      # goes on from the batch before
            if at[code[0]] < 0:
                at[code[0]], held, many = len(held), np.vstack([held, np.zeros((1, width))]), np.append(many, 0)
            held[at[code[0]]] += vector
            many[at[code[0]]] += number

        keys = b.column(2).filter(pa.array(~is_vector)).dictionary_encode("encode")
        slot = np.asarray([places.setdefault(k, len(places)) for k in keys.dictionary.to_pylist()], np.int64)[keys.indices.to_numpy()]
        if len(places) > len(counts):
            grown = max(len(places), len(counts) * 3 // 2) - len(counts)
            sums, counts = np.vstack([sums, np.zeros((grown, width))]), np.concatenate([counts, np.zeros(grown)])
        n = b.column(3).to_numpy(zero_copy_only=False)[~is_vector]
        head = b.column(4).fill_null(-1).to_numpy(zero_copy_only=False)[~is_vector]
        place = at[code[~is_vector]]
        for source, times, where, use in ((top, np.ones(len(top)), head, head >= 0), (held, many, place, (head < 0) & (place >= 0))):
            if use.any():
                order = np.argsort(slot[use], kind="stable")
                to, first = np.unique(slot[use][order], return_index=True)
                amount = n[use][order]
                sums[to] += np.add.reduceat(source[where[use][order]] * amount[:, None], first)
                counts[to] += np.add.reduceat(times[where[use][order]] * amount, first)
        last = at[code[-1]]
        word, vector, number = (names[code[-1]].as_py(), held[last].copy(), many[last]) if last >= 0 else (None, None, 0)
    docs = list(places)
    for lo in range(0, len(docs), 1000):
        some = docs[lo:lo + 1000]
        mean = sums[lo:lo + 1000] / np.maximum(counts[lo:lo + 1000], 1)[:, None]
        means = [m.tolist() if c and d is not None else [0.0] * dim for d, m, c in zip(some, mean, counts[lo:lo + 1000])]
        yield pa.RecordBatch.from_arrays([pa.array(some, b.schema.field(2).type), pa.array(means, pa.list_(pa.float64()))], [doc, "embedding"])
