"""Relational scoring: linear models as (class, term, coef) tables, scores
as joins + aggregations, argmax, top-k, wide tables, ensembles, confidences.

A document's score for a class is sigmoid(sum_t weight(doc, t) * coef(class,
t) + intercept(class)). Terms missing from a model contribute nothing, which
is also how a shorter model is padded with zeros. Coefficient tables are
joined on ``term``, one row for each term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sigmoid
from ..session import materialize

SCORE_DIGITS = 9
# Coefficients of all classes broadcast to the weights, at most: 16 MB and the terms.
COEF_BROADCAST_MAX = 2_000_000


def centroid_model(weights: DataFrame, docs: DataFrame, cls: str, digits: int = SCORE_DIGITS):
    """A linear model derived from labelled TF-IDF rows: coef(class, term) =
    mean weight of the term over the class's documents (nearest-centroid
    scoring), intercept = ln(class share). Returns (coef, intercept) tables
    (class, term, coef) and (class, intercept)."""
    coefs, intercept = centroid_models(weights, docs, cls, ["weight"], digits)
    return coefs.select("class", "term", F.col("weight").alias("coef")), intercept


def centroid_models(weights: DataFrame, docs: DataFrame, cls: str, columns, digits: int = SCORE_DIGITS):
    """:func:`centroid_model` on each of the weights' ``columns`` from one pass:
    (class, term, *columns) and (class, intercept)."""
    n_cls = docs.filter(F.col(cls).isNotNull()).groupBy(F.col(cls).alias("class")) \
        .agg(F.count(F.lit(1)).alias("_nc"))
    n_all = docs.filter(F.col(cls).isNotNull()).select(F.count(F.lit(1))).scalar()
    sums = weights.filter(F.col(cls).isNotNull()).groupBy(F.col(cls).alias("class"), "term") \
        .agg(*(F.sum(c).alias(c) for c in columns))
    coefs = sums.join(F.broadcast(n_cls), "class", "inner").select(
        "class", "term", *(F.round(F.col(c) / F.col("_nc"), digits).alias(c) for c in columns))
    intercept = n_cls.select("class", F.round(F.log(F.col("_nc") / n_all), digits).alias("intercept"))
    return coefs, intercept


def score_linear(weights: DataFrame, coef: DataFrame, intercept: DataFrame, docs: DataFrame,
                 doc: str, classes, digits: int = SCORE_DIGITS, max_features: int | None = None) -> DataFrame:
    """(doc, class, score) for every document and every model class.
    Documents without a known term still get sigmoid(intercept). A model has one
    row for each vocabulary term: when their number is bounded (by ``max_features``)
    they are broadcast, and the (doc, term) rows stay where they are."""
    coefs = coef.withColumnRenamed("coef", "weight")
    return score_linears(weights.select(doc, "term", "weight"), coefs, intercept, docs, doc, classes, digits, max_features)["weight"]


def score_linears(weights: DataFrame, coefs: DataFrame, intercept: DataFrame, docs: DataFrame,
                  doc: str, classes, digits: int = SCORE_DIGITS, max_features: int | None = None) -> dict[str, DataFrame]:
    """The scores of several models of the same classes and terms, by name: a
    model has a column of that name in ``weights`` (doc, term, ...) and in
    ``coefs`` (class, term, ...). The rows are summed once for all models, and
    kept when there are several."""
    classes, models = list(classes), [c for c in weights.columns if c in coefs.columns and c not in (doc, "class", "term")]
    small = max_features is not None and max_features * len(classes) * len(models) <= COEF_BROADCAST_MAX
    # One row for each term with its coefficients in class order, so a (doc,
    # term) row stays one row: k sums for a document, then k scores.
    places = [(m, i, c) for m in models for i, c in enumerate(classes)]
    by_class = [F.sum(F.when(F.col("class") == c, F.col(m)).otherwise(0.0)).alias(f"_c{i}_{m}") for m, i, c in places]
    c = coefs.filter(F.col("class").isin(*classes)).groupBy("term").agg(*by_class)
    dots = (weights.select(doc, "term", *models).join(F.broadcast(c) if small else c, "term", "inner").groupBy(doc)
            .agg(*(F.sum(F.col(m) * F.col(f"_c{i}_{m}")).alias(f"_d{i}_{m}") for m, i, _ in places)))
    dots = materialize(dots, keep_partitioning=False) if len(models) > 1 else dots
    out = {}
    for m in models:
        each = F.array(*(F.struct(F.lit(c).alias("class"), F.coalesce(F.col(f"_d{i}_{m}"), F.lit(0.0)).alias("dot")) for i, c in enumerate(classes)))
        rows = docs.select(doc).join(dots, doc, "left").select(doc, F.explode(each).alias("_s")).select(doc, "_s.*")
        # A row for each class: broadcast. A class without training rows has no intercept, so no score.
        out[m] = (rows.join(F.broadcast(intercept), "class", "inner")
                  .select(doc, "class", F.round(sigmoid(F.col("dot") + F.col("intercept")), digits).alias("score")))
    return out


def argmax_label(scores: DataFrame, doc: str, cls: str = "class", score: str = "score",
                 out: str = "predicted") -> DataFrame:
    """Class with the highest score per document; ties go to the first class
    in class order. NaN scores never win; a document with no other score
    keeps its row, with a null label."""
    s = F.when(F.isnan(F.col(score)), F.lit(None)).otherwise(F.col(score))
    best = F.min_by(F.col(cls), F.when(s.isNotNull(), F.struct((-s).alias("_neg"), F.col(cls))))
    return scores.groupBy(doc).agg(best.alias(out), F.max(s).alias("top_score"))


def scores_topk(scores: DataFrame, doc: str, k: int, cls: str = "class",
                score: str = "score") -> DataFrame:
    """Classes by score desc (class asc on ties), top k per document, with
    the score as a percentage (2 decimals)."""
    w = Window.partitionBy(doc).orderBy(F.desc(score), F.asc(cls))
    return (scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(doc, F.col("rank").cast("int"), cls,
                    F.round(F.col(score) * 100, 2).alias("pct")))


def compare_scores(methods: dict[str, DataFrame], doc: str, classes, cls: str = "class") -> DataFrame:
    """Several methods' scores side by side, a row a document: conf_<method>_<class>
    of every method, then pred_<method>, the class each method gives the highest
    score. Documents that one method lacks have nulls there.

    One shuffle by document: the methods' long rows are put under each other and
    pivoted over the given classes."""
    classes = list(classes)
    rows = None
    for i, scores in enumerate(methods.values()):
        part = scores.select(doc, F.col(cls).alias("_c"), F.col("score").alias("_s"), F.lit(i).alias("_m"))
        rows = part if rows is None else rows.unionByName(part)
    confs, preds = [], []
    for i, name in enumerate(methods):
        mine = F.col("_m") == i
        confs += [F.max(F.when(mine & (F.col("_c") == c), F.col("_s"))).alias(f"conf_{name}_{c}") for c in classes]
        usable = F.when(mine & F.col("_c").isin(classes) & ~F.isnan("_s"), F.struct((-F.col("_s")).alias("n"), F.col("_c").alias("c")))
        preds.append(F.min(usable)["c"].alias(f"pred_{name}"))
    return rows.groupBy(doc).agg(*confs, *preds)


def score_ensemble(a: DataFrame, b: DataFrame, doc: str, wa: float, wb: float,
                   cls: str = "class", digits: int = SCORE_DIGITS) -> DataFrame:
    """(doc, class, score_a, score_b, score_mix) with mix = wa*A + wb*B;
    :func:`ensemble_labels` adds what each of the three decides."""
    j = a.select(doc, cls, F.col("score").alias("score_a")).join(
        b.select(doc, cls, F.col("score").alias("score_b")), [doc, cls], "inner")
    return j.withColumn("score_mix", F.round(wa * F.col("score_a") + wb * F.col("score_b"), digits))


def ensemble_labels(mixed: DataFrame, doc: str, cls: str = "class") -> DataFrame:
    """``mixed`` with pred_a, pred_b and pred_mix, the classes of the document's
    highest score_a, score_b and score_mix (ties: first class), in one grouping."""
    names = ("a", "b", "mix")
    best = [F.min(F.struct((-F.col(f"score_{n}")).alias("s"), F.col(cls).alias("c")))["c"].alias(f"pred_{n}") for n in names]
    rows = F.collect_list(F.struct(cls, *(f"score_{n}" for n in names))).alias("_r")        # one for each class
    return (mixed.groupBy(doc).agg(rows, *best).select(doc, F.explode("_r").alias("_r"), *(f"pred_{n}" for n in names))
            .select(doc, "_r.*", *(f"pred_{n}" for n in names)))


def max_score(scores: DataFrame, doc: str, score: str = "score") -> DataFrame:
    """Largest finite score per document; null when there is none."""
    s = F.col(score)
    finite = F.when(~F.isnan(s) & (F.abs(s) != float("inf")), s)
    return scores.groupBy(doc).agg(F.max(finite).alias("max_score"))


def model_width_check(coef: DataFrame, vocab: DataFrame, cls: str = "class") -> DataFrame:
    """Per class: number of coefficient rows vs vectoriser rows, and whether
    they agree."""
    a = coef.groupBy(cls).agg(F.count(F.lit(1)).alias("model_width"))
    b = vocab.groupBy(cls).agg(F.count(F.lit(1)).alias("vectorizer_width"))
    j = a.join(b, cls, "full")
    return j.select(cls, F.coalesce("model_width", F.lit(0)).alias("model_width"),
                    F.coalesce("vectorizer_width", F.lit(0)).alias("vectorizer_width"),
                    (F.coalesce("model_width", F.lit(0)) == F.coalesce("vectorizer_width", F.lit(0)))
                    .alias("widths_match"))


def scan_models(coef: DataFrame, vocab: DataFrame, cls: str = "class") -> DataFrame:
    """Model registry: classes that have both a coefficient table and a
    vocabulary (a class lacking either part is skipped), sorted. Without any
    complete class there is no model to score with: an error."""
    have_coef = coef.select(cls).distinct()
    have_vocab = vocab.select(cls).distinct()
    found = have_coef.join(have_vocab, cls, "left_semi").orderBy(cls)
    if found.isEmpty():
        raise ValueError("no class has both coefficients and a vocabulary")
    return found


def load_models(spark, path: str, cls: str = "class") -> tuple[DataFrame, DataFrame]:
    """(coef, vocab) of a model folder as :func:`eraspark.operators.sinks.write_model`
    writes it, of the complete classes only."""
    coef, vocab = spark.read.parquet(f"{path}/coef"), spark.read.parquet(f"{path}/vocab")
    classes = F.broadcast(scan_models(coef, vocab, cls))            # one row a class
    return coef.join(classes, cls, "left_semi"), vocab.join(classes, cls, "left_semi")


SCORERS: dict = {}


def register_scorer(name: str, fn, return_type: str = "double"):
    """Register a user scorer: a function pandas.Series[str] -> pandas.Series
    of scores, run as an Arrow-batched pandas UDF."""
    udf = F.pandas_udf(fn, return_type)
    SCORERS[name] = udf
    return udf


def example_length_scorer(texts):
    """Example scorer: share of a text's characters that are letters."""
    import pandas as pd
    t = texts.fillna("")
    letters = t.str.count(r"[^\W\d_]")
    return (letters / t.str.len().where(t.str.len() > 0)).astype("float64").fillna(0.0).rename(None) \
        if isinstance(t, pd.Series) else t
