"""Registered queries: relational scoring, argmax, wide/ensemble tables,
confidences, evaluation reports (SURVEY §2.3 TS rows, 2.4, 2.5, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as TX
from ..operators import analytics as A
from ..operators import metrics as M
from ..operators import scoring as SC
from ..operators.features import distinct_term_stats, fit_tfidf, tfidf_arrays, transform_tfidf
from ..operators.sampling import split_random
from ..session import materialize, materialize_bucketed
from ..sources.tables import songs
from . import sqltext as S
from .registry import register

ERAS = fixed.ERA_LABELS
GENRES = fixed.GENRES
V, MIN_DF = fixed.TOP_TOKENS_V, fixed.TOP_TOKENS_MIN_DF
WA, WB = fixed.ENSEMBLE_WEIGHT_A, fixed.ENSEMBLE_WEIGHT_B
TOPK = 3


# ---------------------------------------------------------------- Spark side
class Ctx:
    """Documents, TF-IDF features and the derived linear models of one run."""

    def __init__(self, spark, sf_dir, both=False):
        """``both``: plain and sublinear features will be asked for."""
        self.docs = materialize_bucketed(A.prepare_era_docs(songs(spark, sf_dir), extra=("tag",)),
                                         "text_key")
        self.n_docs = self.docs.count()
        self.both = both
        self._cache = {}

    def stats(self):
        """Term statistics, which the fits of any vocabulary size share."""
        if "stats" not in self._cache:
            self._cache["stats"] = distinct_term_stats(self.docs, "clean_lyrics", MIN_DF)
        return self._cache["stats"]

    def features(self, sublinear=False):
        """(rows, index, vocab, column): a row of term numbers and weights for
        each document, materialised, since the model fit and the scoring both
        read them; the numbers' terms; the vocabulary; the weights' column. Made
        once for both feature variants together where both are used."""
        if ("f", sublinear) not in self._cache:
            _, vocab = fit_tfidf(self.docs, "text_key", "clean_lyrics", V, MIN_DF, n_docs=self.n_docs, stats=self.stats())
            vocab = materialize(vocab, keep_partitioning=False)
            rows, index = tfidf_arrays(self.docs, vocab, "clean_lyrics", ("id", "song_era", "tag"), sublinear=sublinear, also="other" if self.both else None)
            rows = materialize(rows, keep_partitioning=False)
            self._cache["f", sublinear] = rows, index, vocab, "weight"
            if self.both:
                self._cache["f", not sublinear] = rows, index, vocab, "other"
        return self._cache["f", sublinear]

    def weights(self, rows, *columns):
        """(id, song_era, tag, term number, weights) rows of :meth:`features`."""
        each = rows.select("id", "song_era", "tag", F.explode(F.arrays_zip("terms", *columns)).alias("_e"))
        return each.select("id", "song_era", "tag", F.col("_e.terms").alias("term"), *(F.col(f"_e.{c}").alias(c) for c in columns))

    def model(self, cls="song_era", classes=ERAS, sublinear=False):
        """Features fitted on every document; the model on the documents of
        the listed classes only."""
        rows, index, vocab, column = self.features(sublinear)
        lw = self.weights(rows.filter(F.col(cls).isin(*classes)), column).withColumnRenamed(column, "weight")
        coef, icpt = SC.centroid_model(lw, self.labelled(cls, classes), cls)
        terms = F.broadcast(index.withColumnRenamed("term", "_w"))             # V rows
        named = lambda d: d.join(terms, F.col("term") == F.col("idx")).drop("term", "idx").withColumnRenamed("_w", "term")
        return named(lw), vocab, named(coef), icpt

    def labelled(self, cls, classes):
        return self.docs.filter(F.col(cls).isin(*classes))

    def scores(self, cls="song_era", classes=ERAS, sublinear=False):
        """Where both feature variants are used, one pass sums both models'
        coefficients and one scores both; those scores are kept."""
        if not self.both:
            return self._scored(cls, classes, {"weight": sublinear})["weight"]
        key = ("s", cls, tuple(classes))
        if key not in self._cache:
            columns = {self.features(sub)[3]: sub for sub in (False, True)}
            found = self._scored(cls, classes, columns)
            self._cache[key] = {sub: found[c] for c, sub in columns.items()}
        return self._cache[key][sublinear]

    def _scored(self, cls, classes, columns):
        """The scores of the models on each of the weights' ``columns`` (name ->
        sublinear or not)."""
        rows = self.features(next(iter(columns.values())))[0]
        lw = self.weights(rows.filter(F.col(cls).isin(*classes)), *columns)
        coefs, icpt = SC.centroid_models(lw, self.labelled(cls, classes), cls, list(columns))
        return SC.score_linears(lw, coefs, icpt, self.labelled(cls, classes), "id", classes, max_features=V)


def predictions(ctx, sublinear=False):
    sc = ctx.scores(sublinear=sublinear)
    pred = SC.argmax_label(sc, "id")
    return sc, pred.join(ctx.docs.select("id", "song_era", "year"), "id", "inner")


# ---------------------------------------------------------------- SQL side
def model_sql(p: str, cls: str, docs: str, sublinear: bool = False, classes=ERAS) -> str:
    """CTEs {p}w (weights), {p}coef, {p}icpt, {p}scores for a centroid model
    over ``docs`` labelled by ``cls``."""
    return f"""{S.tfidf_ctes('docs', 'id', 'clean_lyrics', V, MIN_DF, extra='song_era, tag', sublinear=sublinear, prefix=p)},
{p}ldocs AS (SELECT * FROM {docs} WHERE {cls} IN {S.in_list(classes)}),
{p}ncls AS (SELECT {cls} AS class, count(*) AS nc FROM {p}ldocs GROUP BY {cls}),
{p}coef AS (SELECT w.{cls} AS class, term, round(sum(weight) / any_value(nc), 9) AS coef
            FROM {p}w w JOIN {p}ncls c ON c.class = w.{cls} GROUP BY w.{cls}, term),
{p}icpt AS (SELECT class, round(ln(nc / (SELECT count(*) FROM {p}ldocs)), 9) AS intercept FROM {p}ncls),
{p}dots AS (SELECT w.doc AS id, c.class, sum(w.weight * c.coef) AS dot
            FROM {p}w w JOIN {p}coef c USING (term) GROUP BY ALL),
{p}scores AS (
  SELECT d.id, i.class, round(1 / (1 + exp(-(coalesce(dt.dot, 0) + i.intercept))), 9) AS score
  FROM {p}ldocs d CROSS JOIN {p}icpt i LEFT JOIN {p}dots dt ON dt.id = d.id AND dt.class = i.class),
{p}pred AS (
  SELECT id, class AS predicted, score AS top_score FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS rn FROM {p}scores)
  WHERE rn = 1)"""


BASE = f"""WITH {S.CLEANED_CTE},
docs AS (SELECT * FROM era_docs WHERE song_era IS NOT NULL AND clean_lyrics IS NOT NULL)"""
MA = model_sql("a_", "song_era", "docs")
MB = model_sql("b_", "song_era", "docs", sublinear=True)
MG = model_sql("g_", "tag", "docs", classes=GENRES)
PRED_A = "pa AS (SELECT p.id, p.predicted, p.top_score, d.song_era, d.year FROM a_pred p JOIN docs d USING (id))"


def q_sql(*parts) -> str:
    return ",\n".join((BASE,) + parts)


# ---------------------------------------------------------------- scoring
@register("score_linear_relational", q_sql(MA) + " SELECT id, class, score FROM a_scores")
def q_score_linear_relational(spark, sf_dir):
    return Ctx(spark, sf_dir).scores()


@register("sigmoid", q_sql(MA) + """
SELECT s.id, s.class, round(coalesce(d.dot, 0) + i.intercept, 9) AS z,
       round(1 / (1 + exp(-round(coalesce(d.dot, 0) + i.intercept, 9))), 9) AS p
FROM a_scores s JOIN a_icpt i USING (class) LEFT JOIN a_dots d ON d.id = s.id AND d.class = s.class""")
def q_sigmoid(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    w, _, coef, icpt = ctx.model()
    dots = (w.select("id", "term", "weight").join(coef, "term")
            .groupBy("id", "class").agg(F.sum(F.col("weight") * F.col("coef")).alias("dot")))
    grid = ctx.docs.select("id").withColumn("class", F.explode(F.array(*[F.lit(x) for x in ERAS]))) \
        .join(F.broadcast(icpt), "class")
    z = F.round(F.coalesce("dot", F.lit(0.0)) + F.col("intercept"), 9)
    return (grid.join(dots, ["id", "class"], "left")
            .select("id", "class", z.alias("z"), F.round(TX.sigmoid(z), 9).alias("p")))


@register("argmax_label", q_sql(MA) + " SELECT id, predicted, top_score FROM a_pred")
def q_argmax_label(spark, sf_dir):
    return SC.argmax_label(Ctx(spark, sf_dir).scores(), "id")


@register("scores_topk", q_sql(MA) + f"""
SELECT id, CAST(rk AS INTEGER) AS rank, class, round(score * 100, 2) AS pct FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS rk FROM a_scores)
WHERE rk <= {TOPK}""")
def q_scores_topk(spark, sf_dir):
    return SC.scores_topk(Ctx(spark, sf_dir).scores(), "id", TOPK)


def _side_by_side_sql(methods: dict[str, str], classes) -> str:
    """conf_<method>_<class> and pred_<method> of ({p}scores, {p}pred) pairs."""
    first = next(iter(methods.values()))
    cols = ", ".join(f"(SELECT max(s.score) FROM {p}scores s WHERE s.id = d.id AND s.class = '{c}') AS conf_{m}_{c}"
                     for m, p in methods.items() for c in classes)
    preds = ", ".join(f"(SELECT max(q.predicted) FROM {p}pred q WHERE q.id = d.id) AS pred_{m}" for m, p in methods.items())
    return f"SELECT d.id, {cols}, {preds} FROM (SELECT DISTINCT id FROM {first}scores) d"


MGS = model_sql("h_", "tag", "docs", sublinear=True, classes=GENRES)


@register("score_wide", q_sql(MG, MGS) + " " + _side_by_side_sql({"bin": "h_", "multi": "g_"}, GENRES))
def q_score_wide(spark, sf_dir):
    """Both methods' confidences a genre side by side: "bin" on sublinear
    features, "multi" on plain ones."""
    ctx = Ctx(spark, sf_dir, both=True)
    return SC.compare_scores({"bin": ctx.scores("tag", GENRES, sublinear=True), "multi": ctx.scores("tag", GENRES)}, "id", GENRES)


@register("score_wide_eras", q_sql(MA, MB) + " " + _side_by_side_sql({"bin": "b_", "multi": "a_"}, ERAS))
def q_score_wide_eras(spark, sf_dir):
    ctx = Ctx(spark, sf_dir, both=True)
    return SC.compare_scores({"bin": ctx.scores(sublinear=True), "multi": ctx.scores()}, "id", ERAS)


@register("max_score", q_sql(MA) + """
SELECT id, max(CASE WHEN isfinite(score) THEN score END) AS max_score FROM a_scores GROUP BY id""")
def q_max_score(spark, sf_dir):
    return SC.max_score(Ctx(spark, sf_dir).scores(), "id")


def _conf_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} = 0 THEN 0 "
            f"ELSE CAST(greatest(0, least(100, floor({x} * 100 + 0.5))) AS INTEGER) END")


@register("confidence_pct", q_sql(MA) + f"""
SELECT id, {_conf_sql('top_score')} AS era_confidence FROM a_pred""")
def q_confidence_pct(spark, sf_dir):
    p = SC.argmax_label(Ctx(spark, sf_dir).scores(), "id")
    return p.select("id", TX.confidence_pct("top_score").alias("era_confidence"))


_GENRE_ERA = q_sql(MA, MG) + f""",
j AS (SELECT a.id, a.predicted AS predicted_era, {_conf_sql('a.top_score')} AS era_confidence,
             g.predicted AS predicted_genre, {_conf_sql('g.top_score')} AS genre_confidence
      FROM a_pred a JOIN g_pred g USING (id))"""


def _genre_era(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    era = SC.argmax_label(ctx.scores(), "id")
    genre = SC.argmax_label(ctx.scores("tag", GENRES), "id")
    return era.select("id", F.col("predicted").alias("predicted_era"),
                      TX.confidence_pct("top_score").alias("era_confidence")).join(
        genre.select("id", F.col("predicted").alias("predicted_genre"),
                     TX.confidence_pct("top_score").alias("genre_confidence")), "id", "inner")


@register("join_genre_era", _GENRE_ERA + """
SELECT id, predicted_era, era_confidence, predicted_genre, genre_confidence FROM j""")
def q_join_genre_era(spark, sf_dir):
    return _genre_era(spark, sf_dir)


@register("overall_confidence", _GENRE_ERA + """
SELECT id, era_confidence, genre_confidence,
       CAST(greatest(0, least(100, floor((era_confidence + genre_confidence) / 2 + 0.5))) AS INTEGER)
         AS overall_confidence FROM j""")
def q_overall_confidence(spark, sf_dir):
    j = _genre_era(spark, sf_dir)
    return j.select("id", "era_confidence", "genre_confidence",
                    TX.overall_confidence("era_confidence", "genre_confidence").alias("overall_confidence"))


# ---------------------------------------------------------------- two models
_TWO = q_sql(MA, MB) + """,
ab AS (SELECT a.id, a.class, a.score AS score_a, b.score AS score_b FROM a_scores a JOIN b_scores b USING (id, class))"""


@register("join_scores_two_models", _TWO + " SELECT id, class, score_a, score_b FROM ab")
def q_join_scores_two_models(spark, sf_dir):
    ctx = Ctx(spark, sf_dir, both=True)
    a = ctx.scores().select("id", "class", F.col("score").alias("score_a"))
    b = ctx.scores(sublinear=True).select("id", "class", F.col("score").alias("score_b"))
    return a.join(b, ["id", "class"], "inner")


def _pred_from(col: str) -> str:
    return f"""(SELECT id, class AS predicted FROM (
  SELECT id, class, row_number() OVER (PARTITION BY id ORDER BY {col} DESC, class) AS rn FROM mix)
  WHERE rn = 1)"""


_MIX = f"""mix AS (SELECT id, class, score_a, score_b, round({WA} * score_a + {WB} * score_b, 9) AS score_mix FROM ab)"""
_LABELS = f"""pa AS {_pred_from('score_a')}, pb AS {_pred_from('score_b')}, pm AS {_pred_from('score_mix')}"""


@register("score_ensemble", _TWO + f""", {_MIX}, {_LABELS}
SELECT m.id, m.class, score_a, score_b, score_mix, pa.predicted AS pred_a, pb.predicted AS pred_b, pm.predicted AS pred_mix
FROM mix m JOIN pa USING (id) JOIN pb USING (id) JOIN pm USING (id)""")
def q_score_ensemble(spark, sf_dir):
    """Weighted scores of two models and the labels that A, B and the mix give."""
    ctx = Ctx(spark, sf_dir, both=True)
    return SC.ensemble_labels(SC.score_ensemble(ctx.scores(), ctx.scores(sublinear=True), "id", WA, WB), "id")


@register("compare_methods", _TWO + f""",
{_MIX}, {_LABELS}
SELECT m.id,
  {', '.join(f"max(CASE WHEN m.class = '{e}' THEN m.{c} END) AS conf_{n}_{e}"
             for n, c in (('a', 'score_a'), ('b', 'score_b'), ('mix', 'score_mix')) for e in ERAS)},
  any_value(pa.predicted) AS pred_a, any_value(pb.predicted) AS pred_b, any_value(pm.predicted) AS pred_mix
FROM mix m JOIN pa USING (id) JOIN pb USING (id) JOIN pm USING (id) GROUP BY m.id""")
def q_compare_methods(spark, sf_dir):
    ctx = Ctx(spark, sf_dir, both=True)
    mix = SC.score_ensemble(ctx.scores(), ctx.scores(sublinear=True), "id", WA, WB)
    return SC.compare_scores({n: mix.select("id", "class", F.col(f"score_{n}").alias("score")) for n in ("a", "b", "mix")}, "id", ERAS)


@register("score_feature_align", q_sql(MA) + f""",
{S.tfidf_ctes('docs', 'id', 'clean_lyrics', fixed.OVR_ERA_V, MIN_DF, prefix='f_')},
fd AS (SELECT w.doc AS id, c.class, sum(w.weight * c.coef) AS dot FROM f_w w JOIN a_coef c USING (term) GROUP BY ALL)
SELECT d.id, i.class, round(1 / (1 + exp(-(coalesce(fd.dot, 0) + i.intercept))), 9) AS score
FROM docs d CROSS JOIN a_icpt i LEFT JOIN fd ON fd.id = d.id AND fd.class = i.class""")
def q_score_feature_align(spark, sf_dir):
    """Features from a smaller vocabulary scored by a model fitted on a
    larger one: missing terms simply contribute zero."""
    ctx = Ctx(spark, sf_dir)
    _, _, coef, icpt = ctx.model()
    w_small, _ = fit_tfidf(ctx.docs, "text_key", "clean_lyrics", fixed.OVR_ERA_V, MIN_DF,
                           keep=("id",), n_docs=ctx.n_docs, stats=ctx.stats())
    return SC.score_linear(w_small, coef, icpt, ctx.docs, "id", ERAS, max_features=V)


@register("model_width_check", q_sql(MA) + """
SELECT i.class, CAST(count(c.term) AS BIGINT) AS model_width,
       CAST((SELECT count(*) FROM a_vocab) AS BIGINT) AS vectorizer_width,
       count(c.term) = (SELECT count(*) FROM a_vocab) AS widths_match
FROM a_icpt i LEFT JOIN a_coef c USING (class) GROUP BY i.class""")
def q_model_width_check(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    _, vocab, coef, icpt = ctx.model()
    per_class_vocab = vocab.select("term").withColumn(
        "class", F.explode(F.array(*[F.lit(x) for x in ERAS]))).join(
        F.broadcast(icpt.select("class")), "class", "left_semi")
    return SC.model_width_check(coef, per_class_vocab).select(
        "class", F.col("model_width").cast("long"), F.col("vectorizer_width").cast("long"), "widths_match")


@register("scan_models", q_sql(MA) + f"""
SELECT DISTINCT class FROM a_coef WHERE class <> '{ERAS[0]}' AND class <> '{ERAS[-1]}'""")
def q_scan_models(spark, sf_dir):
    """The registry over a written model of which one class lacks its
    vocabulary and another its coefficients."""
    from ..operators import sinks as K
    from ..session import shared_path
    _, vocab, coef, icpt = Ctx(spark, sf_dir).model()
    parts = vocab.select("term", "idf").withColumn("class", F.explode(F.array(*[F.lit(x) for x in ERAS[1:]])))
    path = shared_path(spark, "registry")
    K.write_model(coef.filter(F.col("class") != ERAS[-1]), parts, path)
    return SC.load_models(spark, path)[0].select("class").distinct()


# ---------------------------------------------------------------- metrics
def _labels_pred(spark, sf_dir):
    _, pred = predictions(Ctx(spark, sf_dir))
    return pred


@register("confusion_matrix", q_sql(MA, PRED_A) + f""",
grid AS (SELECT t.l AS true_label, p.l AS pred_label
         FROM (SELECT unnest({S.stop_list(ERAS)}) AS l) t, (SELECT unnest({S.stop_list(ERAS)}) AS l) p),
cnt AS (SELECT song_era AS true_label, predicted AS pred_label, count(*) AS n FROM pa GROUP BY ALL)
SELECT g.true_label, g.pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cnt c USING (true_label, pred_label)""")
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_labels_pred(spark, sf_dir), "song_era", "predicted", ERAS)


def _prf_sql(src: str, by: str = "") -> str:
    """Per-label tp / n_pred / support and P, R, F1 from ``src`` (song_era, predicted[, by])."""
    bsel = f"{by}, " if by else ""
    bgrp = f"GROUP BY {by}" if by else ""
    parts = " UNION ALL ".join(
        f"SELECT {bsel}'{e}' AS label, "
        f"CAST(count(*) FILTER (WHERE song_era = '{e}' AND predicted = '{e}') AS BIGINT) AS tp, "
        f"CAST(count(*) FILTER (WHERE predicted = '{e}') AS BIGINT) AS n_pred, "
        f"CAST(count(*) FILTER (WHERE song_era = '{e}') AS BIGINT) AS support FROM {src} {bgrp}"
        for e in ERAS)
    return f"""pc AS ({parts}),
prf0 AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
                   CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                       ELSE 0.0 END AS f1 FROM prf0)"""


@register("classification_report", q_sql(MA, PRED_A, _prf_sql("pa")) + """,
s AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
             sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM prf)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM prf
UNION ALL SELECT 'accuracy', NULL, NULL, round(CASE WHEN n > 0 THEN tp / n ELSE 0.0 END, 6), CAST(n AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(n AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(wp / n, 6), round(wr / n, 6), round(wf / n, 6), CAST(n AS BIGINT) FROM s""")
def q_classification_report(spark, sf_dir):
    return M.classification_report(_labels_pred(spark, sf_dir), "song_era", "predicted", ERAS)


@register("prf_table", q_sql(MA, PRED_A, _prf_sql("pa")) + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf""")
def q_prf_table(spark, sf_dir):
    return M.prf_table(_labels_pred(spark, sf_dir), "song_era", "predicted", ERAS)


@register("accuracy_f1", q_sql(MA, PRED_A, _prf_sql("pa")) + """
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro FROM prf""")
def q_accuracy_f1(spark, sf_dir):
    return M.accuracy_f1(_labels_pred(spark, sf_dir), "song_era", "predicted", ERAS)


# Features and model of the training rows alone; every row scored with them.
HELD_SQL = f"""sp AS (
  SELECT id, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + nv THEN 'val' ELSE 'train' END AS split FROM
    (SELECT id, row_number() OVER (ORDER BY md5('{fixed.SEED}|' || CAST(id AS VARCHAR)), id) AS r FROM docs),
    (SELECT nt, ceil(CAST(0.1 AS DOUBLE) * (n - nt)) AS nv FROM
       (SELECT ceil(CAST(0.1 AS DOUBLE) * count(*)) AS nt, count(*) AS n FROM docs))),
sdocs AS (SELECT docs.*, sp.split FROM docs JOIN sp USING (id)),
tdocs AS (SELECT * FROM sdocs WHERE split = 'train'),
{S.tfidf_ctes('tdocs', 'id', 'clean_lyrics', V, MIN_DF, extra='song_era', prefix='t_')},
t_ncls AS (SELECT song_era AS class, count(*) AS nc FROM tdocs GROUP BY song_era),
t_coef AS (SELECT w.song_era AS class, term, round(sum(weight) / any_value(nc), 9) AS coef
           FROM t_w w JOIN t_ncls c ON c.class = w.song_era GROUP BY w.song_era, term),
t_icpt AS (SELECT class, round(ln(nc / (SELECT count(*) FROM tdocs)), 9) AS intercept FROM t_ncls),
e_toks AS (SELECT id AS doc, {S.tokens('clean_lyrics')} AS t FROM sdocs),
e_grams AS (SELECT doc, unnest({S.grams('t')}) AS term FROM e_toks),
e_tf AS (SELECT doc, term, count(*) AS tf FROM e_grams GROUP BY ALL),
e_w0 AS (SELECT e_tf.doc, e_tf.term, e_tf.tf * v.idf AS w FROM e_tf JOIN t_vocab v USING (term)),
e_w AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM e_w0),
e_dots AS (SELECT w.doc AS id, c.class, sum(w.weight * c.coef) AS dot FROM e_w w JOIN t_coef c USING (term) GROUP BY ALL),
e_scores AS (SELECT d.id, i.class, round(1 / (1 + exp(-(coalesce(dt.dot, 0) + i.intercept))), 9) AS score
  FROM sdocs d CROSS JOIN t_icpt i LEFT JOIN e_dots dt ON dt.id = d.id AND dt.class = i.class),
pas AS (SELECT d.id, d.song_era, d.split, p.class AS predicted FROM sdocs d JOIN (
  SELECT id, class, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS rn FROM e_scores) p ON p.id = d.id AND p.rn = 1)"""


@register("evaluate_splits", q_sql(HELD_SQL, _prf_sql("pas", "split")) + """
SELECT split, round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro
FROM prf GROUP BY split""")
def q_evaluate_splits(spark, sf_dir):
    """Metrics of each split, the features and the model fitted on the training
    rows only: val and test are rows that neither has seen."""
    docs = materialize_bucketed(split_random(A.prepare_era_docs(songs(spark, sf_dir))), "text_key")
    train = docs.filter("split = 'train'")
    w, vocab = fit_tfidf(train, "text_key", "clean_lyrics", V, MIN_DF, keep=("song_era",))
    vocab = materialize(vocab, keep_partitioning=False)
    coef, icpt = SC.centroid_model(materialize(w, keep_partitioning=False), train, "song_era")
    seen = transform_tfidf(docs, vocab, "text_key", "clean_lyrics", max_features=V, keep=("id",))
    pred = SC.argmax_label(SC.score_linear(seen, materialize(coef, keep_partitioning=False), icpt, docs, "id", ERAS, max_features=V), "id")
    return M.accuracy_f1(pred.join(docs.select("id", "song_era", "split"), "id"), "song_era", "predicted", ERAS, by=("split",))


_MID = " + ".join(f"CASE WHEN class = '{e}' THEN {int(e[:4]) + 5} ELSE 0 END" for e in ERAS)


@register("regression_metrics", q_sql(MA) + f""",
yh AS (SELECT id, sum(score * ({_MID})) / sum(score) AS yhat FROM a_scores GROUP BY id),
r AS (SELECT d.year AS y, yh.yhat FROM yh JOIN docs d USING (id))
SELECT round(avg(abs(yhat - y)), 6) AS mae, round(avg((yhat - y) * (yhat - y)), 6) AS mse,
       round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse,
       round(1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(*)), 6) AS r2 FROM r""")
def q_regression_metrics(spark, sf_dir):
    """Year regression read off the era scores: the score-weighted mean of
    the era mid-points, against the true year."""
    ctx = Ctx(spark, sf_dir)
    sc = ctx.scores()
    mid = sum((F.when(F.col("class") == e, F.lit(int(e[:4]) + 5)).otherwise(F.lit(0)) for e in ERAS),
              F.lit(0))
    yh = sc.groupBy("id").agg((F.sum(F.col("score") * mid) / F.sum("score")).alias("yhat"))
    r = yh.join(ctx.docs.select("id", F.col("year").alias("y")), "id")
    return M.regression_metrics(r, "y", "yhat")
