"""Line deduplication by a log-template tree.

A line is parsed down a tree of fixed depth: its token count, then its
``DEPTH`` leading tokens, tokens with a digit counting as a variable field.
Within a leaf, a group of lines votes: at each position the group's most
frequent token is a constant of its template, and a line belongs to the
template when it has at least ``SIMILARITY`` of the constants; the other
positions are variable fields. The lines left over are divided by their token
at the position where they hold the fewest different ones, and each part votes
again, until every line has its template. So a leaf holds as many templates as
its lines need, in at most as many rounds as a line has tokens.

A template is frequent when it is found in at least ``min_docs`` different
texts, and it recurs when that many of them are not copies, a copy being a
text with ``COPY`` or more of its tokens in lines of frequent templates, the
similarity at which documents count as near copies. So boilerplate is told from
the lines of copied and nearly copied documents, which bring their whole
surroundings along: those are left to document deduplication. Lines of
recurring templates are dropped everywhere.

All steps are DataFrame expressions. Texts that are equal count once. A line
that very many documents share is summed up before every shuffle by its key,
and the joins that put results back are of the kind that skew handling splits.
They are sort-merge joins at every size: tables that grow with the texts are not
broadcast while they happen to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

DEPTH = 3
SIMILARITY = 0.8
MIN_DOCS = 10
COPY = 0.8

_TEXT = ["t1", "t2"]
_LINE = ["leaf", "line_key"]
_TEMPLATE = ["leaf", "code"]


# A set of hashes as a bit table of fixed size: 4096 rows of 32 768 bits.
_TABLE_ROWS, _ROW_BITS = 1 << 12, 1 << 15


def _bits(keys: DataFrame, column: str) -> DataFrame:
    """(row, bitmap): a bit for each hash (long) in ``column``; 16 MB at most."""
    return (keys.select(F.expr(f"{column} & {_TABLE_ROWS - 1}").alias("row"),
                        F.expr(f"shiftrightunsigned({column}, 12) & {_ROW_BITS - 1}").alias("bit"))
            .groupBy("row").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap")))


def _maybe_in(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """``df`` with ``_in``: false for rows whose hash is surely not in the
    table, else true (for a chance hit too). The table has a fixed size, so
    it is broadcast."""
    row = F.expr(f"{column} & {_TABLE_ROWS - 1}")
    bit = F.expr(f"cast(shiftrightunsigned({column}, 12) & {_ROW_BITS - 1} as int)")
    joined = (df.withColumns({"_row": row, "_bit": bit})
              .join(F.broadcast(table.select(F.col("row").alias("_row"), F.col("bitmap").alias("_bitmap"))), "_row", "left"))
    hit = F.expr("shiftright(cast(conv(hex(substring(_bitmap, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int), _bit % 8) & 1") == 1
    return joined.withColumn("_in", F.coalesce(hit, F.lit(False))).drop("_row", "_bit", "_bitmap")


def _lines(docs: DataFrame) -> DataFrame:
    """(t1, t2, i, tokens, leaf, line_key) of every line with a token."""
    lines = docs.select(*_TEXT, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    # Blanks alone divide most lines; digits and other white space take the long way.
    tidy = F.split(F.regexp_replace("line", r"[\t\x0B\f\r]", " "), " ")
    masked = F.transform(tidy, lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t))
    tokens = F.when(F.col("line").rlike(r"[0-9\t\x0B\f\r]"), masked).otherwise(F.split("line", " "))
    # Through a generator, so that a filter on the tokens does not build them twice.
    lines = lines.select(*_TEXT, "i", F.explode(F.array(F.array_remove(tokens, ""))).alias("tokens")).filter(F.size("tokens") > 0)
    return lines.withColumns({"leaf": F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)), "line_key": F.xxhash64("tokens")})


def _generalised(docs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """(leaf, line_key, code) of the lines in leaves that hold different lines,
    ``code`` being the line's template within the leaf."""
    mixed = (lines.groupBy("leaf").agg(F.min("line_key").alias("lo"), F.max("line_key").alias("hi"))
             .filter("lo != hi").select("leaf"))
    mixed = materialize(mixed, keep_partitioning=False)
    # Only texts with such a line are cut into lines again, and only its lines move.
    texts = lines.join(mixed.hint("merge"), "leaf", "left_semi").select("t1").distinct()
    texts = _maybe_in(docs, "t1", _bits(texts, "t1")).filter("_in").drop("_in")
    some = _maybe_in(_lines(texts).select(*_LINE, "tokens"), "leaf", _bits(mixed, "leaf")).filter("_in")
    # A line moves as one string, as no token holds a blank. A leaf that the bit
    # table lets through by chance holds one line, which is then its template.
    kinds = some.select(*_LINE, F.array_join("tokens", " ").alias("line")).distinct()
    kinds = materialize(kinds, keep_partitioning=False).withColumn("tokens", F.split("line", " ")).drop("line")
    # The leading tokens are the leaf's own: the vote is on the places after them.
    rest = F.expr(f"slice(tokens, {DEPTH + 1}, greatest(size(tokens) - {DEPTH}, 0))")
    group, left, placed = ["leaf", "code"], kinds.withColumn("code", F.lit(0).cast("long")), None
    while placed is None or not left.isEmpty():
        votes = (left.select(*group, F.posexplode(rest).alias("at", "token"))
                 .groupBy(*group, "at", "token").agg(F.count(F.lit(1)).alias("n")))
        constant = votes.groupBy(*group, "at").agg(F.max(F.struct("n", "token")).alias("top"))
        constants = (constant.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("at", "top.token"))).alias("_c"))
                     .select(*group, F.col("_c.token").alias("constants")))
        same = F.expr(f"least(size(tokens), {DEPTH})") + F.size(F.filter(F.zip_with(rest, "constants", lambda t, c: t == c), lambda x: x))
        judged = left.join(constants.hint("merge"), group).withColumn("agrees", same >= F.lit(similarity) * F.size("tokens"))
        judged = materialize(judged.select(*_LINE, "code", "agrees", F.when(~F.col("agrees"), F.col("tokens")).alias("tokens")), keep_partitioning=False)
        found = judged.filter("agrees").select(*_LINE, "code")
        placed = found if placed is None else placed.union(found)
        # The others part by their token at the place that holds the fewest kinds.
        others = judged.filter("not agrees").drop("agrees")
        kinds_at = (others.select(*group, F.posexplode(rest).alias("at", "token")).distinct()
                    .groupBy(*group, "at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        divide = kinds_at.groupBy(*group).agg(F.min(F.struct("n", "at")).alias("_d")).select(*group, F.col("_d.at").alias("at"))
        left = others.join(divide.hint("merge"), group).select(
            *_LINE, F.expr(f"xxhash64(code, at, tokens[at + {DEPTH}])").alias("code"), "tokens")
        left = materialize(left, keep_partitioning=False)
    return placed


def templates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(t1, t2, i, size, leaf, code): the template of every line of the distinct
    texts with the line's token count. ``code`` tells the templates of a leaf
    apart; it is the line's own where the leaf holds one line only."""
    lines = materialize(_lines(docs).select(*_TEXT, "i", F.size("tokens").alias("size"), *_LINE).distinct(), keep_partitioning=False)
    general = _generalised(docs, lines, similarity)
    return (lines.join(general.hint("merge"), _LINE, "left")
            .select(*_TEXT, "i", "size", "leaf", F.coalesce("code", "line_key").alias("code")))


def _found_in(lines: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, code) of the templates found in at least ``min_docs`` texts."""
    return (lines.select(*_TEMPLATE, *_TEXT).distinct().groupBy(*_TEMPLATE).agg(F.count(F.lit(1)).alias("texts"))
            .filter(F.col("texts") >= min_docs).select(*_TEMPLATE))


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(leaf, code) of the recurring templates."""
    frequent = _found_in(lines, min_docs).withColumn("frequent", F.lit(True))
    marked = materialize(lines.join(frequent.hint("merge"), _TEMPLATE, "left"), keep_partitioning=False)
    own = (marked.groupBy(*_TEXT).agg(F.sum("size").alias("n"), F.sum(F.when(F.col("frequent"), F.col("size"))).alias("shared"))
           .filter(F.col("shared") < COPY * F.col("n")).select(*_TEXT))
    return _found_in(marked.filter("frequent").join(own.hint("merge"), _TEXT, "left_semi"), min_docs)


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY,
                         text_col: str = "text") -> DataFrame:
    """``docs`` with all its rows and columns, ``text_col`` without the lines
    of recurring templates, plus n_lines and n_dropped (replacing columns of
    these names).

    Lines end at newlines; what is left is joined by newlines again, and a
    text that loses nothing stays as it is. Lines without a token are never
    dropped. A null text stays null with 0 lines. Equal texts, so repeated
    rows, get equal results. An empty table gives no rows.
    """
    keys = {"t1": F.xxhash64("text"), "t2": F.hash("text")}
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null").withColumns(keys)
    lines = materialize(templates(texts, similarity), keep_partitioning=False)
    gone = (lines.join(recurring(lines, min_docs).select(*_TEMPLATE).hint("merge"), _TEMPLATE)
            .groupBy(*_TEXT).agg(F.collect_list("i").alias("_gone")))
    gone = materialize(gone, keep_partitioning=False)
    rows = docs.drop("n_lines", "n_dropped").withColumns({"_t1": F.coalesce(F.xxhash64(text_col), F.lit(0).cast("long")), "_t2": F.hash(text_col)})
    # Only the texts that may lose lines are moved to the list of those lines.
    rows = _maybe_in(rows, "_t1", _bits(gone, "t1")).withColumn("_in", F.col("_in") & F.col(text_col).isNotNull())
    lost = rows.filter("_in").join(gone.withColumnsRenamed({"t1": "_g1", "t2": "_g2"}).hint("merge"),
                                   (F.col("_t1") == F.col("_g1")) & (F.col("_t2") == F.col("_g2")), "left").drop("_g1", "_g2")
    rows = lost.unionByName(rows.filter("not _in").withColumn("_gone", F.lit(None).cast("array<int>")))
    parts = F.split(text_col, "\n")
    left = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("_gone", i)), "\n")
    return rows.withColumns({
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long"),
        "n_dropped": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"),
        text_col: F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(left),
    }).drop("_t1", "_t2", "_gone", "_in")


#: The same for ``documents`` in DuckDB: doc_id, n_lines, n_dropped, kept_sha256.
SQL = rf"""
WITH RECURSIVE lines AS (
    SELECT text, i, list_transform(list_filter(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda t: t <> ''),
                                   lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
    FROM (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
          FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL))),
keyed AS (SELECT text, i, tokens, (len(tokens), tokens[1:{DEPTH}]) AS leaf FROM lines WHERE len(tokens) > 0),
kinds AS (SELECT DISTINCT leaf, tokens FROM keyed),
mixed AS (SELECT leaf FROM kinds GROUP BY leaf HAVING count(*) > 1),
rounds AS (
    SELECT leaf, []::VARCHAR[] AS code, tokens, FALSE AS agrees FROM kinds SEMI JOIN mixed USING (leaf)
    UNION ALL
    (WITH parts AS (SELECT leaf, code, tokens, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM rounds WHERE NOT agrees),
    votes AS (SELECT leaf, code, place, token, count(*) AS n FROM parts GROUP BY ALL),
    constants AS (SELECT leaf, code, place, max((n, token)) AS top FROM votes GROUP BY ALL),
    judged AS (SELECT leaf, code, tokens, count(*) FILTER (token = top[2]) >= CAST({SIMILARITY} AS DOUBLE) * count(*) AS agrees
               FROM parts JOIN constants USING (leaf, code, place) GROUP BY leaf, code, tokens),
    kinds_at AS (SELECT leaf, code, place, count(DISTINCT token) AS n FROM parts JOIN judged USING (leaf, code, tokens)
                 WHERE NOT agrees GROUP BY leaf, code, place HAVING count(DISTINCT token) > 1),
    divide AS (SELECT leaf, code, min((n, place)) AS least FROM kinds_at GROUP BY ALL)
    SELECT j.leaf, CASE WHEN j.agrees THEN j.code ELSE list_append(list_append(j.code, CAST(least[2] AS VARCHAR)), j.tokens[least[2]]) END, j.tokens, j.agrees
    FROM judged j LEFT JOIN divide d ON j.leaf = d.leaf AND j.code = d.code)),
placed AS (SELECT k.text, k.i, len(k.tokens) AS size, k.leaf, coalesce(r.code, k.tokens) AS code
           FROM keyed k LEFT JOIN rounds r ON k.leaf = r.leaf AND k.tokens = r.tokens AND r.agrees),
frequent AS (SELECT leaf, code FROM placed GROUP BY leaf, code HAVING count(DISTINCT text) >= {MIN_DOCS}),
marked AS (SELECT p.*, f.code IS NOT NULL AS frequent FROM placed p LEFT JOIN frequent f ON p.leaf = f.leaf AND p.code = f.code),
own AS (SELECT text FROM marked GROUP BY text HAVING sum(CASE WHEN frequent THEN size ELSE 0 END) < CAST({COPY} AS DOUBLE) * sum(size)),
recurring AS (SELECT leaf, code FROM marked SEMI JOIN own USING (text) WHERE frequent
              GROUP BY leaf, code HAVING count(DISTINCT text) >= {MIN_DOCS}),
gone AS (SELECT text, list(i) AS gone FROM placed SEMI JOIN recurring USING (leaf, code) GROUP BY text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(len(gone), 0) AS n_dropped,
       sha256(CASE WHEN gone IS NULL THEN coalesce(d.text, '') ELSE
              array_to_string(list_filter(string_split(d.text, chr(10)), lambda line, i: NOT list_contains(gone, i)), chr(10)) END) AS kept_sha256
FROM documents d LEFT JOIN gone USING (text)
"""
