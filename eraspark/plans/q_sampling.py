"""Registered queries: caps, samples, splits, one-vs-rest sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import corpus as C
from ..operators import sampling as SM
from ..sources.tables import songs
from . import sqltext as S
from .registry import register

ERAS = fixed.ERA_LABELS
SEED = fixed.SEED
WITH_CLEAN = f"WITH {S.CLEANED_CTE}"
D = "d AS (SELECT id, song_era FROM era_docs)"


def H(key: str) -> str:
    """SQL form of sha_order(seed, key)."""
    return f"md5('{SEED}|' || {key})"


def era_docs(spark, sf_dir):
    return C.prepare_songs(songs(spark, sf_dir)).select("id", "song_era")


def targets_sql(values) -> str:
    return "(VALUES " + ", ".join(f"('{v}')" for v in values) + ") AS tg(target)"


@register("undersample_cap", f"""{WITH_CLEAN}, {D},
r AS (SELECT id, song_era, row_number() OVER (PARTITION BY song_era ORDER BY {H('CAST(id AS VARCHAR)')}, id) AS k FROM d)
SELECT id, song_era FROM r WHERE k <= {fixed.CLASS_CAP}""")
def q_undersample_cap(spark, sf_dir):
    return SM.undersample_cap(era_docs(spark, sf_dir), "song_era")


@register("sample_n", f"""{WITH_CLEAN},
r AS (SELECT id, year, row_number() OVER (ORDER BY {H('CAST(id AS VARCHAR)')}, id) AS sample_rank FROM era_docs)
SELECT id, year, sample_rank, '' AS verified_year FROM r WHERE sample_rank <= {fixed.VERIFY_SAMPLE_N}""")
def q_sample_n(spark, sf_dir):
    d = C.prepare_songs(songs(spark, sf_dir)).select("id", "year")
    return SM.sample_n(d, fixed.VERIFY_SAMPLE_N).withColumn("verified_year", F.lit(""))


@register("shuffle_rows", f"""{WITH_CLEAN}, {D}
SELECT id, row_number() OVER (ORDER BY {H('CAST(id AS VARCHAR)')}, id) AS position FROM d""")
def q_shuffle_rows(spark, sf_dir):
    return SM.shuffle_rows(era_docs(spark, sf_dir).select("id"))


@register("split_random", f"""{WITH_CLEAN}, {D},
r AS (SELECT id, row_number() OVER (ORDER BY {H('CAST(id AS VARCHAR)')}, id) AS r FROM d),
n AS (SELECT ceil(CAST(0.1 AS DOUBLE) * count(*)) AS nt, count(*) AS n FROM d),
sz AS (SELECT nt, ceil(CAST(0.1 AS DOUBLE) * (n - nt)) AS nv FROM n)
SELECT id, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + nv THEN 'val' ELSE 'train' END AS split
FROM r, sz""")
def q_split_random(spark, sf_dir):
    return SM.split_random(era_docs(spark, sf_dir).select("id"))


def _approx_mode_sql(src: str, count: str, draws: str, out: str, keep: str) -> str:
    return f"""(SELECT {keep}, fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS {out} FROM (
  SELECT *, floor(cont) AS fl, {draws} - sum(floor(cont)) OVER () AS need,
         row_number() OVER (ORDER BY cont - floor(cont) DESC, song_era) AS rk
  FROM (SELECT *, {count} / sum({count}) OVER () * {draws} AS cont FROM {src})))"""


_STRAT_SQL = f"""{WITH_CLEAN}, {D},
r AS (SELECT id, song_era, row_number() OVER (PARTITION BY song_era ORDER BY {H('CAST(id AS VARCHAR)')}, id) AS r FROM d),
c AS (SELECT song_era, count(*) AS c FROM d GROUP BY song_era),
c1 AS (SELECT *, ceil(CAST(0.1 AS DOUBLE) * sum(c) OVER ()) AS nt_all FROM c),
t AS {_approx_mode_sql('c1', 'c', 'nt_all', 'nt', 'song_era, c')},
t1 AS (SELECT *, c - nt AS rest FROM t),
t2 AS (SELECT *, ceil(CAST(0.1 AS DOUBLE) * sum(rest) OVER ()) AS nv_all FROM t1),
q AS {_approx_mode_sql('t2', 'rest', 'nv_all', 'nv', 'song_era, nt')}
SELECT r.id, r.song_era,
       CASE WHEN r.r <= q.nt THEN 'test' WHEN r.r <= q.nt + q.nv THEN 'val' ELSE 'train' END AS split
FROM r JOIN q USING (song_era)"""


@register("split_stratified", _STRAT_SQL)
def q_split_stratified(spark, sf_dir):
    return SM.split_stratified(era_docs(spark, sf_dir), "song_era")


@register("ovr_balanced", f"""{WITH_CLEAN}, {D},
cnt AS (SELECT song_era AS target, least(count(*), {fixed.OVR_NEGATIVE_CAP}) AS q FROM d GROUP BY song_era),
pool AS (
  SELECT tg.target, d.id, d.song_era, cnt.q,
         row_number() OVER (PARTITION BY tg.target
                            ORDER BY {H("tg.target || '|' || CAST(d.id AS VARCHAR)")}, d.id) AS k
  FROM d JOIN {targets_sql(ERAS)} ON d.song_era IS NULL OR d.song_era <> tg.target
  JOIN cnt ON cnt.target = tg.target)
SELECT id, song_era, target, 0 AS is_target FROM pool WHERE k <= q
UNION ALL
SELECT id, song_era, song_era AS target, 1 AS is_target FROM d WHERE song_era IN {S.in_list(ERAS)}""")
def q_ovr_balanced(spark, sf_dir):
    return SM.ovr_balanced(era_docs(spark, sf_dir), "song_era", ERAS)


@register("ovr_fair_negatives", f"""{WITH_CLEAN}, {D},
sizes AS (SELECT song_era, count(*) AS s FROM d GROUP BY song_era),
tq AS (
  SELECT target, least(n_pos, CAST(floor(tot / m) AS BIGINT), tot, {fixed.OVR_NEGATIVE_CAP}) AS T FROM (
    SELECT t.song_era AS target, t.s AS n_pos,
           (SELECT sum(s) FROM sizes o WHERE o.song_era <> t.song_era) AS tot,
           (SELECT count(*) FROM sizes o WHERE o.song_era <> t.song_era) AS m
    FROM sizes t) WHERE m > 0),
k AS (SELECT id, song_era, row_number() OVER (PARTITION BY song_era ORDER BY {H('CAST(id AS VARCHAR)')}, id) AS k FROM d),
negc AS (SELECT tq.target, tq.T, k.id, k.song_era, k.k FROM k JOIN tq ON k.song_era <> tq.target WHERE k.k <= tq.T),
negp AS (
  SELECT n.*,
    (SELECT sum(least(o.s, n.k - 1)) FROM sizes o WHERE o.song_era <> n.target)
    + (SELECT count(*) FROM sizes o WHERE o.song_era <> n.target AND o.song_era < n.song_era AND o.s >= n.k)
    + 1 AS position
  FROM negc n)
SELECT id, song_era, target, 0 AS is_target FROM negp WHERE position <= T
UNION ALL
SELECT k.id, k.song_era, tq.target, 1 AS is_target FROM k JOIN tq ON k.song_era = tq.target WHERE k.k <= tq.T""")
def q_ovr_fair_negatives(spark, sf_dir):
    return SM.ovr_fair_negatives(era_docs(spark, sf_dir), "song_era")


_N_DRAWS = fixed.GENRE_DRAWS_PER_CLASS


def hash15(x: str) -> str:
    """SQL form of a draw's hash."""
    return f"('0x' || substr(md5({x}), 1, 15))::BIGINT"


# Ranks within the own class; a side's classes lie one after the other.
@register("ovr_with_replacement", f"""WITH {S.SONGS_CTE},
g AS (SELECT id, tag, row_number() OVER (PARTITION BY tag ORDER BY {H("CAST(id AS VARCHAR)")}, id) AS pos
      FROM songs WHERE tag IN {S.in_list(fixed.GENRES)}),
sizes AS (SELECT tag, count(*) AS n FROM g GROUP BY tag),
seg AS (SELECT tg.target, CAST(s.tag = tg.target AS INTEGER) AS is_target, s.tag, s.n,
               coalesce(sum(s.n) OVER (PARTITION BY tg.target, s.tag = tg.target ORDER BY s.tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM sizes s, {targets_sql(fixed.GENRES)}),
sides AS (SELECT target, is_target, sum(n) AS size FROM seg GROUP BY ALL),
draws AS (
  SELECT s.target, s.is_target, r.draw,
         {hash15(f"'{SEED}|' || s.target || '|' || CAST(s.is_target AS VARCHAR) || '|' || CAST(r.draw AS VARCHAR)")} % s.size AS u
  FROM sides s, (SELECT range AS draw FROM range(1, {_N_DRAWS} + 1)) r)
SELECT d.target, d.is_target, d.draw, g.id
FROM draws d JOIN seg ON seg.target = d.target AND seg.is_target = d.is_target AND d.u >= seg.below AND d.u < seg.below + seg.n
JOIN g ON g.tag = seg.tag AND g.pos = d.u - seg.below + 1""")
def q_ovr_with_replacement(spark, sf_dir):
    g = C.filter_in_genres(songs(spark, sf_dir)).select("id", "tag")
    return SM.ovr_with_replacement(g, "tag", fixed.GENRES, _N_DRAWS).select(
        "target", "is_target", "draw", "id")


@register("weighted_sample_replace", f"""{WITH_CLEAN},
d AS (SELECT id, song_era, year, row_number() OVER (PARTITION BY song_era ORDER BY {H('CAST(id AS VARCHAR)')}, id) AS pos
      FROM era_docs WHERE song_era IS NOT NULL),
sizes AS (SELECT song_era, count(*) AS size, row_number() OVER (ORDER BY song_era) - 1 AS ci FROM d GROUP BY song_era),
draws AS (SELECT r.draw, {hash15(f"'{SEED}|c|' || CAST(r.draw AS VARCHAR)")} % (SELECT count(*) FROM sizes) AS ci
          FROM (SELECT unnest(range(1, (SELECT count(*) FROM d) + 1)) AS draw) r)
SELECT draws.draw, d.id, d.song_era, d.year FROM draws JOIN sizes USING (ci)
JOIN d ON d.song_era = sizes.song_era AND d.pos = {hash15(f"'{SEED}|r|' || CAST(draws.draw AS VARCHAR)")} % sizes.size + 1""")
def q_weighted_sample_replace(spark, sf_dir):
    """Year-regression training draws, every era equally likely."""
    d = C.prepare_songs(songs(spark, sf_dir)).select("id", "song_era", "year")
    return SM.weighted_sample_replace(d, "song_era").select("draw", "id", "song_era", "year")


@register("sample_n_report", f"""{WITH_CLEAN},
r AS (SELECT id, song_era, row_number() OVER (ORDER BY {H('CAST(id AS VARCHAR)')}, id) AS sample_rank FROM era_docs)
SELECT id, song_era, sample_rank FROM r WHERE sample_rank <= {fixed.REPORT_SAMPLE_N}""")
def q_sample_n_report(spark, sf_dir):
    """The 1 000-row sample the method comparison is run on."""
    d = C.prepare_songs(songs(spark, sf_dir)).select("id", "song_era")
    return SM.sample_n(d, fixed.REPORT_SAMPLE_N)


def split_by_target_sql(src: str) -> str:
    """CTEs up to ``bt``: rows of ``src`` (target, is_target, id) with the
    stratified split of each target's set."""
    def shares(table, count, draws, out, keep):
        return f"""(SELECT {keep}, fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS {out} FROM (
  SELECT *, floor(cont) AS fl, {draws} - sum(floor(cont)) OVER (PARTITION BY target) AS need,
         row_number() OVER (PARTITION BY target ORDER BY cont - floor(cont) DESC, is_target) AS rk
  FROM (SELECT *, {count} / sum({count}) OVER (PARTITION BY target) * {draws} AS cont FROM {table})))"""
    return f"""br AS (SELECT target, is_target, id, row_number() OVER (PARTITION BY target, is_target
         ORDER BY {H("target || '|' || CAST(id AS VARCHAR)")}, id) AS r FROM {src}),
bc AS (SELECT *, ceil(CAST(0.1 AS DOUBLE) * sum(c) OVER (PARTITION BY target)) AS nt_all
       FROM (SELECT target, is_target, count(*) AS c FROM {src} GROUP BY ALL)),
b1 AS {shares('bc', 'c', 'nt_all', 'nt', 'target, is_target, c')},
b2 AS (SELECT *, ceil(CAST(0.1 AS DOUBLE) * sum(c - nt) OVER (PARTITION BY target)) AS nv_all, c - nt AS rest FROM b1),
b3 AS {shares('b2', 'rest', 'nv_all', 'nv', 'target, is_target, nt')},
bt AS (SELECT br.target, br.is_target, br.id,
  CASE WHEN br.r <= b3.nt THEN 'test' WHEN br.r <= b3.nt + b3.nv THEN 'val' ELSE 'train' END AS split
  FROM br JOIN b3 USING (target, is_target))"""
