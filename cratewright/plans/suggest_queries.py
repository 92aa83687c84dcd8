"""Suggestion queries over the part table read as a collection of tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewright.functions import harmonic
from cratewright.functions.lookups import CORE_GENRES, FLOOR_GENRES, NEIGHBOURS, SHOW_GENRES, theme_pairs, two_steps
from cratewright.plans import suggest
from cratewright.plans.registry import query
from cratewright.session import table

# Part types stand for genres, so that all distances of the genre graph occur.
TYPE_GENRE = {"ECONOMY": "Darkwave", "SMALL": "Gothic Rock", "MEDIUM": "EBM", "PROMO": "Metal", "STANDARD": "Pop", "LARGE": "Ambient"}
THEMES = ("loss", "love", "power", "surreal", "")


def part_tracks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    genre = F.lit("Other")
    for t, g in TYPE_GENRE.items():
        genre = F.when(F.col("p_type") == t, g).otherwise(genre)
    letter = F.when(F.floor(F.col("p_partkey") / 12) % 2 == 0, "d").otherwise("m")
    theme = F.element_at(F.array(*map(F.lit, THEMES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(
        F.col("p_partkey").cast("string").alias("path"),
        F.col("p_brand").alias("artist"),
        F.col("p_name").alias("title"),
        genre.alias("genre"),
        (F.lit(90.0) + F.col("p_size")).alias("bpm"),
        F.concat((F.col("p_partkey") % 12 + 1).cast("string"), letter).alias("key"),
        (F.col("p_partkey") % 6).cast("int").alias("stars"),
        theme.alias("theme"),
        F.col("p_retailprice").alias("bitrate"),
        F.col("p_partkey").alias("idx"),
    )


def anchors(tracks: DataFrame) -> DataFrame:
    """The stated query set: every track whose number is divisible by 20."""
    return tracks.where("idx % 20 = 0")


def _strings(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


TRACKS_SQL = f"""tracks AS (
  SELECT CAST(p_partkey AS VARCHAR) AS path, p_brand AS artist, p_name AS title,
    CASE p_type {" ".join(f"WHEN '{t}' THEN '{g}'" for t, g in TYPE_GENRE.items())} ELSE 'Other' END AS genre,
    CAST(90 + p_size AS DOUBLE) AS bpm, CAST(p_partkey % 12 + 1 AS VARCHAR) || CASE WHEN (p_partkey // 12) % 2 = 0 THEN 'd' ELSE 'm' END AS key,
    p_partkey % 12 + 1 AS kn, CASE WHEN (p_partkey // 12) % 2 = 0 THEN 'd' ELSE 'm' END AS kl,
    CAST(p_partkey % 6 AS INTEGER) AS stars, ([{_strings(THEMES)}])[p_partkey % 5 + 1] AS theme,
    lower(trim(p_brand)) || chr(9) || lower(trim(p_name)) AS song, p_retailprice AS bitrate, p_partkey AS idx
  FROM part)"""
PAIRS_SQL = (
    "gp(g1, g2, w) AS (VALUES " + ", ".join(f"('{a}', '{b}', {w})" for a, b, w in two_steps()) + "), "
    "tp(t1, t2, w) AS (VALUES " + ", ".join(f"('{a}', '{b}', {w})" for a, b, w in theme_pairs()) + ")"
)


def bpm_sql(a: str, b: str) -> str:
    return f"CASE WHEN abs({a} - {b}) <= 2 THEN 1.0 WHEN abs({a} - {b}) <= 6 THEN 0.85 WHEN abs({a} - {b}) <= 12 THEN 0.6 WHEN abs({a} - {b}) <= 18 THEN 0.3 WHEN abs({a} - {b}) <= 30 THEN 0.1 ELSE 0.0 END::DOUBLE"


def key_sql(a: str, b: str) -> str:
    d = f"least(abs({a}.kn - {b}.kn), 12 - abs({a}.kn - {b}.kn))"
    return f"CASE WHEN {a}.kn = {b}.kn AND {a}.kl = {b}.kl THEN 1.0 WHEN {a}.kn = {b}.kn THEN 0.9 WHEN {d} = 1 AND {a}.kl = {b}.kl THEN 0.85 WHEN {d} = 1 THEN 0.6 WHEN {d} = 2 AND {a}.kl = {b}.kl THEN 0.4 WHEN {d} <= 3 THEN 0.2 ELSE 0.05 END::DOUBLE"


def transition_sql(a: str, b: str, k: str) -> str:
    d, same = f"abs({a}.bpm - {b}.bpm)", f"{a}.genre = {b}.genre"
    return f"""CASE WHEN {d} <= 2.5 AND {same} AND {k} >= 0.8 THEN 'BEAT+FRAGMENT' WHEN {d} <= 6 AND {k} >= 0.8 THEN 'BEAT MATCH' WHEN {d} <= 6 AND {k} < 0.4 THEN 'BEAT+FX'
    WHEN {d} <= 6 THEN 'BEAT MATCH' WHEN {d} <= 12 AND {k} >= 0.5 AND NOT {same} THEN 'STEM BLEND' WHEN {d} <= 12 AND {k} >= 0.5 THEN 'BLEND' WHEN {k} < 0.25 THEN 'EFFECT FADE'
    WHEN {d} > 12 AND {k} >= 0.6 THEN 'LOOP DROP' ELSE 'BLEND' END"""


THEME_SQL = "CASE WHEN a.theme = '' OR t.theme = '' THEN 0.0 WHEN a.theme = t.theme THEN 1.0 WHEN a.theme = 'surreal' OR t.theme = 'surreal' THEN 0.5 ELSE coalesce(tp.w, 0.0) END"
CORE_SQL = f"CASE WHEN t.genre IN ({_strings(CORE_GENRES)}) THEN 1.0 ELSE 0.4 END"

_LOCK = f"""
WITH {TRACKS_SQL}, {PAIRS_SQL},
s AS (
  SELECT a.path AS anchor, a.bpm AS abpm, t.path, t.idx, t.artist, t.title, t.genre, t.song, {transition_sql("a", "t", key_sql("a", "t"))} AS transition,
    round(CAST(0.33 AS DOUBLE) * {bpm_sql("a.bpm", "t.bpm")} + CAST(0.28 AS DOUBLE) * {key_sql("a", "t")} + CAST(0.17 AS DOUBLE) * CASE WHEN a.genre = t.genre THEN 1.0 ELSE coalesce(gp.w, 0.05) * 0.5 END::DOUBLE
      + CAST(0.10 AS DOUBLE) * (t.stars / 5.0) + CAST(0.07 AS DOUBLE) * {CORE_SQL}::DOUBLE + CAST(0.05 AS DOUBLE) * ({THEME_SQL})::DOUBLE, 6) AS score
  FROM tracks a JOIN tracks t ON a.idx % 20 = 0 AND a.path <> t.path AND a.song <> t.song AND a.artist <> t.artist
  LEFT JOIN gp ON gp.g1 = a.genre AND gp.g2 = t.genre LEFT JOIN tp ON tp.t1 = a.theme AND tp.t2 = t.theme
  WHERE t.genre IN ({_strings(SHOW_GENRES)})),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY anchor, song ORDER BY score DESC, idx) = 1),
w AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY anchor, artist ORDER BY score DESC, idx) = 1),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor ORDER BY score DESC, idx) AS INTEGER) AS place FROM w)
SELECT anchor, place, path, artist, title, genre, score, transition FROM p WHERE place <= 8 AND score > 0.1
"""


@query(_LOCK)
def suggest_lock(spark: SparkSession, d: str) -> DataFrame:
    t = part_tracks(spark, d)
    return suggest.lock(t, anchors(t))


_NEAR = ", ".join(f"('{g}', '{x}')" for g, xs in NEIGHBOURS.items() for x in xs if x in SHOW_GENRES)
_BRIDGE = f"""
WITH {TRACKS_SQL}, {PAIRS_SQL}, near(g, d) AS (VALUES {_NEAR}),
pair AS (SELECT a.*, s.path AS s_path, s.artist AS s_artist, s.song AS s_song, s.bpm AS s_bpm, s.kn AS s_kn, s.kl AS s_kl, s.genre AS s_genre FROM tracks a JOIN tracks s ON a.idx % 20 = 0 AND s.idx = a.idx + 7),
gs AS (SELECT DISTINCT genre FROM tracks WHERE genre IN ({_strings(SHOW_GENRES)})),
dest AS (
  SELECT pair.path AS anchor, near.d FROM pair JOIN near ON near.g = pair.genre
  UNION ALL
  SELECT anchor, d FROM (SELECT pair.path AS anchor, gs.genre AS d, row_number() OVER (PARTITION BY pair.path ORDER BY gs.genre) AS r FROM pair JOIN gs ON gs.genre <> pair.genre WHERE pair.genre NOT IN (SELECT g FROM near)) WHERE r <= 8),
s AS (
  SELECT a.path AS anchor, dest.d AS destination, t.path, t.idx, t.song, t.artist,
    {transition_sql("b", "t", key_sql("b", "t"))} AS transition,
    round(CAST(0.47 AS DOUBLE) * (CAST(0.5 AS DOUBLE) * {bpm_sql("a.s_bpm", "t.bpm")} + CAST(0.5 AS DOUBLE) * {key_sql("b", "t")}) + CAST(0.38 AS DOUBLE) * CASE WHEN t.genre = dest.d THEN 1.0 WHEN gp.w = 0.6 THEN 0.5 ELSE 0.0 END::DOUBLE
      + CAST(0.10 AS DOUBLE) * {CORE_SQL}::DOUBLE + CAST(0.05 AS DOUBLE) * ({THEME_SQL})::DOUBLE, 6) AS score
  FROM pair a JOIN dest ON dest.anchor = a.path JOIN tracks b ON b.path = a.s_path
  JOIN tracks t ON t.path <> a.path AND t.path <> a.s_path AND t.song <> a.song AND t.song <> a.s_song AND t.artist <> a.artist AND t.artist <> a.s_artist
  LEFT JOIN gp ON gp.g1 = t.genre AND gp.g2 = dest.d LEFT JOIN tp ON tp.t1 = a.theme AND tp.t2 = t.theme
  WHERE t.genre IN ({_strings(SHOW_GENRES)})),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY anchor, destination, song ORDER BY score DESC, idx) = 1),
f AS (SELECT * FROM o WHERE score > 0.25),
w AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY anchor, destination, artist ORDER BY score DESC, idx) = 1),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor, destination ORDER BY score DESC, idx) AS INTEGER) AS place FROM w),
q AS (SELECT *, max(round_even(score * 100, 0)) OVER (PARTITION BY anchor, destination) AS best FROM p WHERE place <= 3)
SELECT anchor, destination, CAST(dense_rank() OVER (PARTITION BY anchor ORDER BY best DESC, destination) AS INTEGER) AS group_place, place, path, score, transition FROM q
"""


@query(_BRIDGE)
def suggest_bridge(spark: SparkSession, d: str) -> DataFrame:
    t = part_tracks(spark, d)
    a = anchors(t).select(*(F.col(c).alias(f"a_{c}") for c in suggest.TRACK))
    s = t.select(*(F.col(c).alias(f"s_{c}") for c in suggest.TRACK))
    return suggest.bridge(t, a.join(s, F.col("s_idx") == F.col("a_idx") + 7))


@query(f"""
WITH {TRACKS_SQL}, {PAIRS_SQL},
s AS (SELECT a.path AS anchor, t.path, t.idx, round(0.4::DOUBLE * t.stars / 5.0::DOUBLE + 0.35::DOUBLE * {bpm_sql("a.bpm", "t.bpm")} + 0.25::DOUBLE * CASE WHEN a.genre = t.genre THEN 1.0 ELSE coalesce(gp.w, 0.05) END::DOUBLE, 6) AS score
  FROM tracks a JOIN tracks t ON a.idx % 20 = 0 LEFT JOIN gp ON gp.g1 = a.genre AND gp.g2 = t.genre WHERE t.stars >= 3),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor ORDER BY score DESC, idx) AS INTEGER) AS place FROM s WHERE score > 0)
SELECT anchor, place, path, score FROM p WHERE place <= 5
""")
def rescue_topk(spark: SparkSession, d: str) -> DataFrame:
    t = part_tracks(spark, d)
    return suggest.rescue(t, anchors(t))


_NOISE = "CAST(('0x' || substring(md5('0 ' || path), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"WITH {TRACKS_SQL} SELECT path, round(stars / 5.0::DOUBLE + {_NOISE} * 0.25::DOUBLE, 6) AS score FROM tracks WHERE stars >= 4 ORDER BY score DESC, path LIMIT 20")
def fallback_topk(spark: SparkSession, d: str) -> DataFrame:
    return suggest.fallback(part_tracks(spark, d), 20, 4, 0.25)


@query(f"WITH {TRACKS_SQL} SELECT path, round(stars / 5.0::DOUBLE + {_NOISE} * 0.15::DOUBLE, 6) AS score FROM tracks WHERE stars >= 3 AND genre IN ({_strings(FLOOR_GENRES)}) AND idx % 20 <> 0 ORDER BY score DESC, path LIMIT 20")
def surprise_topk(spark: SparkSession, d: str) -> DataFrame:
    t = part_tracks(spark, d)
    return suggest.surprise(t, t.where("idx % 20 = 0"), n=20)


@query(f"""
WITH {TRACKS_SQL}, m AS (SELECT a.path AS a_path, b.path AS b_path, a.bpm AS ab, b.bpm AS bb, {key_sql("a", "b")} AS k, {transition_sql("a", "b", key_sql("a", "b"))} AS transition FROM tracks a JOIN tracks b ON b.idx = a.idx + 1)
SELECT a_path, b_path, {bpm_sql("ab", "bb")} AS bpm_score, k AS key_score, transition FROM m
""")
def transition_label(spark: SparkSession, d: str) -> DataFrame:
    t = part_tracks(spark, d)
    b = t.select((F.col("idx") - 1).alias("idx"), *(F.col(c).alias(f"b_{c}") for c in ("path", "bpm", "key", "genre")))
    x = t.select("idx", *(F.col(c).alias(f"a_{c}") for c in ("path", "bpm", "key", "genre"))).join(b, "idx")
    c = F.col
    return x.select("a_path", "b_path", harmonic.bpm_compat(c("a_bpm"), c("b_bpm")).alias("bpm_score"), harmonic.key_compat(c("a_key"), c("b_key")).alias("key_score"), harmonic.transition(c("a_bpm"), c("a_key"), c("a_genre"), c("b_bpm"), c("b_key"), c("b_genre")).alias("transition"))


@query(f"WITH {TRACKS_SQL} SELECT path, artist, title FROM tracks WHERE contains(lower(artist || ' ' || title || ' ' || genre), 'ring') ORDER BY path LIMIT 30")
def search_topn(spark: SparkSession, d: str) -> DataFrame:
    return suggest.search(part_tracks(spark, d), " Ring").select("path", "artist", "title")


@query(f"""
WITH {TRACKS_SQL}, g AS (SELECT path, CAST(CASE WHEN contains(lower(title), 'blue') AND contains(lower(artist), 'brand#1') THEN 3
  WHEN contains(lower(artist || ' ' || title || ' ' || genre), 'blue') OR contains(lower(artist || ' ' || title || ' ' || genre), 'brand#1') THEN 2 WHEN contains(lower(title), 'blue') THEN 1 ELSE 0 END AS INTEGER) AS grade FROM tracks)
SELECT path, grade FROM g WHERE grade > 0 ORDER BY grade DESC, path LIMIT 1
""")
def graded_match(spark: SparkSession, d: str) -> DataFrame:
    return suggest.resolve(part_tracks(spark, d), "Brand#1", "blue").select("path", "grade")


@query(f"WITH {TRACKS_SQL} SELECT path, title, bitrate FROM tracks QUALIFY row_number() OVER (PARTITION BY song ORDER BY bitrate DESC, path) = 1")
def dedup_song_key(spark: SparkSession, d: str) -> DataFrame:
    return suggest.dedup_tracks(part_tracks(spark, d)).select("path", "title", "bitrate")


@query(f"""
WITH {TRACKS_SQL} SELECT path, CASE WHEN round_even(bpm, 0) BETWEEN 118 AND 124 THEN '1' WHEN least(abs(round_even(bpm, 0) - 118), abs(round_even(bpm, 0) - 124)) <= 6 THEN '2' WHEN least(abs(round_even(bpm, 0) - 118), abs(round_even(bpm, 0) - 124)) <= 12 THEN '3'
  WHEN least(abs(round_even(bpm, 0) - 118), abs(round_even(bpm, 0) - 124)) <= 18 THEN '4' WHEN least(abs(round_even(bpm, 0) - 118), abs(round_even(bpm, 0) - 124)) <= 24 THEN '5' WHEN least(abs(round_even(bpm, 0) - 118), abs(round_even(bpm, 0) - 124)) <= 30 THEN '6' ELSE '7' END AS color FROM tracks
""")
def banded_color(spark: SparkSession, d: str) -> DataFrame:
    return part_tracks(spark, d).select("path", harmonic.bpm_color(F.col("bpm")).alias("color"))


@query(f"WITH {TRACKS_SQL} SELECT genre, count(*) AS n, count_if(genre IN ({_strings(FLOOR_GENRES)})) AS n_floor, count_if(genre IN ({_strings(CORE_GENRES)})) AS n_core FROM tracks GROUP BY genre")
def genre_counts(spark: SparkSession, d: str) -> DataFrame:
    return part_tracks(spark, d).groupBy("genre").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("genre").isin(*FLOOR_GENRES)).alias("n_floor"), F.count_if(F.col("genre").isin(*CORE_GENRES)).alias("n_core"))
