"""Queries of plans, reports, exports and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewright.functions import paths, text
from cratewright.operators import changes, stages
from cratewright.plans.collection_queries import low_sql
from cratewright.plans.library_queries import _T, tracks
from cratewright.plans.registry import query
from cratewright.session import table
from cratewright.sources import files, lookups, state

c = F.col


@query(f"""
WITH RECURSIVE {_T}, x AS (SELECT entry_id AS idx, path, regexp_replace({low_sql('artist')}, '^(the|a|an) ', '') || chr(9) || regexp_replace({low_sql('title')}, '^(the|a|an) ', '') AS song, info_key AS k, playtime, bpm, len(cues) AS rich,
  CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.flac' THEN 6 WHEN '.wav' THEN 5 WHEN '.aiff' THEN 4 WHEN '.aif' THEN 4 WHEN '.m4a' THEN 3 WHEN '.ogg' THEN 2 WHEN '.opus' THEN 2 WHEN '.mp3' THEN 1 ELSE 0 END AS fmt,
  CASE WHEN contains(path, '/Backups/') OR contains(path, '/backups/') THEN 0 ELSE 1 END AS ok FROM t),
e AS (SELECT a.idx AS a, b.idx AS b FROM x a JOIN x b ON a.song = b.song AND a.k = b.k AND a.idx <> b.idx AND abs(a.playtime - b.playtime) <= 1 AND abs(a.bpm - b.bpm) <= 0.5),
r(v, w) AS (SELECT a, a FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.w), g AS (SELECT v AS idx, min(w) AS comp FROM r GROUP BY v),
w AS (SELECT comp, path AS winner FROM g JOIN x USING (idx) QUALIFY row_number() OVER (PARTITION BY comp ORDER BY rich DESC, fmt DESC, playtime DESC, ok DESC, length(path), idx) = 1)
SELECT DISTINCT x.path AS loser, w.winner FROM g JOIN x USING (idx) JOIN w USING (comp) WHERE x.path <> w.winner
""")
def tolerance_winners(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select(c("entry_id").alias("idx"), "path", "artist", "title", c("info_key").alias("any_key"), "playtime", "bpm", F.size("cues").alias("richness"))
    return stages.merge_by_tolerance(t)


@query()
def converted_duplicates(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select(c("entry_id").alias("idx"), "path", "artist", "title", F.trim("filesize").try_cast("double").alias("size"), F.trim("playtime_float").try_cast("double").alias("seconds"))
    return stages.merge_converted(t.where("size > 0 and seconds > 0"))


@query()
def corrected_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nml_entry").select("entry_id", text.clean_existing(c("artist"), c("title")).alias("x")).select("entry_id", "x.*")


@query()
def recovered_artists(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "artist_credit").select(c("artist").alias("name"))
    return stages.recover_with_confidence(table(spark, d, "nml_entry"), "entry_id", "title", known)


def _safe_sql(x: str) -> str:
    s = f"trim(regexp_replace(regexp_replace(trim({x}, ' '), '[\\\\/:*?\"<>|]', '_', 'g'), '[ _]{{2,}}', ' ', 'g'), ' ._')"
    return f"CASE WHEN {s} <> '' THEN substring({s}, 1, 100) ELSE 'Unknown' END"


@query(f"""
WITH x AS (SELECT entry_id, artist, title, CASE WHEN coalesce(album_title, '') = '' THEN 'Unknown Album' ELSE album_title || CASE WHEN coalesce(release_date, '') <> '' THEN ' (' || release_date || ')' ELSE '' END END AS folder,
  try_cast(regexp_extract(album_track, '^\\s*(\\d+)', 1) AS INTEGER) AS n, loc_file FROM nml_entry)
SELECT entry_id, concat_ws('/', '/out', {_safe_sql('artist')}, {_safe_sql('folder')}, {_safe_sql("CASE WHEN n IS NOT NULL THEN printf('%02d - ', n) ELSE '' END || title")} || lower(regexp_extract(loc_file, '(\\.[^./]+)$', 1))) AS target FROM x
""")
def destinations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nml_entry").select("entry_id", text.destination("/out", c("artist"), c("album_title"), c("release_date"), c("album_track"), c("title"), paths.extension(c("loc_file"))).alias("target"))


@query("""
SELECT p_partkey, p_name AS title, p_brand || ' & ' || p_type AS artist, CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE 'A' END AS album, CASE WHEN p_partkey % 2 = 0 THEN CAST(1950 + p_size AS VARCHAR) END AS year, CASE WHEN p_partkey % 2 = 0 THEN '7' END AS track,
  CASE WHEN p_size >= 25 THEN 'Dark Wave' ELSE 'Ebm' END AS genre FROM part
""")
def recordings(spark: SparkSession, d: str) -> DataFrame:
    official = F.concat(F.lit(', {"title": "B", "status": "Official", "date": "'), (c("p_size") + 1950).cast("string"), F.lit('-01", "media": [{"track": [{"number": "7"}]}]}'))
    votes = F.concat(F.lit('[{"name": "dark wave", "count": '), c("p_size").cast("string"), F.lit('}, {"name": "ebm", "count": 25}]'))
    body = F.concat(
        F.lit('{"title": "'), c("p_name"), F.lit('", "artist-credit": [{"name": "'), c("p_brand"), F.lit('", "joinphrase": " & "}, {"artist": {"name": "'), c("p_type"), F.lit('"}}], "releases": [{"title": "A", "date": "soon"}'),
        F.when(c("p_partkey") % 2 == 0, official).otherwise(""), F.lit('], "genres": '), F.when(c("p_partkey") % 3 == 0, votes).otherwise("[]"), F.lit(', "tags": '), votes, F.lit("}"),
    )
    # Equal counts leave the first one in front.
    return table(spark, d, "part").select("p_partkey", lookups.recording(body).alias("x")).select("p_partkey", "x.*")


@query("""
WITH h AS (SELECT h.started_at, n.entry_id, n.artist, n.title, try_cast(trim(n.bpm) AS DOUBLE) AS bpm, n.genre FROM history_row h JOIN nml_entry n USING (entry_id) WHERE started_at IS NOT NULL),
p AS (SELECT started_at, CAST(entry_id AS VARCHAR) AS path, min(artist) AS artist, min(title) AS title, min(bpm) AS bpm, min(genre) AS genre FROM h GROUP BY 1, 2)
SELECT CAST(row_number() OVER (ORDER BY started_at, path) AS INTEGER) AS n, printf('%02d. %s - %s [%.1f BPM | %s]', row_number() OVER (ORDER BY started_at, path), coalesce(artist, 'null'), coalesce(title, 'null'), bpm, coalesce(genre, 'null')) AS line FROM p WHERE bpm IS NOT NULL
""")
def setlist_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry").select("entry_id", "artist", "title", F.trim("bpm").try_cast("double").alias("bpm"), "genre")
    h = table(spark, d, "history_row").where("started_at is not null").select("entry_id", c("started_at").alias("played_at")).join(e, "entry_id")
    played = h.groupBy("played_at", c("entry_id").cast("string").alias("path")).agg(*(F.min(x).alias(x) for x in ("artist", "title", "bpm", "genre")))
    return state.setlist_lines(played.where("bpm is not null"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def applied_changes(spark: SparkSession, d: str) -> DataFrame:
    before = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    after = before.withColumn("c_mktsegment", F.when(c("c_acctbal") < 0, F.lower("c_mktsegment")).otherwise(c("c_mktsegment")))
    return changes.apply_changes(before, changes.change_set(before, after, "c_custkey", ["c_mktsegment"]), "c_custkey")


@query("SELECT lang, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:5], ',') AS examples FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def language_report(spark: SparkSession, d: str) -> DataFrame:
    r = changes.report(table(spark, d, "documents").where("lang is not null").select("lang", "doc_id"), ["lang"], "doc_id", 5)
    return r.select("lang", "n", F.array_join(c("examples").cast("array<string>"), ",").alias("examples"))


@query(f"WITH {_T} SELECT CASE WHEN contains(path, '/backups/') OR contains(path, '/Backups/') THEN 'delete' WHEN path LIKE '/crates/inbox/%' THEN 'move' END AS action, path AS src, '/library' || path AS dst, genre AS reason FROM t WHERE contains(path, '/backups/') OR contains(path, '/Backups/') OR path LIKE '/crates/inbox/%'")
def file_plan(spark: SparkSession, d: str) -> DataFrame:
    p = c("path")
    action = F.when(F.contains(p, F.lit("/backups/")) | F.contains(p, F.lit("/Backups/")), "delete").when(p.like("/crates/inbox/%"), "move")
    return changes.file_actions(tracks(spark, d), action, p, F.concat(F.lit("/library"), p), c("genre"))


@query("""
WITH RECURSIVE f AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey // 4 AS VARCHAR) AS parent FROM part), b(id, depth) AS (SELECT '1', 0 UNION ALL SELECT f.id, b.depth + 1 FROM f JOIN b ON f.parent = b.id)
SELECT id, depth FROM b
""")
def folders_below(spark: SparkSession, d: str) -> DataFrame:
    return files.below(table(spark, d, "part").select(c("p_partkey").cast("string").alias("id"), F.floor(c("p_partkey") / 4).cast("bigint").cast("string").alias("parent")), "1")


@query(f"""
WITH {_T}, s AS (SELECT DISTINCT path, regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\\.[^.]*$', '\\1') AS stem FROM t),
k AS (SELECT path, unnest(CASE WHEN regexp_matches(stem, '^(.+?)\\s*[-–—]\\s*(.+)$') THEN [{{'a': trim(regexp_extract(stem, '^(.+?)\\s*[-–—]\\s*(.+)$', 1)), 't': trim(regexp_extract(stem, '^(.+?)\\s*[-–—]\\s*(.+)$', 2))}}, {{'a': trim(regexp_extract(stem, '^(.+?)\\s*[-–—]\\s*(.+)$', 2)), 't': trim(regexp_extract(stem, '^(.+?)\\s*[-–—]\\s*(.+)$', 1))}}]
  ELSE [{{'a': '', 't': trim(stem)}}] END) AS c FROM s),
i AS (SELECT path, {low_sql('c.a')} || chr(9) || {low_sql("regexp_replace(coalesce(c.t, ''), '(?s)\\s*[\\(\\[].*', '')")} AS key FROM k)
SELECT key, min(path) AS path FROM i WHERE key IN (SELECT chr(9) || {low_sql("regexp_replace(coalesce(title, ''), '(?s)\\s*[\\(\\[].*', '')")} FROM t) GROUP BY 1
""")
def file_index(spark: SparkSession, d: str) -> DataFrame:
    from cratewright.functions import keys

    t = tracks(spark, d)
    return files.file_index(t.select("path").distinct(), t.select(keys.cut_key(F.lit(""), c("title")).alias("key")))


@query("SELECT c_custkey, '<X NAME=\"' || c_mktsegment || '\" RANKING=\"255\"/>' AS line FROM customer")
def patched_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit('<X NAME="'), c("c_name"), F.lit('" RANKING="'), c("c_custkey").cast("string"), F.lit('"/>'))
    return table(spark, d, "customer").select("c_custkey", files.patch_attribute(files.patch_attribute(line, "RANKING", F.lit("255")), "NAME", c("c_mktsegment")).alias("line"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN coalesce(source, 'none') END AS summary FROM documents")
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct(F.coalesce("source", F.lit("none")).alias("summary")))
    reply = F.when(c("doc_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(c("doc_id") % 3 == 2, body).otherwise('{"other": 1}')
    return table(spark, d, "documents").select("doc_id", text.fenced_json(reply, "summary string", "summary")["summary"].alias("summary"))
