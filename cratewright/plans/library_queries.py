"""Queries of indexes, audits, small joins and text rules over the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewright.functions import grid, harmonic, keys, paths, text
from cratewright.functions.lookups import LOWERCASE_NAMES
from cratewright.operators import dedup, joins, library, normalize, rank, stages
from cratewright.plans.collection_queries import _PATHS, entry_paths, low_sql
from cratewright.plans.registry import query
from cratewright.session import table
from cratewright.sources import lookups as services

c = F.col
TAB = " || chr(9) || "


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """The entries as tracks: typed numbers and cues, the entry's number as its order."""
    number = lambda x: F.trim(x).try_cast("double")
    cue = lambda x: F.struct(x["cue_name"].alias("name"), x["cue_type"].try_cast("int").alias("type"), number(x["start_ms"]).alias("start_ms"), number(x["len_ms"]).alias("len_ms"), x["hotcue"].try_cast("int").alias("hotcue"))
    e = entry_paths(spark, d).withColumn("entry_idx", c("entry_id")).withColumn("album", c("album_title")).withColumn("cues", F.transform("cues", cue))
    return e.withColumn("bpm", number(c("bpm"))).withColumn("playtime", number(c("playtime"))).withColumn("ranking", number(c("ranking")))


_T = f"{_PATHS}, t AS (SELECT n.* REPLACE (try_cast(trim(bpm) AS DOUBLE) AS bpm, try_cast(trim(playtime) AS DOUBLE) AS playtime, try_cast(trim(ranking) AS DOUBLE) AS ranking), p.path FROM nml_entry n JOIN p USING (entry_id))"
_NAMED = "(trim(coalesce(artist, '')) <> '' OR trim(coalesce(title, '')) <> '')"
_SONG = low_sql("artist") + TAB + low_sql("title")
_VERSION = low_sql("artist") + TAB + low_sql("regexp_replace(coalesce(title, ''), '\\s*[\\(\\[][^\\n\\r]{0,40}[\\)\\]]\\s*$', '')")
_BARE = low_sql("artist") + TAB + low_sql("regexp_replace(coalesce(title, ''), '\\s*[\\(\\[][^)\\]]*[\\)\\]]', '', 'g')")
_CUT = low_sql("artist") + TAB + low_sql("regexp_replace(coalesce(title, ''), '(?s)\\s*[\\(\\[].*', '')")
_BASE = low_sql("artist") + TAB + low_sql("regexp_replace(coalesce(title, ''), '\\s*\\([^)]*\\)\\s*$', '')")


@query(f"WITH {_T} SELECT {_VERSION} AS key, arg_max(path, entry_id) AS path FROM t WHERE {_NAMED} GROUP BY 1")
def path_index(spark: SparkSession, d: str) -> DataFrame:
    return library.path_index(tracks(spark, d))


@query(f"WITH {_T} SELECT {_BARE} AS key, CAST(len(arg_min(cues, entry_id)) AS INTEGER) AS n_cues FROM t WHERE len(cues) > 0 GROUP BY 1")
def cue_index(spark: SparkSession, d: str) -> DataFrame:
    return library.cue_index(tracks(spark, d)).select("key", F.size("cues").alias("n_cues"))


_DISTINCT = f"f AS (SELECT {_SONG} AS key, trim(artist) AS artist, trim(title) AS title, trim(album_title) AS album, path FROM t WHERE {_NAMED} QUALIFY row_number() OVER (PARTITION BY {_SONG} ORDER BY entry_id) = 1)"


@query(f"WITH {_T}, {_DISTINCT} SELECT * FROM f")
def distinct_tracks(spark: SparkSession, d: str) -> DataFrame:
    return library.distinct_tracks(tracks(spark, d))


@query(f"WITH {_T}, {_DISTINCT} SELECT {low_sql('artist')}{TAB}{low_sql('album')} AS album_key, key FROM f WHERE coalesce(artist, '') <> '' AND coalesce(album, '') <> ''")
def album_tracks(spark: SparkSession, d: str) -> DataFrame:
    return library.album_tracks(tracks(spark, d))


@query(f"""
WITH {_T}, a AS (SELECT entry_id, bpm, playtime, try_cast(trim(list_filter(cues, lambda x: x.cue_name = 'AutoGrid')[1].start_ms) AS DOUBLE) AS anchor_ms FROM t)
SELECT * FROM a WHERE bpm > 0 AND playtime > 0 AND anchor_ms IS NOT NULL
""")
def beat_entries(spark: SparkSession, d: str) -> DataFrame:
    return library.beat_entries(tracks(spark, d)).select("entry_id", "bpm", "playtime", "anchor_ms")


@query(f"WITH {_T} SELECT entry_id FROM t WHERE coalesce(ranking, 0) = 0")
def unranked_tracks(spark: SparkSession, d: str) -> DataFrame:
    return library.unranked(tracks(spark, d)).select("entry_id")


_RENAMED = "r AS (SELECT artist, min(mb_artist_id) AS new_artist FROM artist_credit WHERE mb_artist_id IS NOT NULL GROUP BY 1)"


@query(f"""
WITH {_T}, {_RENAMED}, x AS (SELECT path, coalesce(trim(artist), '') AS artist, trim(title) AS title FROM t WHERE regexp_matches(trim(title), '^\\p{{Ll}}'))
SELECT x.path, x.artist, coalesce(r.new_artist, x.artist) AS effective_artist, x.title FROM x LEFT JOIN r USING (artist) WHERE x.artist NOT IN ({", ".join(f"'{n}'" for n in LOWERCASE_NAMES)})
""")
def title_audit(spark: SparkSession, d: str) -> DataFrame:
    renames = table(spark, d, "artist_credit").where("mb_artist_id is not null").groupBy("artist").agg(F.min("mb_artist_id").alias("new_artist"))
    return library.title_audit(tracks(spark, d), renames)


@query(f"WITH {_T} SELECT DISTINCT lyrics_key AS key FROM lyrics_raw WHERE lyrics_key IN (SELECT {_CUT} FROM t)")
def progress_pruned(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lyrics_raw").select(c("lyrics_key").alias("key")).where("key is not null").distinct()
    return library.still_there(done, tracks(spark, d))


@query("SELECT entry_id, row_number() OVER (ORDER BY lower(artist) NULLS FIRST, lower(title) NULLS FIRST, entry_id) - 1 AS place FROM nml_entry")
def sorted_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry").select("entry_id", F.struct(F.lower("artist").alias("a"), F.lower("title").alias("t"), "entry_id").alias("at"))
    return rank.numbered(e, "at", "place").select("entry_id", "place")


@query("""
WITH g AS (SELECT m.group_id AS key, count(DISTINCT m.entry_id) - 1 AS n_losers, sum(len(n.cues)) AS richness FROM dedup_member m JOIN nml_entry n USING (entry_id) WHERE m.group_id IS NOT NULL GROUP BY 1)
SELECT key, n_losers, CAST(richness AS BIGINT) AS richness FROM g WHERE n_losers >= 1 ORDER BY n_losers DESC, richness DESC, key LIMIT 25
""")
def worst_groups(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "dedup_member").where("group_id is not null").join(table(spark, d, "nml_entry").select("entry_id", "cues"), "entry_id")
    g = m.groupBy(c("group_id").alias("key")).agg((F.count_distinct("entry_id") - 1).alias("n_losers"), F.sum(F.size("cues")).alias("richness"))
    return library.worst_first(g, most=25, least=1)


@query(f"""
WITH {_T}, r AS (SELECT m.group_id AS g, min(n.genre) AS genre FROM dedup_member m JOIN nml_entry n USING (entry_id) WHERE trim(n.genre) <> '' GROUP BY 1)
SELECT DISTINCT t.path, r.genre FROM t JOIN dedup_member m USING (entry_id) JOIN r ON r.g = m.group_id
""")
def genre_of_recordings(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "dedup_member").select(c("group_id").alias("recording_id"), "entry_id").distinct()
    t = tracks(spark, d).select("entry_id", "path", "genre").join(m, "entry_id")
    return library.genre_of_recordings(t.select("path", "recording_id"), t.select("recording_id", "genre")).distinct()


_MUSIC = "m AS (SELECT DISTINCT path AS old_path, '/music' || substring(path, 13) AS new_path FROM t WHERE path LIKE '/crates/main/%')"


@query(f"WITH {_T}, {_MUSIC} SELECT t.entry_id, m.new_path AS path, t.genre FROM t JOIN m ON m.old_path = t.path")
def genre_at_new_paths(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("entry_id", "path", "genre")
    m = t.where("path like '/crates/main/%'").select(c("path").alias("old_path"), F.concat(F.lit("/music"), F.substring("path", 13, 1 << 30)).alias("new_path")).distinct()
    return library.at_new_paths(t, m)


@query(f"""
WITH {_T}, {_MUSIC}, s AS (SELECT new_path AS old, '/library' || substring(new_path, 7) AS new FROM m WHERE length(new_path) % 2 = 0 UNION SELECT path, '/attic' || path FROM t WHERE path LIKE '/crates/inbox/%')
SELECT m.old_path AS old, coalesce(s.new, m.new_path) AS new FROM m LEFT JOIN s ON s.old = m.new_path UNION ALL SELECT old, new FROM s WHERE old NOT IN (SELECT old_path FROM m) AND old NOT IN (SELECT new_path FROM m WHERE false)
""")
def composed_renames(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("path").distinct()
    first = t.where("path like '/crates/main/%'").select(c("path").alias("old"), F.concat(F.lit("/music"), F.substring("path", 13, 1 << 30)).alias("new"))
    again = first.where(F.length("new") % 2 == 0).select(c("new").alias("old"), F.concat(F.lit("/library"), F.substring("new", 7, 1 << 30)).alias("new"))
    inbox = t.where("path like '/crates/inbox/%'").select(c("path").alias("old"), F.concat(F.lit("/attic"), "path").alias("new"))
    return joins.compose(first, again.unionByName(inbox))


def _known(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is known of lyrics, artists and songs, from the tables that hold their keys."""
    lyrics = table(spark, d, "lyrics_raw").where("lyrics_key is not null").groupBy(c("lyrics_key").alias("key")).agg(F.min(F.substring(F.replace("lyrics_text", F.lit("\n"), F.lit(" ")), 1, 40)).alias("summary"), F.min("origin").alias("theme"), F.sort_array(F.collect_set(F.lower("lang_label"))).alias("flags"))
    artists = table(spark, d, "artist_credit").where("mb_artist_id is not null").groupBy(keys.low(c("artist")).alias("artist")).agg(F.min("mb_artist_id").alias("tier"))
    songs = library.song_flags(table(spark, d, "nml_entry").where("trim(ranking) = '51'").select("artist", "title", c("genre").alias("reason")).where("reason is not null"))
    return lyrics, artists, songs


_KNOWN = f"""
l AS (SELECT lyrics_key AS key, min(substring(replace(lyrics_text, chr(10), ' '), 1, 40)) AS summary, min(origin) AS theme, list_sort(list_distinct(list(lower(lang_label)))) AS flags FROM lyrics_raw WHERE lyrics_key IS NOT NULL GROUP BY 1),
a AS (SELECT {low_sql('artist')} AS who, min(mb_artist_id) AS tier FROM artist_credit WHERE mb_artist_id IS NOT NULL GROUP BY 1),
s AS (SELECT {_SONG} AS key, max(genre) AS reason FROM nml_entry WHERE trim(ranking) = '51' AND genre IS NOT NULL GROUP BY 1)"""


@query(f"WITH {_KNOWN} SELECT * FROM s")
def song_flag_index(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d)[2]


@query(f"""
WITH {_T}, {_KNOWN}, x AS (SELECT t.entry_id, l.summary, t.comment2 AS old, nullif(concat_ws(' | ', nullif(l.theme, ''), nullif(array_to_string(list_transform(l.flags, lambda f: '⚑' || f), ' '), ''), CASE WHEN coalesce(a.tier, '') <> '' THEN '⚑rep:' || a.tier END,
    CASE WHEN coalesce(s.reason, '') <> '' THEN '⚑song:' || CASE WHEN length(s.reason) > 60 THEN substring(s.reason, 1, 60) || '…' ELSE s.reason END END), '') AS built
  FROM t LEFT JOIN l ON l.key = {_SONG} LEFT JOIN a ON a.who = {low_sql('artist')} LEFT JOIN s ON s.key = {_SONG})
SELECT entry_id, nullif(summary, '') AS comment, coalesce(built, old) AS comment2 FROM x
""")
def track_comments(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).withColumn("comment", F.lit(None).cast("string"))
    return library.with_comments(t, *_known(spark, d)).select("entry_id", "comment", "comment2")


@query(f"""
WITH {_T}, {_KNOWN}, x AS (SELECT t.entry_id, path, trim(artist) AS artist, trim(title) AS title, bpm, playtime, a.tier, s.reason, l.summary, l.theme, try_cast(trim(playtime_float) AS DOUBLE) AS dur, try_cast(trim(cues[1].start_ms) AS DOUBLE) AS v_in
  FROM t LEFT JOIN l ON l.key = {_SONG} LEFT JOIN a ON a.who = {low_sql('artist')} LEFT JOIN s ON s.key = {_SONG})
SELECT path, artist, title, round_even(bpm, 1) AS bpm, CAST(round_even(playtime % 101 / 100 * 100, 0) AS INTEGER) AS score, tier AS rep_tier, reason AS song_flag, nullif(summary, '') AS lyric_summary, nullif(theme, '') AS lyric_theme,
  CAST(round_even(dur * 1000, 0) AS BIGINT) AS duration_ms, CASE WHEN coalesce(v_in, 0) <> 0 THEN CAST(round_even(v_in, 0) AS BIGINT) END AS vocal_in_ms,
  regexp_matches(coalesce(title, ''), '(?i)\\b(instrumental|inst\\.?|no[ -]?vocals?|karaoke|ambient\\s+mix|dub\\s+mix)\\b') OR lower(trim(coalesce(theme, ''))) = 'instrumental' OR starts_with(lower(trim(coalesce(summary, ''))), 'instrumental') OR starts_with(lower(trim(coalesce(summary, ''))), '[instrumental]') AS is_instrumental FROM x
""")
def shown_tracks(spark: SparkSession, d: str) -> DataFrame:
    lyrics, artists, songs = _known(spark, d)
    t = tracks(spark, d).withColumn("key", keys.song_key(c("artist"), c("title"))).join(lyrics.select("key", "summary", "theme"), "key", "left")
    t = t.withColumn("artist", F.trim("artist")).withColumn("title", F.trim("title")).withColumn("stars", F.lit(0)).withColumn("duration", F.trim("playtime_float").try_cast("double"))
    t = t.withColumn("vocal_in_ms", F.try_element_at("cues", F.lit(1))["start_ms"]).withColumn("vocal_out_ms", F.lit(None).cast("double"))
    shown = library.as_shown(t, F.pmod("playtime", F.lit(101)) / 100, F.lit(""), songs, artists.withColumn("summary", F.lit(None).cast("string")))
    return shown.select("path", "artist", "title", "bpm", "score", "rep_tier", "song_flag", "lyric_summary", "lyric_theme", "duration_ms", "vocal_in_ms", "is_instrumental")


@query(f"""
WITH {_T}, w AS (SELECT {_SONG} AS key, min(trim(artist)) AS a, min(trim(title)) AS t FROM t WHERE trim(artist) <> '' AND trim(title) <> '' GROUP BY 1),
f AS (SELECT path, list_extract(string_split(path, '/'), -1) AS name, list_extract(string_split(path, '/'), -2) AS dir, string_split(path, '/')[:-2] AS dirs FROM (SELECT DISTINCT path FROM t)),
x AS (SELECT w.key, f.path, CASE WHEN len(list_filter(f.dirs, lambda y: starts_with(y, w.a))) > 0 THEN 0 WHEN contains(f.dir, substring(w.a, 1, 15)) THEN 1 END AS r FROM w JOIN f ON contains(f.name, substring(w.t, 1, 20)))
SELECT key, arg_min(path, {{'r': r, 'p': path}}) AS path FROM x WHERE r IS NOT NULL GROUP BY 1
""")
def found_files(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    w = t.where("trim(artist) <> '' and trim(title) <> ''").groupBy(keys.song_key(c("artist"), c("title")).alias("key")).agg(F.min(F.trim("artist")).alias("artist"), F.min(F.trim("title")).alias("title"))
    return library.find_files(w, t.select("path"))


@query(f"WITH {_T} SELECT DISTINCT t.entry_id, '/share/' || substring(t.path, 14) AS audio FROM t WHERE starts_with(t.path, '/crates/main/') AND t.path IN (SELECT path FROM t WHERE entry_id % 3 <> 0)")
def audio_index(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    files = t.where("entry_id % 3 <> 0").select(paths.re_anchor(c("path"), "main", "/share").alias("audio")).where("audio is not null").distinct()
    return t.select("entry_id", paths.re_anchor(c("path"), "main", "/share").alias("audio")).join(files, "audio").select("entry_id", "audio")


@query(f"""
WITH {_T}, n AS (SELECT DISTINCT path, list_extract(string_split(path, '/'), -1) AS base FROM t), u AS (SELECT DISTINCT list_extract(string_split(path, '/'), -1) AS base FROM t WHERE entry_id % 7 = 0),
x AS (SELECT path, base, regexp_extract(base, '.(\\.[^.]*)$', 1) AS ext, path = min(path) OVER (PARTITION BY base) AND base NOT IN (SELECT base FROM u) AS plain FROM n),
y AS (SELECT path, plain, base, ext, substring(base, 1, length(base) - length(ext)) || '__20240101' AS stamped FROM x)
SELECT path, '/done/' || CASE WHEN plain THEN base ELSE stamped || CASE WHEN row_number() OVER (PARTITION BY plain, stamped ORDER BY path) > 1 THEN '_' || CAST(row_number() OVER (PARTITION BY plain, stamped ORDER BY path) AS VARCHAR) ELSE '' END || ext END AS target FROM y
""")
def safe_moves(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    taken = t.where("entry_id % 7 = 0").select(paths.base_name(c("path")).alias("name"))
    return library.safe_moves(t.select("path").distinct(), "/done", taken, "20240101")


# ---- small joins


@query("SELECT entry_id, CASE WHEN entry_id IN (SELECT entry_id FROM history_row WHERE entry_id IS NOT NULL) THEN 'hit' ELSE 'miss' END AS outcome FROM nml_entry")
def cached_or_not(spark: SparkSession, d: str) -> DataFrame:
    hit, miss = joins.hits_and_misses(table(spark, d, "nml_entry").select("entry_id"), table(spark, d, "history_row"), "entry_id")
    return hit.withColumn("outcome", F.lit("hit")).unionByName(miss.withColumn("outcome", F.lit("miss")))


@query("SELECT entry_id, entry_id IN (SELECT entry_id FROM dedup_member WHERE entry_id IS NOT NULL) AS in_group FROM nml_entry")
def flag_by_key(spark: SparkSession, d: str) -> DataFrame:
    return joins.flagged(table(spark, d, "nml_entry").select("entry_id"), table(spark, d, "dedup_member"), "entry_id", "in_group")


@query(f"""
WITH {_T}, i AS (SELECT {_BARE} AS key, arg_min(cues, entry_id) AS donor FROM t WHERE len(cues) > 0 AND entry_id % 2 = 0 GROUP BY 1)
SELECT t.entry_id, CAST(coalesce(len(coalesce(i.donor, t.cues)), -1) AS INTEGER) AS n_cues, i.donor IS NOT NULL AS transplanted FROM t LEFT JOIN i ON i.key = {_BARE} WHERE t.entry_id % 2 = 1
""")
def cue_transplant(spark: SparkSession, d: str) -> DataFrame:
    # Odd entries stand for one collection, even ones for the other.
    t = tracks(spark, d).withColumn("key", keys.bare_key(c("artist"), c("title")))
    out = joins.transplant(t.where("entry_id % 2 = 1").select("entry_id", "key", "cues"), library.cue_index(t.where("entry_id % 2 = 0")), ["key"], "cues")
    return out.select("entry_id", F.coalesce(F.size("cues"), F.lit(-1)).alias("n_cues"), "transplanted")


@query(f"""
WITH l AS (SELECT DISTINCT lyrics_key AS k FROM lyrics_raw WHERE coalesce(lyrics_text, '') <> ''), x AS (SELECT l.k IS NOT NULL AS hit, coalesce(trim(comment2), '') <> '' AS had FROM nml_entry LEFT JOIN l ON l.k = {_SONG})
SELECT count_if(hit) AS written, count_if(hit AND had) AS already, count_if(NOT hit) AS skipped FROM x
""")
def overwrite_count(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "lyrics_raw").select(c("lyrics_key").alias("k"), c("lyrics_text").alias("comment2"))
    return joins.overwritten(table(spark, d, "nml_entry").select(keys.song_key(c("artist"), c("title")).alias("k"), "comment2"), new, "k", "comment2")


@query("SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def only_missing(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(c("o_custkey").alias("k"), c("o_orderkey").alias("v"), "o_orderstatus")
    own, other = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.max("v").alias("v")), o.groupBy("k").agg(F.min("v").alias("v"))
    return joins.only_missing(own, other, "k")


@query(f"""
WITH {_T}, s AS (SELECT path, max(len(cues)) AS score FROM t GROUP BY 1), m AS (SELECT DISTINCT d.group_id, t.path FROM dedup_member d JOIN t USING (entry_id) WHERE d.group_id IS NOT NULL)
SELECT group_id, CAST(coalesce(max(CASE WHEN s.score > 3 THEN s.score END), 0) AS INTEGER) AS best FROM m LEFT JOIN s USING (path) GROUP BY 1
""")
def best_of_paths(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    groups = table(spark, d, "dedup_member").where("group_id is not null").join(t.select("entry_id", "path"), "entry_id").groupBy("group_id").agg(F.collect_set("path").alias("paths"))
    scores = t.groupBy("path").agg(F.max(F.size("cues")).alias("score")).where("score > 3")
    return rank.best_of_paths(groups, "paths", scores, "best").select("group_id", "best")


@query("""
SELECT p_partkey, round_even(p_size * 100.0::DOUBLE / 50, 1) AS pct, round_even(CASE WHEN p_retailprice > 0 AND p_size > 0 THEN p_size / CAST(p_retailprice AS DOUBLE) END, 2) AS per_second,
  round_even((50 - p_size) / (p_size / CAST(p_retailprice AS DOUBLE)), 0) AS eta_s FROM part
""")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    x = rank.progress(c("p_size"), F.lit(50), c("p_retailprice").cast("double"))
    return table(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.*")


# ---- text rules


@query("SELECT lyrics_id, length(trim(coalesce(lyrics_text, ''))) < 20 OR regexp_full_match(trim(coalesce(lyrics_text, '')), '(?i)(Thank you\\.?\\s*)+') AS invented FROM lyrics_raw")
def invented_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lyrics_raw").select("lyrics_id", text.is_invented(c("lyrics_text")).alias("invented"))


_FLAGS, _THEMES = ("en", "de", "fr"), ("web", "typed")


@query(f"SELECT lyrics_id, array_to_string(list_filter([lang_label, origin, lower(lang_label)], lambda x: x IN {_FLAGS}), ',') AS flags, CASE WHEN origin IN {_THEMES} THEN origin ELSE '' END AS theme FROM lyrics_raw")
def allowed_values(spark: SparkSession, d: str) -> DataFrame:
    values = F.array(c("lang_label"), c("origin"), F.lower("lang_label"))
    return table(spark, d, "lyrics_raw").select("lyrics_id", F.array_join(text.allowed_only(values, _FLAGS), ",").alias("flags"), text.allowed_or_blank(c("origin"), _THEMES).alias("theme"))


@query("SELECT entry_id, coalesce(trim(artist), '') = '' AS unknown_artist, regexp_matches(coalesce(artist, ''), '^\\p{Ll}') AS lower_case, regexp_extract(coalesce(title, ''), '^(\\d{1,3}\\s*[-–]\\s*)', 1) AS prefix FROM nml_entry")
def name_flags(spark: SparkSession, d: str) -> DataFrame:
    a = F.coalesce("artist", F.lit(""))
    return table(spark, d, "nml_entry").select("entry_id", (F.coalesce(F.trim("artist"), F.lit("")) == "").alias("unknown_artist"), a.rlike(r"^\p{Ll}").alias("lower_case"), text.track_prefix(F.coalesce("title", F.lit(""))).alias("prefix"))


@query("""
WITH x AS (SELECT credit_id, artist, CASE WHEN regexp_matches(artist, '(?i)^(.+?)\\s+(?:feat\\.?|ft\\.?|featuring|with|w/)\\s+.+$') THEN trim(regexp_extract(artist, '(?i)^(.+?)\\s+(?:feat\\.?|ft\\.?|featuring|with|w/)\\s+.+$', 1))
  WHEN regexp_matches(artist, '(?i)^(.+?)\\s+(?:&|and)\\s+.+$') THEN trim(regexp_extract(artist, '(?i)^(.+?)\\s+(?:&|and)\\s+.+$', 1)) END AS first_artist FROM artist_credit)
SELECT credit_id, first_artist, coalesce(length(artist) BETWEEN 3 AND 60 AND NOT regexp_full_match(artist, '\\d+') AND NOT regexp_matches(artist, '(?i)^(track\\s*\\d+|unknown|untitled|track)$'), false) AS plausible FROM x
""")
def primary_artists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artist_credit").select("credit_id", text.primary_artist(c("artist")).alias("first_artist"), text.plausible_artist(c("artist")).alias("plausible"))


@query("SELECT entry_id, CASE WHEN b >= 150 THEN b / 2 WHEN b > 0 AND b < 60 THEN b * 2 ELSE b END AS folded FROM (SELECT entry_id, try_cast(trim(bpm) AS DOUBLE) AS b FROM nml_entry)")
def folded_tempo(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).select("entry_id", harmonic.fold_bpm(c("bpm")).alias("folded"))


@query("SELECT event_id, printf('%d:%02d', CAST(floor(abs(value) / 60) AS BIGINT), CAST(floor(abs(value)) AS BIGINT) % 60) AS shown, round(pow(10.0::DOUBLE, (value % 60) / 20), 6) AS amplitude FROM events WHERE value IS NOT NULL")
def minutes_and_levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value is not null").select("event_id", text.minutes(F.abs("value")).alias("shown"), F.round(grid.amplitude(c("value").cast("double") % 60), 6).alias("amplitude"))


@query(f"""
WITH {_T}, x AS (SELECT entry_id, path, list_position(string_split(path, '/'), 'main') AS i, string_split(path, '/') AS ps FROM t)
SELECT entry_id, CASE WHEN i > 0 AND i + 1 < len(ps) THEN ps[i + 1] ELSE list_extract(ps, -2) END AS folder, regexp_replace(list_extract(ps, -1), '(.)\\.[^.]*$', '\\1') AS stem, starts_with(path, '/crates/inbox/') AS inbox,
  '/' || array_to_string(list_filter(string_split('Other HD/:' || array_to_string(list_filter(ps, lambda y: y <> ''), '/:'), '/:')[2:], lambda y: y <> ''), '/') AS from_key FROM x
""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = c("path")
    return tracks(spark, d).select("entry_id", paths.folder_after(p, "main").alias("folder"), paths.stem(p).alias("stem"), paths.under_any(p, ["/crates/inbox"]).alias("inbox"), paths.any_key_to_path(paths.path_to_key(p, "Other HD")).alias("from_key"))


@query("SELECT l_orderkey, l_linenumber, CAST(least(greatest(floor((l_quantity - 10) / 30 * 7), 0), 6) AS INTEGER) AS word, len(list_filter([0, 1, 2, 3, 7], lambda s: s <> l_linenumber)) AS n_missing FROM lineitem")
def sung_word(spark: SparkSession, d: str) -> DataFrame:
    from cratewright.operators.series import word_at

    cues = F.array(F.struct(c("l_linenumber").cast("int").alias("hotcue")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", word_at(F.lit(10.0), F.lit(40.0), c("l_quantity").cast("double"), F.lit(7)).alias("word"), F.size(grid.missing_slots(cues)).cast("bigint").alias("n_missing"))


@query("""
WITH a AS (SELECT p_partkey, 60000.0::DOUBLE / (90 + p_size) AS p, CAST(p_retailprice AS DOUBLE) AS x FROM part), b AS (SELECT *, (x - 120.5::DOUBLE) % p AS m FROM a), o AS (SELECT *, CASE WHEN m < 0 THEN (m + p) % p ELSE m END AS off FROM b)
SELECT p_partkey, round(CASE WHEN off < p / 2 THEN x - off ELSE x - off + p END, 3) AS beat, CAST(greatest(ceil((3000.0::DOUBLE - (120.5::DOUBLE - floor(120.5::DOUBLE / p) * p)) / p), 0) AS INTEGER) AS n_beats FROM o
""")
def beats(spark: SparkSession, d: str) -> DataFrame:
    p = grid.beat_ms(F.lit(90.0) + c("p_size"))
    return table(spark, d, "part").select("p_partkey", F.round(grid.beat_half_up(c("p_retailprice").cast("double"), F.lit(120.5), p), 3).alias("beat"), F.size(grid.beats_between(F.lit(120.5), p, F.lit(3000.0))).alias("n_beats"))


# ---- stages


@query(f"""
WITH {_T}, g AS (SELECT t.*, row_number() OVER (PARTITION BY {_SONG} ORDER BY entry_id) AS r FROM t WHERE trim(artist) <> '' AND trim(title) <> ''),
x AS (SELECT CAST(entry_id AS VARCHAR) AS sha, path AS winner, artist, title, CAST(len(cues) AS INTEGER) AS richness, coalesce(try_cast(trim(bitrate) AS BIGINT), 0) AS bitrate,
  CASE WHEN coalesce(title, '') = '' OR regexp_matches(title, '(?i)^(track\\s*\\d+|unknown|untitled|track)$') OR regexp_matches(artist, '(?i)^artist$') OR {low_sql('artist')} IN ('unknown artist', 'artist') OR {low_sql('title')} = '' THEN 'sha ' || CAST(entry_id AS VARCHAR)
    ELSE regexp_replace({low_sql('artist')}, '^(the|a|an) ', '') || chr(9) || {low_sql('title')} END AS key,
  CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.flac' THEN 6 WHEN '.wav' THEN 5 WHEN '.aiff' THEN 4 WHEN '.aif' THEN 4 WHEN '.m4a' THEN 3 WHEN '.ogg' THEN 2 WHEN '.opus' THEN 2 WHEN '.mp3' THEN 1 ELSE 0 END AS fmt,
  CASE WHEN contains(path, '/Backups/') OR contains(path, '/backups/') THEN 0 ELSE 1 END AS ok FROM g),
w AS (SELECT key, sha, winner FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY richness DESC, fmt DESC, bitrate DESC, ok DESC, length(winner), sha) = 1),
l AS (SELECT DISTINCT x.key, x.winner AS loser FROM x JOIN w USING (key) WHERE x.winner <> w.winner)
SELECT w.key, w.sha, w.winner, l.loser FROM w LEFT JOIN l USING (key)
""")
def merge_by_name(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).where("trim(artist) <> '' and trim(title) <> ''")
    g = t.select(c("entry_id").cast("string").alias("sha"), c("path").alias("winner"), F.array().cast("array<string>").alias("losers"), "artist", "title", F.size("cues").alias("richness"), F.coalesce(F.trim("bitrate").try_cast("bigint"), F.lit(0)).alias("bitrate"))
    return stages.merge_by_name(g).select("key", "sha", "winner", "loser")


@query("SELECT md5(text) AS md5, arg_min(doc_id, {'s': -(length(coalesce(artist, '')) + length(coalesce(source, ''))), 'i': doc_id}) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def better_tags(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select(c("doc_id").alias("idx"), F.md5("text").alias("md5"), "artist", c("source").alias("title"))
    return stages.better_tags(t).select("md5", c("idx").alias("doc_id"))


@query("""
WITH n AS (SELECT artist AS name, count(*) AS n FROM nml_entry WHERE trim(artist) <> '' GROUP BY 1), b AS (SELECT lower(trim(name)) AS k, arg_min(name, {'u': CASE WHEN regexp_matches(name, '^\\p{Lu}') THEN 0 ELSE 1 END, 'n': -n, 'x': name}) AS best, count(*) AS c FROM n GROUP BY 1),
r AS (SELECT n.name, b.best AS canonical, n.n FROM n JOIN b ON b.k = lower(trim(n.name)) WHERE c > 1 AND n.name <> b.best)
SELECT canonical, array_to_string(list_sort(list(name)), '|') AS variants, CAST(sum(n) AS BIGINT) AS n_records FROM r GROUP BY 1
""")
def rename_report(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "nml_entry").where("trim(artist) <> ''").groupBy(c("artist").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return stages.rename_report(normalize.canonical_names(counts), counts).withColumn("variants", F.array_join("variants", "|"))


_CONSOLIDATED = (("BUILDING", "MACHINERY"), ("FURNITURE", "HOUSEHOLD"))


@query("WITH m(raw, canonical) AS (VALUES " + ", ".join(str(x) for x in _CONSOLIDATED) + ") SELECT c_custkey, coalesce(m.canonical, c_mktsegment) AS c_mktsegment, m.canonical IS NOT NULL AS changed FROM customer LEFT JOIN m ON m.raw = c_mktsegment")
def consolidated(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame(_CONSOLIDATED, "raw string, canonical string")
    return stages.consolidate(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", m, ["MACHINERY", "HOUSEHOLD", "AUTOMOBILE"])


# ---- results of services, as tables


@query("""
WITH r AS (SELECT o_custkey AS k, list({'id': o_orderkey, 's': CAST(o_totalprice AS DOUBLE), 'n': o_orderpriority} ORDER BY o_orderkey) AS rs FROM orders GROUP BY 1)
SELECT k, list_filter(rs, lambda r: r.s = list_max(list_transform(rs, lambda y: y.s)))[1].id AS best, coalesce(list_filter(rs, lambda r: contains(lower(r.n), 'high') OR contains('high', lower(r.n)))[1], rs[1]).id AS closest FROM r
""")
def service_choices(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(c("o_custkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct(c("o_orderkey").alias("id"), c("o_totalprice").cast("double").alias("score"), c("o_orderpriority").alias("name")))).alias("rs"))
    return o.select("k", services.best_result(c("rs"))["id"].alias("best"), services.closest_hit(c("rs"), F.lit(" HIGH"), "name")["id"].alias("closest"))


@query("""
WITH f AS (SELECT DISTINCT entry_id FROM match_pair, LATERAL (SELECT unnest([entry_a, entry_b]) AS entry_id) WHERE entry_id IS NOT NULL)
SELECT entry_id, CASE WHEN entry_id IN (SELECT entry_id FROM dedup_member WHERE entry_id IS NOT NULL) THEN 'in library' WHEN entry_id IN (SELECT entry_id FROM history_row WHERE entry_id IS NOT NULL) THEN 'downloaded' ELSE 'new' END AS status FROM f
""")
def drive_status(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "match_pair").select(F.explode(F.array("entry_a", "entry_b")).alias("entry_id")).where("entry_id is not null").distinct()
    return services.drive_status(f, table(spark, d, "dedup_member"), table(spark, d, "history_row"), "entry_id")


@query("""
WITH a AS (SELECT artist AS name, CASE ascii(artist) % 3 WHEN 0 THEN 'convicted' WHEN 1 THEN 'accused' ELSE 'settled' END AS tier, substring(artist, 1, 5) AS summary FROM artist_credit WHERE artist IS NOT NULL AND length(artist) % 2 = 0),
x AS (SELECT lower(trim(name)) AS artist, tier, summary, CASE tier WHEN 'convicted' THEN 3 WHEN 'accused' THEN 2 ELSE 1 END AS r FROM a)
SELECT artist, arg_max(tier, {'r': r, 's': summary}) AS tier, arg_max(summary, {'r': r, 's': summary}) AS summary FROM x GROUP BY 1
""")
def reputation_index(spark: SparkSession, d: str) -> DataFrame:
    from cratewright.sources.state import reputation

    a = table(spark, d, "artist_credit").where("artist is not null and length(artist) % 2 = 0")
    n = F.ascii("artist") % 3
    tiers = a.select(F.when(n == 0, "convicted").when(n == 1, "accused").otherwise("settled").alias("tier"), F.substring("artist", 1, 5).alias("summary"), F.array("artist").alias("artists"), F.lit(None).cast("array<string>").alias("members"))
    return reputation(tiers)


@query(f"""
WITH {_T}, x AS (SELECT path, array_to_string(list_filter(string_split(path, '/'), lambda y: y <> ''), '/:') AS k, string_split(path, '/') AS ps FROM t)
SELECT DISTINCT path, CASE WHEN len(ps) > 2 THEN '/:' || array_to_string(ps[2:-2], '/:') || '/:' ELSE '/:' END AS dir, 'Macintosh HD/:' || k AS key FROM x
""")
def distinct_paths(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("path").distinct()
    return t.select("path", paths.path_to_location(c("path"))["dir"].alias("dir"), paths.path_to_key(c("path")).alias("key"))
