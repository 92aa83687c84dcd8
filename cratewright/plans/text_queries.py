"""Queries of the text family: cleaning, tags, timed texts and filters."""

from __future__ import annotations

import html.entities
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewright.functions import keys, text
from cratewright.functions.lookups import GENRE_WORDS, SMALL_WORDS, TITLE_GENRES
from cratewright.operators import normalize, series
from cratewright.plans.registry import query
from cratewright.session import table

c = F.col


@query("SELECT entry_id, try_cast(playtime AS INTEGER) AS seconds FROM nml_entry WHERE regexp_full_match(playtime, '\\d+') AND try_cast(playtime AS INTEGER) > 450")
def filter_long(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry").where(c("playtime").rlike(r"^\d+$")).withColumn("seconds", c("playtime").try_cast("int"))
    return e.where("seconds > 450").select("entry_id", "seconds")


@query("""
WITH e AS (SELECT entry_id, CASE WHEN regexp_full_match(playtime, '\\d+') THEN coalesce(try_cast(playtime AS INTEGER), 0) ELSE 0 END AS s, coalesce(title, '') AS title, regexp_replace(loc_file, '(.)\\.[^.]*$', '\\1') AS stem FROM nml_entry)
SELECT entry_id, CASE WHEN s > 0 AND s <= 30 THEN 'short' WHEN regexp_matches(stem, '(?i)(loop.?recorder|recording\\s+\\d{4}[-_]\\d{2}[-_]\\d{2}|\\d{4}-\\d{2}-\\d{2}\\s+\\d{2}-\\d{2}-\\d{2}|lost.tape)') THEN 'file name'
  WHEN title <> '' AND regexp_matches(title, '(?i)^(loop.?recorder|recording\\s+\\d{4}|intro|track\\s+\\d+|track.by.track.*intro|\\(\\d+\\)\\s+(synth|organ))') THEN 'title' END AS reason FROM e
""")
def reason_cascade(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry")
    seconds = F.when(c("playtime").rlike(r"^\d+$"), F.coalesce(c("playtime").try_cast("int"), F.lit(0))).otherwise(0)
    stem = F.regexp_replace("loc_file", r"(?<=.)\.[^.]*$", "")
    return e.select("entry_id", text.not_a_song(stem, seconds, F.coalesce("title", F.lit("")), names=("lost.tape",)).alias("reason"))


LIVE_SQL = "(?i)(\\(live\\b|\\[live\\b|\\blive\\s+at\\b|\\blive\\s+in\\b|\\blive\\s+from\\b|\\blive\\s*-|-\\s*live\\b|\\(unplugged\\b|\\[unplugged\\b|\\bunplugged\\s+version\\b|\\bbbc\\s+(?:radio|session)\\b|\\blive\\s+audio\\b|\\blive\\s+recording\\b|\\blive\\s+version\\b|\\blive\\s+session\\b|\\blive\\s+performance\\b)"


@query(f"""
SELECT entry_id, coalesce(regexp_matches(title, '{LIVE_SQL}'), false) AS live,
  regexp_matches(coalesce(title, ''), '(?i)\\b(instrumental|inst\\.?|no[ -]?vocals?|karaoke|ambient\\s+mix|dub\\s+mix)\\b') OR lower(trim(coalesce(genre, ''))) = 'instrumental' OR starts_with(lower(trim(coalesce(comment2, ''))), 'instrumental') OR starts_with(lower(trim(coalesce(comment2, ''))), '[instrumental]') AS instrumental,
  coalesce(title, '') = '' OR regexp_matches(title, '(?i)^(track\\s*\\d+|unknown|untitled|track)$') OR coalesce(artist, '') = '' OR regexp_matches(artist, '(?i)^artist$') AS placeholder FROM nml_entry
""")
def flag_predicate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry")
    return e.select("entry_id", text.is_live(c("title")).alias("live"), text.is_instrumental(c("title"), c("genre"), c("comment2")).alias("instrumental"), text.is_placeholder(c("artist"), c("title")).alias("placeholder"))


@query("""
WITH p AS (SELECT entry_id, string_split(coalesce(comment2, ''), ' | ') AS parts FROM nml_entry)
SELECT entry_id, coalesce(list_filter(parts, lambda x: x <> '' AND NOT starts_with(x, '⚑'))[1], '') AS theme,
  array_to_string(list_transform(list_filter(flatten(list_transform(list_filter(parts, lambda x: starts_with(x, '⚑') AND NOT starts_with(x, '⚑rep:') AND NOT starts_with(x, '⚑song:')), lambda x: string_split(x, ' '))), lambda w: starts_with(w, '⚑') AND length(w) > 1), lambda w: substring(w, 2)), ',') AS flags FROM p
""")
def parse_tagged_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nml_entry").select("entry_id", text.tagged_theme(c("comment2")).alias("theme"), F.array_join(text.tagged_flags(c("comment2")), ",").alias("flags"))


@query("""
WITH w AS (SELECT credit_id, list_filter(regexp_split_to_array(trim(artist), '\\s+'), lambda w: w <> '') AS ws FROM artist_credit)
SELECT credit_id, array_to_string(list_transform(ws, lambda w, i: CASE WHEN (upper(w) = w AND lower(w) <> w AND length(w) BETWEEN 2 AND 5) OR regexp_matches(w, '[\\d/]') THEN w WHEN lower(w) IN (""" + ", ".join(f"'{w}'" for w in SMALL_WORDS) + """) AND i > 1 THEN lower(w) ELSE upper(substring(w, 1, 1)) || substring(w, 2) END), ' ') AS cased FROM w
""")
def title_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artist_credit").select("credit_id", text.title_case(c("artist")).alias("cased"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def compatibility_sql(x: str) -> str:
    """NFKC in SQL: characters with a compatibility form are replaced by it, then all are composed."""
    forms = {chr(i): unicodedata.normalize("NFKD", chr(i)) for i in range(128, 0x30000) if unicodedata.decomposition(chr(i)).startswith("<")}
    known = f"MAP {{{', '.join(f'{_sql_text(a)}: {_sql_text(b)}' for a, b in forms.items())}}}"
    return f"nfc_normalize(array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda ch: CASE WHEN ascii(ch) < 128 THEN ch ELSE coalesce({known}[ch], ch) END), ''))"


@query(f"""
WITH s AS (SELECT entry_id, trim(regexp_replace(regexp_replace({compatibility_sql("trim(title, ' ')")}, '[\\\\/:*?"<>|]', '_', 'g'), '[ _]{{2,}}', ' ', 'g'), ' ._') AS s FROM nml_entry WHERE title IS NOT NULL)
SELECT entry_id, CASE WHEN s <> '' THEN substring(s, 1, 100) ELSE 'Unknown' END AS name FROM s
""")
def sanitize_name(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry").where("title is not null")
    return e.select("entry_id", text.safe_name(c("title")).alias("name"))


def _replaced(x: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        x = f"trim(regexp_replace({x}, {_sql_text(pattern)}, {_sql_text(by)}, 'g'), ' ')"
    return x


@query(f"""
WITH a AS (SELECT entry_id, {_replaced("trim(regexp_replace(loc_file, '(.)[.][^.]*$', '" + chr(92) + "1'), ' ')", (text.DOWNLOADER, ""), (text.VIDEO_ID, ""), (text.OFFICIAL, ""), (text.QUALITY, ""), ("[.]{2,}", "."), (text.TRACK_NUMBER, ""))} AS s FROM nml_entry WHERE loc_file IS NOT NULL),
b AS (SELECT entry_id, CASE WHEN length(s) - length(replace(s, '_', '')) >= 2 THEN replace(s, '_', ' ') ELSE s END AS x FROM a),
c AS (SELECT entry_id, regexp_replace(regexp_replace(x, '\\s*-\\s+', ' - ', 'g'), '\\s+-\\s*', ' - ', 'g') AS t, regexp_matches(x, '^(.+\\S)-\\s+([A-Za-z].*)$') AS turned FROM b),
d AS (SELECT *, list_transform(string_split(t, ' - '), lambda y: trim(y, ' ')) AS parts, contains(t, ' - ') AS dashed, trim(regexp_extract(t, '^(.+?)-([A-Z][A-Za-z\\s]+)$', 1), ' ') AS tt, CASE WHEN NOT starts_with(t, '-') THEN trim(regexp_extract(t, '^(.+?)-([A-Z][A-Za-z\\s]+)$', 2), ' ') END AS ta FROM c),
e AS (SELECT *, coalesce(list_position(list_transform(parts, lambda y: regexp_matches(y, {_sql_text(text.NOISE_PART)})), true), 0) AS noise FROM d),
f AS (SELECT *, CASE WHEN noise > 0 THEN parts[1:noise - 1] ELSE parts END AS kept FROM e),
g AS (SELECT *, CASE WHEN len(kept) >= 2 THEN kept[1] ELSE parts[1] END AS l, CASE WHEN len(kept) >= 2 THEN array_to_string(kept[2:], ' - ') WHEN dashed THEN trim(substring(t, instr(t, ' - ') + 3), ' ') END AS r FROM f),
h AS (SELECT entry_id, CASE WHEN dashed THEN CASE WHEN lower(l) IN ({", ".join(map(_sql_text, GENRE_WORDS))}) THEN NULL WHEN turned THEN r ELSE l END WHEN coalesce(ta, '') <> '' AND len(regexp_split_to_array(ta, '\\s+')) <= 4 THEN ta END AS artist,
  CASE WHEN dashed THEN CASE WHEN lower(l) IN ({", ".join(map(_sql_text, GENRE_WORDS))}) THEN r WHEN turned THEN l ELSE r END WHEN coalesce(ta, '') <> '' AND len(regexp_split_to_array(ta, '\\s+')) <= 4 THEN tt ELSE t END AS title FROM g),
i AS (SELECT entry_id, trim(artist, ' -_.,') AS artist, trim(title, ' -_.,') AS title FROM h)
SELECT entry_id, CASE WHEN NOT coalesce(regexp_matches(title, {_sql_text(text.PLACEHOLDER_TITLE)}), false) AND NOT regexp_matches(artist, {_sql_text(text.PLACEHOLDER_ARTIST)}) THEN nullif(artist, '') END AS artist, CASE WHEN NOT coalesce(regexp_matches(title, {_sql_text(text.PLACEHOLDER_TITLE)}), false) THEN nullif(title, '') END AS title FROM i
""")
def clean_stem(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry").where("loc_file is not null").withColumn("x", text.clean_stem(F.regexp_replace("loc_file", r"(?<=.)\.[^.]*$", "")))
    return e.select("entry_id", "x.artist", "x.title")


_GENRE_FIRST = f"(?i)^({'|'.join(TITLE_GENRES)})\\s*[-_]\\s*(.+?)\\s*[-_]\\s*(.+)$"


@query(f"""
WITH x AS (SELECT entry_id, title, coalesce(artist, '') AS a, CASE WHEN regexp_matches(title, {_sql_text(text.AUDIO_END)}) THEN trim(regexp_replace(title, {_sql_text(text.AUDIO_END)}, ''), ' ') ELSE title END AS t1 FROM nml_entry),
y AS (SELECT *, trim(regexp_replace(t1, {_sql_text(text.ARTIFACTS)}, '', 'g'), ' ') AS t2 FROM x),
z AS (SELECT *, CASE WHEN a <> '' AND lower(trim(regexp_extract(t2, {_sql_text(_GENRE_FIRST)}, 2), ' ')) = lower(a) THEN trim(regexp_extract(t2, {_sql_text(_GENRE_FIRST)}, 3), ' ') ELSE t2 END AS t3 FROM y),
w AS (SELECT *, substring(t3, length(a) + 1) AS rest, length(a) > 2 AND lower(substring(t3, 1, length(a))) = lower(a) AS st FROM z),
v AS (SELECT *, CASE WHEN st AND regexp_matches(rest, '^\\s*[-–]\\s*') THEN trim(regexp_replace(rest, '^\\s*[-–]\\s*', ''), ' ') WHEN st AND regexp_matches(rest, '^[-_]') THEN trim(substring(rest, 2), ' ') ELSE t3 END AS t4 FROM w)
SELECT entry_id, trim(t4, ' -–_') AS new_title FROM v WHERE t4 <> title AND trim(t4, ' -–_') <> ''
""")
def clean_title(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry")
    return e.select("entry_id", text.clean_title(c("title"), c("artist")).alias("new_title")).where("new_title is not null")


@query("""
WITH t AS (SELECT entry_id, regexp_extract(title, '^(.+?)\\s+-\\s+(.+)$', 1) AS l0, trim(regexp_extract(title, '^(.+?)\\s+-\\s+(.+)$', 2)) AS r FROM nml_entry),
s AS (SELECT entry_id, trim(regexp_replace(l0, '^\\d{1,3}[\\s.\\-]+', '')) AS l, r FROM t WHERE r <> ''), k AS (SELECT lower(artist) AS k, max(artist) AS artist FROM artist_credit GROUP BY 1)
SELECT s.entry_id, coalesce(a.artist, b.artist) AS artist, CASE WHEN a.artist IS NOT NULL THEN s.r ELSE s.l END AS new_title FROM s LEFT JOIN k a ON a.k = lower(s.l) AND s.l <> '' LEFT JOIN k b ON b.k = lower(s.r) WHERE a.artist IS NOT NULL OR b.artist IS NOT NULL
""")
def artist_recovery(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "artist_credit").select(c("artist").alias("name"))
    return normalize.recover_artist(table(spark, d, "nml_entry"), "entry_id", "title", known)


@query("""
WITH l AS (SELECT lyrics_id, unnest(string_split(lyrics_text, chr(10))) AS line, generate_subscripts(string_split(lyrics_text, chr(10)), 1) - 1 AS pos FROM lyrics_raw WHERE lyrics_text IS NOT NULL),
n AS (SELECT lyrics_id, pos, line, lag(line, 1) OVER w AS line_m1, lead(line, 1) OVER w AS line_p1, lag(line, 2) OVER w AS line_m2, lead(line, 2) OVER w AS line_p2 FROM l WHERE trim(line, ' ') <> '' WINDOW w AS (PARTITION BY lyrics_id ORDER BY pos))
SELECT lyrics_id, CAST(pos AS INTEGER) AS pos, line, line_m1, line_p1, line_m2, line_p2 FROM n
""")
def lag_lead_context(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lyrics_raw").select("lyrics_id", F.posexplode(F.split("lyrics_text", "\n")).alias("pos", "line"))
    return series.with_neighbours(lines, "lyrics_id", "pos", "line", 2).select("lyrics_id", "pos", "line", "line_m1", "line_p1", "line_m2", "line_p2")


@query("""
WITH b AS (SELECT lyrics_id, list_filter(list_transform(string_split(regexp_replace(lyrics_text, '^\\d+\\s+Contributor[^\\n]*\\n?', ''), chr(10)), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^\\[.*\\]$')) AS ls FROM lyrics_raw WHERE lyrics_text IS NOT NULL),
u AS (SELECT lyrics_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n FROM b)
SELECT lyrics_id, CAST(i AS INTEGER) AS i, round(CASE WHEN lyrics_id % 2 = 0 THEN 15000.0::DOUBLE + i * (180000.0::DOUBLE / n) ELSE i * (240000.0::DOUBLE / n) END, 3) AS ms, text FROM u
""")
def estimate_lines(spark: SparkSession, d: str) -> DataFrame:
    sung = F.when(c("lyrics_id") % 2 == 0, 1.0).otherwise(0.0)
    t = table(spark, d, "lyrics_raw").select("lyrics_id", F.posexplode(text.estimated_lines(c("lyrics_text"), F.lit(240000.0), sung * 15000.0, sung * 195000.0)).alias("i", "x"))
    return t.select("lyrics_id", "i", F.round("x.ms", 3).alias("ms"), c("x.text").alias("text"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(i AS INTEGER) AS i, round((i + 0.5::DOUBLE) * 1000, 1) AS ms, t AS text FROM (SELECT doc_id, i, regexp_replace(regexp_extract(line, '^[^\\r\\x{85}\\x{2028}\\x{2029}]*'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS t FROM l) WHERE t <> ''
""")
def lrc_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    tagged = lines.select("doc_id", "i", F.concat(F.format_string("[%d:%.2f]", F.floor((c("i") + 0.5) / 60).cast("int"), F.pmod(c("i") + 0.5, F.lit(60.0))), "line").alias("lrc"))
    return tagged.select("doc_id", "i", F.inline(text.lrc_lines(c("lrc")))).select("doc_id", "i", F.round("ms", 1).alias("ms"), "text")


@query("""
WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[ \\t\\n\\f\\r\\x0b]+'), lambda x, i: {'s': (i - 1) * 0.4::DOUBLE, 't': x}), lambda y: trim(y.t, ' ') <> '') AS ws FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_reduce(list_transform(ws, lambda y: [y]), lambda acc, x: CASE WHEN length(acc[-1].t) + 1 + length(x[1].t) > 60 OR regexp_matches(acc[-1].t, '[.!?,;:]$') THEN list_concat(acc, x)
  ELSE list_concat(acc[:-2], [{'s': acc[-1].s, 't': acc[-1].t || ' ' || x[1].t}]) END) AS ls FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line, unnest(ls).s AS start, unnest(ls).t AS text FROM f
""")
def group_words(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "word"))
    return series.grouped_words(words.withColumn("start", c("pos") * 0.4), "doc_id", "pos", "word", "start")


@query("""
WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'swap decks' WHEN 1 THEN ' Save me ' WHEN 2 THEN 'select ' || CAST(event_id % 100 AS VARCHAR) WHEN 3 THEN 'select B' ELSE event_type END AS said FROM events)
SELECT event_id, CASE WHEN regexp_matches(lower(trim(said)), '^swap\\s+decks?$') THEN 'swap' WHEN regexp_matches(lower(trim(said)), '^save\\s+me$') THEN 'save' WHEN regexp_matches(lower(trim(said)), '^select\\s+\\d{1,2}$') THEN 'select' WHEN regexp_matches(lower(trim(said)), '^select\\s+[ab]$') THEN 'load' END AS action FROM t
""")
def command_parse(spark: SparkSession, d: str) -> DataFrame:
    i = c("event_id") % 5
    said = F.when(i == 0, "swap decks").when(i == 1, " Save me ").when(i == 2, F.concat(F.lit("select "), (c("event_id") % 100).cast("string"))).when(i == 3, "select B").otherwise(c("event_type"))
    return table(spark, d, "events").select("event_id", text.command(said)["action"].alias("action"))


_NAMED_ENTITIES = "MAP {" + ", ".join(f"{_sql_text('&' + k)}: {_sql_text(v)}" for k, v in html.entities.html5.items() if k.endswith(";")) + "}"
_ENTITY = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z0-9]+);"


@query(f"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)<br\\s*/?>', chr(10), 'g'), '(?is)<script\\b.*?</script>|<style\\b.*?</style>', '', 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, t, regexp_split_to_array(t, '{_ENTITY}') AS parts, regexp_extract_all(t, '{_ENTITY}') AS ents FROM t)
SELECT doc_id, CASE WHEN len(ents) = 0 THEN t ELSE array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i > len(ents) THEN ''
  WHEN regexp_matches(ents[i], '^&#[0-9]') THEN chr(CAST(regexp_extract(ents[i], '[0-9]+') AS INTEGER)) WHEN starts_with(lower(ents[i]), '&#x') THEN chr(CAST('0x' || regexp_extract(ents[i], '[xX]([0-9a-fA-F]+)', 1) AS INTEGER))
  ELSE coalesce({_NAMED_ENTITIES}[ents[i]], ents[i]) END), '') END AS plain FROM p
""")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", text.html_to_text(c("text")).alias("plain"))


@query("SELECT lyrics_id, CASE WHEN length(lyrics_text) > 800 THEN substring(lyrics_text, 1, 800) || chr(10) || '[truncated]' ELSE lyrics_text END AS short FROM lyrics_raw")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lyrics_raw").select("lyrics_id", text.truncated(c("lyrics_text"), 800).alias("short"))


@query("SELECT lyrics_id, lower(trim(split_part(lyrics_key, chr(9), 1))) || chr(9) || lower(trim(split_part(lyrics_key, chr(9), 2))) AS k, md5(lyrics_key) || '.jpg' AS art_file FROM lyrics_raw WHERE lyrics_key IS NOT NULL")
def art_files(spark: SparkSession, d: str) -> DataFrame:
    part = F.split("lyrics_key", "\t")
    t = table(spark, d, "lyrics_raw").where("lyrics_key is not null")
    return t.select("lyrics_id", keys.song_key(F.try_element_at(part, F.lit(1)), F.coalesce(F.try_element_at(part, F.lit(2)), F.lit(""))).alias("k"), F.concat(F.md5("lyrics_key"), F.lit(".jpg")).alias("art_file"))
