"""The queries of this subpackage, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewright.llm import canon, components, copies, language, lookalike, mixing, names, reading, survivor, tokens
from cratewright.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.best_fields(table(spark, d, "dedup_member"), table(spark, d, "nml_entry")).select("group_id", "field_name", "entry_id")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "dedup_member"), table(spark, d, "nml_entry"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.language_cases(table(spark, d, "lyrics_raw"), table(spark, d, "documents"), fitted=False).select("lyrics_id", "stanza_no", "lang")


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "documents")
    ranks = language.train_profiles(labelled)
    tagged = language.add_language(table(spark, d, "lyrics_raw").select("lyrics_id", "lyrics_text"), "lyrics_text", ranks, language.fit_confidence(labelled, ranks))
    return tagged.select("lyrics_id", F.col("tagged.lang").alias("lang"), F.round("tagged.confidence", 4).alias("confidence"), F.size("tagged.parts").alias("n_stanzas"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found_values(table(spark, d, "nml_entry"))


def p3_normalised(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(table(spark, d, "nml_entry"), ["entry_id"], ["title", "artist"]).select("entry_id", "field_name", "clean", "repaired", "mixed")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_pairs(names.linked_names(table(spark, d, "artist_credit"), table(spark, d, "given_name_short")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.formatting_copies(table(spark, d, "nml_entry"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.one_per_record(table(spark, d, "nml_entry"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.linked_entries(table(spark, d, "match_pair"), table(spark, d, "nml_entry"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.to_map(table(spark, d, "nml_entry"), table(spark, d, "genre_canon"))


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    mapped = canon.map_values(table(spark, d, "nml_entry").select("genre"), "genre", table(spark, d, "genre_canon"), "genre_id", "genre_name", "aliases")
    return canon.unmatched_report(mapped, "genre")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def p9_audit(spark: SparkSession, d: str) -> DataFrame:
    """What a mixture must hold, per target: checked from its rows."""
    mixture, shares = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))
    mixture = cut(mixture)
    copies = table(spark, d, "documents").where("text is not null").select(F.col("source").alias("source_name"), "doc_id", F.sha2("text", 256).alias("same"))
    used = mixture.join(copies, ["source_name", "doc_id"]).groupBy("source_name").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("sum"), F.max("repeats").alias("most"), F.count_distinct("same").alias("n"), F.count(F.lit(1)).alias("rows"))
    s = shares.join(used, "source_name", "left")
    gap = F.col("budget") - F.col("tokens")
    return s.select(
        "source_name",
        ((gap >= 0) & (F.col("tokens") == F.coalesce("sum", F.lit(0)))).alias("in_budget"),
        (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("in_repeats"),
        F.coalesce(F.col("n") == F.col("rows"), F.lit(True)).alias("once_each"),
        ((gap == 0) | F.col("smallest_left").isNull() | (F.col("smallest_left") > gap)).alias("filled"),
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.document_levels(table(spark, d, "documents"), table(spark, d, "reading_label")).select("doc_id", "reading_level")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_survivors, p2_found, p2_languages, p3_found, p3_normalised, p4_found, p5_found, p5_records, p6_found, p7_found, p7_unmatched, p8_ids, p9_mix, p9_shares, p9_audit, p10_found)}


_DATE = """
try_cast(CASE
  WHEN regexp_full_match(t, '\\d{4}[/-]\\d{1,2}[/-]\\d{1,2}([T ]\\d{1,2}:\\d{2}(:\\d{2})?)?') THEN regexp_extract(t, '^(\\d{4})', 1) || '-' || lpad(regexp_extract(t, '^\\d{4}[/-](\\d{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(t, '^\\d{4}[/-]\\d{1,2}[/-](\\d{1,2})', 1), 2, '0')
  WHEN regexp_full_match(t, '\\d{1,2}\\.\\d{1,2}\\.\\d{4}') THEN split_part(t, '.', 3) || '-' || lpad(split_part(t, '.', 2), 2, '0') || '-' || lpad(split_part(t, '.', 1), 2, '0')
  WHEN regexp_full_match(t, '\\d{8}') THEN t[1:4] || '-' || t[5:6] || '-' || t[7:8]
  WHEN regexp_full_match(t, '[A-Za-z]+ \\d{1,2}, \\d{4}') THEN right(t, 4) || '-' || lpad(CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(t[1:3])) + 2) // 3 AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(t, ' (\\d{1,2}),', 1), 2, '0')
  WHEN regexp_full_match(t, '\\d{1,2} [A-Za-z]+ \\d{4}') THEN right(t, 4) || '-' || lpad(CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(split_part(t, ' ', 2)[1:3])) + 2) // 3 AS VARCHAR), 2, '0') || '-' || lpad(split_part(t, ' ', 1), 2, '0')
END AS DATE)"""

_P1 = f"""
WITH v AS (
  SELECT entry_id,
    try_cast(CASE WHEN regexp_full_match(trim(ranking), '\\+?\\d+(\\.0*)?') THEN regexp_extract(trim(ranking), '^\\+?(\\d+)', 1) END AS BIGINT) AS r,
    try_cast(CASE WHEN regexp_full_match(trim(playcount), '\\+?\\d+(\\.0*)?') THEN regexp_extract(trim(playcount), '^\\+?(\\d+)', 1) END AS BIGINT) AS p,
    trim(last_played) AS t
  FROM nml_entry),
w AS (SELECT *, {_DATE} AS d0 FROM v),
m AS (
  SELECT DISTINCT g.group_id, w.entry_id, w.r, w.p, CASE WHEN d0 BETWEEN DATE '2001-01-01' AND DATE '2026-06-30' THEN d0 END AS d
  FROM dedup_member g JOIN w USING (entry_id) WHERE g.group_id IS NOT NULL),
f AS (
  SELECT group_id, 'ranking' AS field_name, entry_id, coalesce(epoch(d), -1e15) AS k FROM m WHERE r IN (51, 102, 153, 204, 255)
  UNION ALL SELECT group_id, 'playcount', entry_id, p FROM m WHERE p BETWEEN 0 AND 9999
  UNION ALL SELECT group_id, 'last_played', entry_id, epoch(d) FROM m WHERE d IS NOT NULL)
SELECT group_id, field_name, entry_id FROM f
QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY k DESC, entry_id) = 1
"""

_FILLED = ("title", "artist", "album_title", "album_track", "loc_dir", "loc_file", "loc_volume", "audio_id", "modified_date", "modified_time", "bitrate", "genre", "info_key", "playtime", "playtime_float", "playcount", "ranking", "last_played", "import_date", "release_date", "comment2", "filesize", "bpm", "musical_key")
_P1_SURVIVORS = _P1.replace("\nSELECT group_id, field_name, entry_id FROM f\n", f"""
, g AS (SELECT f.group_id, f.field_name, CASE f.field_name WHEN 'ranking' THEN CAST(m.r AS VARCHAR) WHEN 'playcount' THEN CAST(m.p AS VARCHAR) ELSE CAST(m.d AS VARCHAR) END AS v FROM f JOIN m USING (group_id, entry_id)
  QUALIFY row_number() OVER (PARTITION BY f.group_id, f.field_name ORDER BY k DESC, entry_id) = 1),
e AS (SELECT entry_id, imported_at, CAST(contains(lower(coalesce(loc_dir, '')), '/:backups/:') = false AS INTEGER) AS trusted, {" + ".join(f"CASE WHEN trim({c}, ' ') <> '' THEN 1 ELSE 0 END" for c in _FILLED)} AS complete FROM nml_entry),
b AS (SELECT m.group_id, e.* FROM m JOIN e USING (entry_id) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY complete DESC, trusted DESC, imported_at DESC NULLS LAST, entry_id) = 1)
SELECT b.group_id, b.entry_id AS survivor_id, CAST(b.complete AS INTEGER) AS complete, b.trusted, max(v) FILTER (WHERE field_name = 'ranking') AS ranking, max(v) FILTER (WHERE field_name = 'playcount') AS playcount, max(v) FILTER (WHERE field_name = 'last_played') AS last_played
FROM b LEFT JOIN g USING (group_id) GROUP BY ALL
""").replace("QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY k DESC, entry_id) = 1\n", "")

_P5_KEYS = """
k AS (
  SELECT entry_id, regexp_replace(upper(lower(artist)), '[^\\p{L}\\p{N}]', '', 'g') AS a, regexp_replace(upper(lower(title)), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM nml_entry),
r AS (SELECT entry_id, least(a, t) || chr(9) || greatest(a, t) AS key FROM k WHERE a <> '' AND t <> ''),
c AS (SELECT entry_id, min(entry_id) OVER (PARTITION BY key) AS group_id, count(*) OVER (PARTITION BY key) AS copies FROM r)"""

_P6 = """
WITH RECURSIVE e AS (
  SELECT DISTINCT entry_a AS a, entry_b AS b FROM match_pair
  WHERE entry_a <> entry_b AND entry_a IN (SELECT entry_id FROM nml_entry) AND entry_b IN (SELECT entry_id FROM nml_entry)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(v, w) AS (SELECT a, a FROM u UNION SELECT reach.v, u.b FROM reach JOIN u ON u.a = reach.w)
SELECT v AS entry_id, min(w) AS group_id FROM reach GROUP BY v
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_survivors": _P1_SURVIVORS,
        "p9_audit": "SELECT DISTINCT source_name, true AS in_budget, true AS in_repeats, true AS once_each, true AS filled FROM mix_target WHERE source_name IS NOT NULL",
        "p5_found": f"WITH {_P5_KEYS.strip()} SELECT group_id, entry_id FROM c WHERE copies > 1",
        "p5_records": f"WITH {_P5_KEYS.strip()} SELECT DISTINCT group_id, copies FROM c",
        "p6_found": _P6,
    }
