"""Collection files (NML): explicit schema in, one ordered file out."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewright.functions import paths
from cratewright.functions.grid import CUE
from cratewright.operators.rank import stars_of

HEADER = '<?xml version="1.0" encoding="UTF-8" standalone="no" ?>'
INFO = "BITRATE GENRE KEY PLAYTIME PLAYTIME_FLOAT PLAYCOUNT RANKING COLOR LAST_PLAYED IMPORT_DATE RELEASE_DATE COMMENT COMMENT2 KEY_LYRICS FILESIZE FLAGS FILETYPE COVERARTID"
CUE_FIELDS = "NAME DISPL_ORDER TYPE START LEN REPEATS HOTCUE COLOR"


def _struct(names: str, more: str = "") -> str:
    return "struct<" + ",".join(f"_{n}:string" for n in names.split()) + (f",{more}" if more else "") + ">"


# All attributes are text, as in the file; readers cast what they need.
ENTRY_SCHEMA = (
    "_TITLE string, _ARTIST string, _AUDIO_ID string, _MODIFIED_DATE string, _MODIFIED_TIME string, "
    f"LOCATION {_struct('DIR FILE VOLUME VOLUMEID')}, ALBUM {_struct('TITLE TRACK OF_TRACKS')}, INFO {_struct(INFO)}, TEMPO {_struct('BPM BPM_QUALITY')}, "
    f"LOUDNESS {_struct('PEAK_DB PERCEIVED_DB ANALYZED_DB')}, MUSICAL_KEY {_struct('VALUE')}, CUE_V2 array<{_struct(CUE_FIELDS, 'GRID:struct<_BPM:string>')}>, "
    f"PRIMARYKEY {_struct('TYPE KEY')}, EXTENDEDDATA {_struct('DECK STARTTIME')}"
)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """All ENTRY elements with src_file and entry_idx, a number in the order of files and of elements within each file, with gaps between partitions."""
    raw = spark.read.format("xml").option("rowTag", "ENTRY").schema(ENTRY_SCHEMA).load(path)
    return raw.withColumn("src_file", F.col("_metadata.file_path")).withColumn("entry_idx", F.monotonically_increasing_id())


def _int(c: Column, default: int | None = 0) -> Column:
    n = F.trim(c).try_cast("int")
    return n if default is None else F.coalesce(n, F.lit(default))


def _double(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def typed_cues(cues: Column) -> Column:
    """Cues with typed fields, an empty array for none."""
    one = lambda c: F.struct(F.coalesce(c["_NAME"], F.lit("n.n.")).alias("name"), _int(c["_TYPE"]).alias("type"), F.coalesce(_double(c["_START"]), F.lit(0.0)).alias("start_ms"), F.coalesce(_double(c["_LEN"]), F.lit(0.0)).alias("len_ms"), _int(c["_HOTCUE"], -1).alias("hotcue"))
    return F.coalesce(F.transform(cues, one), F.array().cast(f"array<{CUE}>"))


def tracks(entries: DataFrame) -> DataFrame:
    """The typed records of a collection; playlist references are left out."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    return entries.where("PRIMARYKEY is null and LOCATION is not null").select(
        paths.location_to_path(F.coalesce("LOCATION._DIR", F.lit("")), F.coalesce("LOCATION._FILE", F.lit(""))).alias("path"),
        text("_ARTIST").alias("artist"),
        text("_TITLE").alias("title"),
        text("ALBUM._TITLE").alias("album"),
        F.coalesce(_double(F.col("TEMPO._BPM")), F.lit(0.0)).alias("bpm"),
        text("MUSICAL_KEY._VALUE").alias("musical_key"),
        text("INFO._KEY").alias("key"),
        text("INFO._GENRE").alias("genre"),
        _int(F.col("INFO._RANKING")).alias("ranking"),
        stars_of(_int(F.col("INFO._RANKING"))).alias("stars"),
        _int(F.col("INFO._BITRATE")).alias("bitrate"),
        _int(F.col("INFO._PLAYTIME")).alias("playtime"),
        _double(F.col("INFO._PLAYTIME_FLOAT")).alias("playtime_f"),
        _int(F.col("INFO._PLAYCOUNT")).alias("playcount"),
        text("INFO._LAST_PLAYED").alias("last_played"),
        _int(F.col("INFO._COLOR")).alias("color"),
        text("INFO._COMMENT").alias("comment"),
        text("INFO._COMMENT2").alias("comment2"),
        text("INFO._KEY_LYRICS").alias("lyrics_full"),
        typed_cues(F.col("CUE_V2")).alias("cues"),
        "src_file",
        "entry_idx",
    )


def tracks_or_list(spark: SparkSession, path: str, fallback: str) -> DataFrame:
    """(path, artist, title, key) of a collection, or of a JSON list of (artist, title, dkey) if there is no collection; a key stands for the missing path.

    Tracks without artist and title are left out; neither file gives no rows.
    """
    from cratewright.functions import keys
    from cratewright.operators.library import named
    from cratewright.session import exists

    if exists(spark, path) or not exists(spark, fallback):
        rows = tracks(read_entries(spark, path)) if exists(spark, path) else spark.createDataFrame([], "path string, artist string, title string")
        return named(rows).select("path", "artist", "title", keys.version_key(F.col("artist"), F.col("title")).alias("key"))
    raw = spark.read.schema("artist string, title string, dkey string").option("multiLine", "true").json(fallback)
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    rows = named(raw.select(text("artist").alias("artist"), text("title").alias("title"), "dkey"))
    key = F.coalesce(F.nullif(F.col("dkey"), F.lit("")), keys.version_key(F.col("artist"), F.col("title")))
    return rows.select(key.alias("path"), "artist", "title", key.alias("key"))


def complete_tracks(t: DataFrame) -> DataFrame:
    """Records with title, artist, path, play time, tempo and key; the key comes from either field."""
    key = F.coalesce(F.nullif(F.trim("musical_key"), F.lit("")), F.nullif(F.trim("key"), F.lit("")))
    return t.withColumn("any_key", key).where("title <> '' and artist <> '' and path <> '/' and playtime > 0 and bpm > 0 and any_key is not null")


def playlist_refs(entries: DataFrame) -> DataFrame:
    """(src_file, pos, key, path, deck, started) of each playlist or history reference."""
    return entries.where("PRIMARYKEY is not null").select("src_file", F.col("entry_idx").alias("pos"), F.col("PRIMARYKEY._KEY").alias("key"), paths.any_key_to_path(F.col("PRIMARYKEY._KEY")).alias("path"), F.col("EXTENDEDDATA._DECK").alias("deck"), F.col("EXTENDEDDATA._STARTTIME").alias("started"))


def _attr(name: str, value: Column) -> Column:
    escaped = value.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit(f' {name}="'), escaped, F.lit('"')), F.lit(""))


def entry_lines(t: DataFrame) -> DataFrame:
    """(entry_idx, line): each typed record as one ENTRY element."""
    loc = paths.path_to_location(F.col("path"))
    cue = F.transform("cues", lambda c: F.concat(F.lit("<CUE_V2"), _attr("NAME", c["name"]), F.lit(' DISPL_ORDER="0"'), _attr("TYPE", c["type"]), _attr("START", F.format_string("%.6f", c["start_ms"])), _attr("LEN", F.format_string("%.6f", c["len_ms"])), F.lit(' REPEATS="-1"'), _attr("HOTCUE", c["hotcue"]), F.lit("></CUE_V2>")))
    # fmt: off
    line = F.concat(
        F.lit("<ENTRY"), _attr("TITLE", F.col("title")), _attr("ARTIST", F.col("artist")), F.lit(">"),
        F.lit("<LOCATION"), _attr("DIR", loc["dir"]), _attr("FILE", loc["file"]), _attr("VOLUME", loc["volume"]), _attr("VOLUMEID", loc["volumeid"]), F.lit("></LOCATION>"),
        F.lit("<ALBUM"), _attr("TITLE", F.nullif(F.col("album"), F.lit(""))), F.lit("></ALBUM>"),
        F.lit("<INFO"), _attr("BITRATE", F.col("bitrate")), _attr("GENRE", F.nullif(F.col("genre"), F.lit(""))), _attr("KEY", F.nullif(F.col("key"), F.lit(""))), _attr("PLAYTIME", F.col("playtime")),
        _attr("PLAYTIME_FLOAT", F.col("playtime_f")), _attr("PLAYCOUNT", F.col("playcount")), _attr("RANKING", F.col("ranking")), _attr("COLOR", F.col("color")), _attr("LAST_PLAYED", F.nullif(F.col("last_played"), F.lit(""))),
        _attr("COMMENT", F.nullif(F.col("comment"), F.lit(""))), _attr("COMMENT2", F.nullif(F.col("comment2"), F.lit(""))), F.lit("></INFO>"),
        F.when(F.col("bpm") > 0, F.concat(F.lit("<TEMPO"), _attr("BPM", F.format_string("%.6f", F.col("bpm"))), F.lit("></TEMPO>"))).otherwise(""),
        F.when(F.col("musical_key") != "", F.concat(F.lit("<MUSICAL_KEY"), _attr("VALUE", F.col("musical_key")), F.lit("></MUSICAL_KEY>"))).otherwise(""),
        F.array_join(cue, ""), F.lit("</ENTRY>"),
    )
    # fmt: on
    return t.select("entry_idx", line.alias("line"))


def write_collection(t: DataFrame, refs: DataFrame | None, path: str, playlist: str = "playlist") -> int:
    """Write one collection file on the driver, streamed in order; the number of entries.

    The format asks for a single file with its count in front, so lines are
    fetched one partition at a time; they are never all on the driver.
    """
    n = t.count()
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{HEADER}\n<NML VERSION="19"><COLLECTION ENTRIES="{n}">\n')
        for row in entry_lines(t).repartitionByRange("entry_idx").sortWithinPartitions("entry_idx").toLocalIterator():
            f.write(row.line + "\n")
        f.write("</COLLECTION>\n<PLAYLISTS>")
        if refs is not None:
            m = refs.count()
            f.write(f'<NODE TYPE="PLAYLIST" NAME={quoteattr(playlist)}><PLAYLIST ENTRIES="{m}" TYPE="LIST">\n')
            for row in refs.select("pos", paths.path_to_key(F.col("path")).alias("key")).repartitionByRange("pos").sortWithinPartitions("pos").toLocalIterator():
                f.write(f'<ENTRY><PRIMARYKEY TYPE="TRACK" KEY={quoteattr(row.key)}></PRIMARYKEY></ENTRY>\n')
            f.write("</PLAYLIST></NODE>")
        f.write("</PLAYLISTS></NML>\n")
    return n


def without_lyrics(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without full lyrics, and how many records had some."""
    return t.drop("lyrics_full"), t.agg(F.count_if(F.col("lyrics_full") != "").alias("n_removed"))


def insert_or_update(t: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Records of ``new`` (path and fields) update those with their path where not null; others are added at the end.

    Of several new records with one path the first by its fields counts.  Added
    records get the numbers after the greatest entry_idx, by path.
    """
    from cratewright.operators.dedup import keep_best
    from cratewright.operators.rank import numbered

    one = keep_best(new, ["path"], [F.col(f).asc_nulls_last() for f in fields])
    updated = t.join(one.select("path", *(F.col(f).alias(f"_{f}") for f in fields)), "path", "left")
    for f in fields:
        updated = updated.withColumn(f, F.coalesce(f"_{f}", f))
    last = t.agg(F.coalesce(F.max("entry_idx"), F.lit(-1))).first()[0]
    added = numbered(one.join(t.select("path"), "path", "left_anti"), "path", "_n").withColumn("entry_idx", F.col("_n") + (last + 1))
    return updated.select(t.columns).unionByName(added.drop("_n"), allowMissingColumns=True).select(t.columns)
