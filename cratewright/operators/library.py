"""Indexes and audits of a collection: which track stands for a key, which names need a look."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewright.functions import keys, text
from cratewright.functions.lookups import LOWERCASE_NAMES
from cratewright.llm.batches import by_size
from cratewright.operators.substrings import filters, passing, passing_whole
from cratewright.session import cut, ship


def named(tracks: DataFrame) -> DataFrame:
    """The tracks that have an artist or a title."""
    return tracks.where((F.coalesce(F.trim("artist"), F.lit("")) != "") | (F.coalesce(F.trim("title"), F.lit("")) != ""))


def path_index(tracks: DataFrame, order: str = "entry_idx") -> DataFrame:
    """(key, path): the last track of each song key without its version bracket."""
    return named(tracks).groupBy(keys.version_key(F.col("artist"), F.col("title")).alias("key")).agg(F.max_by("path", order).alias("path"))


def cue_index(tracks: DataFrame, order: str = "entry_idx") -> DataFrame:
    """(key, cues): the cues of the first track of each bare song key that has any."""
    return tracks.where(F.size("cues") > 0).groupBy(keys.bare_key(F.col("artist"), F.col("title")).alias("key")).agg(F.min_by("cues", order).alias("cues"))


def distinct_tracks(tracks: DataFrame, order: str = "entry_idx") -> DataFrame:
    """(key, artist, title, album, path): the first track of each song key."""
    first = F.min_by(F.struct(F.trim("artist").alias("artist"), F.trim("title").alias("title"), F.trim("album").alias("album"), "path"), order)
    return named(tracks).groupBy(keys.song_key(F.col("artist"), F.col("title")).alias("key")).agg(first.alias("x")).select("key", "x.*")


def album_tracks(tracks: DataFrame, order: str = "entry_idx") -> DataFrame:
    """(album_key, key): the songs of each album of an artist, a row each, so an album of any size stays rows."""
    rows = distinct_tracks(tracks, order).where((F.coalesce("artist", F.lit("")) != "") & (F.coalesce("album", F.lit("")) != ""))
    return rows.select(keys.song_key(F.col("artist"), F.col("album")).alias("album_key"), "key")


def beat_entries(tracks: DataFrame) -> DataFrame:
    """Tracks whose beat is known: a tempo, a play time and an AutoGrid cue, whose start is ``anchor_ms``."""
    grid = F.try_element_at(F.filter("cues", lambda c: c["name"] == "AutoGrid"), F.lit(1))["start_ms"]
    return tracks.withColumn("anchor_ms", grid).where("bpm > 0 and playtime > 0 and anchor_ms is not null")


def unranked(tracks: DataFrame) -> DataFrame:
    """Tracks without stars."""
    return tracks.where("coalesce(ranking, 0) = 0")


def title_audit(tracks: DataFrame, renames: DataFrame, keep: tuple[str, ...] = LOWERCASE_NAMES) -> DataFrame:
    """(path, artist, effective_artist, title): titles that begin in lower case, but for artists who write so; renames: (artist, new_artist)."""
    rows = tracks.where(F.trim("title").rlike(r"^\p{Ll}") & ~F.coalesce(F.trim("artist"), F.lit("")).isin(*keep)).withColumn("artist", F.coalesce(F.trim("artist"), F.lit("")))
    return rows.join(renames.select("artist", "new_artist"), "artist", "left").select("path", "artist", F.coalesce("new_artist", "artist").alias("effective_artist"), F.trim("title").alias("title"))


def still_there(done: DataFrame, tracks: DataFrame) -> DataFrame:
    """The progress keys (key) whose track is still in the collection, by the key that wrote them."""
    return done.join(tracks.select(keys.cut_key(F.col("artist"), F.col("title")).alias("key")), "key", "left_semi")


def by_name(tracks: DataFrame) -> DataFrame:
    """Sorted by artist and title, ignoring case; a tie by path."""
    return tracks.orderBy(F.lower("artist"), F.lower("title"), "path")


def worst_first(groups: DataFrame, most: int | None = None, least: int = 0) -> DataFrame:
    """Duplicate groups (n_losers, richness) with at least ``least`` losers, those with most losers first, then the richest; the first ``most`` of them."""
    rows = groups.where(F.col("n_losers") >= least).orderBy(F.desc("n_losers"), F.desc("richness"), "key")
    return rows.limit(most) if most is not None else rows


def genre_of_recordings(tracks: DataFrame, recordings: DataFrame) -> DataFrame:
    """(path, genre): of tracks (path, recording_id) whose recording is known and has a genre."""
    known = recordings.where(F.trim("genre") != "").groupBy("recording_id").agg(F.min("genre").alias("genre"))
    return tracks.where("path is not null and recording_id is not null").join(known, "recording_id").select("path", "genre")


def at_new_paths(values: DataFrame, path_map: DataFrame) -> DataFrame:
    """Values by old path (path, ...) as values by new path; path_map: (old_path, new_path)."""
    return values.join(path_map.select(F.col("old_path").alias("path"), "new_path"), "path").withColumn("path", F.col("new_path")).drop("new_path")


def song_flags(flags: DataFrame) -> DataFrame:
    """(key, reason) of flagged songs (artist, title, reason); of several reasons the last by text."""
    return flags.groupBy(keys.song_key(F.col("artist"), F.col("title")).alias("key")).agg(F.max("reason").alias("reason"))


def with_comments(tracks: DataFrame, lyrics: DataFrame, artists: DataFrame, songs: DataFrame) -> DataFrame:
    """Add comment and comment2 from what is known of a track's lyrics, artist and song.

    lyrics: (key, summary, theme, flags); artists: (artist, tier), in lower case;
    songs: (key, reason).  Blank results leave what was there.
    """
    rows = tracks.withColumn("_key", keys.song_key(F.col("artist"), F.col("title"))).withColumn("_who", keys.low(F.col("artist")))
    for df, on, as_ in ((lyrics.select("key", "summary", "theme", "flags"), "key", "_key"), (artists.select("artist", "tier"), "artist", "_who"), (songs.select("key", "reason"), "key", "_key")):
        rows = rows.join(df.withColumnRenamed(on, as_), as_, "left")
    built = text.build_comment(F.col("theme"), F.col("flags"), F.col("tier"), F.col("reason"))
    new = lambda c, old: F.coalesce(F.nullif(c, F.lit("")), F.col(old))
    return rows.withColumn("comment", new(F.col("summary"), "comment")).withColumn("comment2", new(built, "comment2")).drop("_key", "_who", "summary", "theme", "flags", "tier", "reason")


def as_shown(tracks: DataFrame, score: Column, transition: Column, songs: DataFrame, artists: DataFrame) -> DataFrame:
    """What a list of suggestions shows of each track, rounded as shown: tempo to one decimal, score in percent, times in whole milliseconds, halves to even."""
    ms = lambda c: F.when(F.coalesce(c, F.lit(0.0)) != 0, F.bround(c, 0).cast("bigint"))
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = tracks.withColumn("_key", keys.song_key(F.col("artist"), F.col("title"))).withColumn("_who", keys.low(F.col("artist")))
    rows = rows.join(songs.select(F.col("key").alias("_key"), "reason"), "_key", "left").join(artists.select(F.col("artist").alias("_who"), "tier", F.col("summary").alias("_rep")), "_who", "left")
    return rows.select(
        "path",
        "artist",
        "title",
        F.bround("bpm", 1).alias("bpm"),
        "key",
        "genre",
        "stars",
        F.bround(score * 100, 0).cast("int").alias("score"),
        transition.alias("transition"),
        F.col("tier").alias("rep_tier"),
        F.col("_rep").alias("rep_summary"),
        F.col("reason").alias("song_flag"),
        none("summary").alias("lyric_summary"),
        none("theme").alias("lyric_theme"),
        F.bround(F.col("duration") * 1000, 0).cast("bigint").alias("duration_ms"),
        ms(F.col("vocal_in_ms")).alias("vocal_in_ms"),
        ms(F.col("vocal_out_ms")).alias("vocal_out_ms"),
        text.is_instrumental(F.col("title"), F.col("theme"), F.col("summary")).alias("is_instrumental"),
    )


def find_files(wanted: DataFrame, files: DataFrame, artist_signs: int = 15, title_signs: int = 20) -> DataFrame:
    """(key, path): for each wanted (key, artist, title) the best file whose name holds the beginning of the title.

    First a file somewhere below a folder whose name begins with the artist, then
    one in a folder whose name holds the artist's first signs; the first path of
    each kind.  A file is read once: the parts of its name and folders that may be
    titles and artists are found by filters of all that are wanted, and joined with
    these by equality, however many titles or names begin alike.
    """
    spark = wanted.sparkSession
    ship(spark)
    w = cut(wanted.where((F.coalesce("artist", F.lit("")) != "") & (F.length("title") > 0)).select("key", F.col("artist").alias("_a"), F.substring("artist", 1, artist_signs).alias("_short"), F.substring("title", 1, title_signs).alias("_t")))
    # How well a folder fits, for which artist or first signs of one, and the title.
    asked = lambda r, who: F.struct(F.lit(r).alias("_r"), F.col(who).alias("_who"), F.col("_t"))
    whole = lambda r, who: F.concat(F.lit(f"{r}"), who, F.lit("/"), "_t")
    kinds = ((0, "_t"), (1, "_a"), (2, "_short"), (3, whole(0, "_a")), (4, whole(1, "_short")))
    patterns = w.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), (F.col(x) if isinstance(x, str) else x).alias("pattern")) for k, x in kinds))))
    filled, bits = filters(patterns, len(kinds), w.count())
    sent = spark.sparkContext.broadcast(filled)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(texts: set[str], kind: int, most: int | None, first_only: bool) -> dict[str, list[str]]:
            some, out = sorted(texts), {}
            for k, p in passing(some, sent.value[kind], bits, most, first_only):
                out.setdefault(some[k], []).append(p)
            return out

        for batch in batches:
            for paths in by_size(batch.column(0).to_pylist()):
                split = [p.split("/") for p in paths]
                titles = parts({s[-1] for s in split}, 0, title_signs, False)
                above = parts({d for s in split for d in s[:-1]}, 1, None, True)
                beside = parts({s[-2] for s in split if len(s) > 1}, 2, artist_signs, False)
                rows: list[tuple[int, str, str, str]] = []
                for path, s in zip(paths, split):
                    if len(s) < 2 or s[-1] not in titles:
                        continue
                    who = {(0, a) for d in s[:-1] for a in above.get(d, ())} | {(1, a) for a in beside.get(s[-2], ())}
                    rows += [(r, a, t, path) for t in titles[s[-1]] for r, a in who]
                for r in (0, 1):
                    some = [x for x in rows if x[0] == r]
                    keep = np.flatnonzero(passing_whole([f"{r}{a}/{t}" for _, a, t, _ in some], sent.value[3 + r], bits)) if some else ()
                    yield pa.RecordBatch.from_arrays([pa.array([some[i][c] for i in keep], kind) for c, kind in enumerate((pa.int32(), pa.string(), pa.string(), pa.string()))], names=["_r", "_who", "_t", "path"])

    on = ["_r", "_who", "_t"]
    best = files.select("path").where("path is not null").mapInArrow(hits, "_r int, _who string, _t string, path string").groupBy(*on).agg(F.min("path").alias("path"))
    rows = w.select("key", F.inline(F.array(asked(0, "_a"), asked(1, "_short"))))
    return rows.join(best, on).groupBy("key").agg(F.min_by("path", F.struct("_r", "path")).alias("path"))


def safe_moves(files: DataFrame, folder: str, taken: DataFrame, stamp: str) -> DataFrame:
    """(path, target): moves into a folder; a name that is taken (name) there, or by a file before it, gets the time stamp, then a number."""
    from cratewright.functions import paths
    from cratewright.operators.dedup import numbered_names

    rows = files.select("path", paths.base_name(F.col("path")).alias("_base"))
    used = taken.select(F.col("name").alias("_base")).distinct().withColumn("_used", F.lit(True))
    ext = F.regexp_extract("_base", r"(?<=.)(\.[^.]*)$", 1)
    stamped = F.concat(F.substr(F.col("_base"), F.lit(1), F.length("_base") - F.length(ext)), F.lit(f"__{stamp}"))
    free = rows.join(used, "_base", "left").withColumn("_ext", ext)
    first = free.groupBy("_base").agg(F.min("path").alias("_first"))
    plain = (F.col("path") == F.col("_first")) & F.col("_used").isNull()
    split = free.join(first, "_base").withColumn("_new", F.when(plain, F.col("_base")).otherwise(stamped))
    late = numbered_names(split.where("_new <> _base").withColumnRenamed("_base", "_old"), F.col("_new"), ["path"]).withColumn("target", F.concat("name", "_ext"))
    return split.where("_new = _base").select("path", F.concat(F.lit(folder.rstrip("/") + "/"), "_base").alias("target")).unionByName(late.select("path", F.concat(F.lit(folder.rstrip("/") + "/"), "target").alias("target")))
