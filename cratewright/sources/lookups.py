"""Results of outside services.

The engine opens no connection.  A caller supplies what a service returned as a
table; the functions here parse and choose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORDING = "title string, `artist-credit` array<struct<name:string,joinphrase:string,artist:struct<name:string>>>, releases array<struct<title:string,status:string,date:string,media:array<struct<track:array<struct<number:string>>>>>>, genres array<struct<name:string,count:int>>, tags array<struct<name:string,count:int>>"


def recording(body: Column) -> Column:
    """The struct (title, artist, album, year, track, genre) of a recording's JSON.

    The first official release is taken, else the first; the genre with most
    votes, from the tags if there are no genres.
    """
    r = F.from_json(body, RECORDING)
    official = F.filter(r["releases"], lambda x: x["status"] == "Official")
    release = F.coalesce(F.try_element_at(official, F.lit(1)), F.try_element_at(r["releases"], F.lit(1)))
    artist = F.array_join(F.transform(r["artist-credit"], lambda a: F.concat(F.coalesce(a["name"], a["artist"]["name"], F.lit("")), F.coalesce(a["joinphrase"], F.lit("")))), "")
    year = F.substring(release["date"], 1, 4)
    votes = F.when(F.size(r["genres"]) > 0, r["genres"]).otherwise(r["tags"])
    genre = F.element_at(F.array_sort(votes, lambda a, b: b["count"] - a["count"]), 1)["name"]
    return F.struct(
        r["title"].alias("title"),
        F.nullif(artist, F.lit("")).alias("artist"),
        release["title"].alias("album"),
        F.when(year.rlike(r"^\d{4}$"), year).alias("year"),
        F.try_element_at(F.try_element_at(release["media"], F.lit(1))["track"], F.lit(1))["number"].alias("track"),
        F.when(F.size(votes) > 0, F.initcap(genre)).alias("genre"),
    )


def best_result(results: Column) -> Column:
    """The result (score, ...) with the highest score, the first of equal ones."""
    top = F.array_max(F.transform(results, lambda r: r["score"]))
    return F.try_element_at(F.filter(results, lambda r: r["score"] == top), F.lit(1))


def closest_hit(hits: Column, wanted: Column, field: str) -> Column:
    """The first hit that holds the wanted text or is held by it, else the first hit."""
    w = F.lower(F.trim(wanted))
    near = F.filter(hits, lambda h: F.contains(F.lower(h[field]), w) | F.contains(w, F.lower(h[field])))
    return F.coalesce(F.try_element_at(near, F.lit(1)), F.try_element_at(hits, F.lit(1)))


def merge_metadata(tracks: DataFrame, matches: DataFrame, tags: DataFrame, least: float = 0.5) -> DataFrame:
    """(sha, artist, title, source, needs_review): a confident match, else the file's tags, else its name.

    matches: (sha, confidence, artist, title); tags: (sha, artist, title);
    tracks: (sha, path).
    """
    from cratewright.functions import paths, text

    named = text.clean_stem(paths.stem(F.col("path")))
    rows = tracks.join(matches.select("sha", "confidence", F.col("artist").alias("ma"), F.col("title").alias("mt")), "sha", "left").join(tags.select("sha", F.col("artist").alias("ta"), F.col("title").alias("tt")), "sha", "left").withColumn("n", named)
    matched = F.coalesce(F.col("confidence") >= least, F.lit(False)) & F.col("ma").isNotNull() & F.col("mt").isNotNull()
    tagged = ~text.is_placeholder(F.col("ta"), F.col("tt"))
    pick = lambda a, b, c: F.when(matched, F.col(a)).when(tagged, F.col(b)).otherwise(F.col(c))
    out = rows.select("sha", pick("ma", "ta", "n.artist").alias("artist"), pick("mt", "tt", "n.title").alias("title"), F.when(matched, "match").when(tagged, "tags").otherwise("file name").alias("source"))
    return out.withColumn("needs_review", text.is_placeholder(F.col("artist"), F.col("title")))


def drive_status(files: DataFrame, library: DataFrame, downloaded: DataFrame, key: str) -> DataFrame:
    """Add status: in library, downloaded or new."""
    has = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = files.join(has(library, "_l"), key, "left").join(has(downloaded, "_d"), key, "left")
    return out.withColumn("status", F.when(F.col("_l"), "in library").when(F.col("_d"), "downloaded").otherwise("new")).drop("_l", "_d")
