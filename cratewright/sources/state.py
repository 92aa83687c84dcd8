"""State tables: keyed JSON files in, versioned tables out, and text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewright.session import exists


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of (key, value...) from JSON lines or a Parquet folder; empty if it is missing.  Broken lines are left out."""
    fields = [f.strip().split()[0] for f in schema.split(",") if " " in f.strip()]
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if path.endswith(".json"):
        df = spark.read.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
        return df.where("_broken is null").drop("_broken").select(*fields)
    return spark.read.schema(schema).parquet(path)


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a file that holds one JSON object; an object that cannot be read gives no rows.  A null value stays a row."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"key string, value {value}")
    raw = spark.read.option("wholetext", "true").text(path)
    return raw.select(F.explode_outer(F.from_json("value", f"map<string,{value}>")).alias("key", "value")).where("key is not null")


def reputation(tiers: DataFrame) -> DataFrame:
    """(artist, tier, summary): artists and band members of (tier, summary, artists, members); the most severe tier wins."""
    rank = F.when(F.col("tier") == "convicted", 3).when(F.col("tier") == "accused", 2).when(F.col("tier") == "settled", 1).otherwise(0)
    names = F.concat(F.coalesce("artists", F.array().cast("array<string>")), F.coalesce("members", F.array().cast("array<string>")))
    rows = tiers.select("tier", "summary", rank.alias("_r"), F.explode(names).alias("artist")).withColumn("artist", F.lower(F.trim("artist")))
    return rows.groupBy("artist").agg(F.max_by(F.struct("tier", "summary"), F.struct("_r", "summary")).alias("x")).select("artist", "x.tier", "x.summary")


def write_version(df: DataFrame, folder: str, run: str) -> str:
    """Write a table below its run id, so earlier versions stay; the folder written."""
    target = f"{folder.rstrip('/')}/run={run}"
    df.write.mode("errorifexists").parquet(target)
    return target


def setlist_lines(played: DataFrame) -> DataFrame:
    """(n, line): the numbered list of a night; numbered by range partitions."""
    from cratewright.operators.rank import numbered

    rows = numbered(played.select(F.struct("played_at", "path").alias("_at"), "artist", "title", "bpm", "genre"), "_at", "n").withColumn("n", (F.col("n") + 1).cast("int"))
    return rows.select("n", F.format_string("%02d. %s - %s [%.1f BPM | %s]", "n", "artist", "title", "bpm", "genre").alias("line"))


def m3u_lines(anchor: DataFrame, second: DataFrame, groups: DataFrame) -> DataFrame:
    """(section, place, part, line) of a suggestion playlist: the anchor, the tracks to lock, and the bridges by destination.

    ``second`` and ``groups`` are results of the suggestion queries, with
    artist, title, bpm, key and genre.
    """
    label = F.format_string("#EXTINF:-1,%s — %s  [%.1f BPM | %s | %s | %d%% | %s]", "artist", "title", "bpm", "key", "genre", F.bround(F.col("score") * 100, 0).cast("int"), "transition")
    two = F.array(F.struct(F.lit(0).alias("part"), label.alias("line")), F.struct(F.lit(1).alias("part"), F.col("path").alias("line")))
    head = anchor.select(F.lit(0).alias("section"), F.lit(0).alias("place"), F.inline(F.array(F.struct(F.lit(0).alias("part"), F.lit("#EXTM3U").alias("line")), F.struct(F.lit(1).alias("part"), F.format_string("# Anchor: %s — %s  [%.1f BPM | %s | %s]", "artist", "title", "bpm", "key", "genre").alias("line")))))
    lock = second.select(F.lit(1).alias("section"), "place", F.inline(two))
    titles = groups.select(F.col("group_place") + 1, "destination").distinct().toDF("section", "destination").select("section", F.lit(0).alias("place"), F.lit(0).alias("part"), F.concat(F.lit("# → "), "destination").alias("line"))
    bridges = groups.select((F.col("group_place") + 1).alias("section"), "place", F.inline(two))
    return head.unionByName(lock).unionByName(titles).unionByName(bridges).orderBy("section", "place", "part")
