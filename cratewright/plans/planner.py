"""A facade over one collection: the requests of a live session as methods that return DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewright.functions import text
from cratewright.operators import stages
from cratewright.operators.rank import numbered
from cratewright.plans import suggest
from cratewright.session import ensure_checkpoint_dir
from cratewright.sources.state import m3u_lines, read_state
from cratewright.streaming import deck


PLAYED = "path string, artist string, title string, genre string, bpm double, played_at timestamp"


class Planner:
    """Requests over tracks (path, artist, title, genre, bpm, key, stars, theme, bitrate) and what was played.

    Tracks without a column ``idx`` (their order) are numbered by path.  Plays
    are appended to a table in ``folder`` (by default a new one beside the
    checkpoints), so no plan grows with them.
    """

    def __init__(self, spark: SparkSession, tracks: DataFrame, show: tuple[str, ...] | None = suggest.SHOW_GENRES, folder: str | None = None):
        self.spark, self.show = spark, show
        self.tracks = self._indexed(tracks)
        ensure_checkpoint_dir(spark)
        self.folder = folder or f"{spark.sparkContext.getCheckpointDir()}/plays-{uuid.uuid4().hex}"
        self.night = 0

    @property
    def history(self) -> DataFrame:
        """What was played since the last reset."""
        return read_state(self.spark, f"{self.folder}/night={self.night}", PLAYED)

    def reload(self, tracks: DataFrame) -> None:
        """Replace the collection and every index on it."""
        self.tracks.unpersist()
        self.tracks = self._indexed(tracks)

    def _indexed(self, tracks: DataFrame) -> DataFrame:
        one = suggest.dedup_tracks(tracks)
        return (one if "idx" in one.columns else numbered(one, "path", "idx")).cache()

    def count(self) -> int:
        return self.tracks.count()

    def _one(self, path: str) -> DataFrame:
        return self.tracks.where(F.col("path") == path)

    def mark_played(self, path: str, at: str) -> None:
        """Append a track to the night's plays; one that was played stays as it is."""
        row = self._one(path).select("path", "artist", "title", "genre", F.col("bpm").cast("double"), F.lit(at).cast("timestamp").alias("played_at"))
        row.join(self.history.select("path"), "path", "left_anti").write.mode("append").parquet(f"{self.folder}/night={self.night}")

    def reset(self) -> None:
        self.night += 1

    def genres(self) -> DataFrame:
        return self.tracks.groupBy("genre").agg(F.count(F.lit(1)).alias("n"))

    def next_track(self, path: str) -> DataFrame:
        """The first suggestion."""
        return self.suggest(path, 1)

    def now_playing(self, shown: DataFrame) -> DataFrame:
        """The track of each deck; shown: (deck, artist, title)."""
        return stages.now_playing(shown, self.tracks)

    def deck_status(self, decks: DataFrame) -> DataFrame:
        return deck.deck_status(decks)

    def playlist(self, path: str, second: str) -> DataFrame:
        """The suggestions for a pair of tracks as the lines of a playlist file."""
        t = self.tracks.select("path", "artist", "title", "bpm", "key", "genre")
        locked = self.suggest(path).select("place", "path", "score", "transition").join(t, "path")
        groups = self.bridge(path, second).join(t, "path")
        return m3u_lines(self._one(path), locked, groups)

    def fallback(self, surprising: bool, seed: int = 0) -> DataFrame:
        """What the voice commands "surprise me" and "save me" choose from."""
        return suggest.fallback(self.tracks, 20, 4, 0.25, seed) if surprising else suggest.fallback(self.tracks, 5, 3, 0.1, seed)

    def command(self, said: str) -> dict | None:
        """The action and argument a typed command means; None if it is none."""
        row = self.spark.range(1).select(text.command(F.lit(said)).alias("c")).first()
        return row.c.asDict() if row.c else None

    def search(self, words: str) -> DataFrame:
        return suggest.search(self.tracks, words)

    def resolve(self, artist: str, title: str) -> DataFrame:
        return suggest.resolve(self.tracks, artist, title)

    def suggest(self, path: str, n: int = 8) -> DataFrame:
        return suggest.lock(self.tracks, self._one(path), n, self.show, self.history)

    def bridge(self, anchor: str, second: str) -> DataFrame:
        a = self._one(anchor).select(*(F.col(c).alias(f"a_{c}") for c in suggest.TRACK))
        s = self._one(second).select(*(F.col(c).alias(f"s_{c}") for c in suggest.TRACK))
        return suggest.bridge(self.tracks, a.join(F.broadcast(s)), 3, self.show, self.history)

    def save_me(self, anchor: str) -> DataFrame:
        return suggest.rescue(self.tracks, self._one(anchor))

    def surprise_me(self, seed: int = 0) -> DataFrame:
        return suggest.surprise(self.tracks, self.history, seed=seed)

    def setlist(self) -> DataFrame:
        return numbered(self.history.withColumn("_at", F.struct("played_at", "path")), "_at", "n").withColumn("n", (F.col("n") + 1).cast("int")).drop("_at").orderBy("n")
