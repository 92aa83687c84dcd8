"""Live state under Structured Streaming: decks, plays, history, intake and rates.

Each stream has a batch twin in ``operators.series``; the tests hold them against
each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SOLO_SECONDS = 140
TRUE = ("1", "1.0", "True", "true")
DECK_EVENT = "deck string, seq bigint, ts timestamp, event string, artist string, title string, value double"


def _deck_messages(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    title, artist, loaded, playing = state.get if state.exists else (None, None, False, False)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []

    def emit(r, event: str, value: float | None = None) -> None:
        out.append((key[0], r.seq, r.ts, event, artist, title, value))

    for r in rows.itertuples():
        if r.field in ("title", "artist"):
            if loaded:  # a new track begins: both fields must come again
                title, artist, loaded = None, None, False
            if r.field == "title":
                title = r.value
            else:
                artist = r.value
            if title and artist:
                loaded = True
                emit(r, "loaded")
        elif r.field == "play":
            now = r.value in TRUE
            emit(r, "play_state", float(now))
            if now and not playing and loaded:
                emit(r, "playing")
            playing = now
        elif r.field == "elapsed_time":
            try:
                emit(r, "position", float(r.value))
            except (TypeError, ValueError):
                pass
    state.update((title, artist, loaded, playing))
    yield pd.DataFrame(out, columns=["deck", "seq", "ts", "event", "artist", "title", "value"])


def deck_events(messages: DataFrame) -> DataFrame:
    """Events of a stream of (seq, ts, deck, field, value): loaded, play_state, playing (from off to on) and position."""
    return messages.groupBy("deck").applyInPandasWithState(_deck_messages, DECK_EVENT, "title string, artist string, loaded boolean, playing boolean", "append", GroupStateTimeout.NoTimeout)


class SoloTimer(StatefulProcessor):
    """A track counts as played once its deck was alone for long enough in event time, and once only.

    Input rows: (session, ts, deck, path); path null when the deck is empty.  An
    event-time timer is set when one deck is left alone.
    """

    def __init__(self, seconds: int = SOLO_SECONDS):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "deck string", "path string")
        self.solo = handle.getValueState("solo", "path string, since bigint")
        self.played = handle.getMapState("played", "path string", "at bigint")

    def _settle(self, now: int) -> list[tuple[str, int]]:
        """The path alone since long enough at ``now``, if it was not counted before."""
        if self.solo.exists():
            path, since = self.solo.get()
            if now - since >= self.seconds * 1000 and not self.played.containsKey((path,)):
                self.played.updateValue((path,), (since + self.seconds * 1000,))
                return [(path, since + self.seconds * 1000)]
        return []

    def _frame(self, key, rows: list[tuple[str, int]]) -> pd.DataFrame:
        at = pd.Series([t for _, t in rows], dtype="int64").astype("datetime64[ms]").astype("datetime64[ns]")
        return pd.DataFrame({"session": pd.Series([str(key[0])] * len(rows), dtype=object), "path": pd.Series([str(p) for p, _ in rows], dtype=object), "played_at": at})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, int]] = []
        for r in pd.concat(list(rows)).sort_values(["ts", "deck"]).itertuples():
            now = int(pd.Timestamp(r.ts).timestamp() * 1000)
            out += self._settle(now)
            if r.path is None or pd.isna(r.path):
                if self.open.containsKey((r.deck,)):
                    self.open.removeKey((r.deck,))
            else:
                self.open.updateValue((r.deck,), (r.path,))
            left = [v[0] for v in self.open.values()]
            if len(left) == 1:
                if not self.solo.exists() or self.solo.get()[0] != left[0]:
                    self.solo.update((left[0], now))
                    self.handle.registerTimer(now + self.seconds * 1000)
            elif self.solo.exists():
                self.solo.clear()
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._settle(expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def played_tracks(decks: DataFrame, seconds: int = SOLO_SECONDS, lateness: str = "10 seconds") -> DataFrame:
    """(session, path, played_at) from a stream of (session, ts, deck, path)."""
    return decks.withWatermark("ts", lateness).groupBy("session").transformWithStateInPandas(SoloTimer(seconds), "session string, path string, played_at timestamp", "append", "eventTime")


def deck_assignment(files: list[str], decks: dict[str, str]) -> dict[str, str]:
    """Decks after a poll of open files: files that stay keep their deck, new ones take the free decks a, then b."""
    kept = {d: p for d, p in decks.items() if p in files}
    free = [d for d in ("a", "b") if d not in kept]
    for p in files:
        if p not in kept.values() and free:
            kept[free.pop(0)] = p
    return kept


def _next_decks(decks: dict[str, str], files: list[str]) -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    """(decks after a poll, (event, deck, path) of what closed and opened): new files take the freed decks first, then free ones, then deck a."""
    gone = sorted((d, p) for d, p in decks.items() if p not in files)
    kept = {d: p for d, p in decks.items() if p in files}
    slots = [d for d, _ in gone] + [d for d in ("a", "b") if d not in decks]
    out = [("closed", d, p) for d, p in gone]
    for i, p in enumerate(x for x in files if x not in kept.values()):
        deck = slots[i] if i < len(slots) else "a"
        if deck in kept:
            out.append(("closed", deck, kept[deck]))
        kept[deck] = p
        out.append(("opened", deck, p))
    return kept, out


def _polls(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    decks = dict(zip("ab", state.get)) if state.exists else {}
    decks = {d: p for d, p in decks.items() if p}
    rows = pd.concat(list(batches)).sort_values(["poll", "pos"])
    out = []
    for poll, part in rows.groupby("poll", sort=True):
        files = list(dict.fromkeys(p for p in part["path"] if p is not None and not pd.isna(p)))
        decks, events = _next_decks(decks, files)
        out += [(key[0], poll, *e) for e in events]
    state.update((decks.get("a"), decks.get("b")))
    yield pd.DataFrame(out, columns=["session", "poll", "event", "deck", "path"])


def open_files(polls: DataFrame) -> DataFrame:
    """(session, poll, event, deck, path): files opened and closed between polls of the open files.

    polls: a stream of (session, poll, pos, path), a row per open file, or one
    with a null path if none is open; the rows of a poll arrive together.
    """
    return polls.groupBy("session").applyInPandasWithState(_polls, "session string, poll bigint, event string, deck string, path string", "a string, b string", "append", GroupStateTimeout.NoTimeout)


class PlayedSet(StatefulProcessor):
    """Each path once a night, numbered; a row with ``reset`` begins a new night."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.played = handle.getMapState("played", "path string", "n int")
        self.night = handle.getValueState("night", "night int, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        night, n = self.night.get() if self.night.exists() else (0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            if r.reset:
                self.played.clear()
                night, n = night + 1, 0
            elif r.path is not None and not pd.isna(r.path) and not self.played.containsKey((r.path,)):
                n += 1
                self.played.updateValue((r.path,), (n,))
                out.append((str(key[0]), night, n, str(r.path)))
        self.night.update((night, n))
        if out:
            yield pd.DataFrame(out, columns=["session", "night", "n", "path"])

    def close(self) -> None:
        pass


def set_lists(plays: DataFrame) -> DataFrame:
    """(session, night, n, path) from a stream of (session, ts, seq, path, reset)."""
    return plays.groupBy("session").transformWithStateInPandas(PlayedSet(), "session string, night int, n int, path string", "append", "none")


class HistoryTail(StatefulProcessor):
    """The stream twin of ``operators.series.history_tail``: one library's history files, read after read."""

    def __init__(self, fresh: int):
        self.fresh = fresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "deck string, song string, started bigint", "yes boolean")
        self.file = handle.getValueState("file", "file string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for (read, file), part in pd.concat(list(rows)).sort_values(["read", "pos"]).groupby(["read", "file"], sort=True):
            first = not self.file.exists() or self.file.get()[0] != file
            if first:  # a new session: what its file already holds is no news
                self.file.update((str(file),))
                self.seen.clear()
            latest = {}
            for r in part.itertuples():
                k = (str(r.deck), str(r.song), int(r.started))
                latest[k[0]] = k
                if not self.seen.containsKey(k):
                    self.seen.updateValue(k, (True,))
                    if not first:
                        out.append((str(key[0]), str(file), int(read), *k))
            if first and part["age"].iloc[0] < self.fresh:
                out += [(str(key[0]), str(file), int(read), *k) for k in latest.values()]
        if out:
            yield pd.DataFrame(out, columns=["library", "file", "read", "deck", "song", "started"])

    def close(self) -> None:
        pass


def history_tail(reads: DataFrame, fresh: int = 4 * 3600) -> DataFrame:
    """(library, file, read, deck, song, started) from a stream of (library, file, read, pos, deck, song, started, age)."""
    return reads.groupBy("library").transformWithStateInPandas(HistoryTail(fresh), "library string, file string, read bigint, deck string, song string, started bigint", "append", "none")


def watch_new(rows: DataFrame, cache: str, key: str, step, checkpoint: str, once: bool = False, seconds: int = 60):
    """Rows of a stream whose key the cache lacks go through ``step`` and are appended to the cache, each key once."""
    from cratewright.session import exists

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = df.where(F.col(key).isNotNull()).dropDuplicates([key])
        if exists(spark, cache):
            new = new.join(spark.read.parquet(cache).select(key), key, "left_anti")
        step(new).write.mode("append").parquet(cache)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def fan_out(rows: DataFrame, sinks: list, checkpoint: str, once: bool = False):
    """Hand each micro-batch, computed once, to several sinks."""

    def batch(df: DataFrame, n: int) -> None:
        kept = df.persist()
        for sink in sinks:
            sink(kept, n)
        kept.unpersist()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def new_plays(history: DataFrame, lateness: str = "4 hours") -> DataFrame:
    """Rows of a stream of (deck, key, started_at) not seen before; rows later than ``lateness`` are dropped."""
    return history.withColumn("deck", F.lower("deck")).withWatermark("started_at", lateness).dropDuplicatesWithinWatermark(["deck", "key", "started_at"])


def last_per_window(events: DataFrame, key: str, at: str, value: str, width: str = "100 milliseconds", lateness: str = "1 second") -> DataFrame:
    """(key, window, value): the last value of each tumbling window, so a burst of changes is one."""
    return events.withWatermark(at, lateness).groupBy(key, F.window(at, width)).agg(F.max_by(value, F.struct(at, value)).alias(value))


def sessions(events: DataFrame, key: str, at: str, gap: str = "140 seconds", lateness: str = "1 minute") -> DataFrame:
    return events.withWatermark(at, lateness).groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))


def rate_windows(events: DataFrame, key: str, at: str, width: str = "1 second", slide: str = "250 milliseconds", lateness: str = "1 second") -> DataFrame:
    """Requests per sliding window."""
    return events.withWatermark(at, lateness).groupBy(key, F.window(at, width, slide)).agg(F.count(F.lit(1)).alias("n"))


def intake(spark: SparkSession, folder: str, done: str, failed: str, checkpoint: str, parse, once: bool = False):
    """Watch a drop folder: new files by name are parsed and appended to ``done``, broken ones to ``failed``.

    ``parse`` maps a DataFrame of (path, name, length) to the same rows with a
    boolean column ``ok``.  Runs once over what is there, or every 8 seconds.
    """
    from cratewright.session import exists

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")

    def step(df: DataFrame, _: int) -> None:
        new = df.dropDuplicates(["name"])
        if exists(spark, done):
            new = new.join(spark.read.parquet(done).select("name"), "name", "left_anti")
        out = parse(new).persist()
        out.where("ok").drop("ok").write.mode("append").parquet(done)
        out.where("not ok").drop("ok").write.mode("append").parquet(failed)
        out.unpersist()

    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="8 seconds")).start()


def position(started: str, now: str = "now") -> Column:
    """Seconds since a deck started, for joins with a rate source."""
    return (F.unix_micros(F.col(now)) - F.unix_micros(F.col(started))) / 1e6


def sse_events(lines: DataFrame, order: str, line: str) -> DataFrame:
    """(event, data): server-sent events from lines; a blank line ends one, the first data line counts."""
    from pyspark.sql import Window

    # The lines of one connection, in order.
    w = Window.partitionBy("stream").orderBy(order)
    n = F.sum(F.when(F.trim(line) == "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    data = lines.withColumn("event", n).where(F.col(line).startswith("data:"))
    return data.groupBy("stream", "event").agg(F.min_by(F.trim(F.substring(line, 6, 1 << 30)), order).alias("data"))


def deck_status(decks: DataFrame) -> DataFrame:
    """The line to show: deck A if it plays, else B if it plays, else any loaded one; input (deck, playing, loaded, label)."""
    rank = F.when(F.col("playing") & (F.col("deck") == "a"), 0).when(F.col("playing"), 1).when(F.col("loaded"), 2)
    return decks.withColumn("_r", rank).where("_r is not null").agg(F.min_by("label", F.struct("_r", "deck")).alias("label"))
