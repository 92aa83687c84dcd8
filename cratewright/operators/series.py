"""Features of ordered series: runs, sliding means, neighbours and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_above_mean(df: DataFrame, key: str, at: str, value: str, width: int = 4, quantile: float = 0.75) -> DataFrame:
    """(key, at): the first position whose mean over ``width`` values reaches the key's quantile of all values."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(0, width - 1)
    level = df.groupBy(key).agg(F.percentile(value, F.lit(quantile)).alias("_level"))
    means = df.withColumn("_mean", F.avg(value).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == width)
    return means.join(level, key).where("_mean >= _level").groupBy(key).agg(F.min(at).alias(at))


def first_sustained(df: DataFrame, key: str, at: str, value: str, level: Column | str, length: int = 10) -> DataFrame:
    """(key, at): where the first run of at least ``length`` values above the level begins."""
    level = F.col(level) if isinstance(level, str) else level
    w = Window.partitionBy(key).orderBy(at).rowsBetween(0, length - 1)
    good = df.withColumn("_above", (F.col(value) > level).cast("int"))
    runs = good.withColumn("_all", F.sum("_above").over(w)).where(F.col("_all") == length)
    return runs.groupBy(key).agg(F.min(at).alias(at))


def islands(df: DataFrame, key: str, at: str, inside: Column) -> DataFrame:
    """(key, start, stop, length, closed) of each run of rows inside; ``closed``: a row outside follows."""
    w = Window.partitionBy(key).orderBy(at)
    rows = df.select(key, at, F.coalesce(inside, F.lit(False)).cast("int").alias("_in"))
    rows = rows.withColumn("_new", (F.col("_in") != F.coalesce(F.lag("_in").over(w), F.lit(-1))).cast("int")).withColumn("_next", F.lead("_in").over(w))
    rows = rows.withColumn("_run", F.sum("_new").over(w)).where("_in = 1")
    return rows.groupBy(key, "_run").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count(F.lit(1)).alias("length"), F.max(F.coalesce(F.col("_next") == 0, F.lit(False))).alias("closed")).drop("_run")


def longest_run(df: DataFrame, key: str, at: str, inside: Column, least: int = 1) -> DataFrame:
    """(key, start, length) of the longest closed run; the first of equal ones."""
    runs = islands(df, key, at, inside).where(F.col("closed") & (F.col("length") >= least))
    return runs.groupBy(key).agg(F.min_by(F.struct("start", "length"), F.struct((-F.col("length")).alias("l"), F.col("start").alias("s"))).alias("x")).select(key, "x.start", "x.length")


def last_above(df: DataFrame, key: str, at: str, value: str, level: Column | float) -> DataFrame:
    return df.where(F.col(value) > level).groupBy(key).agg(F.max(at).alias(at))


def with_neighbours(df: DataFrame, key: str, at: str, value: str, reach: int = 3) -> DataFrame:
    """Add value_m1, value_p1 and so on: the values of the rows before and after, blank ones left out first."""
    w = Window.partitionBy(key).orderBy(at)
    out = df.where(F.trim(value) != "")
    for k in range(1, reach + 1):
        out = out.withColumn(f"{value}_m{k}", F.lag(value, k).over(w)).withColumn(f"{value}_p{k}", F.lead(value, k).over(w))
    return out


def word_at(start: Column, stop: Column, now: Column, words: Column) -> Column:
    """The number of the word being sung, spread evenly over its line."""
    part = (now - start) / F.greatest(stop - start, F.lit(1e-9))
    return F.least(F.greatest(F.floor(part * words), F.lit(0)), words - 1).cast("int")


def edges(df: DataFrame, key: str, order: list[str], state: Column) -> DataFrame:
    """Rows at which the state goes from false (or nothing) to true."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_s", F.coalesce(state, F.lit(False))).withColumn("_before", F.coalesce(F.lag("_s").over(w), F.lit(False))).where("_s and not _before").drop("_s", "_before")


def gaps_of_at_least(df: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """(key, start, stop, seconds): a row after which nothing came for at least so long."""
    w = Window.partitionBy(key).orderBy(at)
    long = F.unix_micros(F.col("stop").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return df.select(key, F.col(at).alias("start"), F.lead(at).over(w).alias("stop")).where("stop is not null").withColumn("seconds", long / 1e6).where(F.col("seconds") >= seconds)


def last_per_window(df: DataFrame, key: str, at: str, seconds: float, value: str) -> DataFrame:
    """(key, window_start, value): the last value in each tumbling window."""
    micros = int(seconds * 1_000_000)
    start = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / micros).cast("bigint") * micros
    return df.groupBy(key, start.alias("window_start")).agg(F.max_by(value, F.struct(at, value)).alias(value))


def rate(df: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Add ``in_window``: rows of the key in the seconds up to and including each row."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(t).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("in_window", F.count(F.lit(1)).over(w))


def sessions(df: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """(key, session, start, stop, n): rows less than so many seconds apart."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at)
    new = F.coalesce((t - F.lag(t).over(w) >= seconds * 1_000_000).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count(F.lit(1)).alias("n"))


def grouped_words(df: DataFrame, key: str, pos: str, word: str, start: str, most: int = 60) -> DataFrame:
    """(key, line, start, text): words gathered into lines.

    A line ends before a word that would make it longer than ``most`` signs, and
    after a word that ends in punctuation.  The running length starts anew with
    each line, so the words of a key are folded in order inside the JVM.
    """
    words = df.where(F.trim(word) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(start).alias("s"), F.trim(word).alias("w")))).alias("ws"))
    kind = "array<struct<s:double,t:string>>"

    def add(lines: Column, w: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        full = (F.length(last["t"]) + 1 + F.length(w["w"]) > most) | last["t"].rlike(r"[.!?,;:]$")
        fresh = F.struct(w["s"].cast("double").alias("s"), w["w"].alias("t"))
        grown = F.struct(last["s"].alias("s"), F.concat(last["t"], F.lit(" "), w["w"]).alias("t"))
        return F.when((F.size(lines) == 0) | full, F.concat(lines, F.array(fresh))).otherwise(F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(grown)))

    lines = F.aggregate("ws", F.array().cast(kind), add)
    return words.select(key, F.posexplode(lines).alias("line", "x")).select(key, "line", F.col("x.s").alias("start"), F.col("x.t").alias("text"))


def set_list(df: DataFrame, key: str, order: list[str], path: str, reset: Column) -> DataFrame:
    """(key, night, n, path, first columns of ``order``): what was played since the last reset, each path once a night, in order."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    nights = df.select(key, *order, path, F.coalesce(reset, F.lit(False)).alias("_reset")).withColumn("night", F.sum(F.col("_reset").cast("int")).over(w))
    first = nights.where(~F.col("_reset") & F.col(path).isNotNull()).groupBy(key, "night", path).agg(F.min(F.struct(*order)).alias("_at"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(key, "night").orderBy("_at"))).select(key, "night", "n", path, "_at.*")


def history_tail(df: DataFrame, file: str, read: str, deck: str, song: str, started: str, order: str, age_seconds: str, fresh: int = 4 * 3600) -> DataFrame:
    """(file, read, deck, song, started): what a tail of history files reports.

    Rows are the entries a read of a file showed.  The first read of a file only
    reports the latest entry of each deck, and nothing if the file was not
    written for ``fresh`` seconds; later reads report entries not shown before.
    """
    first = df.groupBy(file).agg(F.min(read).alias("_first"))
    shown = df.groupBy(file, deck, song, started).agg(F.min(read).alias(read)).join(first, file)
    later = shown.where(F.col(read) > F.col("_first")).select(file, read, deck, song, started)
    start = df.join(first, file).where((F.col(read) == F.col("_first")) & (F.col(age_seconds) < fresh))
    latest = start.groupBy(file, read, deck).agg(F.max_by(F.struct(song, started), order).alias("_x")).select(file, read, deck, "_x.*")
    return latest.unionByName(later)


def track_cues(tracks: DataFrame, frames: DataFrame, hop: float, least: float = 30.0, drop_from: float = 2.0, drop_to: float = 30.0, sustain_beats: int = 4, quantile: float = 0.75, vocal_from: float = 4.0, sustain_frames: int = 10, outro_beats: int = 16, loop_beats: int = 4) -> DataFrame:
    """(path, slot, name, type, start_ms, len_ms): the cue points of each track, from what an audio front end measured.

    tracks: (path, anchor_ms, bpm, first_sound_ms), a beat grid and the first
    onset; frames: (path, i, onset, voice), the onset strength and the level of
    the voice band every ``hop`` seconds.  Load at the first sound, fade-in at
    the first beat, vocal where the voice band stays above its threshold, drop
    where the onsets of some beats on end reach the quantile of all beats, outro
    some beats before the end.  Tracks shorter than ``least`` seconds have none.
    """
    from cratewright.functions import grid

    size = frames.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.median(F.when(F.col("i") < int(5.0 / hop), F.col("voice"))).alias("_base"), F.percentile("voice", F.lit(0.4)).alias("_p40"))
    t = tracks.join(size, "path").withColumn("_dur", F.col("_n") * hop).where((F.col("_dur") >= least) & (F.col("bpm") > 0))
    t = t.withColumn("_p", grid.beat_ms(F.col("bpm")) / 1000).withColumn("_a", F.col("anchor_ms") / 1000)
    cue = lambda slot, name, kind, start, length=F.lit(0.0): F.struct(F.lit(slot).alias("slot"), F.lit(name).alias("name"), F.lit(kind).alias("type"), start.cast("double").alias("start_ms"), length.cast("double").alias("len_ms"))
    outro = grid.snap((F.col("_dur") - outro_beats * F.col("_p")) * 1000, F.col("anchor_ms"), F.col("_p") * 1000)
    plain = t.select("path", F.inline(F.array(cue(0, "Load", 3, F.col("first_sound_ms")), cue(1, "Fade In", 1, F.col("anchor_ms")), cue(7, "Outro", 2, F.when(outro > F.col("anchor_ms") + F.col("_p") * 1000, outro)))))

    n_beats = F.greatest(F.ceil((F.col("_dur") - F.col("_a")) / F.col("_p")), F.lit(0)).cast("int")
    beats = t.withColumn("_nb", n_beats).where("_nb > 0").select("path", "anchor_ms", "_a", "_p", "_n", "_nb", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("b"))
    beats = beats.withColumn("i", F.least(F.ceil((F.col("_a") + F.col("b") * F.col("_p")) / hop), F.col("_n") - 1).cast("int"))
    heard = beats.join(frames.select("path", F.col("i").cast("int").alias("i"), "onset"), ["path", "i"])
    level = heard.groupBy("path").agg(F.percentile("onset", F.lit(quantile)).alias("_level"))
    start = F.floor(F.lit(drop_from) / F.col("_p"))
    stop = F.greatest(start + 8, F.col("_nb") - F.floor(F.lit(drop_to) / F.col("_p")))
    w = Window.partitionBy("path").orderBy("b").rowsBetween(0, sustain_beats - 1)
    windows = heard.where((F.col("b") >= start) & (F.col("b") < stop)).withColumn("_mean", F.avg("onset").over(w)).withColumn("_k", F.count(F.lit(1)).over(w)).where(F.col("_k") == sustain_beats)
    hit = windows.join(level, "path").where("_mean >= _level").groupBy("path", "anchor_ms", "_a", "_p").agg(F.min("b").alias("b"))
    at = grid.snap((F.col("_a") + F.col("b") * F.col("_p")) * 1000, F.col("anchor_ms"), F.col("_p") * 1000, 4)
    drop = hit.select("path", cue(3, "Drop", 5, at, loop_beats * F.col("_p") * 1000).alias("c")).select("path", "c.*")

    sung = frames.where(F.col("i") >= int(vocal_from / hop)).join(t.select("path", "anchor_ms", "_a", "_p", F.greatest(F.coalesce("_base", F.lit(0.0)) * 3, F.col("_p40")).alias("_level")), "path")
    ahead = Window.partitionBy("path").orderBy("i").rowsBetween(0, sustain_frames - 1)
    run = sung.withColumn("_all", F.sum((F.col("voice") >= F.col("_level")).cast("int")).over(ahead)).where(F.col("_all") == sustain_frames)
    first = run.groupBy("path", "anchor_ms", "_a", "_p").agg((F.min("i") * hop).alias("_s")).where("_s > _a + _p")
    vocal = first.select("path", cue(2, "Vocal", 0, grid.snap(F.col("_s") * 1000, F.col("anchor_ms"), F.col("_p") * 1000)).alias("c")).select("path", "c.*")
    return plain.where("start_ms is not null").unionByName(drop).unionByName(vocal)
