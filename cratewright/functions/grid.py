"""Beat grids and cue points of a track."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUE = "struct<name:string,type:int,start_ms:double,len_ms:double,hotcue:int>"


def beat_ms(bpm: Column) -> Column:
    return F.when(bpm > 0, F.lit(60000.0) / bpm)


def snap(pos: Column, anchor: Column, period: Column, beats: int = 1) -> Column:
    """The nearest grid line; halfway goes to the even one."""
    step = period * beats
    return anchor + F.bround((pos - anchor) / step, 0) * step


def bar_before(pos: Column, anchor: Column, period: Column) -> Column:
    bar = period * 4
    return F.when(bar > 0, pos - F.pmod(pos - anchor, bar)).otherwise(pos)


def bar_after(pos: Column, anchor: Column, period: Column) -> Column:
    """The first bar line strictly after a position."""
    bar = period * 4
    return F.when(bar > 0, pos - F.pmod(pos - anchor, bar) + bar).otherwise(pos)


def beat_half_up(pos: Column, anchor: Column, period: Column) -> Column:
    off = F.pmod(pos - anchor, period)
    return F.when(F.coalesce(period <= 0, F.lit(True)), pos).when(off < period / 2, pos - off).otherwise(pos - off + period)


def beats_between(anchor: Column, period: Column, duration: Column) -> Column:
    """All beat times from 0 up to, not including, the duration."""
    first = anchor - F.floor(anchor / period) * period
    n = F.greatest(F.ceil((duration - first) / period), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: first + i * period)).otherwise(F.array().cast("array<double>"))


def amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def grid_anchor(cues: Column) -> Column:
    """Start of the first grid cue (no hot-cue number or named AutoGrid), null without one."""
    return F.try_element_at(F.filter(cues, lambda c: (c["hotcue"] == -1) | (c["name"] == "AutoGrid")), F.lit(1))["start_ms"]


def _cue(name: str, kind: int, start: Column, length: Column, slot: int) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), start.cast("double").alias("start_ms"), length.cast("double").alias("len_ms"), F.lit(slot).alias("hotcue"))


def fast_cues(anchor: Column, bpm: Column, duration_s: Column) -> Column:
    """Load, fade-in and outro (16 beats before the end) from the grid alone; null without grid, tempo or 30 seconds."""
    p = beat_ms(bpm)
    outro = snap(duration_s * 1000 - 16 * p, anchor, p)
    zero = F.lit(0.0)
    ends = F.array(_cue("Load", 3, anchor, zero, 0), _cue("Fade In", 1, anchor, zero, 1))
    with_outro = F.when(outro > anchor + p, F.concat(ends, F.array(_cue("Outro", 2, outro, zero, 7)))).otherwise(ends)
    return F.when(F.coalesce((bpm > 0) & anchor.isNotNull() & (duration_s >= 30), F.lit(False)), with_outro)


def bar_cues(anchor: Column, bpm: Column, duration_ms: Column) -> Column:
    """First beat and outro eight bars before the end, on bar lines."""
    p = beat_ms(bpm)
    outro = bar_before(duration_ms - 32 * p, anchor, p)
    first = F.array(_cue("Beat", 0, anchor, F.lit(0.0), 1))
    keep = (duration_ms > 0) & (outro > anchor + 4 * p)
    return F.when(F.coalesce(keep, F.lit(False)), F.concat(first, F.array(_cue("Outro", 2, outro, F.lit(0.0), 7)))).otherwise(first)


def merge_cues(old: Column, new: Column) -> Column:
    """New cues go into the slots that are still free; all in order of slot and start."""
    used = F.transform(F.filter(old, lambda c: c["hotcue"] >= 0), lambda c: c["hotcue"])
    fresh = F.filter(new, lambda c: ~F.array_contains(used, c["hotcue"]))
    return F.array_sort(F.concat(old, fresh), lambda a, b: F.when(a["hotcue"] != b["hotcue"], F.when(a["hotcue"] < b["hotcue"], -1).otherwise(1)).when(a["start_ms"] < b["start_ms"], -1).when(a["start_ms"] > b["start_ms"], 1).otherwise(0))


def user_slots(cues: Column) -> Column:
    """The hot-cue numbers from 1 on that are in use."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(cues, lambda c: c["hotcue"] >= 1), lambda c: c["hotcue"])))


def missing_slots(cues: Column, wanted: tuple[int, ...] = (0, 1, 2, 3, 7)) -> Column:
    return F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(F.transform(cues, lambda c: c["hotcue"]), F.array().cast("array<int>")))


def richness(playcount: Column, ranking: Column, last_played: Column, color: Column, cues: Column) -> Column:
    """How much work went into an entry: plays, stars, colour, named hot cues and cues."""
    named = F.size(F.filter(cues, lambda c: (c["hotcue"] != -1) & (c["name"] != "n.n.")))
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    return one(playcount > 0) + 2 * one(ranking > 0) + one(F.trim(last_played) != "") + one(color != 0) + F.coalesce(named + F.least(F.size(cues), F.lit(5)), F.lit(0))
