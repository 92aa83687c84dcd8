"""Cleaning of names, titles, file names, HTML and timed texts, as column expressions.

Only Unicode compatibility forms and numeric HTML entities need Python; they run
as Arrow batches.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cratewright.functions.keys import strip
from cratewright.functions.lookups import GENRE_WORDS, SMALL_WORDS, TITLE_GENRES

# Patterns of file names and tags.
DOWNLOADER = r"(?i)^y2mate\.com\s*-\s*"
VIDEO_ID = r"[_\-][A-Za-z0-9_\-]{11}$"
OFFICIAL = r"(?i)\s*[\(\[](official\s*(video|audio|music\s*video|lyric\s*video|clip)|lyrics?|hq|hd|4k|mv)[\)\]]\s*$"
QUALITY = r"(?i)\s*[\-_]?\s*(HQ|HD|4K|320k|256k|192k|128k)\s*$"
TRACK_NUMBER = r"^\d{1,3}[\s\-\.]+"
PLACEHOLDER_ARTIST = r"(?i)^artist$"
PLACEHOLDER_TITLE = r"(?i)^(track\s*\d+|unknown|untitled|track)$"
NOISE_PART = r"(?i)^(HQ|HD|4K|\d+k|official.*|lyrics?.*|audio.*)$"
AUDIO_END = r"(?i)\.(mp3|flac|m4a|wav|ogg|aiff|aif|wma|opus)$"
ARTIFACTS = r"(?i)\[YoutubeConverter\.Me\]|\[FREE DOWNLOAD\]|\[Full Album\]|\[Full Compilation\]|\(320\s+kbps\)|\(320kbps\)|\(HD\)|\(Official\s+Video\)|\(Official\s+Audio\)"
LIVE = (
    r"(?i)(\(live\b|\[live\b|\blive\s+at\b|\blive\s+in\b|\blive\s+from\b|\blive\s*-|-\s*live\b|\(unplugged\b|\[unplugged\b|\bunplugged\s+version\b"
    r"|\bbbc\s+(?:radio|session)\b|\blive\s+audio\b|\blive\s+recording\b|\blive\s+version\b|\blive\s+session\b|\blive\s+performance\b)"
)
FEATURED = r"(?i)\s*[\(\[]?\s*(?:feat\.?|ft\.?|featuring|with)\s+.+?[\)\]]?\s*$"
DECADE = r"(?i)^\d0'?s\s+"
DECADE_DASH = r"(?i)^(\d{2}'?s)[-]\s*(.+)$"
COLLABORATION = r"(?i)^(.+?)\s+(?:feat\.?|ft\.?|featuring|with|w/)\s+.+$"
AMPERSAND = r"(?i)^(.+?)\s+(?:&|and)\s+.+$"
NOT_A_SONG_FILE = r"(?i)(loop.?recorder|recording\s+\d{4}[-_]\d{2}[-_]\d{2}|\d{4}-\d{2}-\d{2}\s+\d{2}-\d{2}-\d{2})"
NOT_A_SONG_TITLE = r"(?i)^(loop.?recorder|recording\s+\d{4}|intro|track\s+\d+|track.by.track.*intro|\(\d+\)\s+(synth|organ))"
INSTRUMENTAL = r"(?i)\b(instrumental|inst\.?|no[ -]?vocals?|karaoke|ambient\s+mix|dub\s+mix)\b"
UNSAFE = '\\/:*?"<>|'
STRIPPED = " -_.,"


def strip_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def _blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_stem(stem: Column) -> Column:
    """The struct (artist, title) a file name without extension names; both null for placeholders.

    Downloader marks, video ids, quality marks and track numbers go first; then
    the name is split at a dash.  A genre on the left is dropped; "Title- Artist"
    and "Title-Artist" (capital, at most four words) are turned round.
    """
    s = F.trim(stem)
    for pattern, by in ((DOWNLOADER, ""), (VIDEO_ID, ""), (OFFICIAL, ""), (QUALITY, ""), (r"\.{2,}", "."), (TRACK_NUMBER, "")):
        s = F.trim(F.regexp_replace(s, pattern, by))
    snake = lambda x: F.when(F.length(x) - F.length(F.replace(x, F.lit("_"), F.lit(""))) >= 2, F.replace(x, F.lit("_"), F.lit(" "))).otherwise(x)
    return let(let(s, snake), _named)


def _named(s: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(s, r"\s*-\s+", " - "), r"\s+-\s*", " - ")
    turned = s.rlike(r"^(.+\S)-\s+([A-Za-z].*)$")
    return let(F.struct(spaced.alias("t"), turned.alias("turned"), F.transform(F.split(spaced, " - "), lambda p: F.trim(p)).alias("parts")), _split_name)


def _split_name(x: Column) -> Column:
    # Everything from the first noise part on is dropped.
    noise_at = F.array_position(F.transform(x["parts"], lambda p: p.rlike(NOISE_PART)), True)
    kept = F.when(noise_at > 0, F.slice(x["parts"], F.lit(1), F.greatest(noise_at.cast("int") - 1, F.lit(0)))).otherwise(x["parts"])
    whole = F.split(x["t"], " - ", 2)
    sides = let(kept, lambda k: F.when(F.size(k) >= 2, F.array(F.element_at(k, 1), F.array_join(F.slice(k, F.lit(2), F.size(k)), " - "))).otherwise(F.transform(whole, lambda p: F.trim(p))))
    tight = r"^(.+?)-([A-Z][A-Za-z\s]+)$"
    fields = F.struct(
        x["t"].alias("t"),
        x["turned"].alias("turned"),
        F.contains(x["t"], F.lit(" - ")).alias("dashed"),
        sides.alias("sides"),
        F.trim(F.regexp_extract(x["t"], tight, 1)).alias("tight_title"),
        F.when(~x["t"].startswith("-"), F.trim(F.regexp_extract(x["t"], tight, 2))).alias("tight_artist"),
    )
    return let(fields, _choose_sides)


def _choose_sides(x: Column) -> Column:
    left, right = F.try_element_at(x["sides"], F.lit(1)), F.try_element_at(x["sides"], F.lit(2))
    is_tight = ~x["dashed"] & (F.coalesce(x["tight_artist"], F.lit("")) != "") & (F.size(F.split(x["tight_artist"], r"\s+")) <= 4)
    genre = F.lower(left).isin(*GENRE_WORDS)
    artist = F.when(x["dashed"], F.when(genre, None).when(x["turned"], right).otherwise(left)).when(is_tight, x["tight_artist"])
    title = F.when(x["dashed"], F.when(genre, right).when(x["turned"], left).otherwise(right)).when(is_tight, x["tight_title"]).otherwise(x["t"])
    return let(F.struct(strip_chars(artist, STRIPPED).alias("artist"), strip_chars(title, STRIPPED).alias("title")), _real_names)


def _real_names(x: Column) -> Column:
    known = ~F.coalesce(x["title"].rlike(PLACEHOLDER_TITLE), F.lit(False))
    return F.struct(F.when(known & ~x["artist"].rlike(PLACEHOLDER_ARTIST), _blank_to_null(x["artist"])).alias("artist"), F.when(known, _blank_to_null(x["title"])).alias("title"))


def is_placeholder(artist: Column, title: Column) -> Column:
    a, t = F.coalesce(artist, F.lit("")), F.coalesce(title, F.lit(""))
    return (t == "") | t.rlike(PLACEHOLDER_TITLE) | (a == "") | a.rlike(PLACEHOLDER_ARTIST)


def clean_existing(artist: Column, title: Column) -> Column:
    """Tags corrected only where the title looks like a file name or the artist is blank."""
    a, t = F.coalesce(artist, F.lit("")), F.coalesce(title, F.lit(""))
    bare = F.regexp_replace(t, r"(?<=.)\.[^.]*$", "")
    dirty = t.rlike(DOWNLOADER) | bare.rlike(VIDEO_ID) | t.rlike(OFFICIAL) | t.rlike(PLACEHOLDER_TITLE) | (a == "")

    def chosen(found: Column) -> Column:
        return F.struct(
            F.when(dirty & (a == ""), F.coalesce(found["artist"], artist)).otherwise(artist).alias("artist"),
            F.when(dirty, F.coalesce(found["title"], title)).otherwise(title).alias("title"),
        )

    return let(clean_stem(t), chosen)


def clean_title(title: Column, artist: Column) -> Column:
    """A title without file ending, download marks, genre and artist in front; null if nothing changes.

    The artist is compared as text, not as a pattern.
    """
    a = F.coalesce(artist, F.lit(""))
    t1 = F.when(title.rlike(AUDIO_END), F.trim(F.regexp_replace(title, AUDIO_END, ""))).otherwise(title)
    t2 = F.trim(F.regexp_replace(t1, ARTIFACTS, ""))
    pattern = rf"(?i)^({'|'.join(TITLE_GENRES)})\s*[-_]\s*(.+?)\s*[-_]\s*(.+)$"

    def without_genre(t: Column) -> Column:
        return F.when((a != "") & (F.lower(F.trim(F.regexp_extract(t, pattern, 2))) == F.lower(a)), F.trim(F.regexp_extract(t, pattern, 3))).otherwise(t)

    def without_artist(t: Column) -> Column:
        rest = F.substr(t, F.length(a) + 1)
        starts = (F.length(a) > 2) & (F.lower(F.substr(t, F.lit(1), F.length(a))) == F.lower(a))
        return F.when(starts & rest.rlike(r"^\s*[-–]\s*"), F.trim(F.regexp_replace(rest, r"^\s*[-–]\s*", ""))).when(starts & rest.rlike("^[-_]"), F.trim(F.substring(rest, 2, 1 << 30))).otherwise(t)

    def changed(t: Column) -> Column:
        return F.when((t != title) & (strip_chars(t, " -–_") != ""), strip_chars(t, " -–_"))

    return let(let(let(t2, without_genre), without_artist), changed)


def track_prefix(stem: Column) -> Column:
    return F.regexp_extract(stem, r"^(\d{1,3}\s*[-–]\s*)", 1)


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def compatibility_form(text: Column) -> Column:
    """NFKC; plain ASCII stays in the JVM."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(F.pandas_udf(_nfkc, "string")(text))


def safe_name(text: Column, most: int = 100, normalise: bool = True) -> Column:
    """A name that can stand in a path; "Unknown" if nothing is left."""
    s = F.trim(text)
    s = compatibility_form(s) if normalise else s
    s = F.regexp_replace(s, "[" + UNSAFE.replace("\\", "\\\\") + "]", "_")
    s = strip_chars(F.regexp_replace(s, "[ _]{2,}", " "), " ._")
    return F.when(s != "", F.substring(s, 1, most)).otherwise("Unknown")


def destination(root: str, artist: Column, album: Column, year: Column, track: Column, title: Column, ext: Column) -> Column:
    """``root/artist/album (year)/NN - title.ext``."""
    number = F.regexp_extract(track, r"^\s*(\d+)", 1).try_cast("int")
    folder = F.when(F.coalesce(album, F.lit("")) == "", F.lit("Unknown Album")).otherwise(F.concat(album, F.when(F.coalesce(year, F.lit("")) != "", F.concat(F.lit(" ("), year, F.lit(")"))).otherwise("")))
    name = F.concat(F.when(number.isNotNull(), F.format_string("%02d - ", number)).otherwise(""), title)
    return F.concat_ws("/", F.lit(root), safe_name(artist, normalise=False), safe_name(folder, normalise=False), F.concat(safe_name(name, normalise=False), ext))


def title_case(name: Column) -> Column:
    """Acronyms and words with a digit or slash stay, small words go lower except in front, all others get a capital."""

    def word(w: Column, i: Column) -> Column:
        acronym = (F.upper(w) == w) & (F.lower(w) != w) & F.length(w).between(2, 5)
        return F.when(acronym | w.rlike(r"[\d/]"), w).when(F.lower(w).isin(*SMALL_WORDS) & (i > 0), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))

    return F.array_join(F.transform(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""), word), " ")


def smart_title_case(name: Column) -> Column:
    """A capital for each word that begins in lower case; the rest of a word stays."""
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def full_artist(raw: Column) -> Column:
    """Placeholders become empty; featured artists and a decade in front go; then title case."""
    r = F.trim(F.coalesce(raw, F.lit("")))
    a = F.trim(F.regexp_replace(r, FEATURED, ""))
    a = F.trim(F.regexp_replace(a, DECADE, ""))
    return F.when((r == "") | F.lower(r).isin("unknown", "<unknown>", "unknown artist", "various artists"), "").otherwise(title_case(a))


def primary_artist(artist: Column, exclusions: tuple[str, ...] = ()) -> Column:
    """The first of several artists; null if the name has one, or is excluded."""
    out = F.when(artist.rlike(COLLABORATION), F.trim(F.regexp_extract(artist, COLLABORATION, 1))).when(artist.rlike(AMPERSAND), F.trim(F.regexp_extract(artist, AMPERSAND, 1)))
    return F.when(~artist.isin(*exclusions), out) if exclusions else out


def plausible_artist(name: Column) -> Column:
    n = F.coalesce(name, F.lit(""))
    return (F.length(n).between(3, 60)) & ~n.rlike(r"^\d+$") & ~n.rlike(PLACEHOLDER_TITLE)


def not_a_song(path_stem: Column, seconds: Column, title: Column, most: int = 30, names: tuple[str, ...] = ()) -> Column:
    """Why a record is no song, the first reason that holds; null if none does.  ``names``: further patterns of file names that are none."""
    named = path_stem.rlike(NOT_A_SONG_FILE)
    for pattern in names:
        named = named | path_stem.rlike(f"(?i){pattern}")
    return F.when((seconds > 0) & (seconds <= most), "short").when(named, "file name").when((title != "") & title.rlike(NOT_A_SONG_TITLE), "title")


def is_invented(transcript: Column, least: int = 20) -> Column:
    """Whether a transcript is what a speech model writes for silence: too short, or thanks over and over."""
    t = F.trim(F.coalesce(transcript, F.lit("")))
    return (F.length(t) < least) | t.rlike(r"(?i)^(Thank you\.?\s*)+$")


def allowed_only(values: Column, allowed: tuple[str, ...]) -> Column:
    """The values of an array that are in a fixed list, in their order; an empty array for null."""
    return F.coalesce(F.filter(values, lambda v: v.isin(*allowed)), F.array().cast("array<string>"))


def allowed_or_blank(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(value.isin(*allowed), value).otherwise("")


def is_live(title: Column) -> Column:
    return F.coalesce(title.rlike(LIVE), F.lit(False))


def is_instrumental(title: Column, theme: Column, summary: Column) -> Column:
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(title, F.lit("")).rlike(INSTRUMENTAL) | (low(theme) == "instrumental") | low(summary).startswith("instrumental") | low(summary).startswith("[instrumental]")


def tagged_theme(comment: Column) -> Column:
    """The theme of a comment such as ``theme | ⚑flag ⚑flag``: the first part without flag, empty if none."""
    return F.coalesce(F.try_element_at(F.filter(F.split(F.coalesce(comment, F.lit("")), r" \| "), lambda p: (p != "") & ~p.startswith("⚑")), F.lit(1)), F.lit(""))


def tagged_flags(comment: Column) -> Column:
    """The flags of such a comment, without those of reputation and song."""
    parts = F.filter(F.split(F.coalesce(comment, F.lit("")), r" \| "), lambda p: p.startswith("⚑") & ~p.startswith("⚑rep:") & ~p.startswith("⚑song:"))
    words = F.filter(F.flatten(F.transform(parts, lambda p: F.split(p, r"\s+"))), lambda w: w.startswith("⚑") & (F.length(w) > 1))
    return F.transform(words, lambda w: F.substring(w, 2, 1 << 30))


def build_comment(theme: Column, flags: Column, reputation: Column, reason: Column, most: int = 60) -> Column:
    """The comment with these parts, empty ones left out and the reason cut after ``most`` signs."""
    short = F.when(F.length(reason) > most, F.concat(F.substring(reason, 1, most), F.lit("…"))).otherwise(reason)
    part = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.concat_ws(" | ", part(theme), part(F.array_join(F.transform(flags, lambda f: F.concat(F.lit("⚑"), f)), " ")), F.concat(F.lit("⚑rep:"), part(reputation)), F.concat(F.lit("⚑song:"), part(short)))


def html_to_text(page: Column) -> Column:
    """Text of an HTML fragment: breaks become line ends, tags go, entities are decoded."""
    t = F.regexp_replace(page, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1>", ""), r"(?s)<[^>]*>", "")
    # Only texts that hold an entity leave the JVM.
    decoded = F.pandas_udf(lambda v: v.map(html.unescape, na_action="ignore"), "string")
    return F.when(t.rlike(r"&[#\w]+;"), decoded(t)).otherwise(t)


def nested_blocks(page: Column, marker: str) -> Column:
    """The inner HTML of each ``div`` whose tag holds ``marker``, joined by line ends; nested divs are kept whole."""
    import re

    tag = re.compile(r"<(/?)div\b[^>]*>", re.I)

    def inner(text: str) -> str:
        out, depth, start = [], 0, 0
        for m in tag.finditer(text):
            if depth:
                depth += -1 if m[1] else 1
                if not depth:
                    out.append(text[start : m.start()])
            elif not m[1] and marker in m[0]:
                depth, start = 1, m.end()
        return "\n".join(out)

    return F.pandas_udf(lambda v: v.map(inner, na_action="ignore"), "string")(page)


LRC = r"^\[(\d+):(\d+\.\d+)\](.*)"


def lrc_lines(lrc: Column) -> Column:
    """The lines of a timed text: array of (ms, text), without lines that have no fraction or no text."""
    rows = F.filter(F.split(lrc, "\n"), lambda line: line.rlike(LRC) & (strip(F.regexp_extract(line, LRC, 3)) != ""))
    return F.transform(rows, lambda line: F.struct(((F.regexp_extract(line, LRC, 1).cast("double") * 60 + F.regexp_extract(line, LRC, 2).cast("double")) * 1000).alias("ms"), strip(F.regexp_extract(line, LRC, 3)).alias("text")))


def estimated_lines(text: Column, duration_ms: Column, vocal_in: Column, vocal_out: Column) -> Column:
    """Lines of an untimed text spread evenly over the sung part, or the whole track."""
    body = F.regexp_replace(text, r"^\d+\s+Contributor[^\n]*\n?", "")
    lines = F.filter(F.transform(F.split(body, "\n"), strip), lambda line: (line != "") & ~line.rlike(r"^\[.*\]$"))
    sung = F.coalesce((vocal_in > 0) & (vocal_out > vocal_in), F.lit(False))
    start = F.when(sung, vocal_in).otherwise(0.0)
    step = (F.when(sung, vocal_out).otherwise(duration_ms) - start) / F.size(lines)
    return F.when((duration_ms > 0) & (F.size(lines) > 0), F.transform(lines, lambda line, i: F.struct((start + i * step).alias("ms"), line.alias("text"))))


def truncated(text: Column, most: int = 3000, mark: str = "\n[truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def fenced_json(reply: Column, schema: str, required: str) -> Column:
    """A reply parsed as JSON, with or without a code fence; null without the required field."""
    parsed = F.from_json(F.trim(F.regexp_replace(reply, r"(?m)^\s*```[a-z]*\s*$", "")), schema)
    return F.when(F.coalesce(parsed[required].cast("string"), F.lit("")) != "", parsed)


def command(text: Column) -> Column:
    """The struct (action, argument) a typed command means; null if it is none."""
    t = F.lower(F.trim(text))
    number = F.regexp_extract(t, r"^select\s+(\d{1,2})$", 1)
    deck = F.regexp_extract(t, r"^select\s+([ab])$", 1)
    plain = lambda pattern, action: (t.rlike(pattern), F.struct(F.lit(action).alias("action"), F.lit("").alias("argument")))
    out = None
    for test, value in (
        plain(r"^swap\s+decks?$", "swap"),
        plain(r"^save\s+me$", "save"),
        plain(r"^surprise\s+me$", "surprise"),
        plain(r"^open\s+setlist$", "setlist"),
        plain(r"^open\s+show$", "show"),
        (number != "", F.struct(F.lit("select").alias("action"), number.alias("argument"))),
        (deck != "", F.struct(F.lit("load").alias("action"), deck.alias("argument"))),
    ):
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def minutes(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), F.pmod(F.floor(seconds), F.lit(60)).cast("int"))
