"""The song keys: which records count as the same song under which rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each key removes from a title.
LAST_BRACKET = r"\s*[\(\[].{0,40}[\)\]]\s*$"
ALL_BRACKETS = r"\s*[\(\[][^)\]]*[\)\]]"
FROM_BRACKET = r"(?s)\s*[\(\[].*"
LAST_PARENTHESIS = r"\s*\([^)]*\)\s*$"


AROUND = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(text: Column) -> Column:
    """Without white space of any kind on either side."""
    return F.regexp_replace(text, AROUND, "")


def low(text: Column) -> Column:
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def song_key(artist: Column, title: Column) -> Column:
    """Artist and title in lower case, trimmed."""
    return F.concat(low(artist), F.lit("\t"), low(title))


def version_key(artist: Column, title: Column) -> Column:
    """The same without one bracket of up to 40 signs at the end of the title."""
    return F.concat(low(artist), F.lit("\t"), low(F.regexp_replace(F.coalesce(title, F.lit("")), LAST_BRACKET, "")))


def bare_key(artist: Column, title: Column) -> Column:
    """Without all brackets of the title."""
    return F.concat(low(artist), F.lit("\t"), low(F.regexp_replace(F.coalesce(title, F.lit("")), ALL_BRACKETS, "")))


def cut_key(artist: Column, title: Column) -> Column:
    """The title up to its first bracket."""
    return F.concat(low(artist), F.lit("\t"), low(F.regexp_replace(F.coalesce(title, F.lit("")), FROM_BRACKET, "")))


def base_key(artist: Column, title: Column) -> Column:
    """Without a parenthesis at the end of the title: the fallback key of lookups."""
    return F.concat(low(artist), F.lit("\t"), low(F.regexp_replace(F.coalesce(title, F.lit("")), LAST_PARENTHESIS, "")))


def without_article(text: Column) -> Column:
    """Lower case, trimmed, without one leading "the", "a" or "an"."""
    return F.regexp_replace(low(text), "^(the|a|an) ", "")


def loose_title(title: Column) -> Column:
    """Without track number, artist after a dash, closing number and punctuation."""
    t = low(title)
    for pattern, by in ((r"^\d{1,3}\s*[-.]?\s*", ""), (r"(?U)\s+-\s+\w[\w\s]*$", ""), (r"\s+\d+$", ""), (r"(?U)[^\w\s]", " "), (r"(?U)\s+", " ")):
        t = F.trim(F.regexp_replace(t, pattern, by))
    return t


def loose_name(name: Column) -> Column:
    """Lower case without leading article and punctuation, single blanks."""
    t = F.lower(F.coalesce(name, F.lit("")))
    for pattern, by in ((r"^(the|a|an)\s+", ""), (r"(?U)[^\w\s]", ""), (r"(?U)\s+", " ")):
        t = F.regexp_replace(t, pattern, by)
    return F.trim(t)
