"""Best representative of each duplicate group.

Every field of the surviving record is chosen on its own: the candidates of a
group are ranked by a window (value or recency first, smallest record id last)
and only the top row is kept.  Spark turns ``row_number() = 1`` into a group
limit before the exchange, so a group that holds a third of all rows reaches its
reducer as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The five star steps, the play-count limit and the date range.
RANKINGS = (51, 102, 153, 204, 255)
PLAYCOUNT_MAX = 9999
FIRST_DAY, LAST_DAY = "2001-01-01", "2026-06-30"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_WHOLE = r"(?U)^\s*\+?0*(\d{1,18})(?:\.0*)?\s*$"
_YMD = r"(?U)^\s*(\d{4})([/-])(\d{1,2})\2(\d{1,2})(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?\s*$"
_DMY = r"(?U)^\s*(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})\s*$"
_COMPACT = r"(?U)^\s*(\d{4})(\d{2})(\d{2})\s*$"
_NAME_FIRST = r"(?U)^\s*([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})\s*$"
_DAY_FIRST = r"(?U)^\s*(\d{1,2})(?:st|nd|rd|th)?[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})\s*$"


def whole_number(text: Column) -> Column:
    """A whole number however it is written (blanks, sign, leading zeros, ``.0``); null if it is none."""
    digits = F.regexp_extract(text, _WHOLE, 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def ranking_value(text: Column) -> Column:
    n = whole_number(text)
    return F.when(n.isin(*RANKINGS), n)


def playcount_value(text: Column) -> Column:
    n = whole_number(text)
    return F.when(n.between(0, PLAYCOUNT_MAX), n)


def calendar_date(text: Column, first: str = FIRST_DAY, last: str = LAST_DAY) -> Column:
    """The calendar date a text names, null if it names none inside ``[first, last]``."""

    def built(pattern: str, y: int, m: int, d: int) -> Column:
        month = F.regexp_extract(text, pattern, m)
        number = F.lpad(month, 2, "0")
        named = F.lower(F.substring(month, 1, 3))
        for i, name in enumerate(MONTHS, 1):
            number = F.when(named == name, F.lit(f"{i:02d}")).otherwise(number)
        day = F.concat_ws("-", F.regexp_extract(text, pattern, y), number, F.lpad(F.regexp_extract(text, pattern, d), 2, "0"))
        return F.when(text.rlike(pattern), day.try_cast("date"))

    day = F.coalesce(built(_YMD, 1, 3, 4), built(_DMY, 3, 2, 1), built(_COMPACT, 1, 2, 3), built(_NAME_FIRST, 3, 1, 2), built(_DAY_FIRST, 3, 2, 1))
    return F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), day)


FIELDS = ("ranking", "playcount", "last_played")


def members_with_values(members: DataFrame, entries: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """One row per group member that exists, with its valid values, and the columns ``more`` of its entry.

    Repeated members count once; members without entry, and rows whose group or
    entry is null, are left out.  Other columns of either table are ignored, so
    clashing names do no harm.
    """
    m = members.select("group_id", "entry_id").where("group_id is not null and entry_id is not null").distinct()
    e = entries.select(
        "entry_id",
        ranking_value(F.col("ranking")).alias("ranking"),
        playcount_value(F.col("playcount")).alias("playcount"),
        calendar_date(F.col("last_played")).alias("last_played"),
        *(more or []),
    )
    return m.join(e, "entry_id")


def _tops(rows: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """The first candidate of each group and field: by falling weight, then the smallest entry_id."""
    day = F.datediff(F.col("last_played"), F.lit("1970-01-01").cast("date")).cast("bigint")
    none = F.lit(0).cast("bigint")

    def candidate(field: str, order: Column) -> Column:
        return F.struct(F.lit(field).alias("field_name"), F.struct(order.alias("a"), none.alias("b"), none.alias("c")).alias("weight"), F.col(field).cast("string").alias("value"))

    candidates = F.array(
        candidate("ranking", F.coalesce(day, F.lit(-(10**9)).cast("bigint"))),
        candidate("playcount", F.col("playcount")),
        candidate("last_played", day),
        *(more or []),
    )
    long = rows.select("group_id", "entry_id", F.inline(F.filter(candidates, lambda c: c["value"].isNotNull())))
    top = Window.partitionBy("group_id", "field_name").orderBy(F.desc("weight"), F.asc("entry_id"))
    return long.withColumn("_rank", F.row_number().over(top)).where("_rank = 1")


def best_fields(members: DataFrame, entries: DataFrame) -> DataFrame:
    """For each group and field: the member whose value the survivor takes.

    Result: group_id, field_name, entry_id, value (string).  A group without a
    valid value of a field has no row for it; empty tables give an empty result.
    ``playcount``: the greatest; ``last_played``: the latest; ``ranking``: that
    of the entry played last (invalid dates before all dates).  Ties: smallest
    entry_id.
    """
    return _tops(members_with_values(members, entries)).select("group_id", "field_name", "entry_id", "value")


def survivors(members: DataFrame, entries: DataFrame, trusted: Column | None = None) -> DataFrame:
    """One surviving record per group: its base entry and the best value of each field.

    The base entry is the most complete one, then the trusted one (by default a
    path outside a backup folder), then the one imported last, then the smallest
    entry_id.  It is chosen in the same pass as the fields.
    """
    skip = {"entry_id", "cues", "imported_at"}
    filled = [F.when(F.trim(F.col(f"`{c}`")) != "", 1).otherwise(0) for c, t in entries.dtypes if t == "string" and c not in skip]
    trusted = ~F.coalesce(F.lower("loc_dir"), F.lit("")).contains("/:backups/:") if trusted is None else trusted
    more = [sum(filled[1:], filled[0]).alias("_complete"), trusted.cast("int").alias("_trusted"), F.coalesce(F.unix_micros(F.col("imported_at").cast("timestamp")), F.lit(-(1 << 62))).alias("_at")]
    big = lambda c: F.col(c).cast("bigint")
    base = F.struct(F.lit("base").alias("field_name"), F.struct(big("_complete").alias("a"), big("_trusted").alias("b"), big("_at").alias("c")).alias("weight"), F.lit("").alias("value"))
    tops = _tops(members_with_values(members, entries, more), [base])
    of = lambda field, value: F.max(F.when(F.col("field_name") == field, value))
    return tops.groupBy("group_id").agg(
        of("base", F.col("entry_id")).alias("survivor_id"),
        of("base", F.col("weight.a")).cast("int").alias("complete"),
        of("base", F.col("weight.b")).cast("int").alias("trusted"),
        *(of(f, F.col("value")).alias(f) for f in FIELDS),
    )
