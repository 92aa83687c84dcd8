"""Table functions for SQL, as SQL expressions: timed lines, lines of an untimed text, and the names a file may stand for."""

from __future__ import annotations

from pyspark.sql import SparkSession

_TIME = r"'^\\[(\\d+):(\\d+\\.\\d+)\\](.*)'"
_DASH = r"'^(.+?)\\s*[-–—]\\s*(.+)$'"

FUNCTIONS = (
    f"""lrc_lines(t STRING) RETURNS TABLE(ms DOUBLE, text STRING)
    RETURN SELECT (CAST(regexp_extract(line, {_TIME}, 1) AS DOUBLE) * 60 + CAST(regexp_extract(line, {_TIME}, 2) AS DOUBLE)) * 1000, trim(regexp_extract(line, {_TIME}, 3))
    FROM explode(filter(split(t, '\n'), x -> x RLIKE {_TIME} AND trim(regexp_extract(x, {_TIME}, 3)) <> '')) AS l(line)""",
    r"""estimated_lines(t STRING, duration_ms DOUBLE) RETURNS TABLE(ms DOUBLE, text STRING)
    RETURN SELECT pos * duration_ms / n, line
    FROM (SELECT filter(transform(split(regexp_replace(t, '^\d+\s+Contributor[^\n]*\n?', ''), '\n'), x -> trim(x)), x -> x <> '' AND NOT x RLIKE '^\[.*\]$') AS ls) AS b,
    LATERAL (SELECT size(b.ls) AS n) AS c, LATERAL posexplode(b.ls) AS l(pos, line)""",
    f"""name_candidates(stem STRING) RETURNS TABLE(artist STRING, title STRING)
    RETURN SELECT x.artist, x.title FROM explode(CASE WHEN stem RLIKE {_DASH} THEN array(named_struct('artist', trim(regexp_extract(stem, {_DASH}, 1)), 'title', trim(regexp_extract(stem, {_DASH}, 2))),
      named_struct('artist', trim(regexp_extract(stem, {_DASH}, 2)), 'title', trim(regexp_extract(stem, {_DASH}, 1)))) WHEN stem <> '' THEN array(named_struct('artist', '', 'title', trim(stem))) END) AS l(x)""",
)


def register(spark: SparkSession) -> None:
    """Make lrc_lines, estimated_lines and name_candidates callable from SQL."""
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
