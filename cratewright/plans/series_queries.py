"""Queries over ordered series: the events table, play history and beat grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewright.functions import grid
from cratewright.operators import joins, series
from cratewright.plans.registry import query
from cratewright.session import table


def steps(spark: SparkSession, d: str) -> DataFrame:
    """The events of each user as a series; i counts from 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("i", F.row_number().over(w) - 1)


_S = "s AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i FROM events)"


@query(f"""
WITH {_S}, l AS (SELECT user_id, quantile_cont(value, 0.75) AS level FROM events GROUP BY user_id),
m AS (SELECT user_id, i, avg(value) OVER w AS mean, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT user_id, min(i) AS i FROM m JOIN l USING (user_id) WHERE n = 4 AND mean >= level GROUP BY user_id
""")
def sliding_first_above(spark: SparkSession, d: str) -> DataFrame:
    return series.first_above_mean(steps(spark, d), "user_id", "i", "value")


@query(f"""
WITH {_S}, m AS (SELECT user_id, i, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM s)
SELECT user_id, min(i) AS i FROM m WHERE n = 3 GROUP BY user_id
""")
def sustained_run(spark: SparkSession, d: str) -> DataFrame:
    return series.first_sustained(steps(spark, d), "user_id", "i", "value", F.lit(50.0), 3)


_ISLANDS = f"""
WITH {_S}, a AS (SELECT user_id, i, CASE WHEN value < 40 THEN 1 ELSE 0 END AS low FROM s),
b AS (SELECT *, CASE WHEN low <> coalesce(lag(low) OVER (PARTITION BY user_id ORDER BY i), -1) THEN 1 ELSE 0 END AS new, lead(low) OVER (PARTITION BY user_id ORDER BY i) AS nxt FROM a),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM b),
r AS (SELECT user_id, min(i) AS start, max(i) AS stop, count(*) AS length, bool_or(coalesce(nxt = 0, false)) AS closed FROM c WHERE low = 1 GROUP BY user_id, run)
"""


@query(_ISLANDS + "SELECT user_id, start, length FROM r WHERE closed AND length >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) = 1")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return series.longest_run(steps(spark, d), "user_id", "i", F.col("value") < 40, 2)


@query(_ISLANDS + "SELECT user_id, start, stop, length, closed FROM r")
def low_islands(spark: SparkSession, d: str) -> DataFrame:
    return series.islands(steps(spark, d), "user_id", "i", F.col("value") < 40)


@query(f"WITH {_S} SELECT user_id, max(i) AS i FROM s WHERE value > 100 GROUP BY user_id")
def last_above(spark: SparkSession, d: str) -> DataFrame:
    return series.last_above(steps(spark, d), "user_id", "i", "value", 100.0)


@query(f"""
WITH {_S}, e AS (SELECT user_id, event_id, event_type = 'purchase' AS on_, coalesce(lag(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS before FROM s)
SELECT user_id, event_id FROM e WHERE on_ AND NOT before
""")
def edge_detect(spark: SparkSession, d: str) -> DataFrame:
    return series.edges(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("user_id", "event_id")


@query("""
WITH g AS (SELECT user_id, ts AS start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS stop FROM events)
SELECT user_id, start, stop, (epoch_us(stop) - epoch_us(start)) / 1e6 AS seconds FROM g WHERE stop IS NOT NULL AND epoch_us(stop) - epoch_us(start) >= 43200000000
""")
def solo_interval(spark: SparkSession, d: str) -> DataFrame:
    # Twelve hours stand for the 140 seconds of a deck, as events are hours apart.
    return series.gaps_of_at_least(table(spark, d, "events"), "user_id", "ts", 43200)


@query("SELECT user_id, epoch_us(ts) // 3600000000 * 3600000000 AS window_start, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY ALL")
def tumbling_last(spark: SparkSession, d: str) -> DataFrame:
    return series.last_per_window(table(spark, d, "events"), "user_id", "ts", 3600, "event_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window(spark: SparkSession, d: str) -> DataFrame:
    return series.rate(table(spark, d, "events"), "user_id", "ts", 21600).select("event_id", "in_window")


@query("""
WITH a AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 43200000000 THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM a)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM b GROUP BY ALL
""")
def session_gaps(spark: SparkSession, d: str) -> DataFrame:
    return series.sessions(table(spark, d, "events"), "user_id", "ts", 43200)


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'signup'), m AS (SELECT user_id, ts, max(event_id) AS mark FROM events WHERE event_type = 'signup' GROUP BY user_id, ts)
SELECT p.event_id, p.user_id, m.mark FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.ts >= m.ts
""")
def asof_mark(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    marks = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("mark"))
    return joins.as_of(e.where("event_type <> 'signup'").select("event_id", "user_id", "ts"), marks, ["user_id"], "ts", "ts", "mark").select("event_id", "user_id", "mark")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, CAST(500 AS DOUBLE) AS p, (l_extendedprice - 120.5::DOUBLE) % 2000::DOUBLE AS m FROM lineitem), b AS (SELECT *, CASE WHEN m < 0 THEN (m + 2000::DOUBLE) % 2000::DOUBLE ELSE m END AS off FROM a)
SELECT l_orderkey, l_linenumber, round(x - off, 3) AS bar_before, round(120.5::DOUBLE + round_even((x - 120.5::DOUBLE) / p, 0) * p, 3) AS nearest, round(x - off + 2000::DOUBLE, 3) AS bar_after FROM b
""")
def grid_snap(spark: SparkSession, d: str) -> DataFrame:
    pos, anchor, p = F.col("l_extendedprice"), F.lit(120.5), F.lit(500.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(grid.bar_before(pos, anchor, p), 3).alias("bar_before"), F.round(grid.snap(pos, anchor, p), 3).alias("nearest"), F.round(grid.bar_after(pos, anchor, p), 3).alias("bar_after"))


_GRID = """
WITH c AS (
  SELECT entry_id, try_cast(trim(bpm) AS DOUBLE) AS bpm, try_cast(trim(playtime_float) AS DOUBLE) AS dur,
    try_cast(list_filter(cues, lambda c: c.hotcue = '-1' OR c.cue_name = 'AutoGrid')[1].start_ms AS DOUBLE) AS anchor FROM nml_entry),
p AS (SELECT *, CASE WHEN bpm > 0 THEN 60000.0 / bpm END AS p FROM c WHERE bpm > 0 AND anchor IS NOT NULL AND dur >= 30),
o AS (SELECT *, anchor + round_even((dur * 1000 - 16 * p - anchor) / p, 0) * p AS outro FROM p)
"""


@query(_GRID + "SELECT entry_id, CAST(CASE WHEN outro > anchor + p THEN 3 ELSE 2 END AS INTEGER) AS n_cues, round(CASE WHEN outro > anchor + p THEN outro END, 3) AS outro_ms FROM o")
def grid_cues(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nml_entry")
    number = lambda c: F.trim(c).try_cast("double")
    cues = F.transform("cues", lambda c: F.struct(c["cue_name"].alias("name"), c["hotcue"].try_cast("int").alias("hotcue"), number(c["start_ms"]).alias("start_ms")))
    made = grid.fast_cues(grid.grid_anchor(cues), number(F.col("bpm")), number(F.col("playtime_float")))
    outro = F.element_at(F.filter(made, lambda c: c["hotcue"] == 7).getField("start_ms"), -1)
    out = e.select("entry_id", made.alias("m")).where("m is not null")
    return out.select("entry_id", F.size("m").alias("n_cues"), F.round(F.try_element_at(F.filter("m", lambda c: c["hotcue"] == 7), F.lit(1))["start_ms"], 3).alias("outro_ms"))


@query("""
SELECT entry_id, CAST((CASE WHEN try_cast(trim(playcount) AS INTEGER) > 0 THEN 1 ELSE 0 END) + 2 * (CASE WHEN try_cast(trim(ranking) AS INTEGER) > 0 THEN 1 ELSE 0 END) + (CASE WHEN trim(last_played) <> '' THEN 1 ELSE 0 END)
  + len(list_filter(cues, lambda c: try_cast(c.hotcue AS INTEGER) <> -1 AND c.cue_name <> 'n.n.')) + least(len(cues), 5) AS INTEGER) AS richness
FROM (SELECT * REPLACE (CASE WHEN regexp_full_match(trim(playcount), '[+-]?[0-9]+') THEN playcount END AS playcount, CASE WHEN regexp_full_match(trim(ranking), '[+-]?[0-9]+') THEN ranking END AS ranking) FROM nml_entry)
""")
def richness_score(spark: SparkSession, d: str) -> DataFrame:
    whole = lambda c: F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("int"))
    cues = F.transform("cues", lambda c: F.struct(c["cue_name"].alias("name"), c["hotcue"].try_cast("int").alias("hotcue")))
    e = table(spark, d, "nml_entry")
    return e.select("entry_id", grid.richness(whole(F.col("playcount")), whole(F.col("ranking")), F.col("last_played"), F.lit(0), cues).alias("richness"))


@query("""
SELECT entry_id, CAST(list_sort(list_distinct(list_transform(list_filter(cues, lambda c: try_cast(c.hotcue AS INTEGER) >= 1), lambda c: try_cast(c.hotcue AS INTEGER)))) AS VARCHAR) AS slots FROM nml_entry
""")
def used_slots(spark: SparkSession, d: str) -> DataFrame:
    cues = F.transform("cues", lambda c: F.struct(c["hotcue"].try_cast("int").alias("hotcue")))
    slots = grid.user_slots(cues)
    return table(spark, d, "nml_entry").select("entry_id", F.concat(F.lit("["), F.array_join(slots.cast("array<string>"), ", "), F.lit("]")).alias("slots"))


@query("SELECT lower(deck) AS deck, entry_id, started_at, min(row_id) AS row_id, count(*) AS n_read FROM history_row WHERE deck IS NOT NULL AND entry_id IS NOT NULL AND started_at IS NOT NULL GROUP BY ALL")
def history_plays(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "history_row").where("deck is not null and entry_id is not null and started_at is not null")
    return h.groupBy(F.lower("deck").alias("deck"), "entry_id", "started_at").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n_read"))


@query("SELECT session_id, lower(deck) AS deck, arg_max(entry_id, {'s': started_at, 'r': row_id}) AS entry_id FROM history_row WHERE deck IS NOT NULL AND entry_id IS NOT NULL AND started_at IS NOT NULL AND session_id IS NOT NULL GROUP BY 1, 2")
def latest_per_deck(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "history_row").where("deck is not null and entry_id is not null and started_at is not null and session_id is not null")
    return h.groupBy("session_id", F.lower("deck").alias("deck")).agg(F.max_by("entry_id", F.struct("started_at", "row_id")).alias("entry_id"))


@query("SELECT event_id, CAST(year(ts) AS VARCHAR) || '/' || CAST(month(ts) AS VARCHAR) || '/' || CAST(day(ts) AS VARCHAR) AS day_text, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS second_of_day FROM events")
def event_clock(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.concat_ws("/", F.year("ts"), F.month("ts"), F.dayofmonth("ts")).alias("day_text"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("second_of_day"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""
WITH f AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, CAST(min(i) AS INTEGER) AS i FROM f WHERE v > 0.1 GROUP BY vec_id
""")
def first_frame_above(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return f.where(F.col("v") > F.lit(0.1)).groupBy("vec_id").agg(F.min("i").alias("i"))


@query(f"""
WITH n AS (SELECT user_id, ts, event_id, event_type, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS night, CAST(value AS INTEGER) // 20 AS path FROM events),
f AS (SELECT user_id, night, path, min({{'t': ts, 'e': event_id}}) AS first_at FROM n WHERE event_type <> 'signup' AND path IS NOT NULL GROUP BY ALL)
SELECT user_id, night, CAST(row_number() OVER (PARTITION BY user_id, night ORDER BY first_at) AS INTEGER) AS n, path, first_at.t AS ts, first_at.e AS event_id FROM f
""")
def set_list(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("path", F.floor(F.bround("value", 0) / 20).cast("int"))
    return series.set_list(e, "user_id", ["ts", "event_id"], "path", F.col("event_type") == "signup")


@query("""
WITH h AS (SELECT session_id AS file, lower(deck) AS deck, entry_id AS song, started_at, row_id, epoch_us(received_at) // 3600000000 AS read, session_id % 8 * 3600 AS age FROM history_row WHERE session_id IS NOT NULL AND deck IS NOT NULL AND entry_id IS NOT NULL AND started_at IS NOT NULL AND received_at IS NOT NULL),
f AS (SELECT file, min(read) AS first_read FROM h GROUP BY 1), s AS (SELECT file, deck, song, started_at, min(read) AS read FROM h GROUP BY ALL)
SELECT file, read, deck, song, started_at FROM s JOIN f USING (file) WHERE read > first_read
UNION ALL SELECT file, read, deck, arg_max({'a': song, 'b': started_at}, row_id).a, arg_max({'a': song, 'b': started_at}, row_id).b FROM h JOIN f USING (file) WHERE read = first_read AND age < 14400 GROUP BY file, read, deck
""")
def history_tail(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "history_row").where("session_id is not null and deck is not null and entry_id is not null and started_at is not null and received_at is not null")
    read = F.floor(F.unix_micros(F.col("received_at").cast("timestamp")) / 3_600_000_000).cast("bigint")
    rows = h.select(F.col("session_id").alias("file"), read.alias("read"), F.lower("deck").alias("deck"), F.col("entry_id").alias("song"), "started_at", "row_id", (F.col("session_id") % 8 * 3600).alias("age"))
    return series.history_tail(rows, "file", "read", "deck", "song", "started_at", "row_id", "age")


@query("""
WITH f AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
z AS (SELECT vec_id, count(*) AS n, median(abs(v)) FILTER (WHERE i < 6) AS base, quantile_cont(abs(v), 0.4) AS p40 FROM f GROUP BY 1),
b AS (SELECT z.vec_id, t.b, least(CAST(ceil((0.25 + t.b * 0.5) / 0.75) AS BIGINT), z.n - 1) AS i FROM z, (SELECT unnest(range(96)) AS b) t),
h AS (SELECT b.vec_id, b.b, f.v FROM b JOIN f ON f.vec_id = b.vec_id AND f.i = b.i), l AS (SELECT vec_id, quantile_cont(v, 0.75) AS level FROM h GROUP BY 1),
w AS (SELECT vec_id, b, avg(v) OVER x AS mean, count(*) OVER x AS k FROM h WHERE b >= 4 AND b < 36 WINDOW x AS (PARTITION BY vec_id ORDER BY b ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
d AS (SELECT vec_id, min(b) AS b FROM w JOIN l USING (vec_id) WHERE k = 4 AND mean >= level GROUP BY 1),
s AS (SELECT f.vec_id, i, sum(CASE WHEN abs(v) >= greatest(base * 3, p40) THEN 1 ELSE 0 END) OVER (PARTITION BY f.vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS a FROM f JOIN z USING (vec_id) WHERE i >= 5),
u AS (SELECT vec_id, min(i) * 0.75 AS s FROM s WHERE a = 10 GROUP BY 1)
SELECT vec_id AS path, 0 AS slot, 'Load' AS name, 3 AS type, 100.0::DOUBLE AS start_ms, 0.0::DOUBLE AS len_ms FROM z UNION ALL SELECT vec_id, 1, 'Fade In', 1, 250, 0 FROM z UNION ALL SELECT vec_id, 7, 'Outro', 2, 250 + round_even((40000 - 250) / 500.0, 0) * 500, 0 FROM z
UNION ALL SELECT vec_id, 3, 'Drop', 5, 250 + round_even(b * 500 / 2000.0, 0) * 2000, 2000 FROM d UNION ALL SELECT vec_id, 2, 'Vocal', 0, 250 + round_even((s * 1000 - 250) / 500.0, 0) * 500, 0 FROM u WHERE s > 0.75
""")
def track_cues(spark: SparkSession, d: str) -> DataFrame:
    # Vectors stand for the frames of an audio front end.
    f = table(spark, d, "embeddings").select(F.col("vec_id").alias("path"), F.posexplode("embedding").alias("i", "v")).select("path", "i", F.col("v").cast("double").alias("onset"), F.abs("v").cast("double").alias("voice"))
    t = f.select("path").distinct().select("path", F.lit(250.0).alias("anchor_ms"), F.lit(120.0).alias("bpm"), F.lit(100.0).alias("first_sound_ms"))
    return series.track_cues(t, f, 0.75)
