"""Suggestions: which tracks go with an anchor, and which lead to another genre.

A score depends on a few properties of both tracks (tempo, key, genre, theme,
stars), so classes of equal properties are scored instead of pairs of tracks.
Of a class only the best tracks of the ``n`` + 1 best artists can appear in a
list of ``n`` that leaves out the anchor's own artist; this bound is applied to
the tracks of a class, then for each tempo asked for, then for each class of
anchors.  So the work grows with the number of classes and not with tracks x
anchors, and no side needs to be small.  Score and track number are packed into
one long, so each step is a hash aggregate on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cratewright.functions import harmonic, keys
from cratewright.functions.lookups import CORE_GENRES, FLOOR_GENRES, NEIGHBOURS, SHOW_GENRES, THEME_CLUSTERS, theme_pairs, two_steps
from cratewright.operators.rank import numbered
from cratewright.session import cut

FEW = 100_000  # rows that are sent to every task; more are joined by exchange
TRACK = ("idx", "path", "artist", "title", "genre", "bpm", "key", "stars", "theme")
GENRES = tuple(sorted(NEIGHBOURS))
THEMES = tuple(sorted({t for c in THEME_CLUSTERS for t in c} | {"surreal"}))
IDX_BITS = 40  # of a packed score: millionths above, tracks in order below


def _number(value: Column, names: tuple[str, ...]) -> Column:
    """The place of a value in a list, from 0; null if it is not in it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), value), F.lit(0).cast("bigint")).cast("int") - 1


def _numbered_tracks(tracks: DataFrame) -> DataFrame:
    """The tracks with ``pos``, their order by idx as a number that fits a packed score: idx itself, or a dense number where it is too large."""
    low, high = tracks.agg(F.min("idx"), F.max("idx")).first()
    if low is None or (low >= 0 and high < 1 << IDX_BITS):
        return tracks.withColumn("pos", F.col("idx").cast("bigint"))
    return numbered(tracks, "idx", "pos")


def _millionths(score: Column) -> Column:
    return F.shiftleft(F.round(score * 1_000_000, 0).cast("bigint"), IDX_BITS)


def _pack(score: Column) -> Column:
    return _millionths(score) + (F.lit((1 << IDX_BITS) - 1) - F.col("pos"))


def _score_of(packed: Column) -> Column:
    return F.shiftright(packed, IDX_BITS) / 1_000_000


def _pos_of(packed: Column) -> Column:
    return F.lit((1 << IDX_BITS) - 1) - packed.bitwiseAND(F.lit((1 << IDX_BITS) - 1))


def _small(df: DataFrame) -> DataFrame:
    """Marked to be sent to every task if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _parts(spark: SparkSession) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _row(names: tuple[str, ...], pairs: list[tuple[str, str, float]], other: float, value: Column) -> Column:
    """The scores of a value with all names, as an array; null for a value that is no name."""
    known = {(a, b): w for a, b, w in pairs}
    rows = ((F.lit(a), F.array(*(F.lit(known.get((a, b), other)) for b in names))) for a in names)
    return F.try_element_at(F.create_map(*(x for r in rows for x in r)), value)


def _prepared(tracks: DataFrame, show: tuple[str, ...] | None = None, played: DataFrame | None = None) -> DataFrame:
    """What a score needs of a track."""
    t = tracks.where(F.col("genre").isin(*show)) if show is not None else tracks
    t = t.select(
        "pos",
        F.coalesce("genre", F.lit("")).alias("genre"),
        F.col("bpm").cast("double").alias("bpm"),
        "stars",
        keys.low(F.col("artist")).alias("who"),
        harmonic.key_number(F.col("key")).alias("kn"),
        F.substring(F.trim("key"), -1, 1).alias("kl"),
        F.coalesce("theme", F.lit("")).alias("theme"),
    )
    return t.join(played.select(keys.low(F.col("artist")).alias("who")).distinct(), "who", "left_anti") if played is not None else t


GROUP = ("kn", "kl", "genre", "theme")  # what a track's score depends on besides tempo and stars


def _best(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, who, packed): the best packed row of each artist, for the ``n`` best artists of each group."""
    one = rows.groupBy(*by, "who").agg(F.max("packed").alias("packed"))
    w = Window.partitionBy(*by).orderBy(F.desc("packed"))
    return one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def _by_tempo(tracks: DataFrame, tempos: DataFrame, weight: float, stars: float, n: int) -> DataFrame:
    """(a_bpm, group, who, packed): for each tempo asked for, the best tracks of each group by tempo and stars."""
    own = _best(tracks.withColumn("packed", _pack(stars * F.coalesce("stars", F.lit(0)) / 5.0)), ["bpm", *GROUP], n)
    # At most n rows per tempo and group are left; the steps below all find them where they are, and on all cores.
    own = own.repartition(_parts(own.sparkSession), *GROUP)
    near = own.join(_small(tempos)).withColumn("packed", F.col("packed") + _millionths(weight * harmonic.bpm_compat(F.col("a_bpm"), F.col("bpm"))))
    # What the later steps look up by genre and theme, once per group.
    return _best(near, ["a_bpm", *GROUP], n).withColumn("gid", _number(F.col("genre"), GENRES)).withColumn("tid", _number(F.col("theme"), THEMES)).withColumn("core", F.when(F.col("genre").isin(*CORE_GENRES), 1.0).otherwise(0.4))


def _asked(anchors: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """What a score needs of an anchor: tempo, key, genre and theme."""
    c = lambda name: F.col(f"{prefix}_{name}")
    return anchors.select(
        *columns,
        F.coalesce(c("genre"), F.lit("")).alias(f"{prefix}_genre"),
        F.coalesce(c("bpm").cast("double"), F.lit(0.0)).alias(f"{prefix}_bpm"),
        keys.low(c("artist")).alias(f"{prefix}_who"),
        F.coalesce(harmonic.key_number(c("key")), F.lit(-1000)).alias(f"{prefix}_kn"),
        F.coalesce(F.substring(F.trim(c("key")), -1, 1), F.lit("")).alias(f"{prefix}_kl"),
        F.coalesce(c("theme"), F.lit("")).alias(f"{prefix}_theme"),
    )


def _key_score(p: str) -> Column:
    known = F.nullif(F.col(f"{p}_kn"), F.lit(-1000))
    return harmonic.key_distance(known, F.col(f"{p}_kl"), F.col("kn"), F.col("kl"))


def _genre_scores(asked: DataFrame, p: str) -> DataFrame:
    """Add the anchor's scores with all genres and themes as arrays."""
    themes = theme_pairs() + [(t, "surreal", 0.5) for t in THEMES] + [("surreal", t, 0.5) for t in THEMES]
    return asked.withColumn(f"{p}_genres", _row(GENRES, two_steps(), 0.05, F.col(f"{p}_genre"))).withColumn(f"{p}_themes", _row(THEMES, themes, 0.0, F.col(f"{p}_theme")))


def _genre_score(p: str) -> Column:
    """Compatibility of the anchor's genre with the track's."""
    mine, its = F.col(f"{p}_genre"), F.col("genre")
    return F.when((mine == "") | (its == ""), 0.3).when(mine == its, 1.0).otherwise(F.coalesce(F.get(F.col(f"{p}_genres"), F.col("gid")), F.lit(0.05)))


def _theme_score(p: str) -> Column:
    mine, its = F.col(f"{p}_theme"), F.col("theme")
    return F.when((mine == "") | (its == ""), 0.0).when(mine == its, 1.0).otherwise(F.coalesce(F.get(F.col(f"{p}_themes"), F.col("tid")), F.when((mine == "surreal") | (its == "surreal"), 0.5).otherwise(0.0)))


def dedup_tracks(tracks: DataFrame, quality: str = "bitrate", order: str = "path") -> DataFrame:
    """One track per song: the best bitrate, then the first."""
    w = Window.partitionBy(keys.song_key(F.col("artist"), F.col("title"))).orderBy(F.desc(quality), order)
    return tracks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _top(best: DataFrame, groups: list[str], n: int) -> DataFrame:
    """The ``n`` best packed rows per group, with place, pos and score."""
    w = Window.partitionBy(*groups).orderBy(F.desc("packed"))
    top = best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return top.withColumn("pos", _pos_of(F.col("packed"))).withColumn("score", _score_of(F.col("packed")))


def lock(tracks: DataFrame, anchors: DataFrame, n: int = 8, show: tuple[str, ...] | None = SHOW_GENRES, played: DataFrame | None = None) -> DataFrame:
    """For each anchor the ``n`` tracks that mix best with it, one per artist and so one per song.

    Result: anchor, place, path, artist, title, genre, score (0 to 1), transition.
    The anchor's own artist (and so its song), played artists and genres outside
    the show are left out; of what remains in the list, scores of 0.1 and less
    go.  Ties go to the track that comes first (idx).
    """
    tracks = _numbered_tracks(tracks)
    asked = _asked(anchors.select(*(F.col(c).alias(f"a_{c}") for c in TRACK)), "a", "a_idx", "a_path", F.col("a_bpm").alias("bpm0"), F.col("a_key").alias("key0"), F.col("a_genre").alias("genre0"))
    of = ["a_bpm", "a_kn", "a_kl", "a_genre", "a_theme"]
    classes = cut(asked.select(*of).distinct())
    near = _by_tempo(_prepared(tracks, show, played), classes.select("a_bpm").distinct(), 0.33, 0.10, n + 1)
    same = F.col("genre") == F.col("a_genre")
    rest = 0.28 * _key_score("a") + 0.17 * F.when(same, 1.0).otherwise(_genre_score("a") * 0.5) + 0.07 * F.col("core") + 0.05 * _theme_score("a")
    pairs = near.join(_small(_genre_scores(classes, "a")), "a_bpm").withColumn("packed", F.col("packed") + _millionths(rest))
    best = _best(pairs, of, n + 1)
    top = _top(asked.join(best, of).where(F.col("who") != F.col("a_who")), ["a_idx"], n).where(F.col("score") > 0.1)
    t = tracks.select("pos", "path", "artist", "title", "genre", "bpm", "key")
    named = harmonic.transition(F.col("bpm0"), F.col("key0"), F.col("genre0"), F.col("bpm"), F.col("key"), F.col("genre"))
    return top.drop("genre", "bpm", "key").join(t, "pos").select(F.col("a_path").alias("anchor"), "place", "path", "artist", "title", "genre", "score", named.alias("transition"))


def destinations(anchors: DataFrame, genres: DataFrame, show: tuple[str, ...] | None = SHOW_GENRES) -> DataFrame:
    """(a_idx, destination): the anchor's neighbour genres within the show, else up to eight others by name."""
    allowed = show if show is not None else CORE_GENRES
    near = [(g, d) for g, ds in NEIGHBOURS.items() for d in ds if d in allowed]
    pairs = anchors.sparkSession.createDataFrame(near, "a_genre string, destination string")
    first = anchors.join(F.broadcast(pairs), "a_genre").select("a_idx", "destination")
    rest = anchors.join(first.select("a_idx").distinct(), "a_idx", "left_anti")
    others = F.broadcast(genres.where(F.col("genre").isin(*allowed)).select(F.col("genre").alias("destination")).distinct())
    w = Window.partitionBy("a_idx").orderBy("destination")
    more = rest.join(others, F.col("a_genre") != F.col("destination")).withColumn("_r", F.row_number().over(w)).where("_r <= 8")
    return first.unionByName(more.select("a_idx", "destination"))


def bridge(tracks: DataFrame, pairs: DataFrame, n: int = 3, show: tuple[str, ...] | None = SHOW_GENRES, played: DataFrame | None = None) -> DataFrame:
    """For each (anchor, second) pair and each destination genre up to ``n`` tracks that lead there.

    ``pairs`` has the columns of two tracks, prefixed a_ and s_.  Result:
    anchor, destination, group_place, place, path, score, transition.  Only the
    last step towards the destination depends on it, and only through the
    track's genre; so the best tracks of each genre are found first for each
    class of pairs, two artists more than asked for, as both own artists are
    left out.
    """
    tracks = _numbered_tracks(tracks)
    second = _asked(pairs, "s", "a_idx", "s_idx", F.col("s_bpm").alias("bpm0"), F.col("s_key").alias("key0"), F.col("s_genre").alias("genre0"), "a_path", F.coalesce("a_theme", F.lit("")).alias("a_theme"), F.coalesce("a_genre", F.lit("")).alias("a_genre"), keys.low(F.col("a_artist")).alias("a_who"))
    of = ["s_bpm", "s_kn", "s_kl", "a_theme"]
    classes = cut(second.select(*of).distinct())
    # The first artists of a group by idx where nothing else tells them apart.
    near = _by_tempo(_prepared(tracks, show, played), classes.select(F.col("s_bpm").alias("a_bpm")).distinct(), 0.235, 0.0, n + 2).withColumnRenamed("a_bpm", "s_bpm")
    rest = 0.235 * _key_score("s") + 0.10 * F.col("core") + 0.05 * _theme_score("a")
    scored = near.join(_small(_genre_scores(classes.withColumn("a_genre", F.lit("")), "a")), "s_bpm").withColumn("packed", F.col("packed") + _millionths(rest))
    best = _best(scored, [*of, "genre"], n + 2)
    own = second.join(best, of).where((F.col("who") != F.col("a_who")) & (F.col("who") != F.col("s_who")))
    dest = destinations(second.select("a_idx", "a_genre"), tracks.select("genre"), show)
    leads = F.when(F.col("genre") == F.col("destination"), 1.0).when(harmonic.genre_compat(F.col("genre"), F.col("destination")) == 0.6, 0.5).otherwise(0.0)
    led = own.join(dest, "a_idx").withColumn("packed", F.col("packed") + _millionths(0.38 * leads)).where(_score_of(F.col("packed")) > 0.25)
    one = led.groupBy("a_idx", "s_idx", "destination", "who").agg(F.max("packed").alias("packed"))
    top = _top(one, ["a_idx", "destination"], n)
    first = F.max(F.bround(F.col("score") * 100, 0)).over(Window.partitionBy("a_idx", "destination"))
    placed = top.withColumn("_best", first).withColumn("group_place", F.dense_rank().over(Window.partitionBy("a_idx").orderBy(F.desc("_best"), "destination")))
    t = tracks.select("pos", "path", "genre", "bpm", "key")
    q = second.select("a_idx", F.col("a_path").alias("anchor"), "bpm0", "key0", "genre0")
    named = harmonic.transition(F.col("bpm0"), F.col("key0"), F.col("genre0"), F.col("bpm"), F.col("key"), F.col("genre"))
    return placed.join(t, "pos").join(q, "a_idx").select("anchor", "destination", "group_place", "place", "path", "score", named.alias("transition"))


def rescue(tracks: DataFrame, anchors: DataFrame, n: int = 5, least_stars: int = 3) -> DataFrame:
    """For each anchor the highest rated tracks near it in tempo and genre: anchor, place, path, score.

    Tracks of equal stars, tempo and genre score alike, so the first ``n`` of
    each such group are enough, and anchors of equal tempo and genre have one
    answer.
    """
    tracks = _numbered_tracks(tracks)
    w = Window.partitionBy("stars", "bpm", "genre").orderBy("pos")
    few = _prepared(tracks.where(F.col("stars") >= least_stars)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r").withColumn("gid", _number(F.col("genre"), GENRES))
    asked = _asked(anchors.select(*(F.col(c).alias(f"a_{c}") for c in TRACK)), "a", "a_idx", "a_path")
    of = ["a_bpm", "a_genre"]
    classes = cut(asked.select(*of).distinct()).withColumn("a_theme", F.lit(""))
    score = 0.4 * F.col("stars") / 5.0 + 0.35 * harmonic.bpm_compat(F.col("a_bpm"), F.col("bpm")) + 0.25 * _genre_score("a")
    top = _top(few.join(_small(_genre_scores(classes, "a"))).select(*of, _pack(score).alias("packed")), of, n).where("score > 0")
    return asked.join(top, of).join(tracks.select("pos", "path"), "pos").select(F.col("a_path").alias("anchor"), "place", "path", "score")


def fallback(tracks: DataFrame, n: int, least_stars: int, spread: float, seed: int = 0) -> DataFrame:
    """What a voice command gets: the best rated tracks of any genre and tempo, shuffled a little within a tier: path, score.

    Saving a set asks for three stars, a spread of 0.1 and five tracks;
    surprising for four stars, 0.25 and twenty.
    """
    noise = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} "), "path")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return tracks.where(F.col("stars") >= least_stars).select("path", F.round(F.col("stars") / 5.0 + noise * spread, 6).alias("score")).orderBy(F.desc("score"), "path").limit(n)


def surprise(tracks: DataFrame, played: DataFrame, n: int = 20, least_stars: int = 3, spread: float = 0.15, seed: int = 0) -> DataFrame:
    """Well rated floor tracks not played yet, shuffled a little within a tier: path, score; the same seed draws the same."""
    noise = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} "), "path")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    good = tracks.where((F.col("stars") >= least_stars) & F.col("genre").isin(*FLOOR_GENRES)).join(played.select("path"), "path", "left_anti")
    return good.select("path", F.round(F.col("stars") / 5.0 + noise * spread, 6).alias("score")).orderBy(F.desc("score"), "path").limit(n)


def search(tracks: DataFrame, words: str, n: int = 30, order: str = "path") -> DataFrame:
    """The first ``n`` tracks whose artist, title or genre holds the text (two signs at least)."""
    q = words.lower().strip()
    if len(q) < 2:
        return tracks.limit(0)
    return tracks.where(F.contains(F.lower(F.concat_ws(" ", "artist", "title", "genre")), F.lit(q))).orderBy(order).limit(n)


def resolve(tracks: DataFrame, artist: str, title: str, order: str = "path") -> DataFrame:
    """The track a deck shows: both fields match (3), one is in the text (2), the title matches (1); the best, then the first."""
    a, t = artist.lower().strip(), title.lower().strip()
    low = F.lower(F.concat_ws(" ", "artist", "title", "genre"))
    has = lambda c, x: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(x)) if x else F.lit(False)
    grade = F.when(has(F.col("title"), t) & has(F.col("artist"), a), 3)
    if a and t:
        grade = grade.when(F.contains(low, F.lit(t)) | F.contains(low, F.lit(a)), 2)
    grade = grade.when(has(F.col("title"), t), 1).otherwise(0)
    return tracks.withColumn("grade", grade).where("grade > 0").orderBy(F.desc("grade"), order).limit(1)
