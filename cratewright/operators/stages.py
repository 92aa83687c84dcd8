"""Whole stages of a collection's clean-up, each a composition of the operators.

Every stage returns tables: what is kept, what moves, and why.  Nothing is
written or deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewright.functions import keys, paths, text
from cratewright.operators import dedup, joins, normalize


def rebuild(entries: DataFrame, path_map: DataFrame, keep_roots: list[str], refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries kept, references, outcome of every entry).

    entries: (entry_idx, path, sha, richness); entries of one content become the
    richest one, at the first path that is mapped.  Entries whose path is
    neither mapped nor kept are dropped; references follow the entry that
    stayed.  Every entry has exactly one outcome: remap, keep, merged or drop.
    """
    placed = joins.classify_paths(entries, "path", path_map, keep_roots)
    alive = placed.where("outcome <> 'drop'").withColumn("content", F.coalesce("sha", F.concat(F.lit("entry "), F.col("entry_idx").cast("string"))))
    first = alive.groupBy("content").agg(F.min_by("new_path", F.struct(F.when(F.col("outcome") == "remap", 0).otherwise(1).alias("o"), F.col("entry_idx").alias("i"))).alias("target"))
    best = dedup.keep_best(alive, ["content"], [F.desc("richness"), F.asc("entry_idx")]).join(first, "content")
    kept = best.select("entry_idx", "sha", "outcome", F.col("target").alias("path"))
    stays = best.select("content", F.col("entry_idx").alias("best_idx"), "target")
    fate = alive.join(stays, "content").select("entry_idx", "path", "target", F.when(F.col("entry_idx") == F.col("best_idx"), F.col("outcome")).otherwise("merged").alias("outcome"))
    outcomes = fate.select("entry_idx", "outcome").unionByName(placed.where("outcome = 'drop'").select("entry_idx", "outcome"))
    moved = fate.groupBy("path").agg(F.min("target").alias("target"))
    new_refs = refs.join(moved, "path").select("playlist", "pos", F.col("target").alias("path"))
    return kept, new_refs, outcomes


def merge_by_name(groups: DataFrame) -> DataFrame:
    """Content groups of one song merged: (key, sha, winner, loser), loser null where there is none.

    groups: (sha, winner, losers, artist, title, richness, bitrate).  The group
    with the richest, best formatted, most detailed winner outside a backup
    folder and with the shortest path takes the winners and losers of the
    others.  Placeholders and blank names stay alone.
    """
    named = ~text.is_placeholder(F.col("artist"), F.col("title")) & ~keys.low(F.col("artist")).isin("unknown artist", "artist") & (keys.low(F.col("title")) != "")
    key = F.when(named, F.concat(keys.without_article(F.col("artist")), F.lit("\t"), keys.low(F.col("title")))).otherwise(F.concat(F.lit("sha "), F.col("sha")))
    rows = groups.withColumn("key", key)
    order = [F.desc("richness"), F.desc(dedup.format_rank(F.col("winner"))), F.desc("bitrate"), F.desc(dedup.not_backup(F.col("winner"))), F.length("winner"), F.asc("sha")]
    best = dedup.keep_best(rows, ["key"], order).select("key", "sha", "winner")
    members = rows.select("key", F.explode(F.concat(F.array("winner"), F.coalesce("losers", F.array().cast("array<string>")))).alias("path"))
    others = members.join(best.select("key", "winner"), "key").where("path <> winner").select("key", F.col("path").alias("loser")).distinct()
    return best.join(others, "key", "left")


def merge_by_tolerance(tracks: DataFrame, seconds: float = 1.0, bpm: float = 0.5) -> DataFrame:
    """(loser, winner): tracks of one song, key and nearly equal time and tempo, closed over chains.

    tracks: (idx, path, artist, title, any_key, playtime, bpm, richness).  The
    richest wins, then format, length, place outside a backup folder, shortest
    path.
    """
    t = tracks.withColumn("song", F.concat(keys.without_article(F.col("artist")), F.lit("\t"), keys.without_article(F.col("title"))))
    pairs = dedup.band_pairs(t, ["song", "any_key"], "idx", {"playtime": seconds, "bpm": bpm}, hint="playtime")
    groups = dedup.clusters(pairs).withColumnRenamed("node", "idx").join(t, "idx")
    order = [F.desc("richness"), F.desc(dedup.format_rank(F.col("path"))), F.desc("playtime"), F.desc(dedup.not_backup(F.col("path"))), F.length("path"), F.asc("idx")]
    best = dedup.keep_best(groups, ["component"], order).select("component", F.col("path").alias("winner"))
    return groups.join(best, "component").where("path <> winner").select(F.col("path").alias("loser"), "winner").distinct()


def merge_converted(files: DataFrame) -> DataFrame:
    """(path, winner, pass): duplicates of large files in three passes.

    files: (idx, path, artist, title, size, seconds).  1: equal artist and loose
    title, the largest wins.  2: equal loose title and time to five seconds, if
    sizes spread by less than 2 %; one with an artist wins.  3: equal loose
    title, sizes and times nearly equal, greedily in order.  Each pass sees what
    the passes before left.
    """
    f = files.withColumn("t", keys.loose_title(F.col("title"))).withColumn("a", keys.low(F.col("artist"))).where("t <> ''")

    def pass_of(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
        best = dedup.keep_best(rows, by, order).select(*by, F.col("path").alias("winner"))
        return rows.join(best, by).where("path <> winner").select("path", "winner", F.lit(n).alias("pass"))

    one = pass_of(f.where("a <> ''"), ["a", "t"], [F.desc("size"), F.asc("idx")], 1)
    rest = f.join(one.select("path"), "path", "left_anti").withColumn("bucket", F.bround(F.col("seconds") / 5, 0) * 5)
    tight = rest.groupBy("t", "bucket").agg((F.max("size") - F.min("size")).alias("spread"), F.max("size").alias("top")).where("top > 0 and spread / top < 0.02").select("t", "bucket")
    two = pass_of(rest.join(tight, ["t", "bucket"]), ["t", "bucket"], [F.desc(F.when(F.col("a") != "", 1).otherwise(0)), F.desc("size"), F.asc("idx")], 2)
    left = rest.join(two.select("path"), "path", "left_anti")
    stars = dedup.greedy_stars(left, ["t"], "idx", "size", "seconds", "a")
    names = left.select("idx", "path")
    three = stars.join(names.select(F.col("idx").alias("star"), F.col("path").alias("winner")), "star").join(names.select(F.col("idx").alias("member"), "path"), "member").select("path", "winner", F.lit(3).alias("pass"))
    return one.unionByName(two).unionByName(three)


def drop_reasons(rows: DataFrame, least: int = 30, most: int = 720) -> DataFrame:
    """Add ``reason`` why an entry is dropped, the first that holds: no place, too short, too long, live; null if it stays.

    rows: (path, seconds, title).
    """
    reason = F.when(F.coalesce(F.trim("path"), F.lit("")).isin("", "/"), "no place").when(F.col("seconds") < least, "short").when(F.col("seconds") > most, "long").when(text.is_live(F.col("title")), "live")
    return rows.withColumn("reason", reason)


def better_tags(rows: DataFrame) -> DataFrame:
    """Of entries with one content (md5) the one with the longest artist and title; the first of equal ones.  rows: (idx, md5, artist, title)."""
    size = F.length(F.coalesce("artist", F.lit(""))) + F.length(F.coalesce("title", F.lit("")))
    return dedup.keep_best(rows, ["md5"], [F.desc(size), F.asc("idx")])


def sanitize(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Names and categories of a table (idx, artist, title, genre) brought into form.

    Artists are cleaned and "The X" and "X" merged; genres are mapped (all parts,
    split at slash, semicolon and comma) and missing ones inferred from the
    artist's most frequent one.
    """
    clean = rows.withColumn("artist", text.full_artist(F.col("artist")))
    counts = clean.where("artist <> ''").groupBy(F.col("artist").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    merged = normalize.article_merge(counts)
    clean = clean.join(merged.withColumnRenamed("name", "artist"), "artist", "left").withColumn("artist", F.coalesce("canonical", "artist")).drop("canonical")
    mapped = normalize.resolve_category(clean, "genre", mapping, normalize.taxonomy(rows.sparkSession), "[/;,]", whole_first=False)
    mapped = mapped.withColumn("genre", F.col("canonical")).drop("canonical")
    return normalize.infer_from_mode(mapped.withColumn("artist", F.nullif("artist", F.lit(""))), "artist", "genre", "idx")


def snapshot(counts: dict[str, DataFrame], gaps: dict[str, tuple[str, str]]) -> DataFrame:
    """(name, n): the rows of each table and, for each gap, how many the first has more than the second, not below 0."""
    rows = joins.union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in counts.items()])
    if not gaps:
        return rows
    wanted = F.array(*(F.struct(F.lit(g).alias("gap"), F.lit(a).alias("a"), F.lit(b).alias("b")) for g, (a, b) in gaps.items()))
    # One row per table.
    by = rows.agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("m"))
    more = by.select("m", F.inline(wanted)).select(F.col("gap").alias("name"), F.greatest(F.lit(0), F.try_element_at("m", F.col("a")) - F.try_element_at("m", F.col("b"))).cast("bigint").alias("n"))
    return rows.unionByName(more)


def now_playing(shown: DataFrame, tracks: DataFrame, order: str = "idx") -> DataFrame:
    """The first track whose artist and title hold what a deck shows; shown: (deck, artist, title), a row per deck."""
    s = F.broadcast(shown.select("deck", F.lower("artist").alias("_a"), F.lower("title").alias("_t")).distinct())
    hit = tracks.join(s, F.contains(F.lower("artist"), F.col("_a")) & F.contains(F.lower("title"), F.col("_t")))
    return hit.groupBy("deck").agg(F.min_by("path", order).alias("path"))


def recover_with_confidence(titles: DataFrame, ident: str, title: str, known: DataFrame) -> DataFrame:
    """(ident, artist, new_title, confidence): an artist found in a title.

    Known artists (name) are HIGH, others MEDIUM; the side read first as artist
    is preferred within a grade.  Implausible names are not taken.
    """
    rows = titles.where(F.col(title).isNotNull()).select(ident, text.clean_stem(paths.stem(F.col(title))).alias("x"), F.split(paths.stem(F.col(title)), " - ", 2).alias("sides"))
    one = F.struct(F.lit(0).alias("side"), F.col("x.artist").alias("artist"), F.col("x.title").alias("new_title"))
    two = F.struct(F.lit(1).alias("side"), F.trim(F.try_element_at("sides", F.lit(2))).alias("artist"), F.trim(F.try_element_at("sides", F.lit(1))).alias("new_title"))
    both = rows.select(ident, F.inline(F.array(one, two))).where(text.plausible_artist(F.col("artist")))
    names = known.select(F.lower("name").alias("_k")).distinct().withColumn("_known", F.lit(True))
    graded = both.join(names, F.lower("artist") == F.col("_k"), "left").withColumn("rank", F.when(F.col("_known"), 0).otherwise(2) + F.col("side"))
    return graded.groupBy(ident).agg(F.min_by(F.struct("artist", "new_title", F.when(F.col("_known"), "HIGH").otherwise("MEDIUM").alias("confidence")), "rank").alias("x")).select(ident, "x.*")


def consolidate(df: DataFrame, category: str, mapping: DataFrame, canonical: list[str]) -> DataFrame:
    """Categories mapped exactly (raw, canonical); an error if a target is not canonical or a source is."""
    wrong = mapping.where(~F.col("canonical").isin(canonical) | F.col("raw").isin(canonical))
    if not wrong.isEmpty():
        raise ValueError("a consolidation must lead from other categories to canonical ones")
    m = mapping.select(F.col("raw").alias(category), F.col("canonical").alias("_c"))
    return df.join(m, category, "left").withColumn("changed", F.col("_c").isNotNull()).withColumn(category, F.coalesce("_c", category)).drop("_c")


def rename_report(renames: DataFrame, counts: DataFrame) -> DataFrame:
    """(canonical, variants, n_records): by number of records that change; renames: (name, canonical), counts: (name, n)."""
    c = renames.join(counts, "name").groupBy("canonical").agg(F.sort_array(F.collect_set("name")).alias("variants"), F.sum("n").alias("n_records"))
    return c.orderBy(F.desc("n_records"), "canonical")
