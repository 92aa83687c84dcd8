"""Enrichment and referential joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_with_fallback(df: DataFrame, lookup: DataFrame, keys: list[str], lookup_key: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the lookup's value under the first of ``keys`` that has one.

    The lookup is reduced to one value per key first, so no row is multiplied.
    """
    one = lookup.where(F.col(lookup_key).isNotNull()).groupBy(F.col(lookup_key).alias("_k")).agg(F.min(value).alias("_v"))
    for i, k in enumerate(keys):
        df = df.join(one.select(F.col("_k").alias(k), F.col("_v").alias(f"_v{i}")), k, "left")
    return df.withColumn(out, F.coalesce(*(F.col(f"_v{i}") for i in range(len(keys))))).drop(*(f"_v{i}" for i in range(len(keys))))


def classify_paths(df: DataFrame, path: str, path_map: DataFrame, keep_roots: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Add outcome (remap, keep, drop) and new_path: mapped paths move, those below ``keep_roots`` or that exist stay."""
    from cratewright.functions.paths import under_any

    out = df.join(path_map.select(F.col("old_path").alias(path), "new_path"), path, "left")
    there = under_any(F.col(path), keep_roots)
    if existing is not None:
        out = out.join(existing.select(F.col("path").alias(path)).distinct().withColumn("_e", F.lit(True)), path, "left")
        there = there | F.coalesce("_e", F.lit(False))
    out = out.withColumn("outcome", F.when(F.col("new_path").isNotNull(), "remap").when(there, "keep").otherwise("drop"))
    return out.withColumn("new_path", F.when(F.col("outcome") == "keep", F.col(path)).otherwise(F.col("new_path"))).drop("_e")


def redirect(refs: DataFrame, key: str, moved: DataFrame) -> DataFrame:
    """References follow (old, new); those that did not move stay."""
    m = moved.select(F.col("old").alias(key), F.col("new").alias("_new"))
    return refs.join(m, key, "left").withColumn("target", F.coalesce("_new", F.col(key))).drop("_new")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def todo(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose key was never looked up; a cached null counts as looked up."""
    return df.join(cache.select(key), key, "left_anti")


def gaps(df: DataFrame, cache: DataFrame, key: str, value: str, skip: Column) -> DataFrame:
    """Rows whose cached value is missing or null and that are not to be skipped."""
    return df.join(cache.select(key, F.col(value).alias("_v")), key, "left").where(F.col("_v").isNull() & ~skip).drop("_v")


def replace_where(df: DataFrame, updates: DataFrame, key: str, column: str, when: Column | None = None) -> DataFrame:
    """The column updated by key, everywhere or only where the condition holds; other rows stay."""
    u = updates.select(key, F.col(column).alias("_new"))
    ok = F.col("_new").isNotNull() if when is None else F.col("_new").isNotNull() & when
    return df.join(u, key, "left").withColumn(column, F.when(ok, F.col("_new")).otherwise(F.col(column))).drop("_new")


def first_prefix(df: DataFrame, path: str, renames: DataFrame) -> DataFrame:
    """``new_path`` by the rename (pos, old, new) with the smallest pos whose old folder holds the path.

    The folders above each path are joined by equality, so no path is compared
    with every rename.
    """
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = df.select(path).distinct().select(path, F.explode(folders).alias("old"))
    hit = above.join(renames, "old").groupBy(path).agg(F.min_by(F.struct("old", "new"), "pos").alias("_h"))
    return df.join(hit, path, "left").withColumn("new_path", F.when(F.col("_h").isNull(), F.col(path)).otherwise(F.concat("_h.new", F.substr(F.col(path), F.length("_h.old") + 1)))).drop("_h")


def by_path_or_name(df: DataFrame, path: str, tracks: DataFrame, ident: str, order: str) -> DataFrame:
    """The track with this path, else the first with this file name."""
    from cratewright.functions.paths import base_name

    exact = tracks.select(F.col("path").alias(path), F.col(ident).alias("_a"))
    named = tracks.groupBy(base_name(F.col("path")).alias("_name")).agg(F.min_by(ident, order).alias("_b"))
    return df.join(exact, path, "left").withColumn("_name", base_name(F.col(path))).join(named, "_name", "left").withColumn(ident, F.coalesce("_a", "_b")).drop("_a", "_b", "_name")


def fill_from_siblings(df: DataFrame, group: list[str], value: str, order: list[Column]) -> DataFrame:
    """Nulls take the first known value of their group.

    The value is a small aggregate per group, joined back, so no group is
    gathered in one task.
    """
    known = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.min_by(value, F.struct(*order)).alias("_v"))
    return df.join(known, group, "left").withColumn(value, F.coalesce(value, "_v")).drop("_v")


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, start: str, value: str) -> DataFrame:
    """Each point takes the value of the last mark at or before it.

    Both sides are interleaved, sorted by range and carried forward within each
    part; the last value of a key in a part is carried on to the next parts of
    that key, so a key with most of the rows is spread over many tasks.  Of marks
    at one time the greatest value counts.
    """
    from cratewright.session import cut

    p = points.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_row"), F.lit(None).cast(dict(marks.dtypes)[value]).alias("_v"))
    m = marks.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    rows = cut(p.unionByName(m).repartitionByRange(*keys, "_t", "_side").withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p", *keys).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    # One row per key and part; a key has as many as parts it spans.
    ends = rows.groupBy(*keys, "_p").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t", "_side", "_v"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).where("_carried is not null").select(*keys, "_p", "_carried")
    both = inner.where("_side = 1").join(carried, [*keys, "_p"], "left")
    return both.select("_row.*", F.coalesce("_last", "_carried").alias(value))


def hits_and_misses(df: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key was looked up, rows whose key was not)."""
    return df.join(cache.select(key), key, "left_semi"), df.join(cache.select(key), key, "left_anti")


def flagged(df: DataFrame, known: DataFrame, key: str, flag: str) -> DataFrame:
    """Add whether the row's key is in another table; no row is multiplied."""
    return df.join(known.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(old, new): two renames one after the other; what only one of them moves is kept."""
    a = first.select("old", F.col("new").alias("_mid"))
    b = second.select(F.col("old").alias("_mid"), F.col("new").alias("_end"))
    both = a.join(b, "_mid", "left").select("old", F.coalesce("_end", "_mid").alias("new"))
    return both.unionByName(second.select("old", "new").join(first.select("old"), "old", "left_anti"))


def transplant(df: DataFrame, donors: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A whole column (such as an array of cues) taken from the donor with the same key where there is one; ``transplanted`` tells where."""
    d = donors.select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    out = df.join(d, keys, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column)))
    return out.withColumn("transplanted", F.coalesce("_hit", F.lit(False))).drop("_new", "_hit")


def overwritten(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """One row: how many rows an update would write, how many of these had a value before, and how many it leaves alone."""
    u = updates.where(F.coalesce(F.col(column), F.lit("")) != "").select(key).distinct().withColumn("_u", F.lit(True))
    hit, had = F.coalesce(F.col("_u"), F.lit(False)), F.coalesce(F.trim(F.col(column)), F.lit("")) != ""
    return df.join(u, key, "left").agg(F.count_if(hit).alias("written"), F.count_if(hit & had).alias("already"), F.count_if(~hit).alias("skipped"))


def only_missing(index: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """An index with the entries of another one that it lacks; its own are never replaced."""
    return index.unionByName(found.select(*index.columns).join(index.select(key), key, "left_anti"))


def set_change(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): what came and what went between two sets."""
    b, a = before.select(key).distinct().withColumn("_b", F.lit(1)), after.select(key).distinct().withColumn("_a", F.lit(1))
    return b.join(a, key, "full").where("_a is null or _b is null").select(key, F.when(F.col("_b").isNull(), "came").otherwise("went").alias("change"))


def first_of_sources(df: DataFrame, sources: list[tuple[str, Column, Column]], field: str) -> DataFrame:
    """Add the field and ``source``: the first source (name, condition, value) whose condition holds and whose value is not blank."""
    value, source = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, ok, v in reversed(sources):
        good = F.coalesce(ok, F.lit(False)) & (F.coalesce(F.trim(v.cast("string")), F.lit("")) != "")
        value, source = F.when(good, v).otherwise(value), F.when(good, F.lit(name)).otherwise(source)
    return df.withColumn(field, value).withColumn("source", source)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
