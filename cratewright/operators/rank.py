"""Percentile ratings, top-n with diversity, histograms and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewright.functions.lookups import STAR_RANKING

STEPS = (0.2, 0.4, 0.6, 0.8)


def stars(score: Column) -> Column:
    out = F.when(score < STEPS[0], 1)
    for n, s in enumerate(STEPS[1:], 2):
        out = out.when(score < s, n)
    return F.when(score.isNotNull(), out.otherwise(5))


def ranking_of(star: Column) -> Column:
    out = F.lit(0)
    for s, r in STAR_RANKING.items():
        out = F.when(star == s, r).otherwise(out)
    return out


def stars_of(ranking: Column) -> Column:
    """Exact steps only; any other ranking has no star."""
    out = F.lit(0)
    for s, r in STAR_RANKING.items():
        out = F.when(ranking == r, s).otherwise(out)
    return out


def percentiles(df: DataFrame, value: str, out: str, closed: bool = True) -> DataFrame:
    """Add the share of different values below each value, from 0 to 1 (``closed``) or below 1.

    Ranks are given to the different values only.  They are sorted by range in
    parallel and numbered with the sizes of the parts before, so neither the
    rows nor the values pass through one task.  Nulls stay null.
    """
    # Spark sorts the values in range partitions; the position within a part plus the sizes of the parts before is the rank.
    values = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v")).distinct().repartitionByRange("_v")
    from cratewright.session import cut

    parts = cut(values.withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition.
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_v"))).join(F.broadcast(before), "_p").select("_v", (F.col("_r") - 1 + F.col("_before")).alias("_r"), "_all")
    score = F.when(F.col("_all") == 1, F.lit(0.5)).otherwise(F.col("_r") / (F.col("_all") - 1)) if closed else F.col("_r") / F.col("_all")
    return df.join(ranked.select(F.col("_v").alias(value), score.alias(out)), value, "left")


def blend(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, score, stars): the mean of two percentile scores, or the one there is."""
    x = percentiles(a, "value", "_a").select(key, "_a")
    y = percentiles(b, "value", "_b").select(key, "_b")
    score = F.coalesce(0.5 * F.col("_a") + 0.5 * F.col("_b"), F.col("_a"), F.col("_b"))
    return x.join(y, key, "full").select(key, score.alias("score"), stars(score).alias("stars"))


def thresholds(df: DataFrame, value: str, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """(step, value): the value at position int(step * n) of the sorted values."""
    from cratewright.session import cut

    rows = cut(df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v")).repartitionByRange("_v").withColumn("_p", F.spark_partition_id()))
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    at = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"), "_n")
    wanted = at.select("_p", "_before", "_n", F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.floor(F.lit(s) * F.col("_all")).alias("pos")) for s in steps))).alias("w")).where((F.col("w.pos") >= F.col("_before")) & (F.col("w.pos") < F.col("_before") + F.col("_n")))
    placed = rows.join(F.broadcast(wanted.select("_p").distinct()), "_p", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_v")) - 1)
    return placed.join(F.broadcast(wanted), "_p").where(F.col("_r") + F.col("_before") == F.col("w.pos")).select(F.col("w.step").alias("step"), F.col("_v").alias("value"))


def diverse_top(df: DataFrame, groups: list[str], diverse: list[str], score: str, tie: list[str], n: int, least: float | None = None, least_first: bool = False) -> DataFrame:
    """The ``n`` best rows per group, the best one only of each value of ``diverse``, with ``place``.

    ``least`` drops rows of a lower or equal score, before the cut
    (``least_first``) or after it.
    """
    order = [F.desc(score), *map(F.asc, tie)]
    if least is not None and least_first:
        df = df.where(F.col(score) > least)
    one = df.withColumn("_a", F.row_number().over(Window.partitionBy(*groups, *diverse).orderBy(*order))).where("_a = 1").drop("_a")
    top = one.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("place") <= n)
    return top.where(F.col(score) > least) if least is not None and not least_first else top


def shares(df: DataFrame, by: str) -> DataFrame:
    """(by, n, pct): rows per value and their share of all in percent."""
    c = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


def coverage(df: DataFrame, looked_up: Column, value: Column) -> DataFrame:
    """One row: all, found, empty (looked up, nothing there) and untried."""
    yes, has = F.coalesce(looked_up, F.lit(False)), value.isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(yes & has).alias("found"), F.count_if(yes & ~has).alias("empty"), F.count_if(~yes).alias("untried"))


def most_common(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value, n): the most frequent value of each group; ties go to the one seen first."""
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "_first")
    return c.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(group, value, "n")


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """Add the place of each row, from 0; numbered by range partitions, not in one task."""
    from cratewright.session import cut

    rows = cut(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    n = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.col("_before")
    return rows.join(F.broadcast(before), "_p").withColumn(out, n.cast("bigint")).drop("_p", "_before")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Add ``batch``: rows in order, ``size`` to a batch."""
    return numbered(df, order, "_n").withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")


def placed(df: DataFrame, keys: list[str], order: list[Column | str], out: str) -> DataFrame:
    """Add the place of each row within its key, from 1; rows are sorted by range, so one large key is spread over many tasks."""
    rows = numbered(df.withColumn("_at", F.struct(*keys, *order)), "_at", "_pos").drop("_at")
    starts = rows.groupBy(*keys).agg(F.min("_pos").alias("_start"))
    return rows.join(starts, keys).withColumn(out, (F.col("_pos") - F.col("_start") + 1).cast("int")).drop("_pos", "_start")


def best_of_paths(df: DataFrame, paths: str, scores: DataFrame, out: str) -> DataFrame:
    """Add the greatest score of the paths in an array column, 0 if none has one; scores: (path, score)."""
    wanted = df.select(paths).distinct().withColumn("path", F.explode(paths))
    best = wanted.join(scores.select("path", "score"), "path").groupBy(paths).agg(F.max("score").alias(out))
    return df.join(best, paths, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """The struct (pct, per_second, eta_s) of a job: share done to one decimal, rows a second, seconds to go; null rate before anything is done."""
    rate = F.when((seconds > 0) & (done > 0), done / seconds)
    return F.struct(F.bround(F.when(total > 0, done * 100.0 / total).otherwise(0.0), 1).alias("pct"), F.bround(rate, 2).alias("per_second"), F.bround((total - done) / rate, 0).alias("eta_s"))
