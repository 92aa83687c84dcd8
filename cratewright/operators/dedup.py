"""Keep-best deduplication, tolerance clusters and variants of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewright.functions import paths
from cratewright.functions.lookups import FORMAT_RANK
from cratewright.operators.graph import components
from cratewright.operators.rank import placed
from cratewright.session import cut, release


def format_rank(path: Column) -> Column:
    ext = paths.extension(path)
    out = F.lit(0)
    for e, r in FORMAT_RANK.items():
        out = F.when(ext == e, r).otherwise(out)
    return out


def not_backup(path: Column) -> Column:
    return F.when(path.contains("/Backups/") | path.contains("/backups/"), 0).otherwise(1)


def keep_best(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order; ``order`` must end with a unique column.

    Spark limits each group before the exchange, so large groups do no harm.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def losers(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows but the first of each group; they are told by the first row itself, so no group is sorted in one task."""
    best = keep_best(df, keys, order).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*df.columns).alias("_winner"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(best, same).where(~F.struct(*df.columns).eqNullSafe(F.col("_winner"))).select(df.columns)


def winners_of_losers(df: DataFrame, keys: list[str], order: list[Column], ident: str) -> DataFrame:
    """(keys, winner, loser): a row for each row but the first of its group; lists of any length stay rows."""
    best = keep_best(df, keys, order).select(*keys, F.col(ident).alias("winner"))
    return df.select(*keys, F.col(ident).alias("loser")).join(best, keys).where("loser <> winner").select(*keys, "winner", "loser")


def band_pairs(df: DataFrame, keys: list[str], ident: str, bands: dict[str, float], hint: str | None = None) -> DataFrame:
    """Pairs (a, b), a < b, with equal keys and each band column within its tolerance.

    With ``hint`` (one of the bands) the join also runs on that column's bucket
    and its two neighbours, so large groups of equal keys are split.
    """
    cols = [*keys, ident, *bands]
    left, right = df.select(*cols), df.select(*cols)
    if hint:
        bucket = F.floor(F.col(hint) / bands[hint])
        left = left.withColumn("_b", bucket)
        right = right.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
        keys = [*keys, "_b"]
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= t for c, t in bands.items()]
    return a.join(b, [*on, *near, F.col(f"a.{ident}") < F.col(f"b.{ident}")]).select(F.col(f"a.{ident}").alias("a"), F.col(f"b.{ident}").alias("b"))


def clusters(pairs: DataFrame) -> DataFrame:
    """(node, component) of the transitive closure of pairs (a, b)."""
    return components(pairs, "a", "b")


def bucket_dedup(df: DataFrame, keys: list[str], value: str, step: float, order: list[Column]) -> DataFrame:
    """One row per key and value bucket (nearest multiple of ``step``, halves to even)."""
    return keep_best(df.withColumn("bucket", F.bround(F.col(value) / step, 0) * step), [*keys, "bucket"], order)


SMALL_COMPONENT = 50_000  # pairs that one task may hold


def greedy_stars(df: DataFrame, keys: list[str], ident: str, size: str, seconds: str, artist: str, ratio: float = 0.01, most: float = 2.0) -> DataFrame:
    """(star, member): in order of id, each free row takes all later free rows that match it.

    A match: sizes differ by less than ``ratio`` of the larger, times by at most
    ``most`` seconds, artists equal or one blank.
    """
    cols = [*keys, ident, size, seconds, artist]
    rows = df.select(*cols)
    bucket = F.floor(F.col(seconds) / most)
    a = rows.withColumn("_b", bucket).alias("a")
    b = rows.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).alias("b")
    x, y = F.col(f"a.{size}"), F.col(f"b.{size}")
    same = (F.col(f"a.{artist}") == F.col(f"b.{artist}")) | (F.col(f"a.{artist}") == "") | (F.col(f"b.{artist}") == "")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_b"]]
    pairs = a.join(b, [*on, F.col(f"a.{ident}") < F.col(f"b.{ident}"), F.abs(x - y) < ratio * F.greatest(x, y), F.abs(F.col(f"a.{seconds}") - F.col(f"b.{seconds}")) <= most, same])
    return first_stars(pairs.select(F.col(f"a.{ident}").cast("bigint").alias("a"), F.col(f"b.{ident}").cast("bigint").alias("b")))


def first_stars(pairs: DataFrame, small: int = SMALL_COMPONENT) -> DataFrame:
    """(star, member) of pairs (a, b), a < b: a row is a star unless an earlier star matches it; a member goes to its first star.

    Components of up to ``small`` pairs are settled each in one task.  Larger
    ones are settled in rounds over all rows: a row with no open earlier match
    is a star, rows matched by a star are taken, and both leave.
    """
    pairs = cut(pairs.distinct())
    of = clusters(pairs).select(F.col("node").alias("a"), "component")
    tagged = pairs.join(of, "a")
    sizes = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    tagged = tagged.join(sizes, "component")

    def settle(pdf):
        import pandas as pd

        near = pdf.groupby("a")["b"].apply(list).to_dict()
        taken: set[int] = set()
        stars = []
        for n in sorted(near):
            if n not in taken:
                stars.append(n)
                taken.update(near[n])
        return pd.DataFrame({"star": stars}, dtype="int64")

    stars = tagged.where(F.col("n") <= small).groupBy("component").applyInPandas(settle, "star bigint")
    live = cut(tagged.where(F.col("n") > small).select("a", "b"))
    while not live.isEmpty():
        roots = cut(live.select("a").distinct().join(live.select(F.col("b").alias("a")), "a", "left_anti"))
        stars = stars.unionByName(roots.select(F.col("a").alias("star")))
        gone = cut(roots.unionByName(live.join(roots, "a", "left_semi").select(F.col("b").alias("a"))).distinct())
        live = cut(live.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b"))
    # A member's first star; stars are no members.
    of_star = pairs.join(stars.select(F.col("star").alias("a")), "a").groupBy("b").agg(F.min("a").alias("star"))
    return of_star.join(stars.select(F.col("star").alias("b")), "b", "left_anti").select("star", F.col("b").alias("member"))


def fuzzy_pairs(names: DataFrame, name: str, count: str, most: int) -> DataFrame:
    """Pairs of names with one first word within ``most`` edits: (rare, frequent, distance).

    Of two names within k edits, one of the k + 1 parts of the shorter one stands
    unchanged in the other, shifted by at most k signs.  Names are joined on
    these parts, so a first word that very many names share ("the") makes no
    block of its own.
    """
    low = F.lower(F.col(name))
    rows = names.select(F.col(name).alias("x"), F.col(count).alias("n"), low.alias("l"), F.length(low).alias("len"), F.split(low, " ")[0].alias("block")).where("block <> ''")
    start = lambda size, i: F.floor(size * i / (most + 1)).cast("int")

    def part(size: Column, i: int, shift: int) -> Column:
        a, b = start(size, i), start(size, i + 1)
        inside = (a + shift >= 0) & (b + shift <= F.col("len")) & (size >= 1)
        return F.when(inside, F.struct(size.alias("size"), F.lit(i).alias("i"), F.substring(F.col("l"), a + shift + 1, b - a).alias("part")))

    own = F.array(*(part(F.col("len"), i, 0) for i in range(most + 1)))
    other = F.array_distinct(F.array_compact(F.array(*(part(F.col("len") - less, i, s) for less in range(most + 1) for i in range(most + 1) for s in range(-most, most + 1)))))
    short = rows.select("block", F.inline(own), F.struct("x", "n", "l", "len").alias("a"))
    long = rows.select("block", F.inline(other), F.struct("x", "n", "l", "len").alias("b"))
    pairs = short.join(long, ["block", "size", "i", "part"]).where((F.col("a.x") < F.col("b.x")) | ((F.col("a.len") < F.col("b.len")) & (F.col("a.x") != F.col("b.x"))))
    near = pairs.withColumn("d", F.levenshtein(F.col("a.l"), F.col("b.l"), most)).where("d >= 1").select("a", "b", "d")
    ordered = near.select(F.when(F.col("a.x") < F.col("b.x"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("a.x") < F.col("b.x"), F.col("b")).otherwise(F.col("a")).alias("b"), "d").distinct()
    frequent = F.col("a.n") >= F.col("b.n")
    return ordered.select(F.when(frequent, F.col("b.x")).otherwise(F.col("a.x")).alias("rare"), F.when(frequent, F.col("a.x")).otherwise(F.col("b.x")).alias("frequent"), F.col("d").alias("distance"))


def numbered_names(df: DataFrame, base: Column, order: list[Column | str], taken: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """Add ``name``: the base, or base_2, base_3 and so on in order of arrival where it is used again.

    Names already ``taken`` (column name) count as used first.  Repeated until no
    two are the same, as a base may itself end in a number; each round starts
    from the table of the one before.
    """
    out = df.withColumn("name", base)
    if taken is not None:
        used = taken.select("name").distinct().withColumn("_used", F.lit(1))
        out = out.join(used, "name", "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
    else:
        out = out.withColumn("_used", F.lit(0))
    last = None
    while True:
        n = F.col("_n") + F.col("_used")
        named = placed(out, ["name"], order, "_n").withColumn("name", F.when(n > 1, F.concat("name", F.lit("_"), n.cast("string"))).otherwise(F.col("name")))
        out = cut(named.drop("_n").withColumn("_used", F.lit(0)))
        release(last)
        last = out
        if out.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return out.withColumn("name", F.concat("name", F.lit(suffix))).drop("_used")
