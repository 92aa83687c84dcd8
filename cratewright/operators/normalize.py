"""Canonical names and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewright.functions import text
from cratewright.functions.lookups import TAXONOMY


def resolve_category(df: DataFrame, raw: str, mapping: DataFrame, order: DataFrame, split: str = "/", whole_first: bool = True) -> DataFrame:
    """Add ``canonical``: the value itself, mapped, or of its parts the one highest in the order; null if none maps.

    ``mapping`` (raw, canonical; lower case) and ``order`` (canonical, idx) are
    lookups the size of a taxonomy.  Only the different values are resolved.
    """
    known = mapping.select(F.lower(F.trim("raw")).alias("_k"), F.col("canonical").alias("_c")).unionByName(order.select(F.lower("canonical").alias("_k"), F.col("canonical").alias("_c"))).groupBy("_k").agg(F.min("_c").alias("_c"))
    values = df.select(raw).where(F.trim(raw) != "").distinct()
    parts = values.select(raw, F.posexplode(F.split(raw, split)).alias("_pos", "_part"))
    if whole_first:
        parts = parts.unionByName(values.select(raw, F.lit(-1).alias("_pos"), F.col(raw).alias("_part")))
    hits = parts.withColumn("_k", F.lower(F.trim("_part"))).join(known, "_k").join(order.select(F.col("canonical").alias("_c"), "idx"), "_c", "left")
    rank = F.struct(F.when(F.col("_pos") == -1, 0).otherwise(1).alias("w"), F.coalesce("idx", F.lit(1 << 20)).alias("i"), F.col("_pos").alias("p"))
    best = hits.groupBy(raw).agg(F.min_by("_c", rank).alias("canonical"))
    return df.join(best, raw, "left")


def taxonomy(spark) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(TAXONOMY)], "canonical string, idx int")


def first_mapped_tag(df: DataFrame, ident: str, tags: Column, mapping: DataFrame, most: int = 5) -> DataFrame:
    """(ident, canonical): the first of the leading tags that maps."""
    rows = df.select(ident, F.posexplode(F.slice(tags, 1, most)).alias("pos", "tag"))
    m = mapping.select(F.lower("raw").alias("_k"), "canonical")
    return rows.join(m, F.lower("tag") == F.col("_k")).groupBy(ident).agg(F.min_by("canonical", "pos").alias("canonical"))


def infer_from_mode(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Missing values take the most frequent one of their group; ``inferred`` tells which."""
    from cratewright.operators.rank import most_common

    m = most_common(df, group, value, order).select(group, F.col(value).alias("_m"))
    out = df.join(m, group, "left").withColumn("inferred", F.col(value).isNull() & F.col("_m").isNotNull())
    return out.withColumn(value, F.coalesce(value, "_m")).drop("_m")


def canonical_names(counts: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """(name, canonical) of every name that has a better variant; input (name, n), votes (name, n).

    Names are variants if they are equal in lower case.  A voted name of the same
    group wins; then those that begin with a capital, then the most frequent,
    then the smallest.
    """
    key = F.lower(F.trim("name"))
    c = counts.withColumn("_key", key)
    capital = F.when(F.col("name").rlike(r"^\p{Lu}"), 0).otherwise(1)
    best = c.groupBy("_key").agg(F.min_by("name", F.struct(capital.alias("u"), (-F.col("n")).alias("n"), F.col("name").alias("x"))).alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if votes is not None:
        v = votes.withColumn("_key", key).groupBy("_key").agg(F.min_by("name", F.struct((-F.col("n")).alias("n"), F.col("name").alias("x"))).alias("_vote"))
        best = best.join(v, "_key", "left").withColumn("_best", F.coalesce("_vote", "_best"))
    return c.join(best, "_key").where(F.col("name") != F.col("_best")).select("name", F.col("_best").alias("canonical"))


def article_merge(counts: DataFrame) -> DataFrame:
    """(name, canonical): of "The X" and "X" the rarer takes the other's name; a tie goes to "The X"."""
    a, b = counts.alias("a"), counts.alias("b")
    both = a.join(b, F.col("a.name") == F.concat(F.lit("The "), F.col("b.name"))).select(F.col("a.name").alias("the"), F.col("a.n").alias("nt"), F.col("b.name").alias("bare"), F.col("b.n").alias("nb"))
    return both.select(F.when(F.col("nt") >= F.col("nb"), F.col("bare")).otherwise(F.col("the")).alias("name"), F.when(F.col("nt") >= F.col("nb"), F.col("the")).otherwise(F.col("bare")).alias("canonical"))


def rename_cascade(counts: DataFrame, typos: DataFrame, keep: tuple[str, ...] = (), together: tuple[str, ...] = ()) -> DataFrame:
    """(name, new_name, rule, old_count, new_count): five rules, the first that applies wins.

    Order: listed typos (old, new), capitals for names in lower case (but
    ``keep``), decade in front, collaborators (but ``together``) if the first
    artist has more records, article.  Counts after the first two rules decide.
    """
    c = counts.where("name is not null and trim(name) <> ''").select("name", "n")
    c = c.join(typos.select(F.col("old").alias("name"), F.col("new").alias("_typo")), "name", "left")
    lower = F.col("name").rlike(r"^\p{Ll}") & (~F.col("name").isin(*keep) if keep else F.lit(True))
    cased = text.smart_title_case(F.col("name"))
    c = c.withColumn("_case", F.when(F.col("_typo").isNull() & lower & (cased != F.col("name")), cased))
    c = c.withColumn("_now", F.coalesce("_typo", "_case", "name"))
    counted = c.groupBy(F.col("_now").alias("_x")).agg(F.sum("n").alias("_nx"))

    def count_of(df: DataFrame, column: str, out: str) -> DataFrame:
        return df.join(counted.select(F.col("_x").alias(column), F.col("_nx").alias(out)), column, "left").withColumn(out, F.coalesce(out, F.lit(0)))

    open_ = F.col("_typo").isNull() & F.col("_case").isNull()
    decade = F.trim(F.regexp_extract("name", text.DECADE_DASH, 2))
    c = c.withColumn("_decade", F.when(open_ & (decade != "") & (decade != F.col("name")), decade))
    c = c.withColumn("_first", F.when(open_ & F.col("_decade").isNull(), text.primary_artist(F.col("name"), together)))
    c = count_of(count_of(count_of(c, "_first", "_n_first"), "name", "_n_name"), "_decade", "_n_decade")
    c = c.withColumn("_first", F.when(F.col("_n_first") > F.greatest("_n_name", "n"), F.col("_first")))
    other = F.when(F.col("name").startswith("The ") & (F.length("name") > 4), F.substring("name", 5, 1 << 30)).otherwise(F.concat(F.lit("The "), F.col("name")))
    c = c.withColumn("_other", F.when(open_ & F.col("_decade").isNull() & F.col("_first").isNull(), other))
    c = count_of(c, "_other", "_n_other")
    wins = (F.col("_n_other") > F.col("_n_name")) | ((F.col("_n_other") == F.col("_n_name")) & F.col("_other").startswith("The "))
    c = c.withColumn("_other", F.when((F.col("_n_other") > 0) & (F.col("_n_name") > 0) & wins, F.col("_other")))
    raw = counts.groupBy(F.col("name").alias("_x")).agg(F.sum("n").alias("_raw"))
    new = F.coalesce("_typo", "_case", "_decade", "_first", "_other")
    rule = F.when(F.col("_typo").isNotNull(), "typo").when(F.col("_case").isNotNull(), "case_fix").when(F.col("_decade").isNotNull(), "decade_prefix").when(F.col("_first").isNotNull(), "collab_strip").otherwise("article_norm")
    c = c.withColumn("new_name", new).where("new_name is not null").withColumn("rule", rule).join(raw.withColumnRenamed("_x", "new_name"), "new_name", "left")
    after = F.when(F.col("rule").isin("typo", "case_fix"), F.coalesce("_raw", F.lit(0))).when(F.col("rule") == "decade_prefix", F.col("_n_decade")).when(F.col("rule") == "collab_strip", F.col("_n_first")).otherwise(F.col("_n_other"))
    return c.select("name", "new_name", "rule", F.col("n").alias("old_count"), after.alias("new_count"))


def recover_artist(titles: DataFrame, ident: str, title: str, known: DataFrame) -> DataFrame:
    """(ident, artist, new_title) where a side of "A - B" is a known artist, left side first; known (name)."""
    left = F.trim(F.regexp_replace(F.regexp_extract(title, r"^(.+?)\s+-\s+(.+)$", 1), r"^\d{1,3}[\s.\-]+", ""))
    right = F.trim(F.regexp_extract(title, r"^(.+?)\s+-\s+(.+)$", 2))
    names = known.groupBy(F.lower("name").alias("_k")).agg(F.max("name").alias("artist"))
    sides = titles.select(ident, F.inline(F.array(F.struct(F.lit(0).alias("side"), left.alias("who"), right.alias("new_title")), F.struct(F.lit(1).alias("side"), right.alias("who"), left.alias("new_title"))))).where("who <> ''")
    return sides.join(names, F.lower("who") == F.col("_k")).groupBy(ident).agg(F.min_by(F.struct("artist", "new_title"), "side").alias("x")).select(ident, "x.artist", "x.new_title")
