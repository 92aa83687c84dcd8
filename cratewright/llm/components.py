"""Consolidating pairwise matches into groups: hash-to-min.

Each vertex holds a set of vertices, as rows (v, u).  In a round it sends its
set to the set's minimum and the minimum to all others.  The rows of a set are
spread by (v, u), the minimum is a partial aggregate, and the join that hands
it out has one row per vertex on its other side, so adaptive execution can
split the set of a vertex that holds a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cratewright.session import cut, release


def hash_to_min(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(v, root) for each vertex of an undirected graph: root is the smallest vertex it is linked to.

    Loops and nulls are ignored, so a vertex linked to itself only has no row.
    """
    ends = pairs.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").distinct()
    sets = ends.select(F.inline(F.array(*(F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x, y in (("v", "u"), ("u", "v"), ("v", "v"), ("u", "u")))))).distinct()
    sets, old = cut(sets), None
    while not sets.isEmpty():
        least = sets.groupBy("v").agg(F.min("u").alias("m"))
        seen = Observation()
        # A round changes nothing once every vertex but the minima holds its minimum only.
        told = sets.join(least, "v").observe(seen, F.count_if((F.col("v") != F.col("m")) & (F.col("u") != F.col("m"))).alias("open"))
        sent = told.select(F.inline(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))))
        new = cut(sent.distinct())
        release(old)
        old, sets = sets, new
        if not seen.get["open"]:
            break
    return sets.groupBy("v").agg(F.min("u").alias("root"))


def linked_entries(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_id, group_id) of each entry linked to another; only pairs of two different existing entries link.

    Repeats, either order, self matches, nulls and entries that are gone are
    allowed in the pairs; empty tables give an empty result.
    """
    ends = pairs.select("entry_a", "entry_b").where("entry_a <> entry_b").select(F.least("entry_a", "entry_b").alias("entry_a"), F.greatest("entry_a", "entry_b").alias("entry_b")).distinct()
    there = entries.select("entry_id")
    known = ends.join(there, ends.entry_a == there.entry_id, "left_semi")
    known = known.join(there, known.entry_b == there.entry_id, "left_semi")
    return hash_to_min(known, "entry_a", "entry_b").select(F.col("v").alias("entry_id"), F.col("root").alias("group_id"))
