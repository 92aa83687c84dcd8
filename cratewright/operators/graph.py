"""Connected components for the core: smallest label, spread along the edges until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewright.session import cut, release


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node each one is linked to; loops give a component of one.

    Each round hooks every label to the smallest label next to it and then jumps
    to the label's label, so chains shrink by halves.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.inline(F.array(F.struct(F.col(a).alias("s"), F.col(b).alias("t")), F.struct(F.col(b).alias("s"), F.col(a).alias("t"))))).distinct()
    both = cut(both)
    labels = both.groupBy("s").agg(F.least(F.min("t"), F.col("s")).alias("l")).select(F.col("s").alias("n"), "l")
    labels, before, old = cut(labels), None, None
    while True:
        state = tuple(labels.agg(F.sum(F.col("l").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("n", "l"))).first())
        if state == before:
            return labels.select(F.col("n").alias("node"), F.col("l").alias("component"))
        before = state
        release(old)
        old = labels
        near = both.join(labels.select(F.col("n").alias("t"), "l"), "t").groupBy("s").agg(F.min("l").alias("near"))
        hooked = labels.join(near, labels.n == near.s).select("n", F.least("l", "near").alias("l"))
        jump = hooked.select(F.col("n").alias("via"), F.col("l").alias("far"))
        labels = cut(hooked.join(jump, hooked.l == jump.via, "left").select("n", F.least("l", F.coalesce("far", "l")).alias("l")))
