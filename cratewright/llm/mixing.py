"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Each text gets the key -ln(u)/w, with u from a hash of its id (so a lost task
draws the same again) and w its quality weight; small keys come first.  A
source's budget is met by complete epochs and a part of one: the texts in key
order until the prefix sum reaches what is left.  The prefix sums run over a
histogram of the keys' logarithms, which spreads the keys of any weights evenly
and is aggregated on the map side; only the texts of the one histogram bin where
a source's budget ends are sorted, so a source with a third of all rows needs no
task of its own.  The gap a long text leaves at that line is filled with later
texts that fit, in key order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewright.llm.tokens import count_tokens
from cratewright.session import cut

BINS = 4096  # bins of the keys' logarithms per factor e: one holds at most 0.01 % of a source's texts of one weight
FEW = 10_000  # rows of a table per source that is sent to every task; more are joined by exchange
LEAST_WEIGHT = 0.05


def letter_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L} ]+", "")) / F.greatest(F.length(text), F.lit(1))


def quality(letters: Column, n_tokens: Column, n_different: Column) -> Column:
    """A weight between LEAST_WEIGHT and 1: the share of letters and blanks, less where tokens are repeated more than in running text, whose different tokens grow at least as the 0.8th power of its length."""
    variety = F.least(F.lit(1.0), n_different / F.pow(F.greatest(n_tokens, F.lit(1)), F.lit(0.8)))
    return F.greatest(F.lit(LEAST_WEIGHT), letters * variety)


def sampling_key(id_col: Column, weight: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def _hinted(df: DataFrame) -> DataFrame:
    """A materialised table, marked to be sent to every task if it is small."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def sized_texts(docs: DataFrame, targets: DataFrame, weight: Column | None, seed: int, tokenizer: str, folder: str | None) -> DataFrame:
    """One row per different text of each source with a target: source_name, doc_id (smallest of its copies), n_tokens, key, bin."""
    given = letter_share(F.col("text")) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-6))
    rows = docs.where(F.col("text") != "").select("doc_id", F.col("source").alias("source_name"), "text", given.alias("given")).join(_hinted(targets.select("source_name")), "source_name")
    counted = count_tokens(rows.withColumn("same", F.sha2("text", 256)), ["source_name", "same", "doc_id", "given"], "text", tokenizer, folder)
    texts = counted.groupBy("source_name", "same").agg(F.min("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("n_different").alias("n_different"), F.max("given").alias("given"))
    chosen = quality(F.col("given"), F.col("n_tokens"), F.col("n_different")) if weight is None else F.col("given")
    keyed = texts.select("source_name", "doc_id", "n_tokens", sampling_key(F.col("doc_id"), chosen, seed).alias("key"))
    return keyed.withColumn("bin", F.floor(F.log("key") * BINS).cast("int"))


def plan(targets: DataFrame, sizes: DataFrame, total_tokens: int | None) -> DataFrame:
    """Per target: tokens available, its share of what can be mixed, budget, complete epochs and the tokens left over.

    The mixture is as large as ``total_tokens``, but no larger than lets every
    source that has texts meet its share within its repeats.
    """
    t = targets.join(sizes, "source_name", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    there = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    t = cut(t.withColumn("share", F.when(there, F.col("target_share")).otherwise(F.lit(0.0))))
    whole = t.agg(F.sum("share")).first()[0] or 1.0
    t = t.withColumn("share", F.col("share") / F.lit(whole))
    most = t.agg(F.min(F.when(F.col("share") > 0, F.col("available") * F.col("max_repeats") / F.col("share")))).first()[0] or 0.0
    total = most if total_tokens is None else min(most, float(total_tokens))
    t = t.withColumn("budget", F.floor(F.lit(total) * F.col("share") + 1e-6))
    t = t.withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(0)))
    return t.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))


def _lines(texts: DataFrame, rest: DataFrame) -> DataFrame:
    """Per source with a rest: the histogram bin in which the prefix sum passes it (null if none), and the tokens before that bin."""
    bins = texts.groupBy("source_name", "bin").agg(F.sum("n_tokens").alias("tokens"))
    upto = bins.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source_name").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    over = upto.join(rest, "source_name").where("upto > rest").groupBy("source_name").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("tokens")).alias("before")), "bin").alias("x"))
    return rest.where("rest > 0").join(over, "source_name", "left").select("source_name", "rest", F.col("x.bin").alias("last_bin"), F.col("x.before").alias("before"))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source's candidates those that still fit, in key order."""
    rows = rows.sort_values(["key", "doc_id"])
    gap, taken = int(rows["gap"].iloc[0]), []
    for i, n in enumerate(rows["n_tokens"].tolist()):
        if n <= gap:
            gap -= n
            taken.append(i)
    return rows.iloc[taken][["source_name", "doc_id", "n_tokens"]]


def _part_of_an_epoch(texts: DataFrame, rest: DataFrame) -> DataFrame:
    """Texts that fill the rest of each source, none twice: in key order each that still fits.

    Up to the first text that does not fit this is the prefix sum.  Behind it,
    a gap of g tokens can take at most g / n texts of n tokens, the first ones in
    key order; so these are all the candidates, however many rows there are.
    """
    lines = _hinted(cut(_lines(texts, rest)))
    placed = texts.join(lines, "source_name")
    inside = placed.where("last_bin is null or bin < last_bin").select("source_name", "doc_id", "n_tokens")
    order = Window.partitionBy("source_name").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = cut(placed.where("bin = last_bin").withColumn("sum", F.col("before") + F.sum("n_tokens").over(order)))
    inner = edge.where("sum <= rest")
    gap = edge.groupBy("source_name").agg((F.first("rest") - F.coalesce(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum"))), F.first("before"))).alias("gap"), F.first("last_bin").alias("last_bin"))
    gaps = _hinted(cut(gap.where("gap > 0")))
    behind = texts.join(gaps, "source_name").where("bin > last_bin").unionByName(edge.where("sum > rest").select(*texts.columns).join(gaps, "source_name"))
    fits = behind.where("n_tokens <= gap")
    place = F.row_number().over(Window.partitionBy("source_name", "n_tokens").orderBy("key", "doc_id"))
    candidates = fits.withColumn("place", place).where("place <= floor(gap / n_tokens)").select("source_name", "doc_id", "n_tokens", "key", "gap")
    kinds = dict(texts.dtypes)
    filled = candidates.groupBy("source_name").applyInPandas(_fill, f"source_name {kinds['source_name']}, doc_id {kinds['doc_id']}, n_tokens bigint")
    return inside.unionByName(inner.select("source_name", "doc_id", "n_tokens")).unionByName(filled)


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, weight: Column | None = None, seed: int = 7, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: source_name, doc_id, n_tokens, repeats of each text used.  Copies
    of a text within a source count as one text, so none is used more than
    max_repeats times.  shares: per target source its target share, available
    tokens, budget, epochs, tokens and share really reached, and the smallest
    text it could still have taken once (null if none is left).  Documents of
    sources without target, and null or empty texts, are not used; targets
    without documents reach 0 and their share falls to the others in
    proportion.  No source exceeds its budget, and none leaves a gap in which an
    unused text fits.  ``total_tokens`` caps the mixture; by default it is as
    large as the repeats allow.
    """
    goals = cut(targets.groupBy("source_name").agg(F.max("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")).where("source_name is not null"))
    texts = cut(sized_texts(docs, goals, weight, seed, tokenizer, folder))
    sizes = texts.groupBy("source_name").agg(F.sum("n_tokens").alias("available"))
    goal = cut(plan(goals, sizes, total_tokens))
    part = cut(_part_of_an_epoch(texts, goal.select("source_name", "rest")))
    epochs = texts.join(_hinted(goal.where("epochs > 0").select("source_name", "epochs")), "source_name").select("source_name", "doc_id", "n_tokens", F.col("epochs").alias("repeats"))
    once = part.select("source_name", "doc_id", "n_tokens", F.lit(1).cast("bigint").alias("repeats"))
    mixture = epochs.unionByName(once).groupBy("source_name", "doc_id", "n_tokens").agg(F.sum("repeats").cast("int").alias("repeats"))
    reached = mixture.groupBy("source_name").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("repeats").alias("most_repeats"))
    left = texts.join(part.select("source_name", "doc_id"), ["source_name", "doc_id"], "left_anti").groupBy("source_name").agg(F.min("n_tokens").alias("smallest_left"))
    all_tokens = reached.agg(F.sum("tokens").alias("all_tokens"))
    shares = goal.join(reached, "source_name", "left").join(left, "source_name", "left").join(F.broadcast(all_tokens)).select(  # one row
        "source_name",
        "target_share",
        "max_repeats",
        "available",
        "budget",
        "epochs",
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        "smallest_left",
    )
    return mixture, shares
