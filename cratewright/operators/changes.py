"""What would be done: change sets, action plans and reports.  Nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_set(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new) of each value that differs."""
    b, a = before.alias("b"), after.alias("a")
    rows = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}")).select(F.col(f"b.{key}").alias(key), F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("old"), F.col(f"a.{f}").cast("string").alias("new")) for f in fields))))
    return rows.where(~F.col("old").eqNullSafe(F.col("new")))


def apply_changes(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with a change set applied; fields keep their types."""
    fields = [f for f in df.columns if f != key]
    wide = changes.where(F.col("field").isin(fields)).groupBy(key).agg(*(F.max(F.when(F.col("field") == f, F.struct(F.lit(1).alias("x"), F.col("new").alias("v")))).alias(f"_{f}") for f in fields))
    out = df.join(wide, key, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v").cast(df.schema[f].dataType)).otherwise(F.col(f)))
    return out.select(df.columns)


def file_actions(df: DataFrame, action: Column, source: Column, target: Column, reason: Column) -> DataFrame:
    """(action, src, dst, reason): a plan of copies, moves, deletions and conversions for another tool."""
    return df.select(action.alias("action"), source.alias("src"), target.alias("dst"), reason.alias("reason")).where("action is not null")


def report(df: DataFrame, by: list[str], example: str, most: int = 500) -> DataFrame:
    """(by, n, examples): counts with a list of the smallest examples, at most ``most`` of them."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(example)
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).groupBy(*by).agg(F.sort_array(F.collect_list(example)).alias("examples"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(top, by)


def balance(df: DataFrame, outcome: str) -> DataFrame:
    """Rows per outcome, and in a last row of all: every input row must be in one outcome."""
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n")).unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias(outcome), "n"))
