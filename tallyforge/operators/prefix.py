"""Running sums that no single task has to make alone: totals of ranges of segments first, then the rows within each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.scratch import persist

#: Segments summed up by one task. With 1,000 transactions to a segment, 10^12 transactions are 10^7 ranges.
RANGE = 100


def signed(kind: str = "kind", amount: str = "amount") -> Column:
    """A debit adds, a credit subtracts."""
    return F.when(F.col(kind) == "DEBIT", F.col(amount)).otherwise(-F.col(amount))


def running_sum(df: DataFrame, value: Column, order: list[str], name: str, keys: list[str] = (), segment: Column | str = "segment_id") -> DataFrame:
    """df with the sum of value over the rows of the same keys up to each row, in an order that agrees with segment.

    A key's rows are split by ranges of segments, so a key with a third of all rows is many groups of bounded size. The rows
    are shuffled and sorted once; the totals of the ranges are made from rows added up before they are shuffled.
    """
    segment = F.col(segment) if isinstance(segment, str) else segment
    rows = df.withColumn("_range", F.floor(segment / RANGE))
    totals = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    along = rows.repartition(*keys, "_range").withColumn("_along", F.sum(value).over(inner))
    return along.join(totals, [*keys, "_range"]).withColumn(name, (F.col("_before") + F.col("_along")).cast("long")).drop("_along", "_before", "_range")


def balances_along(entries: DataFrame, segment: Column | str = "segment_id") -> DataFrame:
    """entries with computed_balance, the account's balance after each entry, and segment_id."""
    out = running_sum(entries, signed(), ["tx_id", "seq"], "computed_balance", ["account_id"], segment)
    return out.select("tx_id", "seq", "kind", "account_id", "amount", "computed_balance", (F.col(segment) if isinstance(segment, str) else segment).alias("segment_id"))


def row_numbers(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """df with gap-free numbers in the given order: ranges are numbered apart, then shifted by the rows before them.

    The ranges are written once, so that every number comes from the same ranges even if a task is run again.
    """
    ranged = persist(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each range
    inner = Window.partitionBy("_range").orderBy(*order)
    return ranged.join(counts.drop("_n"), "_range").withColumn(name, (F.col("_before") + F.row_number().over(inner) + (first - 1)).cast("long")).drop("_range", "_before")
