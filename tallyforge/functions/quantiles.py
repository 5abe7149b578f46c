"""Quantiles by index: the element at floor(n * p) of the ascending sample, clamped; nothing is interpolated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_quantiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per key with a column for each quantile, and further aggregates.

    Equal values are counted before they are ranked, so what is sorted for a key is its distinct values.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"_total": F.sum("_n").over(w), "_upto": F.sum("_n").over(upto)})
    at = lambda p: F.least(F.floor(F.col("_total") * F.lit(p)), F.col("_total") - 1)
    found = ranked.groupBy(*keys).agg(F.sum("_n").alias("n"), *[F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(name) for name, p in ps.items()], F.max(value).alias("max"))
    return found if not extra else found.withColumns(extra)
