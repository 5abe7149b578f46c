"""The log as Parquet: one folder for each table, partitioned by segment, appended only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas as S

TABLES = {"tx": S.TX, "entries": S.ENTRIES, "tx_links": S.TX_LINKS, "opens": S.OPENS, "link_events": S.LINK_EVENTS, "flag_events": S.FLAG_EVENTS, "kv_events": S.KV_EVENTS, "constants": S.CONSTANTS, "fn_events": S.FN_EVENTS, "terms": S.TERMS, "votes": S.VOTES}
BY_SEGMENT = ("tx", "entries")


def append(df: DataFrame, root: str, name: str, folders: bool = True) -> None:
    """Add rows of a table, sorted by transaction; with folders, those of tx and entries go to that of their segment."""
    order = [c for c in ("tx_id", "seq") if c in df.columns]
    if name in BY_SEGMENT and folders:
        df.repartition("segment_id").sortWithinPartitions("segment_id", *order).write.mode("append").partitionBy("segment_id").parquet(f"{root}/{name}")
    else:
        (df.sortWithinPartitions(*order) if order else df).write.mode("append").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str, first_segment: int | None = None, last_segment: int | None = None) -> DataFrame:
    """A table with its fixed schema; segment bounds (inclusive) prune folders."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], TABLES[name])
    df = spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
    if name in BY_SEGMENT:
        if first_segment is not None:
            df = df.where(F.col("segment_id") >= first_segment)
        if last_segment is not None:
            df = df.where(F.col("segment_id") <= last_segment)
    return df


def segments(tx: DataFrame, size: int, sealed_upto: int = 0) -> DataFrame:
    """(segment_id, first_tx_id, last_tx_id, status): the newest is ACTIVE, full ones CLOSED or SEALED."""
    found = tx.groupBy("segment_id").agg(F.min("tx_id").alias("first_tx_id"), F.max("tx_id").alias("last_tx_id"))
    status = F.when(F.col("last_tx_id") - F.col("first_tx_id") < size - 1, "ACTIVE").when(F.col("segment_id") <= sealed_upto, "SEALED").otherwise("CLOSED")
    return found.withColumn("status", status)
