"""The log as NDJSON: one object for each record, with its type; unpacking and packing are inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "type string, tx_id long, seq int, fail_reason int, sub_item_count int, ts_ns long, user_ref long, tag string, kind string, account_id long, amount long, computed_balance long, to_tx_id long, begin_account_id long, count long, flags long"


def records(tx: DataFrame, entries: DataFrame, links: DataFrame | None = None, opens: DataFrame | None = None) -> DataFrame:
    """All records of the log with one schema: followers, then the transaction that closes them."""
    parts = [tx.withColumn("type", F.lit("TxMetadata")), entries.withColumn("type", F.lit("TxEntry"))]
    if links is not None:
        parts.append(links.withColumns({"type": F.lit("TxLink"), "seq": F.lit(0)}))
    if opens is not None:
        parts.append(opens.withColumn("type", F.lit("AccountOpened")))
    names = [x.split()[:2] for x in RECORD.split(", ")]
    out = None
    for p in parts:
        row = p.select(*[(F.col(n) if n in p.columns else F.lit(None)).cast(t).alias(n) for n, t in names])
        out = row if out is None else out.unionByName(row)
    return out


def unpack(log: DataFrame, path: str) -> None:
    """Write records as NDJSON, ordered within each file; empty fields are left out."""
    log.repartitionByRange("tx_id").sortWithinPartitions("tx_id", F.col("type") == "TxMetadata", "seq").write.json(path)


def pack(spark: SparkSession, path: str) -> DataFrame:
    """Read records back; raises if a transaction's followers lack their closing record or come twice."""
    log = spark.read.schema(RECORD).json(path)
    per = log.groupBy("tx_id").agg(F.count_if(F.col("type") == "TxMetadata").alias("closed"), F.count_if(F.col("type") != "TxMetadata").alias("followers"), F.max("sub_item_count").alias("declared"))
    wrong = per.where("tx_id IS NULL OR closed <> 1 OR followers <> declared").limit(1).collect()
    if wrong:
        raise ValueError(f"transaction {wrong[0]['tx_id']} is not whole")
    return log


def with_checksums(log: DataFrame) -> DataFrame:
    """Records with a CRC-32 of each transaction's group, computed anew from its fields."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    w = Window.partitionBy("tx_id")
    line = F.to_json(F.struct(*names))
    return log.withColumn("crc32", F.crc32(F.array_join(F.array_sort(F.collect_list(line).over(w)), "\n").cast("binary")))
