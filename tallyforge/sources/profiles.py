"""Ledger inputs made from the star-schema tables.

``events`` become operations: transaction 1 opens an account for each user, event e is transaction e + 2 on account
user_id + 1, its amount the value in cents. P1: purchase and error withdraw, the rest deposits. P1-missing opens the first
nine tenths of the accounts only. P1-dup adds user_ref = user_id * 100 + k + 1 with k from props. P2: a view is a transfer to
account (user_id + k) % n + 1 instead. ``orders`` and ``lineitem`` become a journal: order o is transaction o + 1, which
credits the customer's account with the sum of its lines and debits each line's supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators.prefix import balances_along

SUPPLIERS_FROM = 1_000_000_000
SEGMENT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segment_of(tx_id, size: int = SEGMENT):
    return F.floor((tx_id - 1) / size).cast("long") + 1


def cents(column):
    return F.round(column * 100).cast("long")


def event_ops(spark: SparkSession, sf_dir: str, profile: str = "P1") -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    users = events.agg((F.max("user_id") + 1).alias("n"))
    opened = F.floor(F.col("n") * 9 / 10).cast("long") if profile == "P1-missing" else F.col("n")
    null = F.lit(None).cast("long")
    op = F.when(F.col("event_type").isin("purchase", "error"), "Withdrawal")
    if profile == "P2":
        op = op.when(F.col("event_type") == "view", "Transfer")
    rows = events.select((F.col("event_id") + 2).alias("tx_id"), op.otherwise("Deposit").alias("op"), (F.col("user_id") + 1).alias("own"), k.alias("k"), cents(F.col("value")).alias("amount"))
    rows = rows.crossJoin(F.broadcast(users)) if profile == "P2" else rows.withColumn("n", F.lit(1))  # one row
    moved = F.col("op") == "Transfer"
    rows = rows.select(
        "tx_id", "op", F.when(~moved, F.col("own")).alias("account"), F.when(moved, F.col("own")).alias("from"), F.when(moved, (F.col("own") - 1 + F.col("k")) % F.col("n") + 1).alias("to"),
        "amount", null.alias("count"), F.lit(None).cast("string").alias("fn_name"), F.lit(None).cast("array<long>").alias("params"),
        (F.when(F.lit(profile == "P1-dup"), (F.col("own") - 1) * 100 + F.col("k") + 1).otherwise(0)).alias("user_ref"),
    )
    first = users.select(
        F.lit(1).cast("long").alias("tx_id"), F.lit("OpenAccount").alias("op"), null.alias("account"), null.alias("from"), null.alias("to"), null.alias("amount"), opened.alias("count"),
        F.lit(None).cast("string").alias("fn_name"), F.lit(None).cast("array<long>").alias("params"), F.lit(0).cast("long").alias("user_ref"),
    )
    return first.unionByName(rows)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df by key in as many parts as the session shuffles into, and what it is joined with by key.

    Adaptive execution puts parts together by compressed bytes; of consecutive numbers, some bytes a row, a task would get millions.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def order_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal's entries without running balances.

    Lines of an order are numbered by line number, part, supplier and amount; whichever of those that agree in all four comes
    first, the entries are the same, so no other column is shuffled.
    """
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("tx_id"), "l_linenumber", "l_partkey", "l_suppkey", cents(F.col("l_extendedprice")).alias("amount"))
    numbered = lines.withColumn("seq", F.row_number().over(Window.partitionBy("tx_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "amount")))
    debits = numbered.select("tx_id", "seq", F.lit("DEBIT").alias("kind"), (F.col("l_suppkey") + SUPPLIERS_FROM).alias("account_id"), "amount")
    totals = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents(F.col("l_extendedprice"))).alias("amount"))
    credits = totals.join(spread(table(spark, sf_dir, "orders"), "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") + 1).alias("tx_id"), F.lit(0).alias("seq"), F.lit("CREDIT").alias("kind"), (F.col("o_custkey") + 1).alias("account_id"), "amount")
    return debits.unionByName(credits)


def journal_entries(spark: SparkSession, sf_dir: str, last_tx_id: int | None = None) -> DataFrame:
    """The journal, or its start up to a transaction: balances along it do not depend on what follows."""
    legs = order_legs(spark, sf_dir)
    if last_tx_id is not None:
        legs = legs.where(F.col("tx_id") <= last_tx_id)
    return balances_along(legs, segment_of(F.col("tx_id")))


def journal_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = order_legs(spark, sf_dir).groupBy("tx_id").agg(F.count("*").cast("int").alias("sub_item_count"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("tx_id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ts_ns"))
    return spread(orders, "tx_id").join(counts, "tx_id", "left").select("tx_id", F.lit(0).alias("fail_reason"), F.coalesce("sub_item_count", F.lit(0)).alias("sub_item_count"), "ts_ns", F.lit(0).cast("long").alias("user_ref"), F.lit("TRANSFER").alias("tag"), segment_of(F.col("tx_id")).alias("segment_id"))
