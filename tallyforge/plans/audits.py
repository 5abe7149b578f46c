"""Integrity audits: each returns the rows that break a rule, or a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.prefix import RANGE, signed


def zero_sum_by_tx(entries: DataFrame) -> DataFrame:
    """Per transaction its debits, credits and whether they are equal."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount"))), F.lit(0))
    return entries.groupBy("tx_id").agg(of("DEBIT").alias("debits"), of("CREDIT").alias("credits")).withColumn("balanced", F.col("debits") == F.col("credits"))


def zero_sum_violations(entries: DataFrame) -> DataFrame:
    return zero_sum_by_tx(entries).where("NOT balanced")


def zero_sum_global(balances: DataFrame) -> DataFrame:
    return balances.agg(F.coalesce(F.sum("balance"), F.lit(0)).alias("total"), F.count("*").alias("n_accounts"))


def continuity_violations(entries: DataFrame) -> DataFrame:
    """Entries whose computed balance is not the account's one before it with the amount added or subtracted.

    Within a range of segments the row before is looked up; a range's first row is held against the last of the account's
    ranges before, so no account is scanned by one task.
    """
    order = ["tx_id", "seq"]
    rows = entries.withColumn("_range", F.floor(F.col("segment_id") / RANGE))
    inner = Window.partitionBy("account_id", "_range").orderBy(*order)
    ends = rows.groupBy("account_id", "_range").agg(F.max_by("computed_balance", F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_carried", F.coalesce(F.lag("_end").over(Window.partitionBy("account_id").orderBy("_range")), F.lit(0))).drop("_end")
    rows = rows.withColumn("_prev", F.lag("computed_balance").over(inner)).join(ends, ["account_id", "_range"])
    before = F.coalesce("_prev", "_carried")
    return rows.where(F.col("computed_balance") != before + signed()).select("tx_id", "seq", "account_id", before.alias("previous"), signed().alias("change"), "computed_balance")


def order_violations(log: DataFrame) -> DataFrame:
    """Rows (segment_id, pos, tx_id) whose id does not exceed the one before."""
    w = Window.partitionBy("segment_id").orderBy("pos")
    return log.withColumn("previous", F.lag("tx_id").over(w)).where("previous >= tx_id")


def follower_mismatches(tx: DataFrame, entries: DataFrame) -> DataFrame:
    """Transactions whose declared number of followers is not what the log holds."""
    counts = entries.groupBy("tx_id").agg(F.count("*").alias("actual"))
    return tx.join(counts, "tx_id", "left").select("tx_id", F.col("sub_item_count").alias("declared"), F.coalesce("actual", F.lit(0)).alias("actual")).where("declared <> actual")


def segment_report(tx: DataFrame) -> DataFrame:
    """Per segment its records (transactions and followers), transactions, first and last id."""
    return tx.groupBy("segment_id").agg(F.sum(F.col("sub_item_count") + 1).alias("record_count"), F.count("*").alias("tx_count"), F.min("tx_id").alias("first_tx_id"), F.max("tx_id").alias("last_tx_id"))


def segment_gaps(tx: DataFrame, width: int = 10_000) -> DataFrame:
    """Segments that do not follow the one before by number or by transaction id; compared within blocks, and the blocks' ends with each other."""
    one = F.struct("segment_id", "last_tx_id")
    rows = segment_report(tx).select("segment_id", "first_tx_id", "last_tx_id", F.floor(F.col("segment_id") / width).alias("b"))
    ends = rows.groupBy("b").agg(F.max(one).alias("end"))
    ends = ends.select("b", F.lag("end").over(Window.orderBy("b")).alias("carried"))  # one row for each block
    rows = rows.withColumn("previous", F.lag(one).over(Window.partitionBy("b").orderBy("segment_id"))).join(ends, "b")
    rows = rows.withColumn("previous", F.coalesce("previous", "carried"))
    rows = rows.select("segment_id", "first_tx_id", "last_tx_id", F.col("previous.segment_id").alias("previous_segment"), F.col("previous.last_tx_id").alias("previous_last"))
    return rows.where("segment_id <> previous_segment + 1 OR first_tx_id <> previous_last + 1")


def segment_range(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(F.col("segment_id").between(first, last))


def tx_gaps(tx: DataFrame, width: int = 1_000_000) -> DataFrame:
    """(after_tx_id, before_tx_id) of each gap; ids are compared within blocks, and the blocks' ends with each other."""
    keyed = tx.select("tx_id", F.floor(F.col("tx_id") / width).alias("b"))
    inner = keyed.withColumn("before", F.lead("tx_id").over(Window.partitionBy("b").orderBy("tx_id"))).select(F.col("tx_id").alias("a"), "before")
    blocks = keyed.groupBy("b").agg(F.min("tx_id").alias("lo"), F.max("tx_id").alias("hi"))
    ends = blocks.select(F.col("hi").alias("a"), F.lead("lo").over(Window.orderBy("b")).alias("before"))  # one row for each block
    return inner.unionByName(ends).where("before > a + 1").select(F.col("a").alias("after_tx_id"), F.col("before").alias("before_tx_id"))


def checksums(tx: DataFrame, entries: DataFrame, found: Column | None = None) -> DataFrame:
    """A CRC-32 of each transaction over the text of its followers and then its own (Spark has no CRC-32C).

    With found, an amount for each entry, also found_crc32: that with this amount instead, from the same one shuffle. Followers
    are shuffled as values; their text is made afterwards.
    """
    fields = [F.col(c) for c in ("seq", "kind", "account_id", "amount", "computed_balance")]
    held = entries.groupBy("tx_id").agg(F.collect_list(F.struct(*fields, *([] if found is None else [found.alias("found")]))).alias("_held"))  # MAX_ENTRIES at most
    own = F.concat_ws("|", "tx_id", "fail_reason", "sub_item_count", "ts_ns", "user_ref", "tag")

    def crc(amount: str) -> Column:
        lines = F.transform("_held", lambda x: F.struct(x["seq"].alias("seq"), F.concat_ws("|", x["seq"], x["kind"], x["account_id"], x[amount], x["computed_balance"]).alias("t")))
        body = F.array_join(F.transform(F.array_sort(lines), lambda x: x["t"]), "\n")
        return F.crc32(F.concat_ws("\n", body, own).cast("binary"))

    return tx.join(held, "tx_id", "left").select("tx_id", crc("amount").alias("crc32"), *([] if found is None else [crc("found").alias("found_crc32")]))


def broken_tail(checked: DataFrame) -> DataFrame:
    """Per segment of (segment_id, pos, valid): the first broken group, and whether it is a torn tail or corruption inside.

    It is a torn tail if no valid group follows it.
    """
    found = checked.groupBy("segment_id").agg(F.min(F.when(~F.col("valid"), F.col("pos"))).alias("first_broken"), F.max(F.when(F.col("valid"), F.col("pos"))).alias("last_valid"))
    return found.where("first_broken IS NOT NULL").select("segment_id", "first_broken", F.when(F.coalesce(F.col("last_valid") > F.col("first_broken"), F.lit(False)), "CORRUPT").otherwise("TORN_TAIL").alias("finding"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, as often as it lacks them; empty if replayed and live state are the same. Each side is read once."""
    n = "_n"
    both = a.withColumn(n, F.lit(1)).union(b.withColumn(n, F.lit(-1)))
    more = both.groupBy(*[f"`{c}`" for c in a.columns]).agg(F.sum(n).alias(n)).where(F.col(n) != 0)
    side = F.when(F.col(n) > 0, "left").otherwise("right")
    return more.select(*[f"`{c}`" for c in a.columns], F.explode(F.array_repeat(side, F.abs(F.col(n)).cast("int"))).alias("side"))
