"""State as folds over the log: the last effect on a key wins, in the order (tx_id, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.prefix import signed


def _order():
    return F.struct("tx_id", "seq")


def balances(entries: DataFrame) -> DataFrame:
    """Last computed balance of each account."""
    return entries.groupBy("account_id").agg(F.max_by("computed_balance", _order()).alias("balance"))


def balances_by_sum(entries: DataFrame) -> DataFrame:
    return entries.groupBy("account_id").agg(F.sum(signed()).alias("balance"))


def balances_both_ways(entries: DataFrame) -> DataFrame:
    """(account_id, balance, replayed): balances() and balances_by_sum() in one pass."""
    return entries.groupBy("account_id").agg(F.max_by("computed_balance", _order()).alias("balance"), F.sum(signed()).alias("replayed"))


def account_flags(opens: DataFrame, flag_events: DataFrame | None = None) -> DataFrame:
    """Last flags of each account: from its opening or a later update."""
    rows = opens.select(F.explode(F.sequence("begin_account_id", F.col("begin_account_id") + F.col("count") - 1)).alias("account_id"), "tx_id", "seq", "flags")
    if flag_events is not None:
        rows = rows.unionByName(flag_events.select("account_id", "tx_id", "seq", F.col("new_flags").alias("flags")))
    return rows.groupBy("account_id").agg(F.max_by("flags", _order()).alias("flags"))


def accounts(entries: DataFrame, opens: DataFrame, flag_events: DataFrame | None = None) -> DataFrame:
    """(account_id, balance, flags) of accounts with a balance or flags other than 0."""
    out = balances(entries).join(account_flags(opens, flag_events), "account_id", "full")
    out = out.select("account_id", F.coalesce("balance", F.lit(0)).alias("balance"), F.coalesce("flags", F.lit(0)).alias("flags"))
    return out.where("balance <> 0 OR flags <> 0")


def accounts_after(base: DataFrame, entries: DataFrame, opens: DataFrame, flag_events: DataFrame | None = None) -> DataFrame:
    """Accounts carried on from a base (account_id, balance, flags) over the log after it."""
    first = [F.lit(0).cast("long").alias("tx_id"), F.lit(-1).alias("seq")]
    held = base.select("account_id", *first, F.col("balance").alias("computed_balance"))
    flags = base.select("account_id", *first, F.col("flags").alias("new_flags"))
    later = flags if flag_events is None else flags.unionByName(flag_events.select("account_id", "tx_id", "seq", "new_flags"))
    return accounts(held.unionByName(entries.select(held.columns)), opens, later)


def links(link_events: DataFrame) -> DataFrame:
    return link_events.groupBy("parent_id", "type_id").agg(F.max_by("child_id", _order()).alias("child_id"))


def kv(kv_events: DataFrame) -> DataFrame:
    """Last value of each key that is not deleted."""
    last = kv_events.groupBy("key_str").agg(F.max_by(F.struct("value", "is_delete"), _order()).alias("last"))
    return last.where("NOT last.is_delete").select("key_str", "last.value")


def kv_resolved(kv_events: DataFrame, constants: DataFrame) -> DataFrame:
    """Values with constants by name; a constant that is not known is the empty string."""
    found = kv(kv_events).select("key_str", F.col("value.kind").alias("kind"), F.col("value.i").alias("i"))
    named = found.join(constants_of(constants).select(F.col("id").alias("i"), "name"), "i", "left")
    return named.select("key_str", "kind", F.when(F.col("kind") == "Int", F.col("i")).alias("i"), F.when(F.col("kind") == "Const", F.coalesce("name", F.lit(""))).alias("s"))


def constants_of(constants: DataFrame) -> DataFrame:
    return constants.groupBy("id").agg(F.min("name").alias("name"))


def functions(fn_events: DataFrame, live_only: bool = True) -> DataFrame:
    """Last version of each function; a checksum of 0 means unregistered."""
    last = fn_events.groupBy("name").agg(F.max_by(F.struct("version", "crc32c"), F.col("tx_id")).alias("last")).select("name", "last.*")
    return last.where("crc32c <> 0") if live_only else last


def next_account_id(opens: DataFrame, link_events: DataFrame | None = None) -> DataFrame:
    """One row: the first id that no range and no linked account has taken."""
    tops = opens.select((F.col("begin_account_id") + F.col("count")).alias("top"))
    if link_events is not None:
        tops = tops.unionByName(link_events.select((F.col("child_id") + 1).alias("top")))
    return tops.agg(F.coalesce(F.max("top"), F.lit(1)).alias("next_account_id"))


def until(df: DataFrame, watermark: int) -> DataFrame:
    """The log as it stood at a transaction."""
    return df.where(F.col("tx_id") <= watermark)
