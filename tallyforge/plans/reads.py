"""Point reads, batch reads and scans over the log and the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge import schemas as S
from tallyforge.functions.flags import status


def balance(accounts: DataFrame, account_id: int, guarded: bool = True) -> DataFrame:
    """One row; 0 for an untouched account, null for a program's account if guarded."""
    found = accounts.where(F.col("account_id") == account_id).agg(F.max("balance").alias("balance"), F.max("flags").alias("flags"))
    value = F.coalesce("balance", F.lit(0))
    if guarded:
        value = F.when(status(F.coalesce("flags", F.lit(0))) == S.PROGRAMMED, F.lit(None)).otherwise(value)
    return found.select(F.lit(account_id).cast("long").alias("account_id"), value.alias("balance"))


def balances(accounts: DataFrame, asked: DataFrame) -> DataFrame:
    """Balances for (pos, account_id), order and repetitions kept, 0 where there is none."""
    return asked.join(accounts.select("account_id", "balance"), "account_id", "left").select("pos", "account_id", F.coalesce("balance", F.lit(0)).alias("balance"))


def linked_balances(links: DataFrame, balances_: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(parent_id, type_id, child_id, balance) of the accounts linked to the parents."""
    own = links if parents is None else links.join(parents, "parent_id", "left_semi")
    return own.join(balances_.select(F.col("account_id").alias("child_id"), "balance"), "child_id", "left").select("parent_id", "type_id", "child_id", F.coalesce("balance", F.lit(0)).alias("balance"))


def transactions(tx: DataFrame, entries: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Whole transactions with their entries in order; ids that do not exist are left out."""
    if ids is not None:
        tx, entries = tx.join(ids.select("tx_id").distinct(), "tx_id", "left_semi"), entries.join(ids.select("tx_id").distinct(), "tx_id", "left_semi")
    held = entries.groupBy("tx_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "account_id", "amount", "computed_balance"))).alias("entries"))  # MAX_ENTRIES at most
    return tx.join(held, "tx_id", "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<seq:int,kind:string,account_id:long,amount:long,computed_balance:long>>")))


def statuses(ids: DataFrame, progress: DataFrame) -> DataFrame:
    """Status of each tx_id by the one row of progress (sequence, compute, commit, snapshot)."""
    t = F.col("tx_id")
    state = F.when((t < 1) | (t > F.col("sequence")), "NotFound").when(t <= F.col("snapshot"), "OnSnapshot").when(t <= F.col("commit"), "Committed").when(t <= F.col("compute"), "Computed").otherwise("Pending")
    return ids.crossJoin(F.broadcast(progress.limit(1))).select(*ids.columns, state.alias("status"))  # one row


def term_at(ids: DataFrame, terms: DataFrame) -> DataFrame:
    """ids with the term that covers each tx_id: the largest term among those that start at it or before.

    Terms become intervals and the intervals the segments they overlap, so the as-of join is an equi-join.
    """
    width = 10_000
    order = Window.orderBy("start_tx_id", "term")  # one row for each term
    latest = terms.groupBy("start_tx_id").agg(F.max("term").alias("term"))
    top = F.max("term").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = ids.agg(F.max("tx_id").alias("_last"))
    spans = latest.select("start_tx_id", top.alias("term"), F.lead("start_tx_id").over(order).alias("next")).crossJoin(F.broadcast(last))  # one row
    spans = spans.withColumn("next", F.coalesce("next", F.greatest(F.col("_last"), F.col("start_tx_id")) + 1)).where("start_tx_id <= _last")
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_tx_id") / width), F.floor((F.col("next") - 1) / width))))
    spans = spans.select("_b", "start_tx_id", "next", "term")
    keyed = ids.withColumn("_b", F.floor(F.col("tx_id") / width))
    return keyed.join(spans, (keyed["_b"] == spans["_b"]) & (keyed["tx_id"] >= spans["start_tx_id"]) & (keyed["tx_id"] < spans["next"]), "left").select(*[keyed[c] for c in ids.columns], "term")


def fenced_statuses(asked: DataFrame, progress: DataFrame, terms: DataFrame) -> DataFrame:
    """Status of each (tx_id, asked_term); TX_NOT_FOUND where another term covers the transaction (asked_term 0: any)."""
    found = term_at(statuses(asked, progress), terms)
    matches = (F.col("asked_term") == 0) | F.coalesce(F.col("term") == F.col("asked_term"), F.lit(False))
    return found.select("tx_id", "asked_term", "term", F.when(matches, F.col("status")).otherwise("TX_NOT_FOUND").alias("status"))


def wait_outcome(asked: DataFrame, progress: DataFrame, terms: DataFrame, level: str) -> DataFrame:
    """REACHED, NOT_FOUND, TERM_MISMATCH or null (not yet) for a level of progress."""
    found = term_at(asked, terms).crossJoin(F.broadcast(progress.limit(1)))  # one row
    outcome = F.when(F.col("tx_id") > F.col("sequence"), "NOT_FOUND").when((F.col("asked_term") != 0) & ~F.coalesce(F.col("term") == F.col("asked_term"), F.lit(False)), "TERM_MISMATCH").when(F.col("tx_id") <= F.col(level), "REACHED")
    return found.select("tx_id", "asked_term", outcome.alias("outcome"))


def touched(entries: DataFrame, opens: DataFrame | None = None, link_events: DataFrame | None = None, flag_events: DataFrame | None = None) -> DataFrame:
    """(account_id, tx_id): each transaction with a follower that names the account; ranges are spread out."""
    rows = entries.select("account_id", "tx_id")
    if opens is not None:
        rows = rows.unionByName(opens.select(F.explode(F.sequence("begin_account_id", F.col("begin_account_id") + F.col("count") - 1)).alias("account_id"), "tx_id"))
    if link_events is not None:
        rows = rows.unionByName(link_events.select(F.explode(F.array("parent_id", "child_id")).alias("account_id"), "tx_id"))
    if flag_events is not None:
        rows = rows.unionByName(flag_events.select("account_id", "tx_id"))
    return rows.distinct()


def account_history(account_id: int, entries: DataFrame, opens: DataFrame | None = None, link_events: DataFrame | None = None, flag_events: DataFrame | None = None, from_tx_id: int = 0, to_tx_id: int = 0) -> DataFrame:
    """(tx_id) newest first; from (0: the newest) and to (0: the oldest) are inclusive.

    The four ways to name an account are filtered before they are united, so the filters reach the files.
    """
    me = F.lit(account_id)
    parts = [entries.where(F.col("account_id") == me).select("tx_id")]
    if opens is not None:
        parts.append(opens.where((F.col("begin_account_id") <= me) & (F.col("begin_account_id") + F.col("count") > me)).select("tx_id"))
    if link_events is not None:
        parts.append(link_events.where((F.col("parent_id") == me) | (F.col("child_id") == me)).select("tx_id"))
    if flag_events is not None:
        parts.append(flag_events.where(F.col("account_id") == me).select("tx_id"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if from_tx_id:
        rows = rows.where(F.col("tx_id") <= from_tx_id)
    if to_tx_id:
        rows = rows.where(F.col("tx_id") >= to_tx_id)
    return rows.distinct().orderBy(F.desc("tx_id"))


def account_index(touched_: DataFrame, account_id: int, from_tx_id: int, limit: int) -> DataFrame:
    """(tx_id) of an account, oldest first from an id on."""
    return touched_.where((F.col("account_id") == account_id) & (F.col("tx_id") >= from_tx_id)).select("tx_id").orderBy("tx_id").limit(limit)


def log_page(tx: DataFrame, from_tx_id: int = 0, to_tx_id: int = 0, limit: int = S.DEFAULT_LOG_LIMIT) -> DataFrame:
    """Whole transactions of a page of records (each has 1 + sub_item_count), with next_tx_id.

    A page ends before the first transaction that would exceed the limit; the first one is kept even if it does alone.
    No more than limit transactions can be in a page, so only so many are summed up.
    """
    limit = min(limit or S.DEFAULT_LOG_LIMIT, S.MAX_LOG_LIMIT)
    rows = tx.where(F.col("tx_id") >= max(1, from_tx_id))
    if to_tx_id:
        rows = rows.where(F.col("tx_id") <= to_tx_id)
    first = rows.orderBy("tx_id").limit(limit)
    order = Window.orderBy("tx_id")
    sized = first.withColumns({"records_upto": F.sum(F.col("sub_item_count") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(order)})
    page = sized.where((F.col("records_upto") <= limit) | (F.col("n") == 1)).drop("n")
    return page.withColumn("next_tx_id", F.max("tx_id").over(Window.partitionBy()) + 1)


def bounded_scan(tx: DataFrame, matches: Column, from_tx_id: int, max_scan: int) -> DataFrame:
    """Matching transactions, newest first, among those that begin within the first max_scan records looked at."""
    newest = tx.where(F.col("tx_id") <= from_tx_id).orderBy(F.desc("tx_id")).limit(max_scan)  # each has a record at least
    before = F.coalesce(F.sum(F.col("sub_item_count") + 1).over(Window.orderBy(F.desc("tx_id")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return newest.withColumn("before", before).where((F.col("before") < max_scan) & matches).drop("before").orderBy(F.desc("tx_id"))


def scan_single(tx: DataFrame, matches: Column, from_tx_id: int) -> DataFrame:
    return tx.where((F.col("tx_id") <= from_tx_id) & matches).orderBy(F.desc("tx_id")).limit(1)


def terms_and_votes(terms: DataFrame, votes: DataFrame, from_term: int = 0, limit: int = 0) -> DataFrame:
    """Full outer merge of the term and vote logs, ascending; with a limit also next_term, null at the end."""
    merged = terms.join(votes, "term", "full").where(F.col("term") >= from_term).select("term", "start_tx_id", "voted_for")
    if not limit:
        return merged.orderBy("term")
    page = merged.orderBy("term").limit(limit + 1)
    order = Window.orderBy("term")
    return page.withColumns({"n": F.row_number().over(order), "next_term": F.max(F.struct(F.col("term"))).over(Window.partitionBy())["term"], "total": F.count("*").over(Window.partitionBy())}).select("term", "start_tx_id", "voted_for", F.when(F.col("total") > limit, F.col("next_term")).alias("next_term"), "n").where(F.col("n") <= limit).drop("n")


def newest(df: DataFrame, order: str, limit: int, default: int, cap: int) -> DataFrame:
    """The newest rows: elections by term, faults by number, runs by start."""
    return df.orderBy(F.desc(order)).limit(min(limit or default, cap))


def kv_value(kv: DataFrame, key: str) -> DataFrame:
    return kv.where(F.col("key_str") == key)


def constant(constants: DataFrame, name: str) -> DataFrame:
    return constants.where(F.col("name") == name)


def segment_bounds(tx: DataFrame) -> DataFrame:
    return tx.groupBy("segment_id").agg(F.min("tx_id").alias("first_tx_id"), F.max("tx_id").alias("last_tx_id"))


def first_after(tx: DataFrame, watermark: int) -> DataFrame:
    return tx.where(F.col("tx_id") > watermark).agg(F.min("tx_id").alias("tx_id"))


def opened(tx: DataFrame, opens: DataFrame) -> DataFrame:
    """What each OpenAccount transaction gave: its range, or 0 and 0 where it failed."""
    found = tx.where("tag = 'OPENACC'").join(opens.select("tx_id", "begin_account_id", "count"), "tx_id", "left")
    return found.select("tx_id", "fail_reason", F.coalesce("begin_account_id", F.lit(0)).alias("begin_account_id"), F.coalesce("count", F.lit(0)).alias("count"))
