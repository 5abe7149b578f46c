"""The fold as a stream: operations arrive in files, state is kept per account, results are merged idempotently.

Two forms: judged() keeps a balance for each account in the stream's state, for deposits and withdrawals on open accounts;
submitted() gives every micro-batch to a LedgerEngine, which adds openings, transfers between accounts and references that
expire by count, with one commit a batch. Order across micro-batches is that of the source; within one, a key's rows are sorted by tx_id, and rows at or below the last
id that a key has seen are dropped as late. Windows are counted in transactions, so no event-time watermark is used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge import schemas as S
from tallyforge.plans.engine import LedgerEngine

JUDGED = "account_id long, tx_id long, fail_reason int, change long, computed_balance long"


def read_ops(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Operations from Parquet files in the order of their arrival; few files a trigger hold back what is in flight."""
    return spark.readStream.schema(S.OPS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fold_account(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Deposits and withdrawals of one account on (balance, last tx_id)."""
    balance, last = state.get if state.exists else (0, 0)
    rows = pd.concat(list(frames)).sort_values("tx_id")
    out = []
    for tx_id, op, amount in zip(rows["tx_id"], rows["op"], rows["amount"], strict=True):
        if tx_id <= last:
            continue
        last = int(tx_id)
        if op == "Withdrawal" and balance < amount:
            out.append((key[0], last, S.INSUFFICIENT_FUNDS, 0, balance))
            continue
        change = int(amount) if op == "Deposit" else -int(amount)
        balance += change
        out.append((key[0], last, S.NONE, change, balance))
    state.update((balance, last))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in JUDGED.split(", ")])


def judged(ops: DataFrame) -> DataFrame:
    """JUDGED rows of a stream of deposits and withdrawals on open accounts."""
    own = ops.where(F.col("op").isin("Deposit", "Withdrawal")).select(F.col("account").alias("account_id"), "tx_id", "op", "amount")
    return own.groupBy("account_id").applyInPandasWithState(fold_account, JUDGED, "balance long, last long", "append", GroupStateTimeout.NoTimeout)


def segments_seen(tx: DataFrame, size: int) -> DataFrame:
    """Count-based tumbling windows of a stream: transactions and last id of each segment so far."""
    return tx.groupBy((F.floor((F.col("tx_id") - 1) / size) + 1).alias("segment_id")).agg(F.count("*").alias("n"), F.max("tx_id").alias("last_tx_id"))


def write_batches(rows: DataFrame, root: str, checkpoint: str) -> Callable:
    """Append each micro-batch to root/batch=<id>, replacing what a failed attempt at it left; returns the started query."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def submitted(ops: DataFrame, engine: LedgerEngine, checkpoint: str):
    """Submit a stream of operations batch by batch; returns the started query.

    A batch that is run again after its commit finds its ids taken and adds nothing; rows at or below the last id are late.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        new = batch.where(F.col("tx_id") > engine.last_tx_id())
        if not new.isEmpty():
            engine.submit(new)

    return ops.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query) -> dict:
    """Monotone marks of a running query: batches done and rows read."""
    done = query.recentProgress
    return {"batches": len(done), "rows": sum(p["numInputRows"] for p in done), "last_batch": done[-1]["batchId"] if done else -1}
