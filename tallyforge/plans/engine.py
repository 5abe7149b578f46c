"""A ledger on files: operations in, log and state out.

Every change is a folder of tables and then one numbered commit that names it. What a lost driver leaves behind is named by
no commit: nobody reads it, and submitting the same operations again gives what a first attempt would have given. Of two
writers that go on from one state, the second is refused. State is the newest checkpoint and the log after it, so a batch
reads neither the log before the checkpoint nor references that have expired.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas as S
from tallyforge.operators.dedup import checks_of, last_windows
from tallyforge.operators.fold import execute
from tallyforge.plans import reads, state
from tallyforge.sources import wal
from tallyforge.sources.commits import CommitLog
from tallyforge.sources.config import LedgerConfig

#: State tables of a checkpoint.
CHECKPOINT = {
    "accounts": "account_id long, balance long, flags long",
    "links": "parent_id long, type_id int, child_id long",
    "kv": "key_str string, value struct<kind:string,i:long,s:string>",
    "functions": "name string, version int, crc32c long",
}


class LedgerEngine:
    """Runs batches of operations on what the log holds."""

    def __init__(self, spark: SparkSession, config: LedgerConfig):
        self.spark, self.config = spark, config
        self.commits = CommitLog(spark, f"{config.root}/commits")

    def history(self) -> list[dict]:
        """The commits in order; a batch below a later cut has the cut's transaction as upto, a checkpoint above it is left out."""
        out: list[dict] = []
        for number, text in sorted(self.commits.texts().items()):
            commit = json.loads(text) | {"number": number}
            if commit["kind"] == "cut":
                for x in out:
                    x["upto"] = min(x.get("upto", commit["upto"]), commit["upto"])
            out.append(commit)
        return out

    def _publish(self, history: list[dict], **commit) -> None:
        number = history[-1]["number"] + 1 if history else 1
        if not self.commits.publish(json.dumps(commit), number):
            raise RuntimeError(f"commit {number} is taken: another writer was first; submit again")

    def table(self, name: str, history: list[dict] | None = None, after: int = 0) -> DataFrame:
        """The committed rows of a table, or those after a commit."""
        own = [c for c in (self.history() if history is None else history) if c["kind"] == "batch" and c["number"] > after and name in c["tables"]]
        out = self.spark.createDataFrame([], wal.TABLES[name])
        for upto in sorted({c.get("upto", -1) for c in own}):
            rows = self.spark.read.schema(wal.TABLES[name]).parquet(*[f"{self.config.root}/batches/{c['folder']}/{name}" for c in own if c.get("upto", -1) == upto])
            out = out.unionByName((rows if upto < 0 or "tx_id" not in rows.columns else state.until(rows, upto)).select(out.columns))
        return out

    def last_tx_id(self) -> int:
        history = self.history()
        return history[-1]["last_tx_id"] if history else 0

    def _base(self, history: list[dict]) -> dict | None:
        """The newest checkpoint."""
        return next((c for c in reversed(history) if c["kind"] == "checkpoint"), None)

    def state(self, name: str, history: list[dict] | None = None) -> DataFrame:
        """One of the tables of CHECKPOINT as of the last commit: the newest checkpoint, carried on over the log after it."""
        history = self.history() if history is None else history
        at = self._base(history)
        base = self.spark.read.schema(CHECKPOINT[name]).parquet(f"{self.config.root}/checkpoints/{at['folder']}/{name}") if at else self.spark.createDataFrame([], CHECKPOINT[name])
        tail = lambda table: self.table(table, history, at["number"] if at else 0)
        if name == "accounts":
            return state.accounts_after(base, tail("entries"), tail("opens"), tail("flag_events"))
        events = tail({"links": "link_events", "kv": "kv_events", "functions": "fn_events"}[name])
        first = base.withColumns({"tx_id": F.lit(0).cast("long"), "seq": F.lit(-1), "is_delete": F.lit(False)})
        first = first.select([c for c in events.columns if c in first.columns])
        return {"links": state.links, "kv": state.kv, "functions": lambda e: state.functions(e, live_only=False)}[name](first.unionByName(events.select(first.columns)))

    def accounts(self) -> DataFrame:
        return self.state("accounts")

    def submit(self, ops: DataFrame, effects: dict[str, DataFrame] | None = None) -> DataFrame:
        """Run operations with ids above the last one; returns their transactions. effects are further log tables of the batch."""
        history, size, w = self.history(), self.config.transactions_per_segment, self.config.dedup_window
        before = history[-1] if history else {"last_tx_id": 0, "next_account": 1, "windows": []}
        last = before["last_tx_id"]
        if ops.where(F.col("tx_id") <= last).limit(1).count():
            raise ValueError(f"tx_id must exceed {last}")
        prior = None
        if last:
            since = before["windows"][0] if before["windows"] else 0
            prior = self.table("tx", history).where((F.col("tx_id") >= since) & (F.col("user_ref") != 0))
        ledger = execute(ops, w, size, accounts=self.state("accounts", history) if last else None, next_account=before["next_account"], prior=prior)
        folder = uuid.uuid4().hex
        path = f"{self.config.root}/batches/{folder}"
        made = {"opens": ledger.opens, "tx_links": ledger.tx_links, "entries": ledger.entries, "tx": ledger.tx, **(effects or {})}
        for name, rows in made.items():
            wal.append(rows, path, name, folders=False)
        tx, opens = (self.spark.read.schema(wal.TABLES[name]).parquet(f"{path}/{name}") for name in ("tx", "opens"))
        top = max(last, tx.agg(F.max("tx_id")).first()[0] or 0)
        following = max(before["next_account"], state.next_account_id(opens, effects and effects.get("link_events")).first()[0])
        windows = last_windows(checks_of(tx, prior), w) or before["windows"]
        self._publish(history, kind="batch", folder=folder, tables=sorted(made), last_tx_id=top, next_account=following, windows=windows)
        base = self._base(history)
        closed = top // size - (base["last_tx_id"] // size if base else 0)
        if closed >= self.config.snapshot_frequency:
            self.checkpoint()
        return tx

    def checkpoint(self) -> None:
        """Write the state as of the last commit; later states go on from it, and what it covers cannot be cut any more."""
        history = self.history()
        if not history or history[-1]["kind"] == "checkpoint":
            return
        folder = uuid.uuid4().hex
        for name, columns in CHECKPOINT.items():
            key = columns.split()[0]
            self.state(name, history).repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{self.config.root}/checkpoints/{folder}/{name}")
        self._publish(history, kind="checkpoint", folder=folder, **{k: history[-1][k] for k in ("last_tx_id", "next_account", "windows")})

    def snapshot(self, at_least: int = 0) -> DataFrame | None:
        """The accounts of the newest checkpoint, if it covers a transaction; bounded staleness without the log."""
        at = self._base(self.history())
        return self.spark.read.schema(CHECKPOINT["accounts"]).parquet(f"{self.config.root}/checkpoints/{at['folder']}/accounts") if at and at["last_tx_id"] >= at_least else None

    def cut(self, upto: int) -> None:
        """Recover the ledger as it stood at a transaction; refused if a checkpoint covers a later one."""
        history = self.history()
        base = self._base(history)
        if base and base["last_tx_id"] > upto:
            raise ValueError(f"a checkpoint covers transactions up to {base['last_tx_id']}")
        opens, tx = state.until(self.table("opens", history), upto), state.until(self.table("tx", history), upto)
        next_account = state.next_account_id(opens, state.until(self.table("link_events", history), upto)).first()[0]
        top = tx.agg(F.max("tx_id")).first()[0] or 0
        self._publish(history, kind="cut", upto=upto, last_tx_id=top, next_account=next_account, windows=last_windows(checks_of(tx), self.config.dedup_window))

    def submit_and_read(self, ops: DataFrame) -> DataFrame:
        """Run operations and return their whole transactions."""
        tx = self.submit(ops)
        return reads.transactions(tx, self.table("entries"), tx.select("tx_id"))

    def open_accounts(self, tx_id: int, count: int) -> DataFrame:
        """Open a range of accounts and read it back from the committed transaction."""
        row = {"tx_id": tx_id, "op": "OpenAccount", "count": count, "user_ref": 0}
        self.submit(self.spark.createDataFrame([tuple(row.get(f.name) for f in S.schema(S.OPS))], S.OPS))
        return reads.opened(self.table("tx"), self.table("opens")).where(F.col("tx_id") == tx_id)

    def views(self) -> None:
        """Register the log's tables and the state for SQL."""
        history = self.history()
        for name in wal.TABLES:
            self.table(name, history).createOrReplaceTempView(name)
        self.state("accounts", history).createOrReplaceTempView("accounts")
