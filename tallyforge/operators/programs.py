"""User programs: transactions of several entries, declared as column expressions over their parameters.

A program names who pays how much, who gets what, and which flags and keys it sets. It succeeds if the payer's balance covers
the amount; then all its effects hold, else none. That is one outgoing leg and some incoming ones, so programs run in the same
fold as transfers: accounts are scanned side by side, and no state of a ledger is ever held by one task.

An account may be given as Linked(parent, type): the account linked to a parent under a type, made when a program that
succeeds first mentions it. Until then it goes by a negative number made of parent and type. SYSTEM may pay without limit.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge import schemas as S
from tallyforge.functions.text import is_function_name
from tallyforge.operators.prefix import row_numbers



class Params:
    """The parameters of a call; one that is missing is null."""

    def __init__(self, array: Column):
        self.array = array

    def __getitem__(self, k: int) -> Column:
        return F.get(self.array, F.lit(k))


Expression = Callable[[Params], Column]
#: Width in transactions of the blocks by which calls meet registrations.
BLOCK = 10_000
TYPES = 256


@dataclass(frozen=True)
class Linked:
    parent: Expression
    type_id: int


@dataclass(frozen=True)
class Program:
    """Each expression takes the parameters. gets must add up to the amount paid; short is the code of a payer who lacks it."""

    payer: Expression | Linked
    amount: Expression
    gets: tuple[tuple[Expression | Linked, Expression], ...]
    short: int = S.INSUFFICIENT_FUNDS
    flags: tuple[tuple[Expression, int, Expression], ...] = ()
    keys: tuple[tuple[Expression, Expression], ...] = ()
    source: bytes = b""

    @property
    def checksum(self) -> int:
        return zlib.crc32(self.source) or 1


def account_of(who: Expression | Linked, params: Params) -> Column:
    if isinstance(who, Linked):
        return (-(who.parent(params) * TYPES + who.type_id) - 1).cast("long")
    return who(params).cast("long")


def registrations(ops: DataFrame, programs: dict[str, Program]) -> DataFrame:
    """FN_EVENTS of FunctionRegistration operations: a name without a program is unregistered (a checksum of 0); bad names are dropped."""
    crc = F.lit(0)
    for name, program in programs.items():
        crc = F.when(F.col("fn_name") == name, program.checksum).otherwise(crc)
    events = ops.where("op = 'FunctionRegistration'").select("tx_id", F.col("fn_name").alias("name"), crc.cast("long").alias("crc32c"))
    return function_versions(events)


def registered(calls: DataFrame, events: DataFrame) -> DataFrame:
    """calls (tx_id, fn_name, ...) whose name was last registered, not unregistered, before them."""
    order = Window.partitionBy("name").orderBy("tx_id")  # the registrations of a name
    last = calls.agg(F.max("tx_id").alias("_last"))
    spans = events.select("name", F.col("tx_id").alias("_from"), F.lead("tx_id").over(order).alias("_next"), "crc32c").where("crc32c <> 0").crossJoin(F.broadcast(last))  # one row
    spans = spans.withColumn("_next", F.coalesce("_next", F.col("_last"))).where("_from < _last")
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / BLOCK), F.floor(F.col("_next") / BLOCK)))).select("_b", "name", "_from", "_next")
    keyed = calls.withColumn("_b", F.floor(F.col("tx_id") / BLOCK))
    met = (keyed["_b"] == spans["_b"]) & (keyed["fn_name"] == spans["name"]) & (keyed["tx_id"] > spans["_from"]) & (keyed["tx_id"] <= spans["_next"])
    return keyed.join(spans, met, "left_semi").drop("_b")


def resolve(ops: DataFrame, programs: dict[str, Program], known: DataFrame) -> DataFrame:
    """(tx_id, f_early, f_short, f_src, f_amount, f_legs, f_flags, f_keys) of Function operations; known (account_id, open_tx_id) are the accounts."""
    calls = ops.where("op = 'Function'").select("tx_id", "fn_name", F.coalesce("params", F.array().cast("array<long>")).alias("p"))
    live = registered(calls, registrations(ops, programs))
    p, out = Params(F.col("p")), None
    none = lambda kind: F.array().cast(f"array<{kind}>")
    for name, program in programs.items():
        legs = F.array(*[F.struct(account_of(a, p).alias("account_id"), v(p).cast("long").alias("amount")) for a, v in program.gets])
        flags = F.array(*[F.struct(account_of(a, p).alias("account_id"), F.lit(lane).alias("lane"), v(p).cast("int").alias("value")) for a, lane, v in program.flags]) if program.flags else none("struct<account_id:long,lane:int,value:int>")
        keys = F.array(*[F.struct(k(p).cast("string").alias("key_str"), v(p).cast("long").alias("value")) for k, v in program.keys]) if program.keys else none("struct<key_str:string,value:long>")
        rows = live.where(F.col("fn_name") == name).select("tx_id", F.lit(program.short).alias("f_short"), account_of(program.payer, p).alias("f_src"), program.amount(p).cast("long").alias("f_amount"), legs.alias("f_legs"), flags.alias("f_flags"), keys.alias("f_keys"))
        out = rows if out is None else out.unionByName(rows)
    named = out.select("tx_id", F.explode(F.concat(F.array("f_src"), F.col("f_legs.account_id"), F.col("f_flags.account_id"))).alias("account_id"))
    # Of a linked account its parent must be there.
    named = named.withColumn("account_id", F.when(F.col("account_id") < 0, F.floor((-F.col("account_id") - 1) / TYPES)).otherwise(F.col("account_id"))).where("account_id <> 0")
    missing = named.join(known, "account_id", "left").where("open_tx_id IS NULL OR open_tx_id >= tx_id").select("tx_id").distinct().withColumn("absent", F.lit(True))
    total = F.aggregate("f_legs", F.lit(0).cast("long"), lambda a, x: a + x["amount"])
    least = F.aggregate("f_legs", F.col("f_amount"), lambda a, x: F.least(a, x["amount"]))
    early = (
        F.when(F.col("f_src").isNull(), S.INVALID_OPERATION)
        .when(F.col("absent"), S.ACCOUNT_NOT_FOUND)
        .when(F.coalesce(total != F.col("f_amount"), F.lit(True)), S.ZERO_SUM_VIOLATION)
        .when(least < 0, S.INVALID_OPERATION)
        .when(1 + F.size("f_legs") + F.size("f_flags") + F.size("f_keys") > S.MAX_ENTRIES, S.ENTRY_LIMIT_EXCEEDED)
        .otherwise(S.NONE)
    )
    return calls.select("tx_id").join(out.join(missing, "tx_id", "left"), "tx_id", "left").select("tx_id", early.alias("f_early"), "f_short", "f_src", "f_amount", "f_legs", "f_flags", "f_keys")


def linked_of(entries: DataFrame, first: int) -> DataFrame:
    """LINK_EVENTS, and the number (handle) that stands for each account made: ids from first on in the order of first mention."""
    made = entries.where("account_id < 0").groupBy("account_id").agg(F.min(F.struct("tx_id", "seq")).alias("at"))
    code = -F.col("account_id") - 1
    rows = row_numbers(made.select(F.col("account_id").alias("handle"), "at.tx_id", "at.seq", F.floor(code / TYPES).alias("parent_id"), (code % TYPES).cast("int").alias("type_id")), ["tx_id", "seq"], "child_id", first)
    return rows.select("handle", "tx_id", "seq", "parent_id", "type_id", "child_id")


def flag_changes(done: DataFrame) -> DataFrame:
    """FLAG_EVENTS without what was before: (tx_id, seq, account_id, lane, value) of accepted programs."""
    return done.select("tx_id", F.posexplode("f_flags").alias("seq", "f")).select("tx_id", "seq", "f.*")


def key_changes(done: DataFrame) -> DataFrame:
    """KV_EVENTS of accepted programs."""
    rows = done.select("tx_id", F.posexplode("f_keys").alias("seq", "f"))
    value = F.struct(F.lit("Int").alias("kind"), F.col("f.value").alias("i"), F.lit(None).cast("string").alias("s"))
    return rows.select("tx_id", "seq", "f.key_str", F.lit(None).cast("array<struct<kind:string,i:long,s:string>>").alias("key"), value.alias("value"), F.lit(False).alias("is_delete"))


def function_versions(events: DataFrame) -> DataFrame:
    """Registrations (tx_id, name, crc32c) with their version: one more than any before of the name; bad names are dropped."""
    good = events.where(is_function_name(F.col("name")))
    w = Window.partitionBy("name").orderBy("tx_id").rowsBetween(Window.unboundedPreceding, 0)
    return good.withColumn("version", F.sum(F.when(F.col("crc32c") != 0, 1).otherwise(0)).over(w).cast("int"))
