"""The tables of a ledger, and its fixed codes.

Sign rule: a DEBIT adds to an account's balance, a CREDIT subtracts. Account 0 is SYSTEM. Amounts are integer minor units.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

OPS = "tx_id long, op string, account long, from long, to long, amount long, count long, fn_name string, params array<long>, user_ref long"
TX = "tx_id long, fail_reason int, sub_item_count int, ts_ns long, user_ref long, tag string, segment_id long"
ENTRIES = "tx_id long, seq int, kind string, account_id long, amount long, computed_balance long, segment_id long"
TX_LINKS = "tx_id long, kind string, to_tx_id long"
OPENS = "tx_id long, seq int, begin_account_id long, count long, flags long, user_ref long"
LINK_EVENTS = "tx_id long, seq int, parent_id long, type_id int, child_id long"
FLAG_EVENTS = "tx_id long, seq int, account_id long, prev_flags long, new_flags long"
KV_EVENTS = "tx_id long, seq int, key_str string, key array<struct<kind:string,i:long,s:string>>, value struct<kind:string,i:long,s:string>, is_delete boolean"
CONSTANTS = "id long, name string"
FN_EVENTS = "tx_id long, name string, version int, crc32c long"
TERMS = "term long, start_tx_id long"
VOTES = "term long, voted_for long"
SAMPLES = "at_ms long, node_idx int, compute long, commit long, snapshot long, cluster_commit long, is_leader boolean"
PROBES = "at_ms long, level int, latency_ns long"

SYSTEM = 0

# Reasons for which a transaction fails; 128 to 255 are a program's own.
NONE = 0
INSUFFICIENT_FUNDS = 1
ACCOUNT_NOT_FOUND = 2
ZERO_SUM_VIOLATION = 3
ENTRY_LIMIT_EXCEEDED = 4
INVALID_OPERATION = 5
DUPLICATE = 7
PROHIBITED_HOST_CALL = 8
CONSTANT_NOT_FOUND = 9
CONSTANT_NAME_TOO_LONG = 10

# An account's status, the lowest byte of its flags.
NOT_EXISTENT, OPEN, PROGRAMMED, SYSTEM_STATUS = 0, 1, 2, 3

# The tag of each kind of transaction.
TAGS = {"Deposit": "DEPOSIT", "Withdrawal": "WITHDRAW", "Transfer": "TRANSFER", "OpenAccount": "OPENACC", "FunctionRegistration": "FNREG", "NewTerm": "NEWTERM"}
DUPLICATE_TAG = "DUPLICAT"

MAX_ENTRIES = 65_535
MAX_AMOUNT = (1 << 63) - 1
DEFAULT_LOG_LIMIT, MAX_LOG_LIMIT = 1000, 10_000
DEFAULT_ELECTIONS, MAX_ELECTIONS = 16, 256
DEFAULT_FAULTS, MAX_FAULTS = 64, 1000
DEFAULT_RUNS, MAX_RUNS = 32, 256


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
