"""Golden cases of the fold, the log's files, recovery, programs and streaming."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas as S
from tallyforge.operators import programs
from tallyforge.operators.dedup import duplicates
from tallyforge.operators.fold import execute
from tallyforge.plans import engine as engine_module
from tallyforge.plans import state
from tallyforge.plans.engine import LedgerEngine
from tallyforge.sources import ndjson
from tallyforge.sources.config import LedgerConfig
from tallyforge.streaming import ledger_stream

FIELDS = [x.split()[0] for x in S.OPS.split(", ")]


def frame(spark, rows, first=1):
    """Operations as dicts, numbered from first on."""
    return spark.createDataFrame([tuple({"tx_id": first + i, **r}.get(f) for f in FIELDS) for i, r in enumerate(rows)], S.OPS)


def open_(count=1):
    return {"op": "OpenAccount", "count": count}


def deposit(account, amount, ref=0):
    return {"op": "Deposit", "account": account, "amount": amount, "user_ref": ref}


def withdraw(account, amount):
    return {"op": "Withdrawal", "account": account, "amount": amount}


def transfer(a, b, amount):
    return {"op": "Transfer", "from": a, "to": b, "amount": amount}


def run(spark, rows, **options):
    ledger = execute(frame(spark, rows), **options)
    balances = {r.account_id: r.balance for r in state.balances(ledger.entries).collect()}
    reasons = {r.tx_id: r.fail_reason for r in ledger.tx.collect()}
    return balances, reasons, ledger


def plain(rows):
    """The same operations one after the other."""
    balance, opened, reasons = {0: 0}, set(), {}
    for i, r in enumerate(rows, 1):
        op, amount = r["op"], r.get("amount") or 0
        src = {"Withdrawal": r.get("account"), "Transfer": r.get("from")}.get(op)
        dst = {"Deposit": r.get("account"), "Transfer": r.get("to")}.get(op)
        reasons[i] = S.NONE
        if op == "OpenAccount":
            opened |= {len(opened) + 1 + k for k in range(max(1, r["count"] or 1))}
        elif any(a is not None and a not in opened for a in (src, dst)):
            reasons[i] = S.ACCOUNT_NOT_FOUND
        elif src is not None and src != dst and balance.get(src, 0) < amount:
            reasons[i] = S.INSUFFICIENT_FUNDS
        elif src != dst:
            a, b = 0 if src is None else src, 0 if dst is None else dst
            balance[a] = balance.get(a, 0) - amount
            balance[b] = balance.get(b, 0) + amount
    return balance, reasons


def test_golden_amounts(spark):
    balances, reasons, _ = run(spark, [open_(3), deposit(1, 42), deposit(2, 0), deposit(3, 100), transfer(3, 3, 50), transfer(3, 1, 1000), withdraw(3, 200), deposit(0, 5), deposit(9, 5), deposit(1, -1)])
    assert balances == {0: -142, 1: 42, 2: 0, 3: 100}
    assert reasons == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: S.INSUFFICIENT_FUNDS, 7: S.INSUFFICIENT_FUNDS, 8: S.ACCOUNT_NOT_FOUND, 9: S.ACCOUNT_NOT_FOUND, 10: S.INVALID_OPERATION}


def test_open_zero_is_one_and_an_account_exists_after_it_is_opened(spark):
    balances, reasons, ledger = run(spark, [deposit(1, 5), open_(0), deposit(1, 7), deposit(2, 7)])
    assert balances == {0: -7, 1: 7} and reasons[1] == reasons[4] == S.ACCOUNT_NOT_FOUND
    assert [(r.begin_account_id, r["count"]) for r in ledger.opens.collect()] == [(1, 1)]


def test_duplicates_point_to_the_first(spark):
    balances, reasons, ledger = run(spark, [open_(1), deposit(1, 1000, 42), deposit(1, 1000, 42), deposit(1, 1000, 42)])
    assert balances[1] == 1000 and reasons[3] == reasons[4] == S.DUPLICATE
    assert {(r.tx_id, r.to_tx_id) for r in ledger.tx_links.collect()} == {(3, 2), (4, 2)}


def test_references_expire_after_two_windows(spark):
    ops = spark.createDataFrame([(1, 5), (12, 5), (23, 5)], "tx_id long, user_ref long")
    assert {(r.tx_id, r.to_tx_id) for r in duplicates(ops, 10).collect()} == {(12, 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations_equal_a_sequential_run(spark, seed):
    rng = random.Random(seed)
    rows = [open_(12)]
    for _ in range(700):
        a, b = rng.randrange(1, 14), rng.randrange(1, 14)
        rows.append(rng.choice([deposit(a, rng.randrange(99)), withdraw(a, rng.randrange(120)), transfer(a, b, rng.randrange(90))]))
    balances, reasons, ledger = run(spark, rows)
    want, why = plain(rows)
    assert reasons == why
    assert balances == {a: b for a, b in want.items() if a in balances} and sum(balances.values()) == 0


def test_engine_continues_and_recovers(spark, tmp_path):
    engine = LedgerEngine(spark, LedgerConfig(root=f"file://{tmp_path}/log", transactions_per_segment=4))
    first = [open_(2), deposit(1, 100), transfer(1, 2, 30)]
    second = [withdraw(1, 71), transfer(2, 1, 5), open_(1), deposit(3, 1)]
    engine.submit(frame(spark, first))
    engine.submit(frame(spark, second, 4))
    held = {r.account_id: r.balance for r in engine.accounts().collect()}
    want, why = plain(first + second)
    assert {a: b for a, b in held.items() if a} == {a: b for a, b in want.items() if a}
    assert {r.tx_id: r.fail_reason for r in engine.table("tx").collect()} == why
    with pytest.raises(ValueError, match="exceed"):
        engine.submit(frame(spark, [deposit(1, 1)], 7))


@pytest.mark.parametrize("lost", ["entries", "tx", "commit"])
def test_a_batch_lost_before_its_commit_can_be_submitted_again(spark, tmp_path, monkeypatch, lost):
    engine = LedgerEngine(spark, LedgerConfig(root=f"file://{tmp_path}/log", transactions_per_segment=100))
    engine.submit(frame(spark, [open_(1), deposit(1, 100)]))
    append = engine_module.wal.append

    def failing(df, root, name, folders):
        append(df, root, name, folders)
        if name == lost:
            raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(engine_module.wal, "append", failing)
        if lost == "commit":
            m.setattr(engine.commits, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            engine.submit(frame(spark, [deposit(1, 100)], 3))
    assert engine.last_tx_id() == 2
    engine.submit(frame(spark, [deposit(1, 7)], 3))
    assert {r.account_id: r.balance for r in engine.accounts().collect()} == {0: -107, 1: 107}
    assert engine.table("entries").where("tx_id = 3").count() == 2


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    config = LedgerConfig(root=f"file://{tmp_path}/log", transactions_per_segment=100)
    a, b = LedgerEngine(spark, config), LedgerEngine(spark, config)
    a.submit(frame(spark, [open_(1), deposit(1, 100)]))
    seen = b.history()
    a.submit(frame(spark, [withdraw(1, 80)], 3))
    b.history = lambda: seen
    with pytest.raises(RuntimeError, match="another writer"):
        b.submit(frame(spark, [withdraw(1, 80)], 3))
    assert {r.account_id: r.balance for r in a.accounts().collect()} == {0: -20, 1: 20}


def test_checkpoints_and_tail_equal_one_run(spark, tmp_path):
    """Random batches with references, checkpoints at a cadence: state, transactions and links are those of one execution."""
    rng = random.Random(5)
    rows = [open_(4)]
    for i in range(1, 90):
        a, ref = rng.randrange(1, 7), rng.choice([0, 0, rng.randrange(1, 9)])
        rows.append(rng.choice([deposit(a, rng.randrange(50), ref), {**withdraw(a, rng.randrange(60)), "user_ref": ref}, transfer(a, rng.randrange(1, 7), rng.randrange(40)), open_(1) if i % 20 == 0 else deposit(a, 1)]))
    config = LedgerConfig(root=f"file://{tmp_path}/log", transactions_per_segment=8, snapshot_frequency=3)
    engine = LedgerEngine(spark, config)
    for lo in range(0, 90, 18):
        engine.submit(frame(spark, rows[lo : lo + 18], lo + 1))
    whole = execute(frame(spark, rows), config.dedup_window, config.transactions_per_segment)
    assert sum(c["kind"] == "checkpoint" for c in engine.history()) >= 2
    assert sorted(map(tuple, engine.accounts().collect())) == sorted(map(tuple, state.accounts(whole.entries, whole.opens).collect()))
    columns = ["tx_id", "fail_reason", "sub_item_count", "user_ref", "tag", "segment_id"]
    assert sorted(map(tuple, engine.table("tx").select(columns).collect())) == sorted(map(tuple, whole.tx.select(columns).collect()))
    assert sorted(map(tuple, engine.table("entries").collect())) == sorted(map(tuple, whole.entries.select(engine.table("entries").columns).collect()))
    assert sorted(map(tuple, engine.table("tx_links").collect())) == sorted(map(tuple, whole.tx_links.select("tx_id", "kind", "to_tx_id").collect()))
    assert engine.snapshot(at_least=1000) is None and engine.snapshot().count() > 0


def test_cut_recovers_and_checkpoints_refuse_it(spark, tmp_path):
    rows = [open_(2), deposit(1, 100), transfer(1, 2, 30), withdraw(2, 10), open_(3), deposit(1, 5, 77)]
    engine = LedgerEngine(spark, LedgerConfig(root=f"file://{tmp_path}/log", transactions_per_segment=100))
    engine.submit(frame(spark, rows[:3]))
    engine.submit(frame(spark, rows[3:], 4))
    engine.cut(4)
    want, _ = plain(rows[:4])
    assert engine.last_tx_id() == 4 and {r.account_id: r.balance for r in engine.accounts().collect()} == want
    again = engine.submit(frame(spark, [deposit(1, 9, 77), open_(1)], 5)).collect()
    assert all(r.fail_reason == 0 for r in again)
    opened = engine.open_accounts(7, 2).first()
    assert (opened.begin_account_id, opened["count"]) == (4, 2)
    engine.checkpoint()
    with pytest.raises(ValueError, match="covers"):
        engine.cut(5)


def test_checkpoints_hold_links_keys_and_functions(spark, tmp_path):
    engine = LedgerEngine(spark, LedgerConfig(root=f"file://{tmp_path}/log", transactions_per_segment=100))
    frame_of = lambda name, rows: spark.createDataFrame(rows, S.schema(getattr(S, name)))
    number = lambda i: ("Int", i, None)
    engine.submit(frame(spark, [open_(2)]), {
        "link_events": frame_of("LINK_EVENTS", [(1, 0, 1, 5, 50), (1, 1, 2, 5, 51)]), "fn_events": frame_of("FN_EVENTS", [(1, "f", 1, 9), (1, "g", 1, 8)]),
        "kv_events": frame_of("KV_EVENTS", [(1, 0, "a", None, number(1), False), (1, 1, "b", None, number(2), False)]),
    })
    engine.checkpoint()
    engine.submit(frame(spark, [deposit(1, 3)], 2), {
        "link_events": frame_of("LINK_EVENTS", [(2, 0, 1, 6, 52)]), "fn_events": frame_of("FN_EVENTS", [(2, "g", 1, 0)]),
        "kv_events": frame_of("KV_EVENTS", [(2, 0, "a", None, number(7), False), (2, 1, "b", None, None, True)]),
    })
    assert {(r.parent_id, r.type_id, r.child_id) for r in engine.state("links").collect()} == {(1, 5, 50), (2, 5, 51), (1, 6, 52)}
    assert {r.key_str: r.value.i for r in engine.state("kv").collect()} == {"a": 7}
    assert {r.name: (r.version, r.crc32c) for r in engine.state("functions").collect()} == {"f": (1, 9), "g": (1, 0)}
    assert engine.open_accounts(3, 1).first().begin_account_id == 53
    engine.views()
    assert spark.sql("SELECT count(*) AS n FROM link_events").first().n == 3


def test_ndjson_is_an_inverse_and_refuses_broken_groups(spark, tmp_path):
    _, _, ledger = run(spark, [open_(2), deposit(1, 9), transfer(1, 2, 4), withdraw(1, 50)])
    log = ndjson.records(ledger.tx, ledger.entries, ledger.tx_links, ledger.opens)
    ndjson.unpack(log, f"file://{tmp_path}/a")
    back = ndjson.pack(spark, f"file://{tmp_path}/a")
    assert sorted(map(str, back.collect())) == sorted(map(str, log.collect()))
    ndjson.unpack(log.where("NOT (type = 'TxEntry' AND seq = 1)"), f"file://{tmp_path}/b")
    with pytest.raises(ValueError, match="not whole"):
        ndjson.pack(spark, f"file://{tmp_path}/b")


def test_programs_roll_back_link_accounts_and_set_flags_and_keys(spark):
    bucket = programs.Linked(lambda p: p[0], 1)
    reserve = programs.Program(lambda p: p[0], lambda p: p[1], ((bucket, lambda p: p[1]),), short=130, flags=((lambda p: p[0], 2, lambda p: p[1] % 100),), keys=((lambda p: F.concat(F.lit("reserved/"), p[0]), lambda p: p[1]),))
    release = programs.Program(bucket, lambda p: p[1], ((lambda p: p[0], lambda p: p[1]),), short=131)
    lopsided = programs.Program(lambda p: p[0], lambda p: p[1], ((lambda p: p[2], lambda p: p[1] + 1),))
    mint = programs.Program(lambda p: F.lit(0), lambda p: p[1], ((lambda p: p[0], lambda p: p[1]),))
    known = {"reserve": reserve, "release": release, "lopsided": lopsided, "mint": mint}
    call = lambda name, *params: {"op": "Function", "fn_name": name, "params": list(params)}
    register = lambda name: {"op": "FunctionRegistration", "fn_name": name}
    rows = [open_(2), deposit(1, 1000), *map(register, known), call("reserve", 1, 300), call("reserve", 1, 200), call("reserve", 1, 900), call("release", 1, 501), call("release", 1, 450), call("lopsided", 1, 5, 2)]
    rows += [call("unknown"), call("mint", 2, 70), call("reserve", 2, 70), call("reserve", 9, 1), register("gone"), call("mint", 2)]
    balances, reasons, ledger = run(spark, rows, programs=known)
    assert {t: r for t, r in reasons.items() if t > 6} == {7: 0, 8: 0, 9: 130, 10: 131, 11: 0, 12: S.ZERO_SUM_VIOLATION, 13: S.INVALID_OPERATION, 14: 0, 15: 0, 16: S.ACCOUNT_NOT_FOUND, 17: 0, 18: S.ZERO_SUM_VIOLATION}
    assert balances == {0: -1070, 1: 950, 2: 0, 3: 50, 4: 70}
    assert {(r.tx_id, r.parent_id, r.type_id, r.child_id) for r in ledger.link_events.collect()} == {(7, 1, 1, 3), (15, 2, 1, 4)}
    assert {(r.tx_id, r.account_id, r.lane, r.value) for r in ledger.flag_changes.collect()} == {(7, 1, 2, 0), (8, 1, 2, 0), (15, 2, 2, 70)}
    assert {r.key_str: r.value.i for r in state.kv(ledger.kv_events).collect()} == {"reserved/1": 200, "reserved/2": 70}
    assert {(r.name, r.version, r.crc32c > 0) for r in state.functions(ledger.fn_events).collect()} == {(name, 1, True) for name in known}
    assert {r.tx_id: r.sub_item_count for r in ledger.tx.collect() if r.tx_id in (7, 9, 11)} == {7: 4, 9: 0, 11: 2}


def test_a_program_counts_from_its_registration_until_it_is_unregistered(spark):
    one = programs.Program(lambda p: F.lit(0), lambda p: p[0], ((lambda p: F.lit(1), lambda p: p[0]),))
    call, register = {"op": "Function", "fn_name": "one", "params": [5]}, {"op": "FunctionRegistration", "fn_name": "one"}
    rows = [open_(1), call, register, call, call]
    balances, reasons, _ = run(spark, rows, programs={"one": one})
    assert reasons == {1: 0, 2: S.INVALID_OPERATION, 3: 0, 4: 0, 5: 0} and balances[1] == 10
    calls = spark.createDataFrame([(t, "one") for t in (1, 5, 9_999, 10_001, 30_000)], "tx_id long, fn_name string")
    events = spark.createDataFrame([(4, "one", 7), (10_000, "one", 0), (25_000, "one", 8), (26_000, "two", 8)], "tx_id long, name string, crc32c long")
    assert {r.tx_id for r in programs.registered(calls, events).collect()} == {5, 9_999, 30_000}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [rng.choice([deposit, withdraw])(rng.randrange(1, 6), rng.randrange(60)) for _ in range(120)]
    for k in range(3):
        frame(spark, rows[40 * k : 40 * k + 40], 2 + 40 * k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ops")
    judged = ledger_stream.judged(ledger_stream.read_ops(spark, f"{tmp_path}/ops"))
    query = ledger_stream.write_batches(judged, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    got = {r.tx_id: (r.fail_reason, r.computed_balance) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 120
    _, why = plain([open_(5), *rows])
    assert {t: r for t, (r, _) in got.items()} == {t: r for t, r in why.items() if t > 1}


def test_blocks_of_rows_are_judged_as_one_by_one():
    import numpy as np

    from tallyforge.operators.fold import judged_in_order

    rng = np.random.default_rng(3)
    for high in (20, 60, 400):
        for n in (0, 1, 15, 500, 20_000):
            out = rng.random(n) < 0.5
            amount = rng.integers(0, np.where(out, high, 50) + 1)
            balance, want = 7, []
            for o, a in zip(out.tolist(), amount.tolist(), strict=True):
                ok = not o or balance >= a
                balance += (-a if o else a) if ok else 0
                want.append(ok)
            got, passed = judged_in_order(7, np.where(out, -amount, amount), out)
            assert got == balance and passed.tolist() == want


def test_half_of_all_rows_on_one_account(spark):
    rng = random.Random(9)
    rows = [open_(6)]
    for _ in range(1500):
        a = 1 if rng.random() < 0.5 else rng.randrange(1, 7)
        rows.append(rng.choice([deposit(a, rng.randrange(40)), withdraw(a, rng.randrange(60)), transfer(a, rng.randrange(1, 7), rng.randrange(50))]))
    balances, reasons, _ = run(spark, rows)
    want, why = plain(rows)
    assert reasons == why and balances == {a: b for a, b in want.items() if a in balances}


def test_running_sums_over_several_ranges(spark, monkeypatch):
    from tallyforge.operators import prefix
    from tallyforge.plans import audits

    monkeypatch.setattr(prefix, "RANGE", 3)
    monkeypatch.setattr(audits, "RANGE", 3)
    rows = [(t, s, "DEBIT" if (t + s) % 2 else "CREDIT", (t * s) % 5, t + s, t // 4) for t in range(1, 120) for s in range(2)]
    entries = prefix.balances_along(spark.createDataFrame(rows, "tx_id long, seq int, kind string, account_id long, amount long, segment_id long"))
    held, want = {}, {}
    for t, s, kind, account, amount, _ in rows:
        held[account] = want[t, s] = held.get(account, 0) + (amount if kind == "DEBIT" else -amount)
    assert {(r.tx_id, r.seq): r.computed_balance for r in entries.collect()} == want
    assert audits.continuity_violations(entries).count() == 0
    assert audits.continuity_violations(entries.withColumn("computed_balance", F.col("computed_balance") + F.when(F.col("tx_id") == 60, 1).otherwise(0))).count() > 0


@pytest.mark.parametrize("profile", ["P1-dup", "P2"])
def test_submitted_stream_equals_batch(spark, tiny, tmp_path, profile):
    from tallyforge.sources.profiles import event_ops

    ops = event_ops(spark, tiny, profile).persist()
    last = ops.agg(F.max("tx_id")).first()[0]
    for lo, hi in ((0, last // 2), (last // 2, last)):
        ops.where((F.col("tx_id") > lo) & (F.col("tx_id") <= hi)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ops")
    config = LedgerConfig(root=f"file://{tmp_path}/log", transactions_per_segment=200, snapshot_frequency=2)
    engine = LedgerEngine(spark, config)
    stream = ledger_stream.read_ops(spark, f"{tmp_path}/ops")
    for _ in range(2):  # the second start has nothing left to do
        query = ledger_stream.submitted(stream, engine, f"{tmp_path}/checkpoint")
        query.awaitTermination()
    assert ledger_stream.progress(query)["rows"] in (0, last)
    batch = execute(ops, config.dedup_window, config.transactions_per_segment)
    assert engine.table("tx").count() == last
    assert {(r.tx_id, r.fail_reason) for r in engine.table("tx").collect()} == {(r.tx_id, r.fail_reason) for r in batch.tx.collect()}
    assert {(r.account_id, r.balance) for r in engine.accounts().collect() if r.balance} == {(r.account_id, r.balance) for r in state.balances(batch.entries).collect() if r.balance}
    assert sum(r.n for r in ledger_stream.segments_seen(engine.table("tx"), 200).collect()) == last


def test_a_cluster_session_needs_a_shared_folder():
    from types import SimpleNamespace

    from tallyforge.scratch import scratch_dir

    kept = {}
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=kept.get, set=kept.__setitem__), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_dir(session(master))
    assert scratch_dir(session("local[2]")) == scratch_dir(session("yarn")) == kept["spark.checkpoint.dir"]


def scans(df):
    """The plan as text, and how many files' scans it has."""
    text = df._jdf.queryExecution().sparkPlan().toString()
    return text, text.count("FileScan")


def test_the_start_of_the_journal_is_that_of_the_whole(spark, tiny):
    from tallyforge.sources.profiles import journal_entries

    start, whole = journal_entries(spark, tiny, 700), journal_entries(spark, tiny)
    assert start.count() > 0 and start.exceptAll(whole.where("tx_id <= 700")).isEmpty() and whole.where("tx_id <= 700").exceptAll(start).isEmpty()


def test_a_checkpoint_is_carried_on_over_a_tail_of_one_row_each(spark):
    from tallyforge.plans import checkpoints

    base = spark.createDataFrame([(1, 10, 5), (2, 20, 5)], "account_id long, balance long, last_tx_id long")
    tail = spark.createDataFrame([(6, 0, 1, 11), (7, 1, 1, 13), (7, 0, 1, 12), (6, 1, 3, 30)], "tx_id long, seq int, account_id long, computed_balance long")
    out = checkpoints.balances_after(base, tail)
    assert sorted(map(tuple, out.collect())) == [(1, 13), (2, 20), (3, 30)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_a_replayed_log_is_read_once(spark, tiny, tmp_path):
    from tallyforge.plans import audits

    schema = "k long, v long"
    a, b = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 3)], schema), spark.createDataFrame([(1, 1), (2, None), (4, 4), (4, 4)], schema)
    assert sorted(map(tuple, audits.differences(a, b).collect())) == [(1, 1, "left"), (3, 3, "left"), (4, 4, "right"), (4, 4, "right")]
    a.write.parquet(str(tmp_path / "a"))
    read = spark.read.parquet(str(tmp_path / "a"))
    assert scans(audits.differences(read, read.where("k > 1")))[1] == 2


def test_found_checksums_equal_those_of_changed_entries(spark, tiny):
    from pyspark.sql import functions as F

    from tallyforge.plans import audits
    from tallyforge.sources.profiles import journal_tx, order_legs

    tx, entries = journal_tx(spark, tiny), order_legs(spark, tiny).withColumn("computed_balance", F.col("amount"))
    other = F.col("amount") + F.col("seq") % 2
    both = audits.checksums(tx, entries, other)
    apart = audits.checksums(tx, entries).join(audits.checksums(tx, entries.withColumn("amount", other)).withColumnRenamed("crc32", "found_crc32"), "tx_id")
    assert both.count() == tx.count() and both.exceptAll(apart).isEmpty() and apart.exceptAll(both).isEmpty()


def test_legs_shuffle_only_what_numbers_and_fills_them(spark, tiny):
    from tallyforge.sources.profiles import order_legs

    plan, _ = scans(order_legs(spark, tiny))
    assert "l_suppkey" in plan and "l_tax" not in plan.split("Location")[0] and "l_shipdate" not in plan
    assert "RepartitionByExpression [o_orderkey" in order_legs(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()  # not put together by size


def test_rows_of_a_running_sum_are_sorted_once(spark):
    from tallyforge.operators import prefix

    entries = spark.createDataFrame([(1, 0, "DEBIT", 1, 5, 1)], "tx_id long, seq int, kind string, account_id long, amount long, segment_id long")
    plan = prefix.balances_along(entries)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [account_id") <= 3
