import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tallyforge.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size string, target string"


def expected_targets(sizes):
    """Water filling by repeated resharing; sizes by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, left, target = set(order), float(sum(sizes.values())), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(spark, rows):
    df = spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], DOCS)
    got = mixing.shares(df).collect()
    assert len(got) == len(rows)
    text, source = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken, largest = expected_targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(WORD.findall(text[r.doc_id] or "")) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 * largest[s] + 1
    return {(r.doc_id, r.taken) for r in got}


def test_hot_capped_and_null_sources(spark):
    rows = [(i, "w " * (1 + i % 37), "hot") for i in range(600)] + [(1000 + i, "w " * (5 + i % 3), "tiny") for i in range(4)] + [(2000 + i, "w", None) for i in range(50)] + [(3000 + i, "v w", f"s{i % 5}") for i in range(100)]
    assert check(spark, rows) == check(spark, rows[::-1])


def test_odd_rows(spark):
    check(spark, [(1, None, "a"), (2, "", "a"), (3, " \n", "b"), (4, "x y", ""), (5, "é è", "é"), (6, "w " * 50_000, "big")])
    check(spark, [(1, None, "a"), (2, None, None)])
    assert mixing.shares(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_are_each_sampled(spark):
    rows = [(1, "a b c", "s", "", "")] * 10 + [(2, "a b c", "t", "", "")] * 10
    got = mixing.shares(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 20
    by = Counter()
    for r in got:
        by[r.doc_id] += r.taken
    assert abs(by[1] - 60 * 5 / 7) <= 6 and abs(by[2] - 60 * 2 / 7) <= 6


def test_mix_holds_the_copies_that_shares_counts(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema
    copies = Counter(r.doc_id for r in mixed.collect())
    for r in mixing.shares(docs).collect():
        assert copies[r.doc_id] * r.size == r.taken


def test_sql_gives_the_same(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tiny}/documents.parquet')")
    sql = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP6_SQL})").fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.op6(spark, tiny).collect()}
    assert got.keys() == sql.keys()
    for k, (size, whole, target, taken) in got.items():
        assert (size, whole, taken) == (sql[k][0], sql[k][1], sql[k][3]) and target == pytest.approx(sql[k][2])


def test_the_plan_of_a_mix_is_not_sent_to_the_driver(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "ab"[i % 2]) for i in range(50)], "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
