import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import sharding
from tallyforge.llm.sharding import ShardStore

ROWS = "doc_id long, text string, shard string, tier_ string"


def store(spark, tmp_path, **options):
    return ShardStore(spark, f"file://{tmp_path}/store", **options)


def some(spark, lo, hi):
    return spark.range(lo, hi, 1, 2).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))


def test_append_compact_and_read(spark, tmp_path):
    s = store(spark, tmp_path, target_bytes=60_000, small_rows=40)
    for k in range(4):
        assert s.append(some(spark, 300 * k, 300 * k + 300)) == k + 1
    before = s.manifest().collect()
    assert sum(r.rows for r in before) == 1200 and all(r.rows <= 40 for r in before)
    v = s.compact()
    after = s.manifest(v).collect()
    assert v > 4 and sum(r.rows for r in after) == 1200 and len(after) < len(before) / 4
    assert max(r.bytes for r in after) < 2 * 60_000
    assert Counter(r.doc_id for r in s.read(v).collect()) == Counter(range(1200))
    assert sum(r.rows for r in s.manifest(4).collect()) == 1200  # older versions stay readable
    assert Counter(r.doc_id for r in s.read(4).collect()) == Counter(range(1200))
    assert s.compact() == v  # nothing is left to do
    assert s.vacuum(keep_versions=1, grace=0) >= 1
    assert Counter(r.doc_id for r in s.read().collect()) == Counter(range(1200))


def test_only_one_writer_gets_a_version(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(some(spark, 0, 10))
    assert s._commit(s.manifest(1), 1) and not s._commit(s.manifest(1), 1)
    assert s.versions() == [1, 2]


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda k: store(spark, tmp_path, target_bytes=20_000, small_rows=50).append(some(spark, 100 * k, 100 * k + 100)), range(6)))
    s = store(spark, tmp_path, target_bytes=20_000, small_rows=50)
    assert sorted(done) == [1, 2, 3, 4, 5, 6] and Counter(r.doc_id for r in s.read().collect()) == Counter(range(600))
    with ThreadPoolExecutor(3) as pool:
        jobs = [lambda: s.compact(), lambda: store(spark, tmp_path, target_bytes=20_000).compact(), lambda: s.append(some(spark, 600, 700))]
        list(pool.map(lambda f: f(), jobs))
    assert Counter(r.doc_id for r in s.read().collect()) == Counter(range(700))


def test_a_writer_lost_before_its_commit_hinders_nobody(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    s.append(some(spark, 0, 10))
    with monkeypatch.context() as m:
        m.setattr(s.commits, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            s.append(some(spark, 10, 20))
    (tmp_path / "store/commits/draft-1").write_text("left behind")
    assert s.version() == 1 and s.read().count() == 10
    assert s.append(some(spark, 20, 30)) == 2
    assert Counter(r.doc_id for r in s.read().collect()) == Counter([*range(10), *range(20, 30)])


def test_vacuum_spares_young_files_and_the_versions_it_keeps(spark, tmp_path):
    s = store(spark, tmp_path, target_bytes=60_000, small_rows=40)
    for k in range(3):
        s.append(some(spark, 300 * k, 300 * k + 300))
    last = s.compact()
    some(spark, 0, 5).write.parquet(f"{tmp_path}/store/data/inflight")
    assert s.vacuum(keep_versions=1) == 0 and (tmp_path / "store/data/inflight").exists()
    assert s.vacuum(keep_versions=2, grace=0) >= 1 and not (tmp_path / "store/data/inflight").exists()
    assert s.read(last - 1).count() == s.read().count() == 900
    assert s.vacuum(keep_versions=1, grace=0) >= 1 and s.versions() == [last] and s.read().count() == 900


def test_tiers_and_runs_against_plain_python(spark, tmp_path):
    rng, target = random.Random(7), 1000
    sizes = [rng.choice([1, 3, 10, 40, 200, 600, 740, 751, 3000]) + rng.randrange(3) for _ in range(120)]
    live = spark.createDataFrame([(f"p{i:03d}", 0, b, 1) for i, b in enumerate(sizes)], sharding.SHARD).withColumn("tier", sharding.tier_of(F.col("bytes"), target))
    rows = live.collect()

    def tier(b):
        if b >= 750:
            return 0
        t = 1
        while b * 4**t <= target:
            t += 1
        return t

    assert all(r.tier == tier(r.bytes) for r in rows)
    want = {}
    for t in {r.tier for r in rows if r.tier}:
        of, run, total = sorted((r for r in rows if r.tier == t), key=lambda r: (r.bytes, r.path)), {}, 0
        if len(of) < sharding.FANOUT:
            continue
        for r in of:
            run.setdefault(total // target, []).append(r.path)
            total += r.bytes
        want |= {p: f"{t}-{k}" for k, paths in run.items() if len(paths) > 1 for p in paths}
    got = {r.path: r.run for r in store(spark, tmp_path, target_bytes=target).runs(live).collect()}
    assert got == want


def test_columns_of_any_names(spark, tmp_path):
    s = store(spark, tmp_path, target_bytes=30_000, small_rows=10)
    df = some(spark, 0, 200).withColumns({"_run": F.lit(1), "_shard": F.lit("x"), "_tier": F.lit(7)})
    s.append(df)
    s.compact()
    got = s.read().select(df.columns).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, df.collect()))


def test_tiers_wait_for_enough_shards(spark, tmp_path):
    s = store(spark, tmp_path, small_rows=1000)
    s.append(some(spark, 0, 5).coalesce(1))
    s.append(some(spark, 5, 9).coalesce(1))
    assert s.compact() == 2 and s.manifest().count() == 2


def test_odd_rows(spark, tmp_path):
    s = store(spark, tmp_path, target_bytes=10_000_000)
    assert s.version() == 0 and s.manifest().count() == 0
    rows = [(None, None, "a", "b"), (1, "", "a", "b"), (2, "x" * 200_000, None, None), (2, "x" * 200_000, None, None)]
    df = spark.createDataFrame(rows, ROWS)
    s.append(df)
    assert s.append(df.limit(0)) == 2
    got = [(r.doc_id, r.text) for r in s.read(2).collect()]
    assert sorted(got, key=str) == sorted(((r[0], r[1]) for r in rows), key=str)


def test_query_holds_every_row_once(spark, tiny):
    got = sharding.op10(spark, tiny).collect()
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((r.doc_id, None if r.text is None else len(r.text.encode())) for r in docs)
    assert all(n == rows for (_, rows), n in Counter((r["shard"], r.shard_rows) for r in got).items())
    assert len({r.version for r in got}) == 1
