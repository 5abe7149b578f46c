import duckdb
import numpy as np
import pytest

from tallyforge.llm import ann

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, queries, k):
    out = {}
    sound = {i: np.array(v, np.float64) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q in queries:
        if q in sound:
            s = sorted(((-float(ann.exact(sound[q][None], v[None])[0]), i) for i, v in sound.items() if i != q))
            out[q] = [(i, -d) for d, i in s[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in rows], VECTORS)


def test_recall_and_exact_scores(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{small}/embeddings.parquet')")
    want = {}
    for q, rank, v, s in con.execute(ann.OP8_SQL + " ORDER BY 1, 2").fetchall():
        want.setdefault(q, []).append((v, s))
    got = found(ann.op8(spark, small))
    assert got.keys() == want.keys()
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    for q in want:
        assert all(s == pytest.approx(dict(want[q]).get(v, s), abs=1e-12) for v, s in got[q])


def test_blocks_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-3, 4, 16).astype(np.float32)) for i in range(300)] + [(400 + i, np.full(16, 2, np.float32)) for i in range(90)]
    df = frame(spark, rows)
    got, want = found(ann.nearest(df, df.where("vec_id % 20 = 0"), k=10)), brute(rows, [i for i, _ in rows if i % 20 == 0], 10)
    assert got.keys() == want.keys()
    recall = [len(set(got[q]) & set(want[q])) / 10 for q in want]
    assert np.mean(recall) >= 0.95
    assert all(got[q] == want[q] for q in want if q >= 400)  # equal scores go to the smallest ids


def test_lengths_differ_widely(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(24) * 10.0 ** rng.integers(-3, 4)) for i in range(400)]
    rows = [(i, v.astype(np.float32)) for i, v in rows]
    df = frame(spark, rows)
    got, want = found(ann.nearest(df, df.where("vec_id % 20 = 0"))), brute(rows, range(0, 400, 20), 20)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 2]), (1, [2, 1]), (20, [0, 0]), (40, None), (60, [1, None]), (80, [nan, 1]), (100, [inf, 1]), (120, [-1, -1]), (140, [1, 2, 3]), (160, [])]
    df = frame(spark, rows)
    got = found(ann.nearest(df, df.where("vec_id % 20 = 0")))
    assert got == {0: [(1, 4.0), (120, -3.0)], 120: [(0, -3.0), (1, -3.0)]}


def test_empty_and_single(spark):
    assert ann.nearest(frame(spark, []), frame(spark, [])).count() == 0
    one = frame(spark, [(20, [1, 1])])
    assert ann.nearest(one, one).count() == 0
    assert ann.nearest(one, one.limit(0)).count() == 0


def test_repeated_rows(spark):
    df = frame(spark, [(0, [1, 1]), (0, [1, 1]), (1, [1, 0]), (1, [1, 0])])
    got = ann.nearest(df, df.where("vec_id = 0")).collect()
    assert {r.vec_id for r in got} == {1}


def test_estimates_from_packed_bits_stay_within_their_errors():
    rng = np.random.default_rng(5)
    for dim in (16, 64, 700):
        v, q = rng.standard_normal((2000, dim)), rng.standard_normal((20, dim))
        words, length, c = ann.codes_of(v)
        assert words.shape == (2000, max(ann.BITS, -(-dim // 64) * 64) // 64)
        signs = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little") * 2.0 - 1
        ones = np.bitwise_count(words).sum(1, dtype=np.int32)
        for x in q:
            x = x / np.sqrt((x * x).sum())
            turned = ann.rotation(dim) @ x
            asked = ann.Asked(turned)
            got = asked.estimates(np.ascontiguousarray(words.T), ones, c)
            plain = signs @ turned / (np.sqrt(signs.shape[1]) * c)
            assert np.abs(got - plain).max() < 8 * asked.step
            off = np.abs(got - (v / length[:, None]) @ x) / ann.errors(c, signs.shape[1], asked.step)
            assert np.mean(off < 3) > 0.98


def test_a_common_vector_and_several_dimensions(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 9)
    rng = np.random.default_rng(2)
    rows = [(i, np.full(8, 0.5, np.float32)) for i in range(500)] + [(500 + i, rng.standard_normal(8).astype(np.float32)) for i in range(100)] + [(700 + i, rng.standard_normal(5).astype(np.float32)) for i in range(40)]
    df = frame(spark, rows)
    got = found(ann.nearest(df, df.where("vec_id % 20 = 0"), k=6))
    want = brute([r for r in rows if len(r[1]) == 8], [i for i in range(0, 600, 20)], 6) | brute([r for r in rows if len(r[1]) == 5], [700, 720], 6)
    assert got.keys() == want.keys()
    assert all(got[q] == want[q] for q in range(0, 500, 20))
    assert np.mean([len(set(got[q]) & set(want[q])) / 6 for q in want]) >= 0.9
