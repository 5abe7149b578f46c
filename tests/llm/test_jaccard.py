import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import jaccard
from tallyforge.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n string, comp string"


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """(shingles, component) by document, from all pairs that share a shingle."""
    sets, where = {i: shingles(t) for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for k, n in Counter(k for x in s for k in where[x] if k < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[k]) - n):
                a, b = find(i), find(k)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    got = jaccard.classes(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near(rng, text, changes):
    out = list(text)
    for _ in range(changes):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(k, f"n{rng.randrange(9999)}"), lambda: out.insert(k, "extra"), lambda: len(out) > 1 and out.pop(k)])()
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_near_copies(spark, seed):
    rng, rows = random.Random(seed), []
    for _ in range(25):
        base = words(rng, rng.randrange(1, 120))
        rows += [base, *(near(rng, base, rng.randrange(0, 7)) for _ in range(rng.randrange(0, 8)))]
    chain = words(rng, 80)
    for _ in range(30):  # each links with the next, not the first with the last
        rows.append(chain := near(rng, chain, 1))
    rng.shuffle(rows)
    check(spark, [(i, " ".join(r)) for i, r in enumerate(rows)])


def test_hot_group_of_near_copies_and_shared_passage(spark):
    rng = random.Random(9)
    passage, base = words(rng, 60), words(rng, 100)
    rows = [near(rng, base, rng.randrange(0, 3)) for _ in range(250)] + [words(rng, rng.randrange(20, 60)) + passage for _ in range(150)] + [base] * 60
    rng.shuffle(rows)
    check(spark, [(i, " ".join(r)) for i, r in enumerate(rows)])


def test_threshold_is_met_exactly(spark):
    a = [f"s{i}" for i in range(13)]  # nine shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:-1] + ["z"])), (3, " ".join(a + ["p"])), (4, " ".join(["q", *a, "r"])), (5, " ".join(a[:8]))]
    check(spark, rows)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "two one"), (7, "a b c d"), (8, "a b c d e"), (9, "É b c d e"), (10, "é b c d e"), (11, "x " * 30), (12, "x " * 5), (13, "v" * 50_000), (14, " ".join(f"k{i}" for i in range(40_000))), (15, " ".join(f"k{i}" for i in range(39_000)))]
    check(spark, rows)


def test_documents(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op4(spark, tiny).collect()} == brute(rows)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert jaccard.classes(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "", ""), (1, "a b c d e f", "", ""), (None, "a b c d e f", "", ""), (2, "A b c d e f", "", "")], DOCS)
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard.classes(df).collect())
    assert got == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_one_document_of_each_component_stays(spark):
    df = spark.createDataFrame([(5, "a b c d e f", "x", "y"), (3, "A b c d e f", "x", "y"), (3, "A b c d e f", "x", "y"), (9, "other text", None, None), (7, None, None, None), (None, "a b c d e f", "x", "y"), (None, None, None, None)], DOCS)
    out = jaccard.distinct_documents(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 3, 7, 9]


def test_components(spark):
    pairs = [(1, 2), (2, 3), (10, 11), (11, 12), (3, 10), (7, 7), (20, 21)] + [(100 + i, 101 + i) for i in range(70)] + [(500, 501 + i) for i in range(40)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long").withColumn("a", F.col("a"))).collect()}
    expected = {k: 1 for k in (1, 2, 3, 10, 11, 12)} | {20: 20, 21: 20} | {100 + i: 100 for i in range(71)} | {500 + i: 500 for i in range(41)}
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_ids_collapse_and_one_id_joins_its_texts(spark):
    rng = random.Random(3)
    base = words(rng, 60)
    a, b = " ".join(base), " ".join([*base[:-1], "end"])
    other = " ".join(words(rng, 40))
    rows = [(1, a)] * 40 + [(2, b)] * 40 + [(7, a), (7, other), (5, other), (9, " ".join(words(rng, 30)))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    got = Counter((r.doc_id, r.component_id) for r in jaccard.classes(df).collect())
    assert got == {(1, 1): 40, (2, 1): 40, (7, 1): 2, (5, 1): 1, (9, 9): 1}
    kept = jaccard.distinct_documents(df).collect()
    assert sorted(r.doc_id for r in kept) == [1, 9] and next(r.text for r in kept if r.doc_id == 1) == a


def test_parity_sketches_never_differ_in_more_bits_than_sets_in_shingles():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        both, own, other = (rng.integers(0, 1 << 63, rng.integers(0, 300), dtype=np.uint64) for _ in range(3))
        a, b = np.unique(np.concatenate([both, own])), np.unique(np.concatenate([both, other]))
        assert jaccard.differing(jaccard.parity(a), jaccard.parity(b)) <= len(np.setxor1d(a, b))


def test_shingles_of_many_groups_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SPLIT", 7)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rng = random.Random(12)
    base = words(rng, 70)
    rows = [near(rng, base, rng.randrange(0, 9)) for _ in range(120)] + [near(rng, words(rng, 50), 1) for _ in range(40)]
    check(spark, [(i, " ".join(r)) for i, r in enumerate(rows)])
