import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, quality string, n_words string"


def counts(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def failed(text):
    n, _, _, _, repeated = counts(text)
    return n < 50 or 100 * repeated > 50 * n


ODD = [
    None, "", " \n\t", "a", "a a a a", "x y z x y z", "one\ntwo\none\n \n \none", "l\r\nl\r\n", "   x　y", "é" * 40, "日本 語 日本 語 日本 語", "# * $ % & | < > [ ]",
    "\x0b\x0cword\x1c\x1dother", "😀 😀 😀 😀", "tail newline\n", "w " * 49, "w " * 50, " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i % 40}" for i in range(80)),
    "long " + "z" * 100_000, " ".join(f"t{i % 9001}" for i in range(300_000)),
]


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, None, None, "clash", "clash") for i, t in enumerate(ODD)], DOCS)
    got = {r.doc_id: r for r in quality.judge(docs, None).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text), i
        assert r.base_failed == failed(text)
        assert r.kept == (not r.base_failed) and r.quality is None


def test_counts_of_documents(spark, tiny):
    got = {r.doc_id: r for r in quality.op1(spark, tiny).collect()}
    rows = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        r = got[row.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*counts(row.text), failed(row.text))
        assert not (r.base_failed and r.kept)


def test_held_out_accuracy_and_calibration(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0))
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 2}
    got = [(truth[r.doc_id], r.quality) for r in quality.judge(docs, model).collect() if r.doc_id in truth]
    right = [(q >= quality.THRESHOLD) == bool(t) for t, q in got]
    kept_good = [q >= quality.THRESHOLD for t, q in got if t]
    assert sum(right) / len(right) > 0.95
    assert sum(kept_good) / len(kept_good) > 0.97
    assert sum((q - t) ** 2 for t, q in got) / len(got) < 0.05


def test_repeated_rows_fit_alike_and_reruns_agree(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    a, b = quality.fit(docs, labels), quality.fit(docs.repartition(7), labels.repartition(3))
    assert a.slope == pytest.approx(b.slope, rel=1e-6) and abs(a.weights - b.weights).max() < 1e-4


def test_missing_classes_and_empty_tables(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    one_class = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, one_class) is None
    assert quality.fit(docs.limit(0), one_class) is None
    assert quality.fit(docs, one_class.limit(0)) is None
    assert quality.judge(docs.limit(0), None).count() == 0


def test_filter_keeps_columns(spark):
    good = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good, "en", None, "q", "n"), (1, good, "en", None, "q", "n"), (2, "few", None, None, None, None), (None, good, None, None, None, None)], DOCS)
    out = quality.judge(docs, None, keep_columns=True)
    assert out.schema == docs.schema
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 1]


def test_fitting_takes_little_memory_beside_its_sample():
    rng = np.random.default_rng(3)
    buckets = [np.sort(rng.choice(1 << quality.BITS, 3000, replace=False)).astype(np.int32) for _ in range(1500)]
    values = [rng.random(3000, np.float32) for _ in buckets]
    tracemalloc.start()
    quality.logistic(buckets, values, rng.random(1500) < 0.5, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(x.nbytes for x in [*buckets, *values]) / 2


def test_features_are_collected_small_and_whole():
    texts = ["", " ".join(f"word{i % 700} of {i % 13}" for i in range(4000)), "one two", "é 日本 " * 30]
    batch = pa.RecordBatch.from_pydict({"good": [True] * 4, "part": [False] * 4, "text": texts})
    got = pa.Table.from_batches(list(quality.features(iter([batch]))))
    assert sum(len(x.as_buffer()) for k in ("steps", "values") for x in got.column(k)) < 4 * sum(got.column("n").to_pylist())
    keys, values = quality.unpacked(got)
    for text, k, v in zip(texts, keys, values, strict=True):
        buf, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        want = [np.unique(b, return_counts=True) for b, _ in quality.grams(buf, off, quality.word_hashes(buf, off))]
        assert k.tolist() == [x for b, _ in want for x in b.tolist()]
        assert v.tolist() == [x for _, n in want for x in (n * (quality.SCALE / max(1, n.sum()))).astype(np.float32).tolist()]
