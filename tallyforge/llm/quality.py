"""Quality rules: counting rules, then a calibrated logistic regression over hashed word and character n-grams.

Features of a text are the shares of its hashed word 1- and 2-grams and character 3- and 4-grams, each family adding up
to SCALE. Weights are learned on a bounded sample of labelled documents (``sample`` labels with the smallest id hash; of
rows that share an id, the smallest text), a quarter of which is set aside to fit the two numbers of Platt's calibration. Scoring maps Arrow batches and needs no shuffle.

Defined cases: a null or empty text has no words, so base_failed is true and kept false; texts of any length are read
whole; without labels of both classes there is no model, quality is null and the counting rules alone decide. Repeated
rows are judged alike, columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import MIX, is_held_out, only, per_row, pieces, row_starts, run_hashes, runs_of, word_hashes

BITS = 17
FAMILIES = 4
SCALE = 20.0
#: Labelled rows used for fitting, at most.
SAMPLE = 1500
#: Sample rows that a step of fitting handles at once.
FIT_ROWS = 64
#: A text is kept from this calibrated probability of good quality on.
THRESHOLD = 0.5
MIN_WORDS = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margins + self.bias) + self.shift, -40, 40)))


def same_as_neighbour(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorting order of the keys of a row, and for each pair of neighbours in it whether they are equal."""
    order = np.argsort(keys ^ (rows.astype(np.uint64) * MIX[1]), kind="stable")
    k, r = keys[order], rows[order]
    return order, (k[1:] == k[:-1]) & (r[1:] == r[:-1])


def base_counts(buf: np.ndarray, off: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    starts, hashes, rows = words
    n = len(off) - 1
    white = np.isin(buf, [9, 10, 11, 12, 13, 32])
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": per_row(~white & (buf & 0xC0 != 0x80), off), "n_symbols": per_row(SYMBOLS[buf], off)}
    newline = buf == 10
    first = row_starts(len(buf), off)
    first[1:] |= newline[:-1]
    at, lines = run_hashes(buf, first, ~newline)
    held = np.zeros(len(buf) + 1, np.int64)
    held[starts + 1] = 1
    held = np.cumsum(held)
    with_word = held[np.append(at[1:], len(buf))] > held[at] if len(at) else np.zeros(0, bool)
    at, lines = at[with_word], lines[with_word]
    of = np.searchsorted(off, at, "right") - 1
    order, same = same_as_neighbour(lines, of)
    out["n_dup_lines"] = np.bincount(of[order[1:][same]], minlength=n)
    repeated = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        whole = np.flatnonzero(rows[2:] == rows[:-2])
        order, same = same_as_neighbour(hashes[whole] * MIX[2] + hashes[whole + 1] * MIX[3] + hashes[whole + 2] * MIX[4], rows[whole])
        found = whole[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))]
        for k in range(3):
            repeated[found + k] = True
    out["n_repeat_words"] = np.bincount(rows[repeated], minlength=n)
    return out


def code_points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number for each UTF-8 character (its bytes), and its row."""
    at = np.flatnonzero(buf & 0xC0 != 0x80)
    padded = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.uint32)
    value, lead = padded[at], buf[at]
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        more = lead >= least
        value[more] |= padded[at[more] + k] << np.uint32(8 * k)
    return value.astype(np.uint64), np.searchsorted(off, at, "right") - 1


def grams(buf: np.ndarray, off: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each family: the bucket of every n-gram, and its row, in ascending order of rows."""
    _, h, r = words
    chars, of = code_points(buf, off)
    chars = chars * MIX[5]
    bucket = lambda keys, family: ((keys ^ MIX[6 + family]) * MIX[10] >> np.uint64(64 - BITS)).astype(np.int64)
    yield bucket(h, 0), r
    pair = r[1:] == r[:-1]
    yield bucket((h[:-1] * MIX[2] + h[1:] * MIX[3])[pair], 1), r[1:][pair]
    for family, n in ((2, 3), (3, 4)):
        if len(chars) < n:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        key = np.zeros(len(chars) - n + 1, np.uint64)
        for k in range(n):
            key += chars[k : len(chars) - n + 1 + k] * MIX[11 + k]
        whole = of[n - 1 :] == of[: len(of) - n + 1]
        yield bucket(key[whole], family), of[n - 1 :][whole]


def margins(model: Model, buf: np.ndarray, off: np.ndarray, words) -> np.ndarray:
    out = np.zeros(len(off) - 1)
    for buckets, rows in grams(buf, off, words):
        out += SCALE * np.bincount(rows, model.weights[buckets], len(out)) / np.maximum(np.bincount(rows, minlength=len(out)), 1)
    return out


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(good, part, n, steps, values) of labelled rows: n buckets, as compressed steps from one to the next, and their values."""
    only("quality")
    for batch in batches:
        good, part = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi, buf, off in pieces(batch.column(2)):
            words = word_hashes(buf, off)
            keys, values = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
            for buckets, rows in grams(buf, off, words):
                cut = np.searchsorted(rows, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    k, n = np.unique(buckets[cut[i] : cut[i + 1]], return_counts=True)
                    keys[i].append(k)
                    values[i].append(n * (SCALE / max(1, n.sum())))
            steps = [np.diff(np.concatenate(x).astype(np.int32), prepend=np.int32(0)) for x in keys]
            yield pa.RecordBatch.from_pydict({
                "good": good[lo:hi], "part": part[lo:hi], "n": pa.array(map(len, steps), pa.int64()),
                "steps": pa.array([zlib.compress(x.tobytes(), 1) for x in steps], pa.binary()), "values": pa.array([zlib.compress(np.concatenate(x).astype(np.float32).tobytes(), 1) for x in values], pa.binary()),
            })


def logistic(buckets: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, rounds: int = 60, rate: float = 0.25, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam over the sample, FIT_ROWS rows at once: beside the sample itself little memory is taken."""
    w, m, v = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    share = good.mean()
    weight = np.where(good, 0.5 / share, 0.5 / (1 - share)) / len(good)
    bias = mb = vb = 0.0
    miss = np.zeros(len(good))
    for t in range(1, rounds + 1):
        g = np.zeros(1 << BITS)
        for lo in range(0, len(good), FIT_ROWS):
            of = slice(lo, lo + FIT_ROWS)
            ix, x = np.concatenate(buckets[of]), np.concatenate(values[of]).astype(np.float64)
            rows = np.repeat(np.arange(len(buckets[of])), [len(b) for b in buckets[of]])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, x * w[ix], len(buckets[of])) + bias, -40, 40)))
            miss[of] = (p - good[of]) * weight[of]
            np.add.at(g, ix, x * miss[of][rows])
        g, gb = g + decay * w / len(good), miss.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w, bias


def unpacked(got: pa.Table) -> list[list[np.ndarray]]:
    """Buckets and values of each row of features()."""
    ends = np.cumsum([0, *got.column("n").to_pylist()])
    keys, values = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float32)
    for lo, hi, k, v in zip(ends[:-1], ends[1:], got.column("steps"), got.column("values"), strict=True):
        np.cumsum(np.frombuffer(zlib.decompress(k.as_buffer()), np.int32), dtype=np.int32, out=keys[lo:hi])
        values[lo:hi] = np.frombuffer(zlib.decompress(v.as_buffer()), np.float32)
    return [[x[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)] for x in (keys, values)]


def platt(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's calibration, with his smoothed targets, by Newton's method."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        d, s = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, [(d * z).sum(), d.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from at most ``sample`` labelled rows; None when one of the classes is missing."""
    spark = docs.sparkSession
    chosen = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col("quality") == 1).alias("good"))
    chosen = chosen.distinct().orderBy(F.xxhash64("_id"), "_id", "good").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id", "good").agg(F.min("text").alias("text")).orderBy(F.xxhash64("_id"), "_id", "good")
    rows = rows.select("good", (F.xxhash64("_id", F.lit(7)) % 4 == 0).alias("part"), "text")
    got = rows.mapInArrow(features, "good boolean, part boolean, n long, steps binary, values binary").toArrow()
    good, aside = np.array(got.column("good").to_pylist(), bool), np.array(got.column("part").to_pylist(), bool)
    if good.all() or not good.any():
        return None
    buckets, values = unpacked(got)
    del got
    pa.default_memory_pool().release_unused()  # the driver goes on
    if min(good[aside].sum(), (~good[aside]).sum(), good[~aside].sum(), (~good[~aside]).sum()) < 5:
        fitting = setting = np.flatnonzero(np.ones(len(good), bool))
    else:
        fitting, setting = np.flatnonzero(~aside), np.flatnonzero(aside)
    w, bias = logistic([buckets[i] for i in fitting], [values[i] for i in fitting], good[fitting])
    z = np.array([values[i] @ w[buckets[i]] for i in setting]) + bias
    slope, shift = platt(z, good[setting])
    return Model(w.astype(np.float32), bias, slope, shift)


def judge(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Counts and verdict of every text; with keep_columns the rows of docs that are kept, unchanged."""
    source = docs if keep_columns else docs.select(F.col(id_col), F.col(text_col).alias("text"))
    at = source.columns.index(text_col if keep_columns else "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in runs_of(batches, at):
            parts: list[dict[str, np.ndarray]] = []
            for _, _, buf, off in pieces(batch.column(at)):
                words = word_hashes(buf, off)
                x = base_counts(buf, off, words)
                x["base_failed"] = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
                x["quality"] = model.probability(margins(model, buf, off, words)) if model else np.full(len(off) - 1, np.nan)
                x["kept"] = ~x["base_failed"] & ((x["quality"] >= threshold) if model else True)
                parts.append(x)
            if not parts:
                continue
            joined = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            if keep_columns:
                yield batch.filter(pa.array(joined["kept"]))
            else:
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(joined[k], from_pandas=True) for k in names)], names=[id_col, *names])

    if keep_columns:
        return source.mapInArrow(run, source.schema)
    kind = dict(source.dtypes)[id_col]
    return source.mapInArrow(run, f"`{id_col}` {kind}, {COLUMNS}")


def op1(spark, sf_dir: str) -> DataFrame:
    from tallyforge.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


__all__ = ["Model", "fit", "is_held_out", "judge", "op1"]
