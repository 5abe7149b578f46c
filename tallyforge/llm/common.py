"""What several operators share: the scratch folder, what a worker keeps, and text columns of Arrow batches seen as NumPy bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.scratch import drop_persisted, persist, scratch_dir

__all__ = ["drop_persisted", "persist", "scratch_dir"]

#: Bytes of text handled at once; a longer text is a piece of its own. NumPy work takes some hundred bytes of memory for each.
PIECE_BYTES = 1 << 18
RUN_BYTES = 1 << 20
#: The pattern of a word in all operators: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
#: A random odd 64-bit number for each byte value, and for other mixing.
BYTE_KEYS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict = {}


def keep(key: tuple, make: Callable):
    """make() once for each key and Python worker; a worker holds the object of one key, that of the operator at work."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def only(operator: str) -> None:
    """Let go of what other operators kept in this worker."""
    keep((operator,), lambda: None)


def free(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null. Only byte-length arithmetic: no array of words is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def is_held_out(doc_id: Column) -> Column:
    """Documents kept away from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts with at most limit bytes, or one longer text."""
    data, off = text_bytes(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def runs_of(batches: Iterator[pa.RecordBatch], text: int, limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most limit bytes in the given column of texts, or one longer text.

    After the last, Arrow's unused memory goes back to the system, as a worker stays on when it is idle.
    """
    for batch in batches:
        for lo, hi, _, _ in pieces(batch.column(text), limit):
            yield batch.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()


def text_list(column: pa.Array) -> list[str]:
    """The texts of a column; null is empty."""
    return [t or "" for t in column.to_pylist()]


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS), 4096), MIX[0])
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS[:n]


def run_hashes(buf: np.ndarray, first: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the runs that begin where first is true; bytes where use is false count for nothing."""
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    at = np.arange(len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf)))) if starts[0] == 0 else None
    if at is None:
        at = np.zeros(len(buf), np.int64)
        at[starts[0] :] = np.arange(starts[0], len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf))))
    values = BYTE_KEYS[buf] * powers(int(at.max()) + 1)[at]
    values[~use] = 0
    return starts, np.add.reduceat(values, starts)


def per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often mask is true within each row."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def row_starts(n: int, off: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[off[:-1][off[:-1] < n]] = True
    return out


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and row of every word."""
    white = WHITE[buf]
    before = np.empty(len(buf), bool)
    before[:1] = True
    before[1:] = white[:-1]
    first = ~white & (before | row_starts(len(buf), off))
    starts, hashes = run_hashes(buf, first, ~white)
    return starts, hashes, np.searchsorted(off, starts, "right") - 1
