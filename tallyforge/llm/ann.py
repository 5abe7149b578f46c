"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector is scaled to length one, padded with zeros to at least BITS components, rotated by a seeded random orthogonal
matrix and kept as the signs of its components, packed to 64-bit words, with two correction scalars: its length and c, the
inner product of the rotated vector with its own code scaled to length one. A query is rotated alike and quantised to
PLANES bits, so <code, query> is a sum of bit counts of the code's words and the query's bit planes; divided by c it
estimates the cosine, with a standard error of sqrt((1 - c^2) / (c^2 (D - 1))) and a little for the quantisation.

1. Codes meet queries, and the TAKE * k best estimates of each query are scored with the original vectors: the score that
   k + 1 of them reach is the query's bar.
2. Codes meet queries again, and every vector whose estimate and EPSILON standard errors reach the bar is scored too.
Scores are in double precision, components added from first to last.

Queries and codes are cut into blocks; each pair of blocks is met once by an equi-join on block numbers. Only codes and
queries are shuffled for that; original vectors move once, by joins on the chosen pairs. Every vector is indexed, nothing is
fitted. Equal vectors are one code with the k + 1 smallest of their ids, the only ones that can be among k neighbours, and
equal queries are one query: a vector that a third of all rows hold is no special case.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of another
dimension are no neighbours; rows that repeat a vec_id are one neighbour with its best score; rows with the query's own id
are not its neighbours; ties go to the smaller id; with fewer than k candidates all are returned; no vectors, no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import persist, table

K = 20
#: Times k estimates that are scored for the bar.
TAKE = 2
EPSILON = 3.0
#: Bits of a code, at least; a multiple of 64.
BITS = 1024
PLANES = 4
QUERY_BLOCK, VECTOR_BLOCK = 512, 1 << 15
SEED = 11


@functools.lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """The first dim columns of a random rotation of as many dimensions as the code has bits."""
    bits = max(BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def codes_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (rows, bits / 64), length and c of vectors."""
    length = np.sqrt((v * v).sum(1))
    turned = (v / length[:, None]) @ rotation(v.shape[1]).T
    c = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64), length, c


class Asked:
    """A query's bit planes."""

    def __init__(self, turned: np.ndarray):
        self.low, high = turned.min(), turned.max()
        self.step = max(high - self.low, 1e-12) / ((1 << PLANES) - 1)
        level = np.rint((turned - self.low) / self.step).astype(np.uint8)
        self.total = len(turned) * self.low + self.step * level.sum(dtype=np.int64)
        self.planes = [np.packbits(level >> p & 1, bitorder="little").view(np.uint64) for p in range(PLANES)]

    def estimates(self, words: np.ndarray, ones: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Estimated cosines with codes (words by column, their number of ones, c)."""
        met = np.zeros(words.shape[1], np.int32)
        for p, plane in enumerate(self.planes):
            of_plane = np.zeros(words.shape[1], np.int32)
            for row, word in zip(words, plane, strict=True):
                of_plane += np.bitwise_count(row & word)
            met += of_plane << p
        return (2 * (self.low * ones + self.step * met) - self.total) / (np.sqrt(64 * len(words)) * c)


def errors(c: np.ndarray, bits: int, step: float) -> np.ndarray:
    """Standard errors of the estimates."""
    return np.sqrt((1 - c * c) / (c * c * (bits - 1)) + step * step / (12 * c * c))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in the order of the components."""
    out = a[:, 0] * b[:, 0]
    for k in range(1, a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of a column of lists: the rows that have it, and their values as a matrix of doubles."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def coded(vectors: DataFrame) -> DataFrame:
    """(dim, block, key, bits, length, c) of vectors (dim, block, key, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in matrices(batch.column(3)):
                words, length, c = codes_of(v)
                part = batch.select([0, 1, 2]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([w.tobytes() for w in words], pa.binary()), pa.array(length), pa.array(c)], names=["dim", "block", "key", "bits", "length", "c"])

    return vectors.select("dim", "block", "key", "v").mapInArrow(run, "dim int, block int, key long, bits binary, length double, c double")


def packed(rows: DataFrame, name: str) -> DataFrame:
    """One row for each dim and block of rows (dim, block, key, ...): the block's number as name, each column's values as bytes."""
    columns = rows.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def block() -> pa.RecordBatch:
            cells = [b"".join(h[k] for h in held) for k in range(len(columns))]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], names=["dim", name, *columns])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(2)])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), len(batch)] if len(batch) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if at is not None and (keys[0, lo], keys[1, lo]) != at:
                    yield block()
                    held = []
                at = (int(keys[0, lo]), int(keys[1, lo]))
                held.append([as_bytes(batch.column(k + 2).slice(lo, hi - lo)) for k in range(len(columns))])
        if held:
            yield block()

    ordered = rows.repartition("dim", "block").sortWithinPartitions("dim", "block")
    return ordered.mapInArrow(run, f"dim int, {name} int, " + ", ".join(f"{c} binary" for c in columns))


def as_bytes(column: pa.Array) -> bytes:
    if pa.types.is_binary(column.type):
        return b"".join(column.to_pylist())
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
    return np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).tobytes()


def meet(queries: DataFrame, codes: DataFrame, choose: Callable) -> DataFrame:
    """(qk, vk, estimate) that choose(estimates, errors, bar) picks, for each query of each pair of blocks; estimates are of inner products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim, qk, vk = row["dim"], np.frombuffer(row["qk"], np.int64), np.frombuffer(row["vk"], np.int64)
                q, length, c = np.frombuffer(row["q"]).reshape(-1, dim), np.frombuffer(row["length"]), np.frombuffer(row["c"])
                words = np.ascontiguousarray(np.frombuffer(row["bits"], np.uint64).reshape(len(vk), -1).T)
                ones = np.bitwise_count(words).sum(0, dtype=np.int32)
                size = np.sqrt((q * q).sum(1))
                turned = (q / size[:, None]) @ rotation(dim).T
                for key, s, t, bar in zip(qk, size, turned, np.frombuffer(row["bar"]), strict=True):
                    asked = Asked(t)
                    found = asked.estimates(words, ones, c) * length * s
                    at = choose(found, errors(c, len(t), asked.step) * length * s, bar)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key)), pa.array(vk[at]), pa.array(found[at])], names=["qk", "vk", "estimate"])

    met = queries.join(codes, ["dim", "qb", "vb"]).select("dim", "qk", "q", "bar", "vk", "bits", "length", "c")
    return met.mapInArrow(run, "qk long, vk long, estimate double")


def scored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qk, vk, ids, score) of pairs (qk, vk), from the original vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (at, q), (_, v) in zip(matrices(batch.column(3)), matrices(batch.column(4)), strict=True):
                yield pa.RecordBatch.from_arrays([*batch.select([0, 1, 2]).take(pa.array(at)).columns, pa.array(exact(q, v))], names=["qk", "vk", "ids", "score"])

    both = pairs.join(queries.select("qk", F.col("v").alias("q")), "qk").join(vectors.select("vk", "ids", "v"), "vk")
    return both.select("qk", "vk", "ids", "q", "v").mapInArrow(run, "qk long, vk long, ids array<long>, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors of each query by inner product."""
    v = F.col("v")
    sound = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(sound)
    equal = pick(vectors).withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    base = equal.groupBy("v").agg(F.collect_set("id").alias("ids")).select(F.monotonically_increasing_id().alias("vk"), F.size("v").alias("dim"), "v", "ids")
    base = persist(base, "ann-vectors")
    wanted = pick(queries)
    asked = persist(wanted.groupBy("v").agg(F.count("*")).select(F.monotonically_increasing_id().alias("qk"), F.size("v").alias("dim"), "v"), "ann-queries")
    blocks = lambda n, size: F.ceil(F.count("*") / size).cast("int").alias(n)
    sizes = persist(base.groupBy("dim").agg(blocks("nv", VECTOR_BLOCK)).join(asked.groupBy("dim").agg(blocks("nq", QUERY_BLOCK)), "dim"), "ann-sizes")
    of = lambda key, n: F.pmod(F.xxhash64(key, F.lit(3)), F.col(n)).cast("int").alias("block")
    spread = lambda df, name, n: df.join(sizes, "dim").select("*", F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)).drop("nv", "nq")
    codes = coded(base.join(sizes, "dim").select("dim", of("vk", "nv"), F.col("vk").alias("key"), "v"))
    codes = persist(packed(codes.withColumnRenamed("key", "vk"), "vb"), "ann-codes")
    right = spread(codes, "qb", "nq")
    left = lambda q: spread(packed(q.join(sizes, "dim").select("dim", of("qk", "nq"), "qk", F.col("v").alias("q"), "bar"), "qb"), "vb", "nv")

    most = TAKE * k
    likely = meet(left(asked.withColumn("bar", F.lit(0.0))), right, lambda found, _, bar: np.argpartition(found, len(found) - most)[len(found) - most :] if len(found) > most else np.arange(len(found)))
    ranked = likely.withColumn("n", F.row_number().over(Window.partitionBy("qk").orderBy(F.desc("estimate"), "vk"))).where(F.col("n") <= most)
    first = persist(scored(ranked.select("qk", "vk"), asked, base), "ann-first")
    upto = F.sum(F.size("ids")).over(Window.partitionBy("qk").orderBy(F.desc("score"), "vk").rowsBetween(Window.unboundedPreceding, 0))
    bars = first.withColumn("upto", upto).groupBy("qk").agg(F.max(F.when(F.col("upto") > k, F.col("score"))).alias("bar"))
    barred = persist(asked.join(bars, "qk").select("dim", "qk", "v", F.coalesce("bar", F.lit(float("-inf"))).alias("bar")), "ann-bars")
    reached = meet(left(barred), right, lambda found, error, bar: np.flatnonzero(found + EPSILON * error >= bar))
    more = reached.select("qk", "vk").join(first.select("qk", "vk"), ["qk", "vk"], "left_anti")
    every = first.unionByName(scored(more, asked, base)).select("qk", "score", F.explode("ids").alias("vec_id")).groupBy("qk", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qk").orderBy(F.desc("score"), "vec_id")
    top = every.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    ids = wanted.distinct().join(asked.select("qk", "v"), "v").select(F.col("id").alias("query_id"), "qk")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = ids.join(top, "qk").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


#: Every pair of a query and a vector.
OP8_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
